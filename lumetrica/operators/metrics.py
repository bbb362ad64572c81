"""Error rates by group, their decomposition, and fairness over groups.

Inputs are rows with edit counts s, i, d, h (from functions.align, or stored).  Every rate is a ratio of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = "CAST('Infinity' AS DOUBLE)"


@dataclass(frozen=True)
class Policy:
    """The points on which callers differ; none is a default for all."""

    drop_blank_hypotheses: bool = False  # else a blank hypothesis counts as deletions
    rates_over: str = "reference"  # or "hits"
    min_rows: int = 1  # smaller groups are left out
    zero_best: str = "infinite"  # ratio if the best rate is 0: "infinite", or "skip" groups without errors


def rate(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def usable(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows with a reference (and, if asked, a hypothesis)."""
    kept = rows.where("s + d + h > 0")
    return kept.where("s + i + h > 0") if policy.drop_blank_hypotheses else kept


def group_rates(rows: DataFrame, keys: list[str], policy: Policy = Policy()) -> DataFrame:
    """keys, n, ref_words, s, i, d, h, wer, s_rate, i_rate, d_rate."""
    sums = usable(rows, policy).groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "sidh")).where(F.col("n") >= policy.min_rows)
    words = F.col("s") + F.col("d") + F.col("h")
    below = F.col("h") if policy.rates_over == "hits" else words
    return sums.select(
        *keys, "n", words.alias("ref_words"), *"sidh", rate(F.col("s") + F.col("i") + F.col("d"), words).alias("wer"),
        *(rate(F.col(c), below).alias(f"{c}_rate") for c in "sid"))


def decomposition(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of substitutions, insertions and deletions among all errors, in percent; groups without errors have 0."""
    errors = F.greatest(F.lit(1), F.col("s") + F.col("i") + F.col("d"))
    return rates.select(*keys, "n", "wer", *((100.0 * F.col(c) / errors).alias(f"{c}_percent") for c in "sid"))


def by_axes(rows: DataFrame, axes: list[str], keep: list[str]) -> DataFrame:
    """One row for each axis on which a row has a label: keep, axis, group; all axes in one pass."""
    pairs = ", ".join(f"'{a}', CAST({a} AS STRING)" for a in axes)
    return rows.selectExpr(*keep, f"stack({len(axes)}, {pairs}) AS (axis, `group`)").where("`group` IS NOT NULL AND trim(`group`) NOT IN ('', 'nan')")


def fairness(rates: DataFrame, keys: list[str], group: str = "group", policy: Policy = Policy()) -> DataFrame:
    """Over the groups of each key: best and worst (the first by name of equal ones), ratio, gap, relative gap in percent, spread."""
    used = rates.where("wer > 0") if policy.zero_best == "skip" else rates.where("wer IS NOT NULL")
    best, worst = F.min(F.struct("wer", group)), F.min(F.struct((-F.col("wer")).alias("w"), group))
    out = used.groupBy(*keys).agg(
        F.count("*").alias("groups"), best.alias("b"), worst.alias("w"), F.stddev_pop("wer").alias("spread")).where("groups >= 2")
    low, high = F.col("b.wer"), -F.col("w.w")
    ratio = F.when(low == 0, F.when(high == 0, F.lit(1.0)).otherwise(F.expr(INF))).otherwise(rate(high, low))
    return out.select(
        *keys, "groups", F.col(f"b.{group}").alias("best_group"), low.alias("best_wer"), F.col(f"w.{group}").alias("worst_group"), high.alias("worst_wer"),
        ratio.alias("ratio"), (high - low).alias("gap"), (100 * rate(high - low, low)).alias("gap_percent"), "spread")


def named_gap(rates: DataFrame, keys: list[str], a: str, b: str, group: str = "group") -> DataFrame:
    """Relative difference in percent of one group's rate against another's."""
    of = lambda g: F.max(F.when(F.col(group) == g, F.col("wer")))
    return rates.groupBy(*keys).agg(of(a).alias("wer_a"), of(b).alias("wer_b")).where("wer_a IS NOT NULL AND wer_b IS NOT NULL").select(
        *keys, "wer_a", "wer_b", (100 * rate(F.col("wer_a") - F.col("wer_b"), F.col("wer_b"))).alias("gap_percent"))


def paired_delta(rows: DataFrame, baseline: str, unit: str = "unit", keys: tuple[str, ...] = ("model", "variant", "group")) -> DataFrame:
    """Mean difference of a unit's rate to its baseline's (its first baseline row, by row_index), per key."""
    first = Window.partitionBy("model", unit).orderBy("row_index")
    base = rows.where(F.col("variant") == baseline).withColumn("r", F.row_number().over(first)).where("r = 1").select("model", unit, F.col("wer").alias("base_wer"))
    joined = rows.where(F.col("variant") != baseline).join(base, ["model", unit])
    return joined.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg(F.col("wer") - F.col("base_wer")).alias("mean_delta"))


def degradation(rates: DataFrame, baseline: str, group: str = "group") -> DataFrame:
    """Each group's rate against its own at the baseline, in percent; groups that both have."""
    base = rates.where(F.col("variant") == baseline).select("model", "axis", group, F.col("wer").alias("base_wer"))
    both = rates.where(F.col("variant") != baseline).join(base, ["model", "axis", group])
    return both.select("model", "variant", "axis", group, "wer", "base_wer", (100 * rate(F.col("wer") - F.col("base_wer"), F.col("base_wer"))).alias("werd"))


def amplification(rates: DataFrame, baseline: str, group: str = "group") -> DataFrame:
    """How the ratio of worst to best group grows from the baseline to each variant, and which groups degrade least and most."""
    policy = Policy(zero_best="skip")
    ratios = fairness(rates, ["model", "axis", "variant"], group, policy).select("model", "axis", "variant", "ratio")
    base = ratios.where(F.col("variant") == baseline).select("model", "axis", F.col("ratio").alias("base_ratio"))
    per = degradation(rates, baseline, group).where("werd IS NOT NULL").groupBy("model", "axis", "variant").agg(
        F.min(F.struct("werd", group)).alias("b"), F.min(F.struct((-F.col("werd")).alias("w"), group)).alias("w"))
    joined = ratios.where(F.col("variant") != baseline).join(base, ["model", "axis"]).join(per, ["model", "axis", "variant"])
    return joined.select(
        "model", "axis", "variant", "ratio", "base_ratio", rate(F.col("ratio"), F.col("base_ratio")).alias("amplification"),
        F.col(f"b.{group}").alias("least_degraded"), F.col("b.werd").alias("least_werd"), F.col(f"w.{group}").alias("most_degraded"), (-F.col("w.w")).alias("most_werd"))


def ci_overlap(cis: DataFrame, keys: list[str], group: str = "group", strict: bool = False) -> DataFrame:
    """Whether the intervals (low, high) of the worst and the best group (by point estimate) overlap."""
    out = cis.groupBy(*keys).agg(F.min(F.struct("wer", group, "low", "high")).alias("b"), F.min(F.struct((-F.col("wer")).alias("w"), group, "low", "high")).alias("w"), F.count("*").alias("groups")).where("groups >= 2")
    low, high = F.greatest("b.low", "w.low"), F.least("b.high", "w.high")
    return out.select(*keys, F.col(f"b.{group}").alias("best_group"), F.col(f"w.{group}").alias("worst_group"), (low < high if strict else low <= high).alias("overlap"))


def area_under(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoids under y over x."""
    w = Window.partitionBy(*keys).orderBy(x)
    parts = curve.withColumns({"dx": F.col(x) - F.lag(x).over(w), "m": (F.col(y) + F.lag(y).over(w)) / 2})
    return parts.groupBy(*keys).agg(F.coalesce(F.sum(F.col("dx") * F.col("m")), F.lit(0.0)).alias("area"))
