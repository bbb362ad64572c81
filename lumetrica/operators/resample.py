"""Bootstrap intervals and rank tests that stay distributed whatever a group's size.

A resample gives each row a Poisson(1) weight, which any task can draw for its rows on its own: one md5 of unit and
block gives the weights of eight resamples.  Each task adds up its rows' weighted values (whole numbers, one product
of matrices per group), and Spark adds up the tasks; no group ever meets in one task, and no row is copied per draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stars

#: Poisson(1) below k, times 2**16, for k = 1..8.
CUTS = [24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535]
#: The weight of each 16 bits.
WEIGHTS = np.searchsorted(CUTS, np.arange(1 << 16), side="right").astype(np.float64)


def weights(units: list[str], resamples: int) -> np.ndarray:
    """(units, resamples): Poisson(1) weights from 16 bits each."""
    blocks = [f"#{b}".encode() for b in range(-(-resamples // 8))]
    raw = b"".join(hashlib.md5(u + b).digest() for u in (x.encode() for x in units) for b in blocks)
    return WEIGHTS[np.frombuffer(raw, ">u2").reshape(len(units), -1)[:, :resamples]]


def _partial(keys: list[str], unit: str, sums: list[str], resamples: int, most_groups: int = 256, rows_at_once: int = 1024):
    """Per group of a task's rows one row for each draw with the weighted sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def out() -> Iterator[pa.RecordBatch]:
            for key, values in held.items():
                own = [pa.array([x] * resamples, schema.field(c).type) for c, x in zip(keys, key, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(1, resamples + 1), pa.int64()), *map(pa.array, values)], names=[*keys, "_draw", *sums])
            held.clear()

        for whole in batches:
            schema = whole.schema
            for at in range(0, len(whole), rows_at_once):
                batch = whole.slice(at, rows_at_once)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
                names, place = np.unique(np.array(column(unit).to_pylist(), object), return_inverse=True)
                drawn = weights(names.tolist(), resamples)
                values = np.stack([column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in sums])
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(column(c).to_pylist() for c in keys), strict=True)):
                    groups.setdefault(key, []).append(i)
                for key, rows in groups.items():
                    new = np.rint(values[:, rows] @ drawn[place[rows]]).astype(np.int64)
                    held[key] = held[key] + new if key in held else new
                if len(held) > most_groups:
                    yield from out()
        if schema is not None:
            yield from out()

    return run


def draws(rows: DataFrame, keys: list[str], unit: str, sums: list[str], resamples: int) -> DataFrame:
    """keys, _draw, and the weighted sums of the columns (whole numbers)."""
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keys] + [T.StructField(c, T.LongType()) for c in ("_draw", *sums)]
    own = rows.select(*keys, F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("_unit"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums))
    # rows of a unit stand together, so that its weights are drawn once for all groups
    own = own.repartition("_unit").sortWithinPartitions("_unit")
    found = own.mapInArrow(_partial(keys, "_unit", sums, resamples), T.StructType(fields))
    return found.groupBy(*keys, "_draw").agg(*(F.sum(c).alias(c) for c in sums))


def bootstrap_ci(rows: DataFrame, keys: list[str], unit: str, errors: str = "errors", words: str = "ref_words", resamples: int = 1000, least: int = 10) -> DataFrame:
    """keys, n, wer, mean, low, high: the ratio of sums, and the mean and 95 % interval over resamples; null below `least` rows."""
    point = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(errors).cast("double"), F.sum(words).cast("double")).alias("wer"))
    ratio = draws(rows, keys, unit, [errors, words], resamples).withColumn("x", F.try_divide(F.col(errors).cast("double"), F.col(words).cast("double")))
    per = ratio.groupBy(*keys).agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    enough = F.col("n") >= least
    return point.join(per, keys).select(*keys, "n", "wer", *(F.when(enough, F.col(c)).alias(c) for c in ("mean", "low", "high")))


def paired_bootstrap(rows: DataFrame, keys: list[str], unit: str, a: str, b: str, words: str, resamples: int = 10_000) -> DataFrame:
    """keys, n, delta (rate of b less rate of a, on the same units), low, high, p: share of resamples in which b is not lower, and p_two_sided."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide((F.sum(b) - F.sum(a)).cast("double"), F.sum(words).cast("double")).alias("delta"))
    x = draws(rows, keys, unit, [a, b, words], resamples).withColumn("x", F.try_divide((F.col(b) - F.col(a)).cast("double"), F.col(words).cast("double")))
    up, down = F.avg((F.col("x") >= 0).cast("double")), F.avg((F.col("x") <= 0).cast("double"))
    per = x.groupBy(*keys).agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), up.alias("p"), F.least(F.lit(1.0), 2 * F.least(up, down)).alias("p_two_sided"))
    return n.join(per, keys)


def ratio_bootstrap(
    rows: DataFrame, axis: str, group: str, unit: str, wer: str = "wer", words: str = "ref_words", resamples: int = 200, seed: int = 42, least: int = 50,
) -> DataFrame:
    """Intervals of sum(edits) / sum(words), where edits are a stored rate times the words, rounded half to even.

    Groups of fewer than `least` rows, or usable rows, and blank groups are left out; a group's seed counts all groups of
    (model, variant, group), those left out too.  model, variant, group_axis, group, n, ref_words, wer, ci_low, ci_high,
    ci_width, n_resamples, seed.
    """
    keys = ["model", "variant", group]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    numbered = sizes.withColumn("seed", F.lit(seed) + F.row_number().over(Window.orderBy(*keys)) - 1)  # one row per group
    usable = rows.where(F.col(words) > 0).select(*keys, unit, F.col(words).cast("long").alias("w"), F.bround(F.coalesce(F.col(wer), F.lit(0.0)) * F.col(words)).cast("long").alias("e"))
    point = usable.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("ref_words"), F.sum("e").alias("edits"))
    x = draws(usable, keys, unit, ["e", "w"], resamples).withColumn("x", F.try_divide(F.col("e").cast("double"), F.col("w").cast("double")))
    cis = x.groupBy(*keys).agg(F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"))
    kept = numbered.where((F.col("rows") >= least) & (F.trim(group) != "")).join(point.where(F.col("n") >= least), keys).join(cis, keys)
    return kept.select(
        "model", "variant", F.lit(axis).alias("group_axis"), F.col(group).alias("group"), "n", "ref_words", (F.col("edits") / F.col("ref_words")).alias("wer"),
        "ci_low", "ci_high", (F.col("ci_high") - F.col("ci_low")).alias("ci_width"), F.lit(resamples).alias("n_resamples"), "seed")


def pairwise_test(rows: DataFrame, keys: list[str], unit: str, a: str, b: str, resamples: int = 1000, least: int = 20) -> DataFrame:
    """Mean difference of two rates of the same utterances (to four places), its interval, and a two-sided p: twice the share of
    resamples on the other side of zero.  Fewer than `least` pairs make a row with an error and no result."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *keys, unit, F.round((F.col(a) - F.col(b)) * 10_000).cast("long").alias("d"), F.lit(1).cast("long").alias("one"))
    sizes = rows.select(*keys).distinct().join(pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("d").alias("all")), keys, "left")
    x = draws(pairs, keys, unit, ["d", "one"], resamples).withColumn("x", F.try_divide(F.col("d").cast("double"), F.col("one") * 10_000.0))
    per = x.groupBy(*keys).agg(
        F.percentile("x", F.lit(0.025)).alias("ci_lower"), F.percentile("x", F.lit(0.975)).alias("ci_upper"),
        F.avg((F.col("x") <= 0).cast("double")).alias("down"), F.avg((F.col("x") >= 0).cast("double")).alias("up"))
    n = F.coalesce(F.col("n"), F.lit(0))
    enough = n >= least
    p = F.least(F.lit(1.0), 2 * F.when(F.col("all") >= 0, F.col("down")).otherwise(F.col("up")))
    only = lambda c: F.when(enough, c)
    return sizes.join(per, keys, "left").select(
        *keys, n.alias("n_paired"), only(F.col("all") / (n * 10_000.0)).alias("mean_diff"), only(F.col("ci_lower")).alias("ci_lower"), only(F.col("ci_upper")).alias("ci_upper"),
        only(p).alias("p_value"), F.when(~enough, "too few pairs").alias("error"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(rows: DataFrame, keys: list[str], group: str, value: str, least: int = 10, least_values: int = 10) -> DataFrame:
    """U and two-sided p (normal approximation, corrected for ties) of each pair of groups, a before b by name, with both
    medians and the stars of p.  Groups have `least` rows and `least_values` values.

    Rows are first counted per value and group; ranks come from sums over the distinct values of a pair.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    large = rows.groupBy(*keys, F.col(group).alias("g")).agg(F.count("*").alias("rows")).where((F.col("rows") >= least) & (F.trim("g") != ""))
    sizes = cells.groupBy(*keys, "g").agg(F.sum("c").alias("size"), F.percentile("v", F.lit(0.5), F.col("c")).alias("median")).where(F.col("size") >= least_values)
    sizes = sizes.join(large.drop("rows"), [*keys, "g"])
    side = lambda x: sizes.select(*keys, F.col("g").alias(x), F.col("size").alias(f"n_{x}"), F.col("median").alias(f"median_{x}"))
    pairs = side("a").join(side("b"), keys).where("a < b")
    both_sides = ["a", "b", "n_a", "n_b", "median_a", "median_b"]
    long = pairs.join(cells, keys).where("g = a OR g = b").groupBy(*keys, *both_sides, "v").agg(
        F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum("c").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = long.withColumn("rank", below + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*keys, *both_sides).agg(
        F.sum(F.col("ca") * F.col("rank")).alias("r"), F.sum((F.pow("c", F.lit(3)) - F.col("c")).cast("double")).alias("ties"))
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    both = F.col("n_a").cast("double") * F.col("n_b")
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    sigma = F.sqrt(both / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - both / 2) - 0.5, F.lit(0.0)) / sigma
    p = F.when(sigma > 0, normal_tail(z)).otherwise(1.0)
    return sums.select(*keys, *both_sides, u.alias("u"), p.alias("p"), stars(p).alias("stars"))
