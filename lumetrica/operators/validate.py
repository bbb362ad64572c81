"""Validation gates, each a table of (check, scope, value, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdicts(rows: DataFrame, check: str, scope: Column, value: Column, passed: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), scope.cast("string").alias("scope"), value.cast("double").alias("value"), passed.alias("passed"))


def blank(column: str) -> Column:
    return F.col(column).isNull() | F.trim(F.col(column).cast("string")).isin("", "nan")


def completeness(rows: DataFrame, columns: list[str], most: float) -> DataFrame:
    """Share of blank labels per column; one pass."""
    one = rows.agg(*(F.avg(blank(c).cast("double")).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.selectExpr(f"stack({len(columns)}, {pairs}) AS (c, v)")
    return verdicts(long, "completeness", F.col("c"), F.col("v"), F.col("v") <= most)


def group_sizes(rows: DataFrame, group: str, least: int) -> DataFrame:
    found = rows.where(~blank(group)).groupBy(group).agg(F.count("*").alias("n"))
    return verdicts(found, "group_size", F.col(group), F.col("n"), F.col("n") >= least)


def leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """How many keys are in more than one split."""
    both = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("n"))
    return verdicts(both, "leakage", F.lit(key), F.col("n"), F.col("n") == 0)


def drift(rows: DataFrame, split: str, a: str, b: str, label: str, most: float) -> DataFrame:
    """Difference of a label's shares in two splits, in percentage points; labels of either."""
    counts = rows.groupBy(label).agg(F.count(F.when(F.col(split) == a, 1)).alias("a"), F.count(F.when(F.col(split) == b, 1)).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = counts.crossJoin(F.broadcast(total)).withColumn("v", 100 * F.abs(F.try_divide(F.col("a"), F.col("ta")) - F.try_divide(F.col("b"), F.col("tb"))))
    return verdicts(x, "drift", F.col(label), F.col("v"), F.col("v") <= most)


def duplicates(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows that repeat another's key."""
    x = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return verdicts(x, "duplicates", F.lit(name), F.col("n"), F.col("n") == 0)


def complete_slots(rows: DataFrame, slot: list[str], expected: int) -> DataFrame:
    """Slots that have exactly the expected number of rows; join them to keep only whole runs."""
    return rows.groupBy(*slot).agg(F.count("*").alias("n")).where(F.col("n") == expected)


def missing_and_extra(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, side): expected but not found, found but not expected."""
    lost = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(key, F.lit("missing").alias("side"))
    more = found.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").select(key, F.lit("extra").alias("side"))
    return lost.unionByName(more)


def lookup(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that the table knows, with its columns, and one row: how many it does not know."""
    marked = table.withColumn("known", F.lit(True))
    joined = rows.join(marked, key, "left")
    lost = joined.agg(F.count("*").alias("rows"), F.count(F.when(F.col("known").isNull(), 1)).alias("unmatched"))
    return joined.where("known").drop("known"), lost


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, those with the least digest of seed and key (then the least key)."""
    order = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_o", order).orderBy("_o", key).limit(n).drop("_o")


def existence(rows: DataFrame, known: DataFrame, key: str, n: int = 100) -> DataFrame:
    """Of a sample of n rows, how many the table `known` lacks; a verdict."""
    lost = sample(rows.select(key), key, n).join(known.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return verdicts(lost, "existence", F.lit(key), F.col("n"), F.col("n") == 0)


def manifest_check(rows: DataFrame, required: list[str], expected: int | None, ident: str, wrong: Column, mismatch: Column, silent: Column) -> DataFrame:
    """One row: counts of what is wrong with a manifest, and its status.  A column that is missing is counted, not an error."""
    n = F.count("*")
    missing = [c for c in required if c not in rows.columns]
    counts = rows.groupBy(ident).agg(
        n.alias("n"), F.sum(wrong.cast("long")).alias("wrong"), F.sum(mismatch.cast("long")).alias("mismatch"), F.sum(silent.cast("long")).alias("silent"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    one = counts.agg(
        total("n", "rows"), F.count(F.when((F.col("n") > 1) & (F.col(ident).cast("string") != ""), 1)).alias("duplicate_ids"),
        total("wrong", "wrong_format"), total("mismatch", "duration_mismatches"), total("silent", "silent"))
    good = F.lit(not missing)
    for c in ("duplicate_ids", "wrong_format", "duration_mismatches", "silent"):
        good = good & (F.col(c) == 0)
    if expected is not None:
        good = good & (F.col("rows") == expected)
    return one.withColumns({"missing_columns": F.lit(len(missing)).cast("long"), "status": F.when(good, "pass").otherwise("fail")})


def run_gates(deltas: DataFrame, delta: str, baseline: Column, floor: float, mean_most: float, max_most: float) -> DataFrame:
    """Gates over the changes of many runs: "mixed_sign" (some rise, some do not, not all about 0; a baseline below the floor is a
    warning only), "mean_change" and "max_change" (absolute, at most)."""
    x = F.col(delta)
    one = deltas.agg(
        F.count(F.when(x > 0, 1)).alias("up"), F.count(F.when(x <= 0, 1)).alias("other"), F.max(F.abs(x)).alias("most"), F.avg(F.abs(x)).alias("mean"), F.max(baseline).alias("base"))
    mixed = (F.col("up") > 0) & (F.col("other") > 0) & (F.col("most") >= 1e-6)
    state = F.when(F.col("base") < floor, "warn").when(mixed, "pass").otherwise("fail")
    gate = lambda name, value, status: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), status.alias("status"))
    within = lambda c, most: F.when(F.col(c) <= most, "pass").otherwise("fail")
    return one.select(F.explode(F.array(
        gate("mixed_sign", F.col("up"), state), gate("mean_change", F.col("mean"), within("mean", mean_most)), gate("max_change", F.col("most"), within("most", max_most)))).alias("g")).select("g.*")


def target_gate(one: DataFrame, value: str, name: str, target: float | None, tolerance: float, beyond: str = "fail") -> DataFrame:
    """gate, value, status of a one-row table: "pass" within the tolerance of the target, else `beyond`; without a target "skip"."""
    status = F.lit("skip") if target is None else F.when(F.abs(F.col(value) - target) <= tolerance, "pass").otherwise(beyond)
    return one.select(F.lit(name).alias("gate"), F.col(value).cast("double").alias("value"), status.alias("status"))


def completeness_gate(rows: DataFrame, keys: list[str], expected: DataFrame, empty: Column, name: str = "completeness") -> DataFrame:
    """gate, value (rows), status: "fail" unless every expected key has one row and no other is there, "warn" if some are empty."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(empty, 1)).alias("_e"))
    both = expected.select(*keys).distinct().withColumn("_x", F.lit(True)).join(found, keys, "full")
    one = both.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("value"), F.count(F.when(F.col("_x").isNull() | F.col("_n").isNull() | (F.col("_n") != 1), 1)).alias("_bad"), F.coalesce(F.sum("_e"), F.lit(0)).alias("_e"))
    return one.select(F.lit(name).alias("gate"), F.col("value").cast("double").alias("value"), F.when(F.col("_bad") > 0, "fail").when(F.col("_e") > 0, "warn").otherwise("pass").alias("status"))


def config_gates(config: DataFrame, equal: dict[str, str], below: dict[str, float]) -> DataFrame:
    """(name, actual, passed) for a table of settings (name, value as text): values that must be equal, numbers that must be below.
    A setting that is missing fails."""
    spark = config.sparkSession
    wanted = spark.createDataFrame([*((k, v, None) for k, v in equal.items()), *((k, None, float(v)) for k, v in below.items())], "name string, wanted string, most double")
    number = F.col("value").try_cast("double")
    same = F.coalesce(number == F.col("wanted").try_cast("double"), F.lower("value") == F.lower("wanted"))
    passed = F.coalesce(F.when(F.col("most").isNull(), same).otherwise(number < F.col("most")), F.lit(False))
    return wanted.join(config, "name", "left").select("name", F.col("value").alias("actual"), passed.alias("passed"))


def stage_gate(now: DataFrame, before: DataFrame, config: list[str], loss: str, top: int = 3, least: int = 2) -> DataFrame:
    """One row: how many of the `top` configurations by loss (finite ones) two stages share, and whether that is enough."""
    best = lambda df: df.where((F.col(loss) < float("inf")) & ~F.isnan(loss)).orderBy(loss, *config).limit(top).select(*config)
    shared = best(now).join(best(before), config).agg(F.count("*").alias("shared"))
    return shared.withColumn("gate", F.when(F.col("shared") >= least, "PASSED").otherwise("FAILED"))
