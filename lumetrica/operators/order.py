"""Ranks and selections over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that quantiles cut values into, at most.
RANGES = 8192


def with_ranges(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """rows with `_range`, which rises with the value, and `_common`, true where a value fills whole ranges and has one by itself.

    Quantiles of all rows cut the ranges; they come as the one row of an aggregate within the query, which needs no job of its own.
    """
    quantiles = F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000)
    cut = rows.crossJoin(F.broadcast(rows.agg(quantiles.alias("_bounds")))).withColumn("_below", F.lit(0))
    for k in reversed(range(parts.bit_length())):  # how many bounds are below the value, by halving, 0 for null; plain columns, which Spark compiles
        cut = cut.withColumn("_below", F.col("_below") + F.when(F.get("_bounds", F.col("_below") + ((1 << k) - 1)) < F.col(value), 1 << k).otherwise(0))
    # bounds rise, so two of them are equal to the value if the second that is not below it is not above it either
    cut = cut.withColumn("_common", F.coalesce(F.get("_bounds", F.col("_below") + 1) <= F.col(value), F.lit(False))).drop("_bounds")
    return cut.withColumn("_range", 2 * F.col("_below") + F.col("_common").cast("int")).drop("_below")


def stable_rank(rows: DataFrame, group: list[str], value: str, ident: str, block: int = 4096, name: str = "rank") -> DataFrame:
    """rows with their rank (from 1) by value (a number, nulls first), then by the integer `ident`, within each group.

    Quantiles cut the values into ranges, and a value that fills whole ranges is one by itself, cut into blocks of ids.
    Sums over these cells say where each begins, and only the rows of a cell are sorted together, however many rows a group
    has or share a value.
    """
    parts = min(RANGES, max(8, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = with_ranges(rows, value, parts).withColumn("_block", F.when(F.col("_common"), F.floor(F.col(ident) / block)).otherwise(0)).drop("_common")
    cell = [*group, "_range", "_block"]
    counts = cut.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cell))).agg(F.count("*").alias("_n"))
    keys = [f"_k{i}" for i in range(len(cell))]
    before = Window.partitionBy(*keys[: len(group)]).orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(cell, keys, strict=True)]
    joined = cut.join(starts, same).drop(*keys)
    within = Window.partitionBy(*cell).orderBy(value, ident)
    return joined.withColumn(name, F.col("_start") + F.row_number().over(within)).drop("_range", "_block", "_start")


def pareto_frontier(points: DataFrame, x: str, y: str, cuts: int | None = None) -> DataFrame:
    """Points that no other beats in one measure without being worse in the other; both are to be small.

    Only the least y of each x can stay, so one partial aggregation leaves a row per x.  Quantiles cut these into ranges; a
    row falls if a lower range has a y that is no larger, or a smaller x of its own range.
    """
    points = points.where(f"{x} IS NOT NULL AND {y} IS NOT NULL")
    best = points.groupBy(F.col(x).alias("_x")).agg(F.min(y).alias("_y"))
    cuts = cuts or max(8, 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = best.agg(F.percentile_approx("_x", [i / cuts for i in range(1, cuts)])).first()[0] or []
    limits = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    cut = best.withColumn("_r", F.size(F.filter(limits, lambda b: b < F.col("_x"))))
    below = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    floors = cut.groupBy("_r").agg(F.min("_y").alias("_m")).select("_r", F.min("_m").over(below).alias("_floor"))
    before = Window.partitionBy("_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    kept = cut.join(F.broadcast(floors), "_r").withColumn("_before", F.least(F.min("_y").over(before), "_floor"))
    kept = kept.where(F.col("_before").isNull() | (F.col("_before") > F.col("_y"))).select("_x", "_y")
    return points.join(kept, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).drop("_x", "_y")


def occam_winner(rows: DataFrame, keys: list[str], score: str, cost: str, ident: str, band: float) -> DataFrame:
    """Per key, of the rows within `band` of the best score the cheapest; then the best score, then the smallest id."""
    best = rows.groupBy(*keys).agg(F.max(score).alias("_best"))
    near = rows.join(best, keys).where(F.col(score) >= F.col("_best") - band)
    pick = F.min(F.struct(F.col(cost).alias("c"), (-F.col(score)).alias("s"), F.col(ident).alias("i")))
    return near.groupBy(*keys).agg(pick.alias("p"), F.count("*").alias("candidates")).select(
        *keys, "candidates", F.col("p.i").alias(ident), F.col("p.c").alias(cost), (-F.col("p.s")).alias(score))


def latest(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The value of the last row per key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def by_time(rows: DataFrame, key: str, ts: str, ident: str, name: str = "pos") -> DataFrame:
    """rows with their place (from 1) by time, then by the integer `ident`, within each key, however many rows a key has."""
    clock = rows.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    return stable_rank(clock, [key], "_t", ident, name=name).drop("_t")


def running(rows: DataFrame, key: str, pos: str, value: Column, name: str, least: bool = True, inclusive: bool = True, block: int = 4096) -> DataFrame:
    """rows with the least (or largest) value so far within each key, by place; null before the first.

    Places are cut into blocks: each block is gone through by itself and takes over what the blocks before it have come to.
    """
    pick, both = (F.min, F.least) if least else (F.max, F.greatest)
    cut = rows.withColumns({"_v": value, "_b": F.floor((F.col(pos) - 1) / block)})
    totals = cut.groupBy(key, "_b").agg(pick("_v").alias("_m"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carry = totals.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), pick("_m").over(before).alias("_m"))
    joined = cut.join(carry, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    within = Window.partitionBy(key, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return joined.withColumn(name, both(pick("_v").over(within), "_m")).drop("_v", "_b", "_k", "_c", "_m")


def last_rows(rows: DataFrame, key: str, pos: str, reach: int, block: int = 4096) -> tuple[DataFrame, Column]:
    """rows with a column `_b` so that a window by (key, _b), ordered by place, sees the `reach` rows before each row; and the
    predicate that keeps each row once afterwards (those before a block stand in it as copies)."""
    own = F.floor((F.col(pos) - 1) / block)
    late = F.pmod(F.col(pos) - 1, F.lit(block)) >= block - reach
    copies = F.when(late, F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    cut = rows.withColumn("_p", F.explode(F.coalesce(copies, F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))))
    return cut.withColumns({"_b": F.col("_p.b"), "_own": F.col("_p.own")}).drop("_p"), F.col("_own")


def early_stop(rows: DataFrame, key: str, ts: str, ident: str, loss: str, threshold: float, patience: int) -> DataFrame:
    """Per key the place (from 1) at which a run would stop: the `patience`-th row in a row that is worse than the best so far by the threshold."""
    x = running(by_time(rows, key, ts, ident), key, "pos", F.col(loss), "best", inclusive=False)
    x = x.withColumn("bad", F.coalesce(F.col(loss) > F.col("best") * (1 + threshold), F.lit(False)))
    x = running(x, key, "pos", F.when(~F.col("bad"), F.col("pos")), "last_good", least=False)
    stop = F.min(F.when(F.col("pos") - F.coalesce("last_good", F.lit(0)) >= patience, F.col("pos")))
    return x.groupBy(key).agg(stop.alias("stop_at"), F.count("*").alias("steps"))


def ema_last(rows: DataFrame, key: str, ts: str, ident: str, value: str, beta: float) -> DataFrame:
    """The last value of the moving average with bias correction, as one weighted sum."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    x = by_time(rows, key, ts, ident, "k").join(sizes, key)
    part = F.col(value) * (1 - beta) * F.pow(F.lit(beta), F.col("n") - F.col("k"))
    return x.groupBy(key).agg((F.sum(part) / (1 - F.pow(F.lit(beta), F.max("n")))).alias("ema"), F.max("n").alias("n"))


def band(value: Column, edges: list[tuple[float, str]], other: str) -> Column:
    """The label of the first edge that the value reaches, edges in falling order."""
    out = None
    for edge, label in edges:
        out = F.when(value >= edge, label) if out is None else out.when(value >= edge, label)
    return out.otherwise(other)


def by_ordinal(rows: DataFrame, column: str, ordered: list[str], name: str = "ordinal") -> DataFrame:
    """rows with the place (from 0) of a column's value in a given order; values that it lacks come after all of it."""
    places = F.create_map(*(x for i, v in enumerate(ordered) for x in (F.lit(v), F.lit(i))))
    return rows.withColumn(name, F.coalesce(F.try_element_at(places, F.col(column)), F.lit(len(ordered))))


def largest_feasible(rows: DataFrame, keys: list[str], feasible: Column, *sizes: str) -> DataFrame:
    """Per key the feasible candidate with the largest sizes, the first size first."""
    return rows.where(feasible).groupBy(*keys).agg(F.max(F.struct(*sizes)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in sizes))


def largest_near_best(rows: DataFrame, keys: list[str], size: str, score: str, feasible: Column, share: float = 0.95) -> DataFrame:
    """Per key the largest size whose score is at least a share of the best, among the feasible."""
    usable = rows.where(feasible)
    best = usable.groupBy(*keys).agg(F.max(score).alias("best"))
    return usable.join(best, keys).where(F.col(score) >= share * F.col("best")).groupBy(*keys).agg(F.max(size).alias(size), F.max("best").alias("best"))


def eval_proxy(rows: DataFrame, keys: list[str], group: str, value: str, least: int = 3) -> DataFrame:
    """keys, mean, groups (labels with `least` values), gap: largest less smallest mean of these groups, 0 if there are fewer than two."""
    per = rows.where(F.trim(group) != "").groupBy(*keys, group).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where(F.col("n") >= least)
    gaps = per.groupBy(*keys).agg(F.count("*").alias("groups"), (F.max("m") - F.min("m")).alias("gap"))
    means = rows.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(1.0)).alias("mean"))
    groups = F.coalesce(F.col("groups"), F.lit(0))
    return means.join(gaps, keys, "left").select(*keys, "mean", groups.alias("groups"), F.when(groups >= 2, F.col("gap")).otherwise(0.0).alias("gap"))
