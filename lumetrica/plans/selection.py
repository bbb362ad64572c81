"""Winners, frontiers, ordered folds, ledgers and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import order as O
from .base import exact_mean, rounded, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def pareto_frontier(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("cost"), F.abs(1500 - F.col("p_retailprice")).alias("miss"))
    return rounded(O.pareto_frontier(points, "cost", "miss"))


def occam_winner(spark, sf_dir):
    return rounded(O.occam_winner(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size", "p_partkey", 20.0))


def best_checkpoint(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("m"))
    return rounded(rows.select("user_id", F.col("m.value").alias("best"), (-F.col("m.e")).alias("event_id")))


def latest_status(spark, sf_dir):
    return O.latest(_events(spark, sf_dir), ["user_id"], "event_type", "ts", "event_id")


def topk_abs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(rows.orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(50))


def closest_to_target(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min(F.struct(F.abs(F.col("s_acctbal") - 5000).alias("d"), "s_suppkey")).alias("m"))
    return rounded(rows.select("s_nationkey", F.col("m.s_suppkey").alias("s_suppkey"), F.col("m.d").alias("distance")))


def verdict_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(O.band(F.col("s_acctbal"), [(9000, "great"), (5000, "good"), (0, "fair")], "poor").alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def running_best(spark, sf_dir):
    """The least value so far at every event of a user, and how far it fell."""
    x = O.by_time(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id")
    x = O.running(x, "user_id", "pos", F.col("value"), "best")
    before = O.running(x, "user_id", "pos", F.col("value"), "before", inclusive=False)
    return rounded(before.select("user_id", "event_id", "best", (F.col("best") - F.col("before")).alias("delta")))


def rolling_penalty(spark, sf_dir):
    x, own = O.last_rows(O.by_time(_events(spark, sf_dir), "user_id", "ts", "event_id"), "user_id", "pos", 9)
    w = Window.partitionBy("user_id", "_b").orderBy("pos").rowsBetween(-9, 0)
    x = x.withColumn("rolling", F.avg("value").over(w)).where(own)
    return rounded(x.groupBy("user_id").agg(F.max(F.abs(F.col("value") - F.col("rolling"))).alias("largest"), F.count("*").alias("n")), 10)


def leak_detector(spark, sf_dir):
    """Growth over five rows, or since a user's first."""
    x = O.by_time(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "pos", "value")
    first = x.where("pos = 1").select("user_id", F.col("value").alias("first"))
    x, own = O.last_rows(x, "user_id", "pos", 5)
    x = x.withColumn("before", F.lag("value", 5).over(Window.partitionBy("user_id", "_b").orderBy("pos"))).where(own).join(first, "user_id")
    x = x.withColumn("grown", F.col("value") - F.when(F.col("pos") > 5, F.col("before")).otherwise(F.col("first")))
    return rounded(x.groupBy("user_id").agg(F.max("grown").alias("largest"), F.count(F.when(F.col("grown") > 50, 1)).alias("alarms")))


def early_stop(spark, sf_dir):
    return O.early_stop(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", 0.1, 3).select("user_id", F.col("stop_at").cast("long"), "steps")


def ema(spark, sf_dir):
    return rounded(O.ema_last(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", 0.9), 10)


def _placed(spark, sf_dir):
    """Events with r, their place among a user's, and n, how many the user has."""
    sizes = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return O.by_time(_events(spark, sf_dir), "user_id", "ts", "event_id", "r").join(sizes, "user_id")


def loss_trend(spark, sf_dir):
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    quarter = lambda of: exact_mean(F.when(of, F.col("value")))
    x = _placed(spark, sf_dir).groupBy("user_id").agg(quarter(F.col("r") <= q).alias("first_quarter"), quarter(F.col("r") > F.col("n") - q).alias("last_quarter"))
    return rounded(x.withColumn("falling", F.col("last_quarter") < F.col("first_quarter")), 10)


def monotone_levels(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("hour")
    x = _events(spark, sf_dir).groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("m"))
    x = x.withColumn("ok", F.coalesce(F.col("m") + 5 >= F.lag("m").over(w), F.lit(True)))
    return x.groupBy("event_type").agg(F.bool_and("ok").alias("monotone"), F.count("*").alias("levels"))


def gpu_steady_stats(spark, sf_dir):
    ends = _events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    x = _events(spark, sf_dir).join(ends, "user_id").where((F.col("ts") >= F.col("t0") + F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= F.col("t1") - F.expr("INTERVAL 3 MINUTE")))
    sizes = x.groupBy("user_id").agg(F.count("*").alias("n"))
    x = O.stable_rank(x, ["user_id"], "value", "event_id", name="r").join(sizes, "user_id")
    g = x.groupBy("user_id").agg(
        F.max("n").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 10) + 1, F.col("value"))).alias("p10"),
        F.max("value").alias("peak"), F.avg((F.col("value") >= 50).cast("double")).alias("active"))
    return rounded(g.select("user_id", "n", *(F.when(F.col("n") >= 20, F.col(c)).alias(c) for c in ("mean", "median", "p10", "peak", "active"))), 10)


def warm_up_skip(spark, sf_dir):
    return rounded(_placed(spark, sf_dir).where("n <= 10 OR r > 5").groupBy("user_id").agg(F.count("*").alias("kept"), F.avg("value").alias("mean")), 10)


def status_counts(spark, sf_dir):
    x = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min(F.struct("value", "event_id")).alias("m"))
    total = F.sum("n").over(Window.partitionBy())
    return rounded(x.select("event_type", "n", (F.col("n") / total).alias("share"), F.col("m.value").alias("best"), F.col("m.event_id").alias("best_event")))


def parse_log_lines(spark, sf_dir):
    lines = _events(spark, sf_dir).select(F.concat(F.lit("step="), F.col("event_id").cast("string"), F.lit(" ["), "event_type", F.lit("] k="), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.lit(" 2.50s/it")).otherwise(F.lit(" 4.00it/s"))).alias("line"))
    per, rate = F.regexp_extract("line", r"([0-9.]+)s/it", 1), F.regexp_extract("line", r"([0-9.]+)it/s", 1)
    seconds = F.when(per != "", F.nullif(per, F.lit("")).cast("double")).otherwise(1 / F.nullif(rate, F.lit("")).cast("double"))
    x = lines.select(F.regexp_extract("line", r"\[(\w+)\]", 1).alias("kind"), F.regexp_extract("line", r"k=(\d+)", 1).try_cast("long").alias("k"), seconds.alias("s"))
    return rounded(x.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.avg("s").alias("mean_step")))


def advantage(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "value")
    per = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-8)).alias("s"))
    x = e.join(per, "user_id").select("user_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("advantage"))
    return rounded(x.groupBy("user_id").agg(F.max("advantage").alias("top"), F.min("advantage").alias("bottom"), F.count("*").alias("n")), 10)


def reward(spark, sf_dir):
    x = _events(spark, sf_dir).select("user_id", "event_type", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("wer"))
    groups = x.groupBy("event_type").agg(F.avg("wer").alias("g"), F.count("*").alias("c")).where("c >= 3")
    mean = groups.agg(F.avg("g").alias("m"))
    x = x.join(groups, "event_type").crossJoin(F.broadcast(mean)).withColumn("reward", (1 - F.col("wer")) - 0.5 * F.abs(F.col("g") - F.col("m")))
    y = x.groupBy("user_id").agg(F.avg("reward").alias("reward"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("spread"))
    return rounded(y.select("user_id", "reward", (F.col("spread") < 1e-6).alias("flat")), 10)


def rank_comparison(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    a = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    b = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    x = x.withColumns({"a": a, "b": b}).where("a <= 3")
    return x.select("p_brand", "p_partkey", F.col("a").alias("sweep_rank"), F.col("b").alias("validation_rank"))


def spread_gate(spark, sf_dir):
    x = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("r <= 3")
    g = x.groupBy("p_type").agg(((F.max("p_retailprice") - F.min("p_retailprice")) / F.avg("p_retailprice")).alias("spread"))
    return rounded(g.withColumn("passed", F.col("spread") < 0.5))


QUERIES = {f.__name__: f for f in (
    pareto_frontier, occam_winner, best_checkpoint, latest_status, topk_abs, closest_to_target, verdict_bands, running_best, rolling_penalty, leak_detector, early_stop, ema,
    loss_trend, monotone_levels, gpu_steady_stats, warm_up_skip, status_counts, parse_log_lines, advantage, reward, rank_comparison, spread_gate)}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLE_SQL = {
    "pareto_frontier": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS cost, abs(1500 - p_retailprice) AS miss FROM part)
SELECT p_partkey, round(cost, 6) AS cost, round(miss, 6) AS miss FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.cost <= p.cost AND o.miss <= p.miss AND (o.cost < p.cost OR o.miss < p.miss))""",
    "occam_winner": """WITH b AS (SELECT p_brand, max(p_retailprice) AS best FROM part GROUP BY 1), n AS (SELECT p.* FROM part p JOIN b USING (p_brand) WHERE p_retailprice >= best - 20.0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS candidates FROM n)
SELECT p_brand, candidates, p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM r WHERE r = 1""",
    "best_checkpoint": "SELECT user_id, round(value, 6) AS best, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1",
    "latest_status": "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "topk_abs": "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 50",
    "closest_to_target": "SELECT s_nationkey, s_suppkey, round(abs(s_acctbal - 5000), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 5000), s_suppkey) AS r FROM supplier) WHERE r = 1",
    "verdict_bands": "SELECT CASE WHEN s_acctbal >= 9000 THEN 'great' WHEN s_acctbal >= 5000 THEN 'good' WHEN s_acctbal >= 0 THEN 'fair' ELSE 'poor' END AS verdict, count(*) AS n FROM supplier GROUP BY ALL",
    "running_best": f"WITH b AS (SELECT user_id, event_id, ts, min(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS best FROM events) SELECT user_id, event_id, round(best, 6) AS best, round(best - lag(best) OVER ({_W}), 6) AS delta FROM b",
    "rolling_penalty": f"WITH b AS (SELECT user_id, value, avg(value) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling FROM events) SELECT user_id, round(max(abs(value - rolling)), 10) AS largest, count(*) AS n FROM b GROUP BY 1",
    "leak_detector": f"WITH b AS (SELECT user_id, value - coalesce(lag(value, 5) OVER ({_W}), first(value) OVER ({_W})) AS g FROM events) SELECT user_id, round(max(g), 6) AS largest, count(*) FILTER (WHERE g > 50) AS alarms FROM b GROUP BY 1",
    "early_stop": f"""WITH a AS (SELECT user_id, value, ts, event_id, row_number() OVER ({_W}) AS pos, min(value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
b AS (SELECT *, coalesce(value > best * (1 + 0.1), false) AS bad FROM a), c AS (SELECT *, coalesce(max(pos) FILTER (WHERE NOT bad) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0) AS good FROM b)
SELECT user_id, min(pos) FILTER (WHERE pos - good >= 3) AS stop_at, count(*) AS steps FROM c GROUP BY 1""",
    "ema": f"WITH a AS (SELECT user_id, value, row_number() OVER ({_W}) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(value * 0.1 * pow(0.9, n - k)) / (1 - pow(0.9, max(n))), 10) AS ema, max(n) AS n FROM a GROUP BY 1",
    "loss_trend": f"""WITH a AS (SELECT user_id, value, row_number() OVER ({_W}) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT user_id, avg(value) FILTER (WHERE r <= greatest(1, n // 4)) AS f, avg(value) FILTER (WHERE r > n - greatest(1, n // 4)) AS l FROM a GROUP BY 1)
SELECT user_id, round(f, 10) AS first_quarter, round(l, 10) AS last_quarter, l < f AS falling FROM b""",
    "monotone_levels": "WITH a AS (SELECT event_type, hour(ts) AS h, avg(value) AS m FROM events GROUP BY ALL), b AS (SELECT event_type, coalesce(m + 5 >= lag(m) OVER (PARTITION BY event_type ORDER BY h), true) AS ok FROM a) SELECT event_type, bool_and(ok) AS monotone, count(*) AS levels FROM b GROUP BY 1",
    "gpu_steady_stats": """WITH a AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0, max(ts) OVER (PARTITION BY user_id) AS t1 FROM events), b AS (SELECT * FROM a WHERE ts >= t0 + INTERVAL 1 HOUR AND ts <= t1 - INTERVAL 3 MINUTE),
c AS (SELECT user_id, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, list_sort(list(value)) AS l, max(value) AS peak, avg((value >= 50)::INT) AS active FROM b GROUP BY 1)
SELECT user_id, n, CASE WHEN n >= 20 THEN round(mean, 10) END AS mean, CASE WHEN n >= 20 THEN round(median, 10) END AS median, CASE WHEN n >= 20 THEN round(l[(n // 10 + 1)::INT], 10) END AS p10, CASE WHEN n >= 20 THEN round(peak, 10) END AS peak, CASE WHEN n >= 20 THEN round(active, 10) END AS active FROM c""",
    "warm_up_skip": f"WITH a AS (SELECT user_id, value, row_number() OVER ({_W}) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, count(*) AS kept, round(avg(value), 10) AS mean FROM a WHERE n <= 10 OR r > 5 GROUP BY 1",
    "status_counts": "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share, round(min(value), 6) AS best, arg_min(event_id, (value, event_id)) AS best_event FROM events GROUP BY 1",
    "parse_log_lines": "SELECT event_type AS kind, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k, round(avg(CASE WHEN event_id % 2 = 0 THEN 2.5 ELSE 0.25 END), 6) AS mean_step FROM events GROUP BY 1",
    "advantage": "WITH a AS (SELECT user_id, (value - avg(value) OVER w) / greatest(coalesce(stddev_samp(value) OVER w, 0), 1e-8) AS a FROM events WINDOW w AS (PARTITION BY user_id)) SELECT user_id, round(max(a), 10) AS top, round(min(a), 10) AS bottom, count(*) AS n FROM a GROUP BY 1",
    "reward": """WITH x AS (SELECT user_id, event_type, least(1.0, value / 100) AS wer FROM events), g AS (SELECT event_type, avg(wer) AS g FROM x GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT user_id, (1 - wer) - 0.5 * abs(g - (SELECT avg(g) FROM g)) AS r FROM x JOIN g USING (event_type)) SELECT user_id, round(avg(r), 10) AS reward, coalesce(stddev_samp(r), 0) < 1e-6 AS flat FROM r GROUP BY 1""",
    "rank_comparison": "SELECT p_brand, p_partkey, a AS sweep_rank, b AS validation_rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS b FROM part) WHERE a <= 3",
    "spread_gate": "WITH a AS (SELECT p_type, p_retailprice AS x, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT p_type, round((max(x) - min(x)) / avg(x), 6) AS spread, (max(x) - min(x)) / avg(x) < 0.5 AS passed FROM a WHERE r <= 3 GROUP BY 1",
}
