"""Manifests, gates, choices and tables of whole studies, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import order as O
from ..operators import validate as V
from ..operators.lineage import settled
from .base import labelled, predictions, rounded, run_matrix, table, with_pred

# The order in which users are listed where an order is canonical.
USER_ORDER = [f"u{i}" for i in (7, 3, 11, 0, 5, 2, 9, 1, 8, 4, 10, 6)]


def source_manifest(spark, sf_dir):
    """Orders whose lines are there, and how many were skipped; the expected count guards both."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    found = orders.select("o_orderkey").join(lines.withColumn("there", F.lit(1)), "o_orderkey", "left")
    one = found.agg(F.count("*").alias("source_rows"), F.count("there").alias("kept"), F.count(F.when(F.col("there").isNull(), 1)).alias("skipped"))
    return one.withColumn("complete", F.col("kept") + F.col("skipped") == F.col("source_rows"))


def speaker_lookup(spark, sf_dir):
    """Orders by the segment of their customer; customers in debt are unknown and their orders are counted."""
    known = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    matched, lost = V.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")
    per = matched.groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    return per.crossJoin(lost.select("unmatched"))  # one row


def perturbed_manifest(spark, sf_dir):
    """Documents with the path of their version where there is one; texts under a tenth of a second are skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15).alias("seconds"))
    made = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("made", F.concat(F.lit("made/"), F.col("doc_id").cast("string"), F.lit(".wav")))
    rows = docs.where("seconds >= 0.1").join(made, "doc_id", "left")
    path = F.coalesce("made", F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".wav")))
    return rows.select("doc_id", path.alias("path"))


def count_and_seconds(spark, sf_dir):
    """Rows and their seconds by source, from the first of two columns that has a number."""
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string")).otherwise("n/a").alias("a"), F.length("text").cast("string").alias("b"))
    return rounded(docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce(X.first_number(F.col("a"), F.col("b")), F.lit(0.0))).alias("seconds")))


def manifest_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    length = F.length(F.coalesce("text", F.lit("")))
    return V.manifest_check(docs, ["doc_id", "text", "lang", "duration_seconds"], None, "doc_id", F.col("lang").isNull(), F.abs(length - F.col("n_chars")) > 0.25, F.trim(F.coalesce("text", F.lit(""))) == "")


def existence_sample(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.existence(table(spark, sf_dir, "orders"), lines, "o_orderkey")


def transcription_sanity(spark, sf_dir):
    """By role: blank, chatty and overlong hypotheses; a turn's hypothesis is the next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp")).where("hyp IS NOT NULL")
    out = rows.groupBy("role").agg(
        F.count("*").alias("n"), F.count(F.when(F.trim("hyp") == "", 1)).alias("blank"), F.count(F.when(X.chatty(F.col("hyp")), 1)).alias("chatty"),
        F.count(F.when(X.long_hypothesis(F.col("ref"), F.col("hyp")), 1)).alias("long"))
    return out.withColumn("passed", (F.col("blank") == 0) & (F.col("chatty") == 0) & (F.col("long") == 0))


def filters_census(spark, sf_dir):
    """Rows that pass: durations up to a limit (unreadable ones kept), finite losses, the first rows by index."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    seconds = F.when(F.col("doc_id") % 13 != 0, F.col("n_chars") / 15)
    loss = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).when(F.col("event_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), "n")
    return one(docs.where(F.coalesce(seconds <= 60, F.lit(True))), "max_duration").unionByName(
        one(events.where((loss < float("inf")) & ~F.isnan(loss)), "finite_loss")).unionByName(one(docs.orderBy("doc_id").limit(150), "first_rows"))


def _insertion_deltas(spark, sf_dir, docs=None):
    """model, variant, source as a head: its rate of insertions less that of the model's clean run."""
    rates = M.group_rates(predictions(spark, sf_dir, docs), ["model", "variant", "source"])
    base = rates.where("variant = 'clean'").select("model", "source", F.col("i_rate").alias("base"))
    return rates.where("variant <> 'clean'").join(base, ["model", "source"]).withColumn("delta", F.col("i_rate") - F.col("base"))


def run_gates(spark, sf_dir):
    return rounded(V.run_gates(_insertion_deltas(spark, sf_dir), "delta", F.col("base"), 0.001, 0.005, 0.02))


def regression_guard(spark, sf_dir):
    """The fifty runs whose insertions change least for the better, and whether their errors stay within half a point."""
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant", "source"])
    base = rates.where("variant = 'clean'").select("model", "source", F.col("i_rate").alias("base_i"), F.col("wer").alias("base_wer"))
    x = rates.where("variant <> 'clean'").join(base, ["model", "source"])
    layer, head = F.when(F.col("variant") == "mild", 1).otherwise(2), F.length("source")
    x = x.select("model", "source", X.head_label(layer, head).alias("head"), (F.col("i_rate") - F.col("base_i")).alias("improvement"), (F.col("wer") - F.col("base_wer")).alias("wer_change"))
    top = x.orderBy(F.round("improvement", 9), "model", "source", "head").limit(50)
    return rounded(top.withColumn("regression_ok", F.col("wer_change") <= 0.005))


def config_gates(spark, sf_dir):
    pairs = [("lr_scheduler", "constant"), ("warmup_ratio", "0.0"), ("batch_size", "4"), ("grad_accum_steps", "8"), ("target_mlp", "True"), ("peak_vram_gb", "23.5")]
    config = spark.createDataFrame(pairs, "name string, value string")
    return V.config_gates(
        config, {"lr_scheduler": "constant", "warmup_ratio": "0", "batch_size": "4", "grad_accum_steps": "4", "target_mlp": "true", "effective_batch_size": "16"}, {"peak_vram_gb": 24.0})


def sweep_gates(spark, sf_dir):
    """The gates of a sweep: its baseline's insertion rate near a target, effects of both signs, a replay that stays close, every run of every
    document there once, and the baseline's error rate near that of the labelled part."""
    docs = settled(labelled(spark, sf_dir))  # words are counted once, not for each gate
    rows = predictions(spark, sf_dir, docs)
    clean = rows.where("variant = 'clean' AND n > 0")
    inserted = clean.agg((F.sum("i") / F.sum("n")).alias("v"))
    expected = table(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(run_matrix(spark).select("model", "variant")))  # nine runs of each document
    labelled_only = clean.where("quality <> ''").agg((F.sum("errors") / F.sum("n")).alias("e"))
    wer = clean.agg((F.sum("errors") / F.sum("n")).alias("w")).crossJoin(labelled_only).select((F.col("w") - F.col("e")).alias("v"))  # one row each
    return rounded(
        V.target_gate(inserted, "v", "baseline_insertions", 0.02, 0.005, "note").unionByName(V.run_gates(_insertion_deltas(spark, sf_dir, docs), "delta", F.col("base"), 0.001, 0.005, 0.02))
        .unionByName(V.completeness_gate(rows, ["model", "variant", "doc_id"], expected, F.col("n") == 0)).unionByName(V.target_gate(wer, "v", "baseline_errors", 0.0, 0.005)))


def settings_gates(spark, sf_dir):
    """Gates on the settings that the last event of each kind carries: some must be equal, others below a bound; what is missing fails."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    config = events.groupBy(F.col("event_type").alias("name")).agg(F.max_by("k", F.struct("ts", "event_id")).alias("value"))
    return V.config_gates(config, {"view": "50.0", "signup": "7", "absent": "1"}, {"click": 100.0, "error": 25.0, "purchase": 50.0})


SEVERITIES, FLOORS = (("none", 1.0), ("mild", 0.1), ("harsh", 0.01)), (-40.0, -35.0, -30.0)


def vad_scores(spark, sf_dir):
    """Severity by floor: recordings whose later half is quieter, of whose frames those below the loudest by the floor are dropped: the share
    that stays, the share of recordings that lose a frame, and the loudness of what is dropped."""
    cells = spark.createDataFrame([(a, s, f) for a, s in SEVERITIES for f in FLOORS], "severity string, scale double, floor double")
    rows = table(spark, sf_dir, "embeddings").select("embedding").crossJoin(F.broadcast(cells))  # nine cells
    square = lambda x, i: F.when(i < 32, x.cast("double") * x).otherwise(x.cast("double") * x * F.col("scale") * F.col("scale"))
    rows = rows.withColumn("e", F.transform("embedding", square))
    power = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.aggregate(F.slice("e", 8 * f + 1, 8), F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("p", power).withColumn("db", F.transform("p", lambda x: 10 * F.log10((x + 1e-12) / (F.array_max("p") + 1e-12))))
    rows = rows.withColumn("gone", F.filter("db", lambda x: x < F.col("floor")))
    out = rows.groupBy("severity", "floor").agg(
        F.count("*").alias("n"), F.avg(1 - F.size("gone") / 8).alias("kept"), F.avg((F.size("gone") > 0).cast("double")).alias("shortened"),
        F.try_divide(F.sum(F.aggregate("gone", F.lit(0.0), lambda a, x: a + x)), F.sum(F.size("gone"))).alias("dropped_db"))
    return rounded(out)


def stage_gate(spark, sf_dir):
    """The three best parts by price of two stages, and how many both have."""
    parts = table(spark, sf_dir, "part").select("p_size", "p_brand", "p_retailprice")
    best = lambda brands: parts.where(F.col("p_brand").endswith(brands)).groupBy("p_size").agg(F.min("p_retailprice").alias("loss"))
    return V.stage_gate(best("1"), best("2"), ["p_size"], "loss")


def capacity_choices(spark, sf_dir):
    """By brand: the largest feasible (size, id), and the largest size within 95 % of the best price."""
    parts = table(spark, sf_dir, "part")
    feasible = (F.col("p_retailprice") < 1500) & (F.col("p_partkey") % 5 != 0)
    a = O.largest_feasible(parts, ["p_brand"], feasible, "p_size", "p_partkey").select("p_brand", F.col("p_size").alias("seconds"), F.col("p_partkey").alias("samples"))
    b = O.largest_near_best(parts, ["p_brand"], "p_size", "p_retailprice", F.col("p_partkey") % 5 != 0).select("p_brand", F.col("p_size").alias("batch"), "best")
    return rounded(a.join(b, "p_brand"))


def selected_models(spark, sf_dir):
    """Users of which the latest download and the latest test are good, in the canonical order."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")).alias("model"), "ts", "event_id", "event_type", "value")
    download = F.when(F.col("event_id") % 2 == 0, F.when(F.col("value") > 5, "downloaded").otherwise("failed"))
    smoke = F.when(F.col("event_id") % 2 == 1, F.when(F.col("event_type") == "error", "failed").otherwise("passed"))
    rows = events.select("model", "ts", "event_id", download.alias("d"), smoke.alias("s"))
    last = lambda c: O.latest(rows.where(F.col(c).isNotNull()), ["model"], c, "ts", "event_id")
    good = last("d").where("d = 'downloaded'").join(last("s").where("s = 'passed'"), "model")
    return O.by_ordinal(good.select("model"), "model", USER_ORDER)


def throughput(spark, sf_dir):
    """By user: events and their value a second of the span they cover, and the share of the best rate."""
    span = F.greatest(F.lit(1.0), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6)
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"), span.alias("seconds"))
    per = per.select("user_id", (F.col("n") / F.col("seconds")).alias("per_second"), (F.col("value") / F.col("seconds")).alias("value_per_second"))
    best = per.agg(F.max("per_second").alias("best"))
    return rounded(per.crossJoin(F.broadcast(best)).select("user_id", "per_second", "value_per_second", (F.col("per_second") / F.col("best")).alias("of_best")), 9)


def eval_proxy(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("n > 0").select("model", "variant", "toxic", "wer")
    return rounded(O.eval_proxy(rows, ["model", "variant"], "toxic", "wer"), 5)


def samples_per_step(spark, sf_dir):
    """The largest count that log lines tell, times the accumulation of each run."""
    lines = table(spark, sf_dir, "events").select(
        "event_type", F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" | n_samples="), F.col("user_id").cast("string"), F.lit(" loss=1")).alias("line"))
    n = F.regexp_extract("line", r"n_samples=(\d+)", 1).cast("long")
    return lines.groupBy("event_type").agg((F.max(n) * 4).alias("samples_per_step"))


def grid_cells(spark, sf_dir):
    """A row per cell: its configuration, telemetry after warm-up and step times joined."""
    events = table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 6)
    config = spark.createDataFrame([(i, 160 * (i + 1), 4 << (i % 3)) for i in range(6)], "cell long, max_seconds long, workers long")
    gpu = events.where("event_id >= 100").groupBy("cell").agg(F.avg("value").alias("util"), F.max("value").alias("peak"))
    steps = events.where("event_type = 'click'").groupBy("cell").agg(F.count("*").alias("steps"), F.median("value").alias("median_step"))
    return rounded(config.join(gpu, "cell", "left").join(steps, "cell", "left"))


def sweep_table(spark, sf_dir):
    """Base and masked counts of every unit and head, with the change; heads are the runs that are not clean."""
    rows = predictions(spark, sf_dir)
    base = rows.where("variant = 'clean'").select("model", "doc_id", F.col("i").alias("base_count"))
    masked = rows.where("variant <> 'clean'").select("model", "doc_id", F.col("variant").alias("head"), F.col("i").alias("count"))
    both = masked.join(base, ["model", "doc_id"])
    return both.groupBy("model", "head").agg(
        F.count("*").alias("units"), F.sum("base_count").alias("base"), F.sum("count").alias("masked"), F.count(F.when(F.col("count") < F.col("base_count"), 1)).alias("improved"),
        F.count(F.when(F.col("count") > F.col("base_count"), 1)).alias("worse"))


def replay_difference(spark, sf_dir):
    """How far a batched replay (rates to three places) lies from the run itself."""
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant"]).withColumn("batched", F.round("i_rate", 3))
    d = F.abs(F.col("i_rate") - F.col("batched"))
    return rounded(rates.groupBy("model").agg(F.max(d).alias("most"), F.avg(d).alias("mean")).withColumn("passed", (F.col("mean") <= 0.005) & (F.col("most") <= 0.02)), 9)


def decoding_grid(spark, sf_dir):
    """Each configuration with the four rates of its runs, and which is best by insertions."""
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant"])
    best = rates.groupBy("model").agg(F.min(F.struct(F.round("i_rate", 9).alias("r"), "variant")).alias("b"))
    return rounded(rates.join(best, "model").select(
        F.concat_ws("/", "model", "variant").alias("config"), "wer", "s_rate", "i_rate", "d_rate", (F.col("variant") == F.col("b.variant")).alias("best")))


def interval_census(spark, sf_dir):
    """What a table of intervals covers: models, conditions, axes and groups."""
    long = M.by_axes(predictions(spark, sf_dir), ["lang", "source", "quality", "toxic"], ["model", "variant"])
    return long.groupBy("axis").agg(
        F.count("*").alias("rows"), F.count_distinct("model").alias("models"), F.count_distinct("variant").alias("variants"), F.count_distinct("group").alias("groups"))


def ordered_groups(spark, sf_dir):
    """Segments in a fixed order, others last, with their sizes."""
    per = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return O.by_ordinal(per, "c_mktsegment", ["MACHINERY", "AUTOMOBILE", "HOUSEHOLD"])


def shuffled_union(spark, sf_dir):
    """Two tables by name, in a fixed shuffle; the rank of each row in it."""
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"), "c_mktsegment")
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("k"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("o", F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 15), 16, 10).cast("long"))
    ranked = O.stable_rank(both.withColumn("all", F.lit(0)), ["all"], "o", "k")
    return ranked.select("id", F.col("c_mktsegment").alias("segment"), "rank")


QUERIES = {f.__name__: f for f in (
    source_manifest, speaker_lookup, perturbed_manifest, count_and_seconds, manifest_check, existence_sample, transcription_sanity, filters_census, run_gates,
    regression_guard, config_gates, sweep_gates, settings_gates, vad_scores, stage_gate, capacity_choices, selected_models, throughput, eval_proxy, samples_per_step, grid_cells, sweep_table,
    replay_difference, decoding_grid, interval_census, ordered_groups, shuffled_union)}

_SOURCE_RATES = """, r AS (SELECT model, variant, source, sum(i)::DOUBLE / sum(n) AS i_rate, sum(errors)::DOUBLE / sum(n) AS wer FROM pred WHERE n > 0 GROUP BY ALL),
x AS (SELECT a.model, a.variant, a.source, a.i_rate - b.i_rate AS delta, b.i_rate AS base, a.wer - b.wer AS change FROM r a JOIN r b
  ON a.model = b.model AND a.source = b.source AND b.variant = 'clean' WHERE a.variant <> 'clean')
"""
_RUN_RATES = """, r AS (SELECT model, variant, sum(errors)::DOUBLE / sum(n) AS wer, sum(s)::DOUBLE / sum(n) AS s_rate, sum(i)::DOUBLE / sum(n) AS i_rate,
  sum(d)::DOUBLE / sum(n) AS d_rate FROM pred WHERE n > 0 GROUP BY ALL)
"""
_CHATTY = "(?i)^Sure|^Of course|^Here(?:''s| is)|^The user(?:''s)?|transcri(?:be|ption|bed)|written format"

ORACLE_SQL = {
    "source_manifest": """SELECT count(*) AS source_rows, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS kept,
  count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS skipped, true AS complete FROM orders""",
    "speaker_lookup": """WITH j AS (SELECT c_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS rows, (SELECT count(*) FROM j WHERE c_custkey IS NULL) AS unmatched FROM j WHERE c_custkey IS NOT NULL GROUP BY 1""",
    "perturbed_manifest": """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'made/' ELSE 'source/' END || doc_id || '.wav' AS path
FROM documents WHERE n_chars / 15.0 >= 0.1""",
    "count_and_seconds": "SELECT source, count(*) AS n, round(sum(CASE WHEN doc_id % 7 <> 0 THEN n_chars ELSE length(text) END)::DOUBLE, 6) AS seconds FROM documents GROUP BY 1",
    "manifest_check": """WITH g AS (SELECT doc_id, count(*) AS n, sum((lang IS NULL)::INT) AS w, sum((abs(length(coalesce(text, '')) - n_chars) > 0.25)::INT) AS m,
  sum((trim(coalesce(text, '')) = '')::INT) AS z FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n > 1) AS duplicate_ids, coalesce(sum(w), 0)::BIGINT AS wrong_format, coalesce(sum(m), 0)::BIGINT AS duration_mismatches,
  coalesce(sum(z), 0)::BIGINT AS silent, 1::BIGINT AS missing_columns, 'fail' AS status FROM g""",
    "existence_sample": """WITH s AS (SELECT o_orderkey FROM orders ORDER BY md5('42#' || o_orderkey), o_orderkey LIMIT 100),
n AS (SELECT count(*) AS n FROM s WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT 'existence' AS "check", 'o_orderkey' AS scope, n::DOUBLE AS value, n = 0 AS passed FROM n""",
    "transcription_sanity": f"""WITH t AS (SELECT role, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations),
c AS (SELECT role, count(*) AS n, count(*) FILTER (WHERE trim(hyp) = '') AS blank, count(*) FILTER (WHERE regexp_matches(hyp, '{_CHATTY}')) AS chatty,
  count(*) FILTER (WHERE length(ref) > 0 AND length(hyp) > 3 * length(ref) AND length(hyp) > 50) AS long FROM t WHERE hyp IS NOT NULL GROUP BY 1)
SELECT *, blank = 0 AND chatty = 0 AND long = 0 AS passed FROM c""",
    "filters_census": """SELECT 'max_duration' AS "filter", count(*) AS n FROM documents WHERE doc_id % 13 = 0 OR n_chars / 15.0 <= 60
UNION ALL SELECT 'finite_loss', count(*) FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND value IS NOT NULL
UNION ALL SELECT 'first_rows', least(150, count(*)) FROM documents""",
    "run_gates": with_pred(_SOURCE_RATES + """, one AS (SELECT count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta <= 0) AS other, max(abs(delta)) AS most, avg(abs(delta)) AS mean, max(base) AS base FROM x)
SELECT 'mixed_sign' AS gate, up::DOUBLE AS value, CASE WHEN base < 0.001 THEN 'warn' WHEN up > 0 AND other > 0 AND most >= 1e-6 THEN 'pass' ELSE 'fail' END AS status FROM one
UNION ALL SELECT 'mean_change', round(mean, 6), CASE WHEN mean <= 0.005 THEN 'pass' ELSE 'fail' END FROM one
UNION ALL SELECT 'max_change', round(most, 6), CASE WHEN most <= 0.02 THEN 'pass' ELSE 'fail' END FROM one"""),
    "regression_guard": with_pred(_SOURCE_RATES + """, y AS (SELECT model, source, 'L' || CASE WHEN variant = 'mild' THEN 1 ELSE 2 END || '_h' || length(source) AS head, delta, change FROM x)
SELECT model, source, head, round(delta, 6) AS improvement, round(change, 6) AS wer_change, change <= 0.005 AS regression_ok FROM y ORDER BY round(delta, 9), model, source, head LIMIT 50"""),
    "sweep_gates": with_pred(_SOURCE_RATES + """, one AS (SELECT count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta <= 0) AS other, max(abs(delta)) AS most, avg(abs(delta)) AS mean, max(base) AS base FROM x),
b AS (SELECT sum(i)::DOUBLE / sum(n) AS ins, sum(errors)::DOUBLE / sum(n) - (sum(errors) FILTER (WHERE quality <> ''))::DOUBLE / sum(n) FILTER (WHERE quality <> '') AS wer FROM pred WHERE variant = 'clean' AND n > 0),
k AS (SELECT model, variant, doc_id, count(*) AS c, count(*) FILTER (WHERE n = 0) AS e FROM pred GROUP BY ALL), w AS (SELECT DISTINCT model, variant, d.doc_id FROM documents d, runs),
f AS (SELECT coalesce(sum(c), 0)::DOUBLE AS v, count(*) FILTER (WHERE w.doc_id IS NULL OR k.doc_id IS NULL OR c <> 1) AS bad, coalesce(sum(e), 0) AS e FROM w FULL JOIN k ON w.model = k.model AND w.variant = k.variant AND w.doc_id = k.doc_id)
SELECT 'mixed_sign' AS gate, up::DOUBLE AS value, CASE WHEN base < 0.001 THEN 'warn' WHEN up > 0 AND other > 0 AND most >= 1e-6 THEN 'pass' ELSE 'fail' END AS status FROM one
UNION ALL SELECT 'mean_change', round(mean, 6), CASE WHEN mean <= 0.005 THEN 'pass' ELSE 'fail' END FROM one
UNION ALL SELECT 'max_change', round(most, 6), CASE WHEN most <= 0.02 THEN 'pass' ELSE 'fail' END FROM one
UNION ALL SELECT 'baseline_insertions', round(ins, 6), CASE WHEN abs(ins - 0.02) <= 0.005 THEN 'pass' ELSE 'note' END FROM b
UNION ALL SELECT 'baseline_errors', round(wer, 6), CASE WHEN abs(wer) <= 0.005 THEN 'pass' ELSE 'fail' END FROM b
UNION ALL SELECT 'completeness', v, CASE WHEN bad > 0 THEN 'fail' WHEN e > 0 THEN 'warn' ELSE 'pass' END FROM f"""),
    "settings_gates": """WITH c AS (SELECT event_type AS name, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS value FROM events GROUP BY 1),
w AS (SELECT * FROM (VALUES ('view', 50.0, NULL), ('signup', 7, NULL), ('absent', 1, NULL), ('click', NULL, 100.0), ('error', NULL, 25.0), ('purchase', NULL, 50.0)) t(name, wanted, most))
SELECT w.name, c.value AS actual, coalesce(CASE WHEN most IS NULL THEN TRY_CAST(c.value AS DOUBLE) = wanted ELSE TRY_CAST(c.value AS DOUBLE) < most END, false) AS passed FROM w LEFT JOIN c ON c.name = w.name""",
    "vad_scores": """WITH cells AS (SELECT * FROM (VALUES ('none', 1.0::DOUBLE), ('mild', 0.1::DOUBLE), ('harsh', 0.01::DOUBLE)) a(severity, scale), (VALUES (-40.0::DOUBLE), (-35.0::DOUBLE), (-30.0::DOUBLE)) b(floor)),
e AS (SELECT vec_id, severity, floor, scale, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings, cells),
p AS (SELECT vec_id, severity, floor, i // 8 AS f, sum(x * x * CASE WHEN i < 32 THEN 1 ELSE scale * scale END) AS p FROM e WHERE i < 64 GROUP BY ALL),
d AS (SELECT *, 10 * log10((p + 1e-12) / (max(p) OVER (PARTITION BY vec_id, severity, floor) + 1e-12)) AS db FROM p),
r AS (SELECT vec_id, severity, floor, count(*) FILTER (WHERE db < floor) AS gone, coalesce(sum(db) FILTER (WHERE db < floor), 0) AS s FROM d GROUP BY ALL)
SELECT severity, floor, count(*) AS n, round(avg(1 - gone / 8.0::DOUBLE), 6) AS kept, round(avg((gone > 0)::INT::DOUBLE), 6) AS shortened, round(CASE WHEN sum(gone) > 0 THEN sum(s) / sum(gone) END, 6) AS dropped_db FROM r GROUP BY ALL""",
    "config_gates": """SELECT * FROM (VALUES ('lr_scheduler', 'constant', true), ('warmup_ratio', '0.0', true), ('batch_size', '4', true), ('grad_accum_steps', '8', false),
  ('target_mlp', 'True', true), ('effective_batch_size', NULL, false), ('peak_vram_gb', '23.5', true)) t(name, actual, passed)""",
    "stage_gate": """WITH a AS (SELECT p_size FROM part WHERE p_brand LIKE '%1' GROUP BY 1 ORDER BY min(p_retailprice), 1 LIMIT 3),
b AS (SELECT p_size FROM part WHERE p_brand LIKE '%2' GROUP BY 1 ORDER BY min(p_retailprice), 1 LIMIT 3)
SELECT count(*) AS shared, CASE WHEN count(*) >= 2 THEN 'PASSED' ELSE 'FAILED' END AS gate FROM a JOIN b USING (p_size)""",
    "capacity_choices": """WITH f AS (SELECT p_brand, max((p_size, p_partkey)) AS m FROM part WHERE p_retailprice < 1500 AND p_partkey % 5 <> 0 GROUP BY 1),
u AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part WHERE p_partkey % 5 <> 0),
g AS (SELECT p_brand, max(p_size) AS batch, round(max(best), 6) AS best FROM u WHERE p_retailprice >= 0.95 * best GROUP BY 1)
SELECT f.p_brand, m[1] AS seconds, m[2] AS samples, batch, best FROM f JOIN g ON f.p_brand = g.p_brand""",
    "selected_models": f"""WITH e AS (SELECT 'u' || (user_id % 12) AS model, ts, event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value > 5 THEN 'downloaded' ELSE 'failed' END END AS d,
  CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END END AS s FROM events),
l AS (SELECT model, arg_max(d, (ts, event_id)) FILTER (WHERE d IS NOT NULL) AS d, arg_max(s, (ts, event_id)) FILTER (WHERE s IS NOT NULL) AS s FROM e GROUP BY 1)
SELECT model, (list_position({USER_ORDER!r}, model) - 1)::INT AS ordinal FROM l WHERE d = 'downloaded' AND s = 'passed'""",
    "throughput": """WITH p AS (SELECT user_id, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS v, greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS s FROM events GROUP BY 1)
SELECT user_id, round(n / s, 9) AS per_second, round(v / s, 9) AS value_per_second, round(n / s / max(n / s) OVER (), 9) AS of_best FROM p""",
    "eval_proxy": with_pred(""", u AS (SELECT * FROM pred WHERE n > 0), g AS (SELECT model, variant, toxic, avg(wer) AS m FROM u WHERE trim(toxic) <> '' GROUP BY ALL HAVING count(wer) >= 3),
d AS (SELECT model, variant, count(*) AS groups, max(m) - min(m) AS gap FROM g GROUP BY ALL)
SELECT model, variant, round(avg(wer), 5) AS mean, coalesce(any_value(groups), 0) AS groups, round(CASE WHEN any_value(groups) >= 2 THEN any_value(gap) ELSE 0.0 END, 5) AS gap
FROM u LEFT JOIN d USING (model, variant) GROUP BY ALL"""),
    "samples_per_step": "SELECT event_type, max(user_id) * 4 AS samples_per_step FROM events GROUP BY 1",
    "grid_cells": """WITH c AS (SELECT i AS cell, 160 * (i + 1) AS max_seconds, CASE i % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END::BIGINT AS workers FROM (SELECT unnest(range(0, 6)) AS i)),
g AS (SELECT user_id % 6 AS cell, avg(value) AS util, max(value) AS peak FROM events WHERE event_id >= 100 GROUP BY 1),
s AS (SELECT user_id % 6 AS cell, count(*) AS steps, median(value) AS median_step FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT c.cell, max_seconds, workers, round(util, 6) AS util, round(peak, 6) AS peak, steps, round(median_step, 6) AS median_step FROM c LEFT JOIN g USING (cell) LEFT JOIN s USING (cell)""",
    "sweep_table": with_pred(""" SELECT m.model, m.variant AS head, count(*) AS units, sum(b.i)::BIGINT AS base, sum(m.i)::BIGINT AS masked, count(*) FILTER (WHERE m.i < b.i) AS improved,
  count(*) FILTER (WHERE m.i > b.i) AS worse FROM pred m JOIN pred b ON m.model = b.model AND m.doc_id = b.doc_id AND b.variant = 'clean' WHERE m.variant <> 'clean' GROUP BY ALL"""),
    "replay_difference": with_pred(_RUN_RATES + """, d AS (SELECT model, abs(i_rate - round(i_rate, 3)) AS d FROM r)
SELECT model, round(max(d), 9) AS most, round(avg(d), 9) AS mean, avg(d) <= 0.005 AND max(d) <= 0.02 AS passed FROM d GROUP BY 1"""),
    "decoding_grid": with_pred(_RUN_RATES + """, b AS (SELECT model, min((round(i_rate, 9), variant)) AS b FROM r GROUP BY 1)
SELECT r.model || '/' || variant AS config, round(wer, 6) AS wer, round(s_rate, 6) AS s_rate, round(i_rate, 6) AS i_rate, round(d_rate, 6) AS d_rate, variant = b[2] AS best FROM r JOIN b ON r.model = b.model"""),
    "interval_census": with_pred(""", l AS (SELECT model, variant, 'lang' AS axis, lang AS g FROM pred UNION ALL SELECT model, variant, 'source', source FROM pred
  UNION ALL SELECT model, variant, 'quality', quality FROM pred UNION ALL SELECT model, variant, 'toxic', toxic FROM pred)
SELECT axis, count(*) AS rows, count(DISTINCT model) AS models, count(DISTINCT variant) AS variants, count(DISTINCT g) AS groups FROM l WHERE g IS NOT NULL AND trim(g) NOT IN ('', 'nan') GROUP BY 1"""),
    "ordered_groups": """SELECT c_mktsegment, count(*) AS n, (coalesce(list_position(['MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD'], c_mktsegment), 4) - 1)::INT AS ordinal FROM customer GROUP BY 1""",
    "shuffled_union": """WITH u AS (SELECT 'c' || c_custkey AS id, c_custkey AS k, c_mktsegment AS segment FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey, NULL FROM supplier)
SELECT id, segment, row_number() OVER (ORDER BY ('0x' || substr(md5(id), 1, 15))::BIGINT, k) AS rank FROM u""",
}
