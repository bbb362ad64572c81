"""Queries that put several operators together: rewards, summaries, checks of whole runs, the analysis of one model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import order as O
from ..operators import resample as R
from ..operators import validate as V
from .base import norm_sql, predictions, rounded, table, with_pred
from .metrics import AXES
from .metrics import ORACLE_SQL as METRICS_SQL

WEIGHT, BASELINE_WER, FLOOR_FACTOR = 0.3, 0.02, 1.5


def composite_reward(spark, sf_dir):
    """Models as candidates, documents as prompts: (1 - w)(1 - WER) less w times how far the language's mean rate lies from the
    mean of all; without that penalty where a candidate's mean rate passes the floor or there are not two languages.

    By candidate: mean reward, whether the floor held; and the share of prompts whose rewards are all equal.
    """
    wer = X.utterance_wer(F.col("errors"), F.col("n"), F.expr("s + i + h"), 1.0)
    rows = predictions(spark, sf_dir).where("variant = 'mild'").select("model", "doc_id", F.trim(F.coalesce("lang", F.lit(""))).alias("g"), wer.alias("w"))
    groups = rows.where("g NOT IN ('', 'nan')").groupBy("model", "g").agg(F.avg("w").alias("gw"))
    mean = groups.groupBy("model").agg(F.avg("gw").alias("all"), F.count("*").alias("groups"))
    floor = rows.groupBy("model").agg((F.avg("w") > BASELINE_WER * FLOOR_FACTOR).alias("over_floor"))
    x = rows.join(groups, ["model", "g"], "left").join(F.broadcast(mean.join(floor, "model")), "model")  # one row per model
    fair = F.when(F.col("over_floor") | (F.col("groups") < 2), 0.0).otherwise(F.coalesce(-F.abs(F.col("gw") - F.col("all")), F.lit(0.0)))
    x = x.withColumn("reward", (1 - WEIGHT) * (1 - F.col("w")) + WEIGHT * fair)
    flat = x.groupBy("doc_id").agg(F.stddev_samp("reward").alias("s")).agg(F.avg((F.col("s") < 1e-6).cast("double")).alias("flat_prompts"))
    per = x.groupBy("model").agg(F.avg("reward").alias("reward"), F.first("over_floor").alias("over_floor"))
    return rounded(per.crossJoin(flat))  # one row


def manifest_histograms(spark, sf_dir):
    """How often each value of each label stands in the manifest, and each bucket of durations."""
    docs = table(spark, sf_dir, "documents").withColumn("bucket", X.bucket_label(F.col("n_chars") / 15, [10, 30, 60, 120]))
    long = docs.selectExpr("stack(3, 'lang', lang, 'source', source, 'duration', bucket) AS (field, value)")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def robustness_gap(spark, sf_dir):
    """Each condition's corpus rate less that of the clean one, absolute and relative."""
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant"])
    base = rates.where("variant = 'clean'").select("model", F.col("wer").alias("clean"))
    gap = F.col("wer") - F.col("clean")
    return rounded(rates.where("variant <> 'clean'").join(base, "model").select("model", "variant", gap.alias("gap"), (100 * M.rate(gap, F.col("clean"))).alias("gap_percent")))


def real_time_factor(spark, sf_dir):
    """Seconds of work a second of audio, by kind of event."""
    e = table(spark, sf_dir, "events")
    work, audio = F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), F.sum((F.col("event_id") % 10 + 1).cast("double"))
    return rounded(e.groupBy("event_type").agg(M.rate(work, audio).alias("rtf"), audio.alias("audio_seconds")))


def significance_census(spark, sf_dir):
    """By model: pairs of languages whose medians rise, are equal or fall, and those with p below 0.05 and 0.01."""
    x = R.mann_whitney(predictions(spark, sf_dir).where("variant = 'clean'"), ["model"], "lang", "wer", 50)
    d = F.round(F.col("median_b") - F.col("median_a"), 9)
    tests = {"up": d > 0, "same": d == 0, "down": d < 0, "p05": F.round("p", 9) < 0.05, "p01": F.round("p", 9) < 0.01}
    return x.groupBy("model").agg(F.count("*").alias("pairs"), *(F.count(F.when(c, 1)).alias(n) for n, c in tests.items()))


def backfilled_candidates(spark, sf_dir):
    """Rejection sampling with a floor: the best candidate of each document counts if its rate is within its language's limit (a
    wider one where there are few); languages with fewer than 40 accepted take their next best up to that number."""
    best = predictions(spark, sf_dir).where("n > 0").groupBy("doc_id").agg(F.min(F.struct("wer", "model", "variant")).alias("b"), F.first("lang").alias("lang"))
    best = best.select("doc_id", "lang", "b.wer", "b.model", "b.variant")
    sizes = best.groupBy("lang").agg(F.count("*").alias("c"))
    x = best.join(F.broadcast(sizes), "lang").withColumn("accepted", F.col("wer") <= F.when(F.col("c") < 150, 0.02).otherwise(0.012))
    ranked = O.stable_rank(x, ["lang"], "wer", "doc_id")
    out = ranked.where("accepted OR rank <= 40")
    return rounded(out.groupBy("lang").agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("filled"), F.max("wer").alias("worst")))


def normalization_failures(spark, sf_dir):
    """Texts that differ from their normalized form, by language; and of a sample of fifty those with other characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    per = docs.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("t") != X.normalize(F.col("t")), 1)).alias("not_normalized"))
    odd = V.sample(docs, "doc_id", 50).agg(F.count(F.when(F.col("t").rlike("[^a-zA-Z0-9' .,!?\\n-]"), 1)).alias("odd_in_sample"))
    return per.crossJoin(odd)  # one row


def predictions_check(spark, sf_dir):
    """Each run against the manifest: rows, documents that lack, are unknown or repeat, blank hypotheses, and the verdict."""
    manifest = table(spark, sf_dir, "documents").select("doc_id").distinct()
    made = predictions(spark, sf_dir).where("NOT (model = 'bix' AND doc_id % 50 = 7)").select("model", "variant", "doc_id", F.expr("s + i + h = 0").alias("blank"))
    more = made.where("model = 'cor' AND variant = 'mild' AND doc_id % 40 = 3").withColumn("doc_id", F.when(F.col("doc_id") % 80 == 3, F.col("doc_id")).otherwise(-F.col("doc_id")))
    per = made.unionByName(more).groupBy("model", "variant", "doc_id").agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"))
    per = per.join(manifest.withColumn("known", F.lit(True)), "doc_id", "left")
    total = manifest.agg(F.count("*").alias("expected"))
    one = per.groupBy("model", "variant").agg(
        F.sum("n").alias("rows"), F.count("known").alias("found"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        F.count(F.when(F.col("blank"), 1)).alias("blank"))
    out = one.crossJoin(F.broadcast(total)).withColumn("missing", F.col("expected") - F.col("found")).drop("expected", "found")
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0), "pass").otherwise("fail"))


SEVERITY = ["clean", "mild", "harsh"]


def condition_checks(spark, sf_dir):
    """By model: conditions that are there, rows that each has, whether rates rise with severity (five points of slack) and stay
    above the clean one less five points."""
    rates = O.by_ordinal(predictions(spark, sf_dir).where("n > 0"), "variant", SEVERITY, "level")
    per = rates.groupBy("model", "variant", "level").agg(F.count("*").alias("n"), (100 * F.avg("wer")).alias("w"))
    w = Window.partitionBy("model").orderBy("level")  # one row per condition
    x = per.withColumns({"rises": F.coalesce(F.col("w") + 5 >= F.lag("w").over(w), F.lit(True)), "above": F.col("w") >= F.first("w").over(w) - 5})
    return x.groupBy("model").agg(
        F.count("*").alias("conditions"), F.min("n").alias("fewest_rows"), F.bool_and("rises").alias("monotone"), F.bool_and("above").alias("not_below_clean"))


def condition_families(spark, sf_dir):
    """Names of conditions by family (what stands before the first underscore), with the file stem and a short id."""
    names = table(spark, sf_dir, "events").select(
        F.concat(F.element_at(F.array(*map(F.lit, ("snr", "reverb", "silence", "mask"))), (F.col("user_id") % 4 + 1).cast("int")), F.lit("_"), (F.col("event_id") % 3).cast("string"), F.lit("pct.wav")).alias("file"),
        F.col("event_id"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = names.select(F.split("file", "_")[0].alias("family"), stem.alias("stem"), F.left(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(8)).alias("short"))
    return rows.groupBy("family", "stem").agg(F.count("*").alias("n"), F.min("short").alias("first"))


def model_analysis(spark, sf_dir):
    """All of a model: overall rate, groups of every axis, ratio and gap of each axis, significant pairs; one long table."""
    rows = predictions(spark, sf_dir).where("variant = 'clean'")
    line = lambda df, section, key, value: df.select("model", F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    overall = M.group_rates(rows, ["model"])
    groups = M.group_rates(M.by_axes(rows, AXES, ["model", "variant", *"sidh"]), ["model", "variant", "axis", "group"])
    fair = M.fairness(groups, ["model", "axis"])
    tests = R.mann_whitney(rows, ["model"], "lang", "wer", 50).where(F.round("p", 5) < 0.05).groupBy("model").agg(F.count("*").alias("n"))
    out = line(overall, "overall", F.lit("wer"), F.col("wer"))
    for more in (line(groups, "group", F.concat_ws("/", "axis", "group"), F.col("wer")), line(fair, "ratio", F.col("axis"), F.col("ratio")), line(fair, "gap", F.col("axis"), F.col("gap")),
                 line(tests, "significant_pairs", F.lit("lang"), F.col("n"))):
        out = out.unionByName(more)
    return rounded(out, 6)


QUERIES = {f.__name__: f for f in (
    composite_reward, manifest_histograms, robustness_gap, real_time_factor, significance_census, backfilled_candidates, normalization_failures, predictions_check,
    condition_checks, condition_families, model_analysis)}

_MW = METRICS_SQL["mann_whitney"]

ORACLE_SQL = {
    "composite_reward": with_pred(f""", r AS (SELECT model, doc_id, trim(coalesce(lang, '')) AS g,
  CASE WHEN n = 0 THEN CASE WHEN s + i + h = 0 THEN 0.0 ELSE 1.0 END WHEN s + i + h = 0 THEN 1.0 ELSE errors / n::DOUBLE END AS w FROM pred WHERE variant = 'mild'),
gr AS (SELECT model, g, avg(w) AS gw FROM r WHERE g NOT IN ('', 'nan') GROUP BY ALL),
m AS (SELECT model, avg(gw) AS a, count(*) AS c FROM gr GROUP BY 1), fl AS (SELECT model, avg(w) > {BASELINE_WER} * {FLOOR_FACTOR} AS over_floor FROM r GROUP BY 1),
x AS (SELECT r.model, doc_id, over_floor, {1 - WEIGHT} * (1 - w) + {WEIGHT} * CASE WHEN over_floor OR c < 2 THEN 0.0 ELSE coalesce(-abs(gw - a), 0.0) END AS reward
  FROM r LEFT JOIN gr ON r.model = gr.model AND r.g = gr.g JOIN m ON r.model = m.model JOIN fl ON r.model = fl.model),
f AS (SELECT avg((s < 1e-6)::INT) AS flat FROM (SELECT stddev_samp(reward) AS s FROM x GROUP BY doc_id))
SELECT model, round(avg(reward), 6) AS reward, any_value(over_floor) AS over_floor, round(any_value(flat), 6) AS flat_prompts FROM x, f GROUP BY model"""),
    "manifest_histograms": """WITH d AS (SELECT lang, source, n_chars / 15.0 AS s FROM documents), l AS (SELECT 'lang' AS field, lang AS value FROM d UNION ALL SELECT 'source', source FROM d
UNION ALL SELECT 'duration', CASE WHEN s <= 10 THEN '0-10s' WHEN s <= 30 THEN '10-30s' WHEN s <= 60 THEN '30-60s' WHEN s <= 120 THEN '60-120s' ELSE '>120s' END FROM d)
SELECT field, value, count(*) AS n FROM l GROUP BY ALL""",
    "robustness_gap": with_pred(""", r AS (SELECT model, variant, sum(errors)::DOUBLE / sum(n) AS w FROM pred WHERE n > 0 GROUP BY ALL)
SELECT a.model, a.variant, round(a.w - b.w, 6) AS gap, round(100 * (a.w - b.w) / b.w, 6) AS gap_percent FROM r a JOIN r b ON a.model = b.model AND b.variant = 'clean' WHERE a.variant <> 'clean'"""),
    "real_time_factor": """SELECT event_type, round(sum(value::DECIMAL(18, 4))::DOUBLE / sum(event_id % 10 + 1), 6) AS rtf, round(sum(event_id % 10 + 1)::DOUBLE, 6) AS audio_seconds
FROM events GROUP BY 1""",
    "significance_census": f"""SELECT model, count(*) AS pairs, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d = 0) AS same, count(*) FILTER (WHERE d < 0) AS down,
  count(*) FILTER (WHERE p < 0.05) AS p05, count(*) FILTER (WHERE p < 0.01) AS p01 FROM (SELECT *, round(median_b - median_a, 9) AS d FROM ({_MW.replace('round(p, 5) AS p', 'round(p, 9) AS p').replace('round(median_a, 5)', 'median_a').replace('round(median_b, 5)', 'median_b')})) GROUP BY 1""",
    "backfilled_candidates": with_pred(""", b AS (SELECT doc_id, any_value(lang) AS lang, min(wer) AS wer FROM pred WHERE n > 0 GROUP BY 1),
x AS (SELECT *, wer <= CASE WHEN count(*) OVER (PARTITION BY lang) < 150 THEN 0.02 ELSE 0.012 END AS ok, row_number() OVER (PARTITION BY lang ORDER BY wer, doc_id) AS rank FROM b)
SELECT lang, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS filled, round(max(wer), 6) AS worst FROM x WHERE ok OR rank <= 40 GROUP BY 1"""),
    "normalization_failures": f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
o AS (SELECT count(*) FILTER (WHERE regexp_matches(t, '[^a-zA-Z0-9'' .,!?\n-]')) AS c FROM (SELECT * FROM d ORDER BY md5('42#' || doc_id), doc_id LIMIT 50))
SELECT lang, count(*) AS n, count(*) FILTER (WHERE t <> {norm_sql('t')}) AS not_normalized, (SELECT c FROM o) AS odd_in_sample FROM d GROUP BY 1""",
    "predictions_check": with_pred(""", made AS (SELECT model, variant, doc_id, s + i + h = 0 AS blank FROM pred WHERE NOT (model = 'bix' AND doc_id % 50 = 7)),
al AS (SELECT * FROM made UNION ALL SELECT model, variant, CASE WHEN doc_id % 80 = 3 THEN doc_id ELSE -doc_id END, blank FROM made WHERE model = 'cor' AND variant = 'mild' AND doc_id % 40 = 3),
p AS (SELECT model, variant, doc_id, count(*) AS n, bool_or(blank) AS blank, doc_id IN (SELECT doc_id FROM documents) AS known FROM al GROUP BY ALL),
o AS (SELECT model, variant, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE NOT known) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE blank) AS blank,
  (SELECT count(DISTINCT doc_id) FROM documents) - count(*) FILTER (WHERE known) AS missing FROM p GROUP BY ALL)
SELECT *, CASE WHEN missing = 0 AND unknown = 0 AND repeated = 0 THEN 'pass' ELSE 'fail' END AS status FROM o"""),
    "condition_checks": with_pred(""", p AS (SELECT model, variant, list_position(['clean', 'mild', 'harsh'], variant) AS level, count(*) AS n, 100 * avg(wer) AS w FROM pred WHERE n > 0 GROUP BY ALL),
x AS (SELECT model, n, coalesce(w + 5 >= lag(w) OVER v, true) AS rises, w >= first_value(w) OVER v - 5 AS above FROM p WINDOW v AS (PARTITION BY model ORDER BY level))
SELECT model, count(*) AS conditions, min(n) AS fewest_rows, bool_and(rises) AS monotone, bool_and(above) AS not_below_clean FROM x GROUP BY 1"""),
    "condition_families": """WITH f AS (SELECT ['snr', 'reverb', 'silence', 'mask'][user_id % 4 + 1] AS family, event_id FROM events)
SELECT family, family || '_' || (event_id % 3) || 'pct' AS stem, count(*) AS n, min(substr(md5(event_id::VARCHAR), 1, 8)) AS first FROM f GROUP BY ALL""",
    "model_analysis": f"""SELECT model, 'overall' AS section, 'wer' AS key, wer AS value FROM ({METRICS_SQL['overall']}) WHERE variant = 'clean'
UNION ALL SELECT model, 'group', axis || '/' || "group", wer FROM ({METRICS_SQL['wer_by_group']}) WHERE variant = 'clean'
UNION ALL SELECT model, 'ratio', axis, ratio FROM ({METRICS_SQL['fairness_table']}) WHERE variant = 'clean'
UNION ALL SELECT model, 'gap', axis, gap FROM ({METRICS_SQL['fairness_table']}) WHERE variant = 'clean'
UNION ALL SELECT model, 'significant_pairs', 'lang', count(*)::DOUBLE FROM ({_MW}) WHERE p < 0.05 GROUP BY 1""",
}
