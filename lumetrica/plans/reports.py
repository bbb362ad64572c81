"""Summaries, memberships, curves and figure data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import planning as P
from .base import BASELINE, labelled, norm_sql, predictions, rounded, table, with_pred, words_sql


def manifest_summary(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") / 15).alias("s"))
    return rounded(x.groupBy("lang").agg(F.count("*").alias("n"), F.min("s").alias("shortest"), F.max("s").alias("longest"), (F.sum("s") / 3600).alias("hours")), 4)


def experiment_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("kept"), F.count(F.when(F.col("event_type") == "error", 1)).alias("crashed"),
        (F.count(F.when(F.col("event_type") == "purchase", 1)) / F.count("*")).alias("keep_rate"), F.min_by("event_id", F.struct("value", "event_id")).alias("best_event"), F.min("value").alias("best")))


def delta_vs_prev_kept(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kept = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("delta", F.col("value") - F.lag("value").over(w))
    return rounded(kept.select("user_id", "event_id", "value", "delta"))


def bits_per_byte(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("b"), (F.col("doc_id") % 13).alias("nats"), (F.col("doc_id") % 5 != 0).alias("counted"))
    return rounded(x.groupBy("lang").agg((F.sum(F.when(F.col("counted"), F.col("nats"))) / (F.log(F.lit(2.0)) * F.sum("b"))).alias("bpb")), 9)


def pruning_stats(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") < 15, 25).when(F.col("p_size") < 30, 50).when(F.col("p_size") < 40, 75).alias("pruned_at"))
    return rounded(x.groupBy("p_brand").agg(F.count("*").alias("trials"), *(F.count(F.when(F.col("pruned_at") == r, 1)).alias(f"at_{r}") for r in (25, 50, 75)),
                                             F.sum(F.coalesce(F.col("pruned_at") / 100, F.lit(1.0))).alias("effective_trials")))


def rung_survivors(spark, sf_dir):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    x = table(spark, sf_dir, "part").withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("p_type"))})
    return x.where(F.col("r") <= F.ceil(F.col("n") / 3)).groupBy("p_type").agg(F.count("*").alias("survivors"), F.min("r").alias("first"), F.max("r").cast("long").alias("last")).select("p_type", "survivors", F.col("last"))


def rank_distribution(spark, sf_dir):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return top.groupBy("p_type", "p_size").agg(F.count("*").alias("n"), F.bool_or(F.col("r") == 1).alias("has_best"))


def delta_census(spark, sf_dir):
    x = predictions(spark, sf_dir).where("wer IS NOT NULL")
    wide = x.groupBy("model", "doc_id").pivot("variant", ["clean", "harsh"]).agg(F.max("wer"))
    d = F.col("harsh") - F.col("clean")
    return wide.groupBy("model").agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("worse", d > 0), ("same", d == 0), ("better", d < 0))))


def error_rates_extended(spark, sf_dir):
    """Match error rate, word information lost and preserved, sentence error rate."""
    x = predictions(spark, sf_dir).where("n > 0").groupBy("model", "variant").agg(*(F.sum(c).alias(c) for c in "sidh"), F.avg((F.col("errors") > 0).cast("double")).alias("ser"))
    h, s, d, i = (F.col(c).cast("double") for c in "hsdi")
    wip = (h / (h + s + d)) * (h / (h + s + i))
    return rounded(x.select("model", "variant", "ser", ((s + d + i) / (h + s + d + i)).alias("mer"), wip.alias("wip"), (1 - wip).alias("wil")))


def calibration_error(spark, sf_dir):
    """Expected calibration error and Brier score of a confidence against whether a row has no errors; ten bins."""
    x = predictions(spark, sf_dir).where("n > 0").select("model", (1 - F.least(F.lit(1.0), F.col("wer"))).alias("p"), (F.col("errors") == 0).cast("double").alias("y"))
    x = x.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)))
    bins = x.groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("b"))
    return rounded(bins.groupBy("model").agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier")))


def family_means(spark, sf_dir):
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant", "lang"])
    family = F.when(F.col("variant") == BASELINE, "none").otherwise("degraded")
    return rounded(rates.groupBy("model", family.alias("family")).agg(F.avg("wer").alias("mean_wer"), F.max("wer").alias("worst_wer")))


def ratio_heatmap(spark, sf_dir):
    rates = M.group_rates(M.by_axes(predictions(spark, sf_dir), ["lang", "source"], ["model", "variant", *"sidh"]), ["model", "variant", "axis", "group"])
    fair = M.fairness(rates, ["model", "variant", "axis"], policy=M.Policy(zero_best="skip"))
    return rounded(fair.groupBy("model", "axis").pivot("variant", ["clean", "mild", "harsh"]).agg(F.max("ratio")))


def columns_by_mean(spark, sf_dir):
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant", "source"])
    means = rates.groupBy("source").agg(F.avg("wer").alias("mean_wer"))
    return rounded(means.withColumn("place", F.row_number().over(Window.orderBy(F.round("mean_wer", 9), "source"))))  # a row per column of a figure


def plan_mapping(spark, sf_dir):
    """Batches as arrays, mapped back to rows with their place; ids that are done already drop out and places close up."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"))
    batches = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("rows"))
    done = lines.where("s > 45").select("l_orderkey", "l_linenumber")
    flat = batches.select("l_orderkey", F.posexplode("rows").alias("place", "l_linenumber")).join(done, ["l_orderkey", "l_linenumber"], "left_anti")
    w = Window.partitionBy("l_orderkey").orderBy("place")
    return flat.select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("place"))


def frozen_ids(spark, sf_dir):
    """Rows of a frozen list of ids in the list's order; ids that are not there are reported, not dropped."""
    ids = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 7919 % 10007).alias("ordinal")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ids.join(docs, "doc_id", "left").select("doc_id", "ordinal", "lang", F.col("lang").isNull().alias("missing"))


def existing_files(spark, sf_dir):
    """Existence as a join with a listing: pages stand for files, documents for rows that ask for one."""
    listing = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(listing.withColumn("there", F.lit(True)), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count("there").alias("existing"))


def mega_batches(spark, sf_dir):
    """The batches of shuffled mega-batches, by padded seconds: 160, at most 16 rows, at least 4."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("seconds"))
    return P.mega_batches(rows, "row_id", "seconds", 160, 16)


def best_candidates(spark, sf_dir):
    """Best candidate of each unit over a threshold that is relaxed for small groups (rejection sampling)."""
    x = predictions(spark, sf_dir).where("n > 0").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("wer", "model", "variant"))).where("r = 1")
    sizes = x.groupBy("lang").agg(F.count("*").alias("c"))
    limit = F.when(F.col("c") < 150, 0.2).otherwise(0.1)
    return rounded(x.join(F.broadcast(sizes), "lang").where(F.col("wer") <= limit).groupBy("lang").agg(F.count("*").alias("accepted"), F.avg("wer").alias("mean_wer")))


def document_lengths(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.min("n").alias("shortest"))


def status_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return rounded(e.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "peak"))


def learning_rates(spark, sf_dir):
    from ..functions.text import adapter_megabytes, learning_rate

    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("step"), "p_size")
    return x.select("p_partkey", F.round(learning_rate(F.col("step"), 0.1, 100, 2000), 9).alias("linear"), F.round(learning_rate(F.col("step"), 0.1, 100, 2000, "cosine"), 9).alias("cosine"),
                    F.round(adapter_megabytes(F.col("p_size"), F.lit(1024), F.lit(24)), 6).alias("adapter_mb"))


QUERIES = {f.__name__: f for f in (
    manifest_summary, experiment_outcomes, delta_vs_prev_kept, bits_per_byte, pruning_stats, rung_survivors, rank_distribution, delta_census, error_rates_extended, calibration_error,
    family_means, ratio_heatmap, columns_by_mean, plan_mapping, frozen_ids, existing_files, mega_batches, best_candidates, document_lengths, status_by_hour, learning_rates)}

_LANG_RATES = ", r AS (SELECT model, variant, {0} AS g, sum(errors) / sum(n)::DOUBLE AS wer FROM pred WHERE n > 0 GROUP BY ALL)"
_LS = f"CAST({words_sql('t')} AS BIGINT)"
ORACLE_SQL = {
    "manifest_summary": "SELECT lang, count(*) AS n, round(min(n_chars / 15.0::DOUBLE), 4) AS shortest, round(max(n_chars / 15.0::DOUBLE), 4) AS longest, round(sum(n_chars / 15.0::DOUBLE) / 3600, 4) AS hours FROM documents GROUP BY lang",
    "experiment_outcomes": "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS kept, count(*) FILTER (WHERE event_type = 'error') AS crashed, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS keep_rate, arg_min(event_id, (value, event_id)) AS best_event, round(min(value), 6) AS best FROM events GROUP BY 1",
    "delta_vs_prev_kept": "SELECT user_id, event_id, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events WHERE event_type = 'purchase'",
    "bits_per_byte": "SELECT lang, round(sum(doc_id % 13) FILTER (WHERE doc_id % 5 <> 0) / (ln(2.0::DOUBLE) * sum(strlen(text))), 9) AS bpb FROM documents GROUP BY lang",
    "pruning_stats": "WITH a AS (SELECT p_brand, CASE WHEN p_size < 15 THEN 25 WHEN p_size < 30 THEN 50 WHEN p_size < 40 THEN 75 END AS r FROM part) SELECT p_brand, count(*) AS trials, count(*) FILTER (WHERE r = 25) AS at_25, count(*) FILTER (WHERE r = 50) AS at_50, count(*) FILTER (WHERE r = 75) AS at_75, round(sum(coalesce(r / 100.0::DOUBLE, 1)), 6) AS effective_trials FROM a GROUP BY 1",
    "rung_survivors": "SELECT p_type, count(*) AS survivors, max(r) AS last FROM (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE r <= ceil(n / 3.0::DOUBLE) GROUP BY 1",
    "rank_distribution": "SELECT p_type, p_size, count(*) AS n, bool_or(r = 1) AS has_best FROM (SELECT p_type, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 10 GROUP BY ALL",
    "delta_census": with_pred(", w AS (SELECT model, doc_id, max(wer) FILTER (WHERE variant = 'harsh') - max(wer) FILTER (WHERE variant = 'clean') AS d FROM pred WHERE wer IS NOT NULL GROUP BY ALL) SELECT model, count(*) FILTER (WHERE d > 0) AS worse, count(*) FILTER (WHERE d = 0) AS same, count(*) FILTER (WHERE d < 0) AS better FROM w GROUP BY 1"),
    "error_rates_extended": with_pred(", a AS (SELECT model, variant, sum(s)::DOUBLE AS s, sum(i)::DOUBLE AS i, sum(d)::DOUBLE AS d, sum(h)::DOUBLE AS h, avg((errors > 0)::INT) AS ser FROM pred WHERE n > 0 GROUP BY ALL) SELECT model, variant, round(ser, 6) AS ser, round((s + d + i) / (h + s + d + i), 6) AS mer, round((h / (h + s + d)) * (h / (h + s + i)), 6) AS wip, round(1 - (h / (h + s + d)) * (h / (h + s + i)), 6) AS wil FROM a"),
    "calibration_error": with_pred(", x AS (SELECT model, 1 - least(1.0, wer) AS p, (errors = 0)::INT::DOUBLE AS y FROM pred WHERE n > 0), b AS (SELECT model, least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay, sum((p - y) * (p - y)) AS b FROM x GROUP BY ALL) SELECT model, round(sum(n * abs(ap - ay)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM b GROUP BY 1"),
    "family_means": with_pred(_LANG_RATES.format("lang") + " SELECT model, CASE WHEN variant = 'clean' THEN 'none' ELSE 'degraded' END AS family, round(avg(wer), 6) AS mean_wer, round(max(wer), 6) AS worst_wer FROM r GROUP BY ALL"),
    "ratio_heatmap": with_pred(""", l AS (SELECT model, variant, 'lang' AS axis, lang AS g, errors, n FROM pred UNION ALL SELECT model, variant, 'source', source, errors, n FROM pred),
r AS (SELECT model, variant, axis, g, sum(errors) / sum(n)::DOUBLE AS wer FROM l WHERE n > 0 AND g IS NOT NULL GROUP BY ALL), f AS (SELECT model, variant, axis, max(wer) / min(wer) AS ratio FROM r WHERE wer > 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT model, axis, """ + ", ".join(f"round(max(ratio) FILTER (WHERE variant = '{v}'), 6) AS {v}" for v in ("clean", "mild", "harsh")) + " FROM f GROUP BY ALL"),
    "columns_by_mean": with_pred(_LANG_RATES.format("source") + ", m AS (SELECT g AS source, avg(wer) AS w FROM r GROUP BY 1) SELECT source, round(w, 6) AS mean_wer, row_number() OVER (ORDER BY round(w, 9), source) AS place FROM m"),
    "plan_mapping": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 45)",
    "frozen_ids": "SELECT DISTINCT l.doc_id, l.doc_id * 7919 % 10007 AS ordinal, d.lang, d.lang IS NULL AS missing FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "existing_files": "SELECT source, count(*) AS n, count(p.page_id) AS existing FROM documents d LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON d.doc_id = p.page_id GROUP BY 1",
    "best_candidates": with_pred(", x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY wer, model, variant) AS r FROM pred WHERE n > 0), b AS (SELECT lang, wer, count(*) OVER (PARTITION BY lang) AS c FROM x WHERE r = 1) SELECT lang, count(*) AS accepted, round(avg(wer), 6) AS mean_wer FROM b WHERE wer <= CASE WHEN c < 150 THEN 0.2 ELSE 0.1 END GROUP BY 1"),
    "document_lengths": f"WITH t AS (SELECT lang, {norm_sql('text')} AS t FROM documents) SELECT lang, count(*) AS n, sum({_LS})::BIGINT AS words, max({_LS}) AS longest, min({_LS}) AS shortest FROM t GROUP BY 1",
    "status_by_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(max(value), 6) AS peak FROM events GROUP BY ALL",
    "learning_rates": """WITH a AS (SELECT p_partkey, p_size, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p_partkey - 100) / 1900.0::DOUBLE)) AS part, p_partkey < 100 AS warm FROM part)
SELECT p_partkey, round(0.1::DOUBLE * CASE WHEN warm THEN p_partkey / 100.0::DOUBLE ELSE 1 - part END, 9) AS linear, round(0.1::DOUBLE * CASE WHEN warm THEN p_partkey / 100.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(3.141592653589793::DOUBLE * part)) END, 9) AS cosine, round(p_size * 1024 * 24 * 2 * 2 * 4 / 1048576.0::DOUBLE, 6) AS adapter_mb FROM a""",
}
