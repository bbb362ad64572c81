"""Text standardisation over whole documents and pages, and manifests built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import norm_sql, rounded, table, words_sql


def normalize_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", X.normalize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), X.word_count(F.col("text")).alias("words"))


def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_markup(F.col("html")).cast("binary")).alias("digest"), F.length(X.strip_markup(F.col("html"))).cast("long").alias("length"))


def longest_quoted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.longest_quoted(F.col("html")).alias("quoted"))


def chatty_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(
        F.count("*").alias("n"), F.count(F.when(X.chatty(F.col("text")), 1)).alias("chatty"), F.count(F.when(X.chatty_phrases(F.col("text")), 1)).alias("phrases"))


def safe_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_label(F.col("url")).alias("label"))


def duration_buckets(spark, sf_dir):
    seconds = F.col("n_chars") / 15
    rows = table(spark, sf_dir, "documents").select(X.bucket_label(seconds, [10, 30, 60, 120]).alias("bucket"), seconds.alias("s"))
    return rounded(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("s").cast("decimal(18,6)")).cast("double").alias("total"), F.max("s").alias("longest")), 4)


def label_frequencies(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rounded(rows.crossJoin(F.broadcast(total)).select("lang", "source", "n", (F.col("n") / F.col("total")).alias("share")))


def standardised_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mapped = F.create_map(*(F.lit(x) for pair in (("en", "english"), ("de", "german"), ("fr", "french"), ("es", "spanish")) for x in pair))
    keep = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other")
    t = X.normalize(F.col("text"))
    rows = docs.select(F.concat(F.lit("fs_"), F.col("doc_id").cast("string")).alias("utterance_id"), F.coalesce(F.element_at(mapped, F.lower(F.trim("lang"))), F.lit("")).alias("language"), keep.alias("l1_group"), F.col("source"), t.alias("t"))
    rows = rows.where("t <> ''")
    counts = rows.groupBy("source").agg(F.count("*").alias("c")).where("c >= 10")
    return rows.join(counts, "source", "left_semi").select("utterance_id", "language", "l1_group", "source", X.word_count(F.col("t")).alias("words"))


def cardinality_profile(spark, sf_dir):
    row = table(spark, sf_dir, "orders").agg(*(F.count_distinct(c).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
    long = row.selectExpr("stack(4, 'o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus, 'o_orderpriority', o_orderpriority) AS (column_name, n)")
    return long.withColumn("distance", F.when((F.col("n") >= 400) & (F.col("n") <= 800), 0).otherwise(F.least(F.abs(F.col("n") - 400), F.abs(F.col("n") - 800))).cast("long"))


def variant_fan_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    variants = spark.createDataFrame([("baseline", 1.0), ("mp3_16k", 0.1), ("opus_24k", 0.2)], "variant string, factor double")
    return docs.crossJoin(F.broadcast(variants)).groupBy("variant", "source").agg(F.count("*").alias("n"), F.min(F.concat_ws("/", F.lit("audio"), "variant", F.concat("id", F.lit(".wav")))).alias("first_path"))


def digest_picks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.digest_pick(F.col("doc_id").cast("string"), 97).alias("pick"))


def rate_rounding(spark, sf_dir):
    from .base import predictions

    rows = predictions(spark, sf_dir).where("n > 0")
    edits = X.edits_from_rate(F.col("wer"), F.col("n"))
    return rows.groupBy("model", "variant").agg(F.sum(edits).alias("edits"), F.sum("errors").alias("errors"), F.count(F.when(edits != F.col("errors"), 1)).alias("different"))


NS = norm_sql("text")
_DIGEST = " + ".join(f"('0x' || substr(md5(CAST(doc_id AS VARCHAR)), {4 * i + 1}, 4))::BIGINT * {pow(65536, 7 - i, 97)}" for i in range(8))
STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '/', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"

QUERIES = {f.__name__: f for f in (
    normalize_text, strip_markup, longest_quoted, chatty_flags, safe_labels, duration_buckets, label_frequencies, standardised_manifest, cardinality_profile,
    variant_fan_out, digest_picks, rate_rounding)}

from .base import with_pred  # noqa: E402

ORACLE_SQL = {
    "normalize_text": f"WITH t AS (SELECT doc_id, {NS} AS t FROM documents) SELECT doc_id, md5(t) AS digest, CAST({words_sql('t')} AS BIGINT) AS words FROM t",
    "strip_markup": f"WITH t AS (SELECT page_id, {STRIP} AS t FROM pages) SELECT page_id, md5(t) AS digest, length(t) AS length FROM t",
    "longest_quoted": """WITH q AS (SELECT page_id, html, regexp_extract_all(html, '"([^"]+)"', 1) AS q FROM pages)
SELECT page_id, CASE WHEN len(q) > 0 THEN list_filter(q, lambda x: length(x) = list_max(list_transform(q, lambda y: length(y))))[1] ELSE trim(regexp_replace(html, '(?i)^(sure|certainly|here is|the transcription is)[^:]*:', '')) END AS quoted FROM q""",
    "chatty_flags": """SELECT role, count(*) AS n,
  count(*) FILTER (WHERE regexp_matches(text, '(?i)^Sure|^Of course|^Here(?:''s| is)|^The user(?:''s)?|transcri(?:be|ption|bed)|written format')) AS chatty,
  count(*) FILTER (WHERE regexp_matches(lower(text), 'thank you for watching|please subscribe|like and subscribe|sure|of course|here is|here''s|the user|transcription|transcribed|written format')) AS phrases
FROM conversations GROUP BY role""",
    "safe_labels": "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS label FROM pages",
    "duration_buckets": """WITH t AS (SELECT n_chars / 15.0::DOUBLE AS s FROM documents) SELECT CASE WHEN s <= 10 THEN '0-10s' WHEN s <= 30 THEN '10-30s' WHEN s <= 60 THEN '30-60s' WHEN s <= 120 THEN '60-120s' ELSE '>120s' END AS bucket,
count(*) AS n, round(sum(s::DECIMAL(18,6))::DOUBLE, 4) AS total, round(max(s), 4) AS longest FROM t GROUP BY ALL""",
    "label_frequencies": "SELECT lang, source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM documents GROUP BY ALL",
    "standardised_manifest": f"""WITH t AS (SELECT 'fs_' || doc_id AS utterance_id, CASE lower(trim(lang)) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE '' END AS language,
CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS l1_group, source, {NS} AS t FROM documents), k AS (SELECT * FROM t WHERE t <> '')
SELECT utterance_id, language, l1_group, source, CAST({words_sql('t')} AS BIGINT) AS words FROM k WHERE source IN (SELECT source FROM k GROUP BY source HAVING count(*) >= 10)""",
    "cardinality_profile": """WITH c AS (SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) AS n FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL
SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)
SELECT column_name, n, CASE WHEN n BETWEEN 400 AND 800 THEN 0 ELSE least(abs(n - 400), abs(n - 800)) END AS distance FROM c""",
    "variant_fan_out": "SELECT variant, source, count(*) AS n, min('audio/' || variant || '/' || doc_id || '.wav') AS first_path FROM documents, (VALUES ('baseline'), ('mp3_16k'), ('opus_24k')) v(variant) GROUP BY ALL",
    "digest_picks": f"SELECT doc_id, ({_DIGEST}) % 97 AS pick FROM documents",
    "rate_rounding": with_pred(" SELECT model, variant, sum(round_even(wer * n, 0)::BIGINT)::BIGINT AS edits, sum(errors)::BIGINT AS errors, count(*) FILTER (WHERE round_even(wer * n, 0)::BIGINT <> errors) AS different FROM pred WHERE n > 0 GROUP BY ALL"),
}
