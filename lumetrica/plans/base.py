"""The tables that stand for predictions: edit counts of three models under three conditions, derived from documents.

The counts follow by integer arithmetic from a text's number of words and its id, so that both engines agree on them.
Alignment proper runs on lines of the texts (plans.alignment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count

MODELS = [("ada", 1), ("bix", 2), ("cor", 3)]
VARIANTS = [("clean", 0), ("mild", 1), ("harsh", 2)]
BASELINE = "clean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_matrix(spark: SparkSession) -> DataFrame:
    """model, m, variant, v: nine rows."""
    return spark.createDataFrame([(a, m, b, v) for a, m in MODELS for b, v in VARIANTS], "model string, m int, variant string, v int")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with n (words), and quality and toxic as labels that may be blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_count(F.col("text")).alias("n"))
    docs = docs.repartition("doc_id")  # else Spark counts the words again for every run that a document is joined with
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"), F.max("toxic").cast("string").alias("toxic"))
    return docs.join(labels, "doc_id", "left").na.fill("", ["quality", "toxic"])


def predictions(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, source, quality, toxic, model, variant, n, s, i, d, h, ref_words, errors, wer (4 places); docs: what labelled() gives, where it is kept."""
    rows = (labelled(spark, sf_dir) if docs is None else docs).crossJoin(F.broadcast(run_matrix(spark)))
    rows = rows.withColumn("s", F.least(F.col("n"), F.expr("(n * (2 * m + 4 * v) + doc_id % 7) DIV 100")))
    rows = rows.withColumn("d", F.least(F.expr("n - s"), F.expr("(n * (m + 3 * v) + doc_id % 5) DIV 150")))
    rows = rows.withColumn("i", F.expr("(n * m * (1 + v) + doc_id % 11) DIV 120")).withColumn("h", F.expr("n - s - d"))
    rows = rows.withColumn("errors", F.expr("s + i + d")).withColumn("ref_words", F.col("n"))
    return rows.withColumn("wer", F.round(F.try_divide(F.col("errors").cast("double"), F.col("n").cast("double")), 4)).drop("m", "v")


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


def norm_sql(column: str) -> str:
    return _NORM.format(column)


def words_sql(norm: str) -> str:
    return f"(CASE WHEN {norm} = '' THEN 0 ELSE length({norm}) - length(replace({norm}, ' ', '')) + 1 END)"


PREDICTIONS_SQL = f"""
texts AS (SELECT doc_id, lang, source, {norm_sql('text')} AS t FROM documents),
lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
docs AS (SELECT a.doc_id, lang, source, CAST({words_sql('t')} AS BIGINT) AS n, coalesce(CAST(q AS VARCHAR), '') AS quality, coalesce(CAST(x AS VARCHAR), '') AS toxic
  FROM texts a LEFT JOIN lab ON a.doc_id = lab.doc_id),
runs AS (SELECT * FROM (VALUES ('ada', 1), ('bix', 2), ('cor', 3)) a(model, m), (VALUES ('clean', 0), ('mild', 1), ('harsh', 2)) b(variant, v)),
p1 AS (SELECT *, least(n, (n * (2 * m + 4 * v) + doc_id % 7) // 100) AS s FROM docs, runs),
p2 AS (SELECT *, least(n - s, (n * (m + 3 * v) + doc_id % 5) // 150) AS d, (n * m * (1 + v) + doc_id % 11) // 120 AS i FROM p1),
pred AS (SELECT doc_id, lang, source, quality, toxic, model, variant, n, s, i, d, n - s - d AS h, s + i + d AS errors, n AS ref_words,
  CASE WHEN n > 0 THEN round((s + i + d) / n::DOUBLE, 4) END AS wer FROM p2)
"""


def with_pred(body: str) -> str:
    return f"WITH {PREDICTIONS_SQL.strip()}{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, for comparison with another engine."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def exact_mean(value: Column) -> Column:
    """The mean from a decimal sum, which no order of rows changes, so that equal means compare as equal; the plain one where a value or the sum is out of a decimal's range."""
    exact = value.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(value), F.try_sum(exact)).cast("double") / F.nullif(F.count(value), F.lit(0)), F.avg(value))
