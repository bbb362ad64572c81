"""Token counts from an exact histogram of lengths.

Documents are counted by encoded length; prefix and suffix sums over the distinct
lengths then answer, for every context limit: how many documents and tokens fit,
how many documents are longer, how many tokens are left if longer documents are
cut at the limit, and which quantile a length is.  The sums run within ranges of
`span` lengths and over the ranges' totals, so no task gets the whole histogram.

Nulls: a null text counts as empty: begin and end ids alone.  Repeated rows each
count.  An empty table has an empty histogram.  A very long text is encoded whole.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table
from .sentencepiece import encode_documents


def histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents."""
    return encode_documents(docs, id_col, text_col, model_path, outputs=()).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame, span: int = 1024) -> DataFrame:
    """A row for each length L of a histogram (length, n_docs): docs_up_to and tokens_up_to L, docs_over L,
    truncated_tokens (all documents cut at L), total_docs, total_tokens, and quantile (share of documents up to L)."""
    counts = stash(counts, "lengths")  # both sums below start from it
    cells = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.expr(f"length DIV {span}").alias("r"))
    ranges = cells.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of lengths
    whole = Window.partitionBy()
    ranges = ranges.select("r", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                           F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    within = Window.partitionBy("r").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.withColumns({"d1": F.sum("n_docs").over(within), "t1": F.sum("tokens").over(within)}).join(ranges, "r")
    rows = rows.select("length", "n_docs", (F.col("d0") + F.col("d1")).alias("docs_up_to"), (F.col("t0") + F.col("t1")).alias("tokens_up_to"), "total_docs", "total_tokens")
    over = F.col("total_docs") - F.col("docs_up_to")
    return rows.select(
        "length", "n_docs", "docs_up_to", "tokens_up_to", over.alias("docs_over"), (F.col("tokens_up_to") + F.col("length") * over).alias("truncated_tokens"),
        "total_docs", "total_tokens", (F.col("docs_up_to") / F.col("total_docs")).alias("quantile"))


def at_limits(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The answers for any context limits (column `limit`): from the largest length that is not over the limit.

    The lengths become half-open intervals; the limits (a few) are matched to them by range.
    """
    nxt = Window.partitionBy("r").orderBy("length")
    rows = found.withColumn("r", F.expr("length DIV 1024"))
    heads = rows.groupBy("r").agg(F.min("length").alias("head")).withColumn("after", F.lead("head").over(Window.orderBy("r")))
    rows = rows.join(heads, "r").withColumn("upto", F.coalesce(F.lead("length").over(nxt), F.col("after"), F.lit((1 << 63) - 1)))
    small = wanted.select(F.col("limit").cast("long").alias("limit")).distinct()
    got = small.join(rows, (F.col("limit") >= F.col("length")) & (F.col("limit") < F.col("upto")), "left")
    totals = found.select(F.col("total_docs").alias("td"), F.col("total_tokens").alias("tt")).limit(1)
    got = got.crossJoin(F.broadcast(totals))
    docs, tokens = F.coalesce("docs_up_to", F.lit(0)), F.coalesce("tokens_up_to", F.lit(0))
    return got.select("limit", docs.alias("docs_up_to"), (F.col("td") - docs).alias("docs_over"), (tokens + F.col("limit") * (F.col("td") - docs)).alias("truncated_tokens"), F.col("td").alias("total_docs"), F.col("tt").alias("total_tokens"))


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length up to which at least that share of the documents lies."""
    picked = [F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    pairs = ", ".join(f"{q!r}D, q{i}" for i, q in enumerate(shares))
    return found.agg(*picked).selectExpr(f"stack({len(shares)}, {pairs}) AS (share, length)")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals at every length that documents have."""
    return limits(histogram(table(spark, sf_dir, "documents")))
