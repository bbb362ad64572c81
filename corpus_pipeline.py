"""A training corpus from raw documents: known languages, no near copies, no benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
rereads for the next stage.  Whole texts go to Python in small batches, whoever writes the stage.  All but the last return the columns of documents, whatever other columns these have.

Nulls and odd rows: a null or blank text is in no known language and goes at the first stage.  Null ids stay (of a group,
a row with an id is kept before one without); of repeated rows one stays.  Very long texts pass whole.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumetrica.llm import decontamination, language_id, sentencepiece, simhash
from lumetrica.llm.common import free, id_bucket, kept, scratch, small_batches, table

#: The least posterior with which a language is taken as known: with fewer than half, no language has a majority.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: no letter, or no language with at least LEAST_SCORE of the posterior."""
    small_batches(spark)
    model = language_id.train(docs, id_bucket(F.col("doc_id"), 4) != 2)
    names = free(docs.columns, "lang_pred", "score")
    found = language_id.predict(docs, model, names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id: five-word shingles, likeness 0.8 or 3 bits."""
    small_batches(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark text, or a whole shorter one."""
    small_batches(spark)
    names = free(docs.columns, "words", "spans", "items")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.where(F.size(names[1]) == 0).drop(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    small_batches(spark)
    return sentencepiece.encode_documents(docs, outputs=("ids", "decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can express neither XXH64 nor BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
