"""Phrase collocations: phrases of two words and more whose words stand together more often than their parts make likely.

Texts fall at sentence signs into pieces, and equal pieces of a language become
one row with their number.  Tasks turn pieces into weighted n-grams, add up
equal ones of a block, and pack them by hash bucket; duckdb adds up each bucket,
with a bound on its memory beyond which it works on disk.  N-grams of three words and
more are made only where both (n-1)-grams in them may be frequent: a bitmap of fixed size,
which lets no frequent one go, says so.

A phrase needs the counts of its parts.  Each cut of each candidate sends two
requests, keyed by part; the shuffle brings them to the part's count, and the
answers return to the phrase.  The same requests tell a phrase how often a
longer candidate around it occurs.  Phrases of a language are ranked in salted
shares first, then the best of all shares.

Nulls: a null text counts as empty, a null language as `und`.  Texts without
words give nothing, an empty table an empty result.  A piece of any length is
read whole; one longer than a block is a block of its own.  Repeated rows count
each time.  Equal scores rank by count, then by phrase (UTF-8 bytes).  Only text
and language are read; other columns may have any name.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, bitmap, in_bitmap, kept, named, scratch, shared_dir, stash, table

#: Characters that end a piece.
ENDS = r"[.,;:!?\n-\r]"
#: Bytes of pieces whose n-grams a task adds up before it packs them.
BLOCK = 1 << 22
PARTIAL = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int8()), ("f", pa.int64())])
COUNTED = "lang string, gram string, n tinyint, f long, h long"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): each distinct piece of a language, its words joined by one space, and how often it occurs."""
    text = F.translate(F.coalesce(named(text_col), F.lit("")), f"{UPPER}\t", f"{UPPER.lower()} ")
    parts = F.explode(F.split(F.regexp_replace(text, "  +", " "), ENDS))
    found = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), parts.alias("piece"))
    return found.select("lang", F.trim("piece").alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


@contextmanager
def _duck(spill: str | None, memory: str):
    """A connection that keeps to `memory`; what is beyond goes to a folder of its own under `spill`, which is deleted at the end."""
    import duckdb

    own = spill and f"{spill}/duckdb-{uuid.uuid4().hex}"
    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": own or "", "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


def spill_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path, if it is mounted; in a store that only Spark reads there is none, and buckets must fit in memory."""
    found = urlparse(shared_dir(spark))
    return found.path if found.scheme in ("", "file") else None


def _hashed(con, values: pa.Array) -> np.ndarray:
    con.register("own", pa.table({"x": values}))
    try:
        return con.execute("SELECT hash(x) AS h FROM own").fetchnumpy()["h"]
    finally:
        con.unregister("own")


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(32))) * MIX[0] + b
    out = (out ^ (out >> np.uint64(29))) * MIX[1]
    return (out ^ (out >> np.uint64(32))) * MIX[2]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces in tables of about BLOCK bytes."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, step := max(1, batch.num_rows * BLOCK // max(batch.nbytes, 1))):
            held.append(part := batch.slice(start, step))
            size += part.nbytes
            if size >= BLOCK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _grams(con, rows: pa.Table, sizes: tuple[int, ...], keep: np.ndarray | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """For each size the weighted n-grams of a block, each once, with their hashes; size 0 stands for all words of a language.

    Words are numbers of the block's dictionary; the number of an n-gram is made of that of its first n-1 words and that of its last.
    """
    words = pc.split_pattern(_whole(rows["piece"]), " ")
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code, dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    langs = _whole(rows["lang"]).dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths)
    weight = np.repeat(rows["m"].to_numpy(), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)  # the place behind a word's piece
    word_hash, lang_hash = _hashed(con, dictionary), _hashed(con, langs.dictionary)
    places, key, hashes = np.arange(len(code)), lang, lang_hash[lang]
    for n in range(max(sizes) + 1):
        if n > 1:
            alive = places + n <= ends[places]
            if keep is not None and n == max(sizes):  # both (n-1)-grams must be in
                inside = np.zeros(len(code) + 1, bool)
                inside[places] = in_bitmap(keep, hashes)
                alive &= inside[places] & inside[places + 1]
            places, key, hashes = places[alive], key[alive], hashes[alive]
        if n:
            last = code[places + n - 1]
            if len(key) and int(key.max()) >= (1 << 62) // len(dictionary):
                key = np.unique(key, return_inverse=True)[1]  # numbers that follow each other leave room for one more word
            key, hashes = key * len(dictionary) + last, _joined(hashes, word_hash[last])
        if n in sizes:
            con.register("own", pa.table({"k": key, "m": weight[places], "i": np.arange(len(places))}))
            found = con.execute("SELECT CAST(sum(m) AS BIGINT) AS f, any_value(i) AS i FROM own GROUP BY k").fetchnumpy()
            con.unregister("own")
            at = places[found["i"]]
            text = [dictionary.take(pa.array(code[at + j])) for j in range(n)]
            gram = pc.binary_join_element_wise(*text, " ") if n else pa.array([""] * len(at), pa.string())
            columns = {"lang": langs.dictionary.take(pa.array(lang[at])), "gram": gram, "n": pa.array(np.full(len(at), n, np.int8)), "f": found["f"]}
            yield pa.table(columns, schema=PARTIAL), hashes[found["i"]]


def _partial(sizes: tuple[int, ...], buckets: int, keep):
    """Blocks of pieces -> (bucket, data): packed n-grams with their weights, each once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _duck(None, "1GB") as con:
            for rows in _gathered(batches):
                for grams, hashes in _grams(con, rows, sizes, keep and keep.value):
                    bucket = (hashes >> np.uint64(33)).astype(np.int64) % buckets
                    order = np.argsort(bucket, kind="stable")
                    grams, bounds = grams.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(bounds)).tolist():
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, PARTIAL, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                            out.write_table(grams.slice(bounds[b], bounds[b + 1] - bounds[b]))
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "data"])

    return run


def _merged(least: int, spill: str | None, memory: str):
    """Packed n-grams of whole buckets -> n-grams that occur `least` times, with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = (x.as_buffer() for batch in batches for x in batch.column("data"))
        with _duck(spill, memory) as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(PARTIAL, (b for x in packed for b in pa.ipc.open_stream(x))))
            found = con.sql(f"SELECT lang, gram, n, CAST(sum(f) AS BIGINT) AS f FROM arriving GROUP BY lang, gram, n HAVING sum(f) >= {int(least)} OR n = 0").to_arrow_table()
            for batch in found.to_batches(max_chunksize=1 << 16):
                hashes = np.zeros(batch.num_rows, np.uint64)
                for n in np.unique(batch["n"].to_numpy()).tolist():
                    at = np.flatnonzero(batch["n"].to_numpy() == n)
                    own = batch.take(pa.array(at))
                    hashes[at] = _hashed(con, own["lang"])
                    for words in zip(*pc.split_pattern(own["gram"], " ").to_pylist(), strict=True) if n else ():
                        hashes[at] = _joined(hashes[at], _hashed(con, pa.array(words, pa.string())))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("lang", "gram", "n", "f")), pa.array(hashes.view(np.int64))], names=["lang", "gram", "n", "f", "h"])

    return run


def counted(rows: DataFrame, sizes: tuple[int, ...], least: int, keep: np.ndarray | None = None, memory: str = "200MB") -> DataFrame:
    """(lang, gram, n, f, h) of all n-grams of these sizes that occur `least` times in pieces(); of size 0 all, which count the words.

    keep: a bitmap of the hashes of (n-1)-grams outside which the largest size is not counted.
    """
    spark = rows.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = None if keep is None else spark.sparkContext.broadcast(keep)
    packed = rows.select("lang", "piece", "m").mapInArrow(_partial(sizes, buckets, held), "bucket int, data binary")
    return packed.repartition(buckets, "bucket").mapInArrow(_merged(least, spill_folder(spark), memory), COUNTED)


def frequent(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang", filter_bits: int = 25) -> DataFrame:
    """(lang, gram, n, f) of all n-grams of up to `longest` words that occur `least` times, and a row of n = 0 for each language with the number of its words."""
    with scratch(docs.sparkSession):
        rows = stash(pieces(docs, text_col, lang_col), "pieces")
        out = last = kept(counted(rows, (0, 1, 2), least), "grams")
        for n in range(3, longest + 1):
            keep = bitmap(last.where(F.col("n") == n - 1), "h", filter_bits)
            last = kept(counted(rows, (n,), least, keep), "grams")
            out = out.union(last)
    return out.drop("h")


def scored(grams: DataFrame, longest: int, absorb: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate that no longer one absorbs: of those around it none has `absorb` percent of its count."""
    words = F.split("gram", " ")
    cut = lambda k: (F.array_join(F.slice(words, 1, F.lit(k)), " "), F.array_join(F.slice(words, F.lit(k + 1), F.col("n") - k), " "))
    requests = []
    for k in range(1, longest):
        for role, part in zip("lr", cut(k), strict=True):
            size = F.lit(k) if role == "l" else F.col("n") - k
            asks = F.struct(part.alias("part"), F.lit(k).alias("k"), F.lit(role).alias("role"), ((size == F.col("n") - 1) & (size > 1)).alias("around"))
            requests.append(F.when(F.col("n") > k, asks))
    asked = grams.where("n > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(F.array_compact(F.array(*requests))).alias("ask"))
    parts = grams.where(F.col("n").between(1, longest - 1)).select("lang", F.col("gram").alias("part"), "f")
    answers = asked.select("lang", "phrase", "a", "ask.*").join(parts, ["lang", "part"])
    own = F.struct("phrase", "a", "k", "role", "f", F.lit(None).cast("long").alias("longer"))
    told = F.when(F.col("around"), F.struct(
        F.col("part").alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("f"),
        F.col("a").alias("longer")))
    found = answers.select("lang", F.explode(F.array_compact(F.array(own, told))).alias("x")).select("lang", "x.*")
    at = lambda k, role: F.max(F.when((F.col("k") == k) & (F.col("role") == role), F.col("f")))
    cuts = [at(k, role).alias(f"{role}{k}") for k in range(1, longest) for role in "lr"]
    found = found.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *cuts)
    found = found.where(f"longer IS NULL OR 100 * longer < {int(absorb)} * a")
    best = F.array_min(F.array_compact(F.array(*(
        F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)))))
    return found.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _score(k: int) -> Column:
    """floor(1000000 * a * a / (l * r)), exact in 38 digits."""
    return F.expr(f"(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) DIV (CAST(l{k} AS DECIMAL(19, 0)) * CAST(r{k} AS DECIMAL(19, 0)))")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, absorb: int = 50, best: int = 2000, shares: int = 64,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `best` phrases of 2 to `longest` words."""
    grams = frequent(docs, longest, least, text_col, lang_col)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = scored(grams, longest, absorb).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    words = grams.where("n = 0").select("lang", F.col("f").alias("n"))  # a row for each language
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))
