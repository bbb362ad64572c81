"""What the operators of this subpackage share: tables, stashes, names, blocks of text, bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows go to Python in batches of about this size: a buffer of a larger one is doubled outside the heap until it fits, and Python holds it whole.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
#: Settings while a stash is written: Spark deletes the query's shuffle files at its end, and batches for Python stay small.
WHILE_STASHING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **SMALL_BATCHES}
#: Paths of stashes, a list for each scratch block that is open.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where that is unset, one of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            held = context._jsc.sc().getCheckpointDir()
        found = held.get()
    return found


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs start there, whichever executor is lost.

    Its shuffle files go when it is written, the table itself at the end of the scratch block around it, else when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_STASHING}
    for k, v in WHILE_STASHING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Small batches for Python in whatever this session runs from now on, where it has no setting of its own."""
    for k, v in SMALL_BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession):
    """Stashes written inside are deleted at the end; what leaves the block must be written with kept()."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            system, target = _file_system(spark, path)
            system.delete(target, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A stash that outlives the innermost scratch block."""
    out = stash(df, name)
    if _scopes:
        path = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(path)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join whose sides both grow with the input: neither goes whole through the driver to every executor.

    Spark sizes a table by its compressed file, an array as one value, and rows after an explode as those before it, so a table
    of millions of rows may seem small enough for a broadcast.
    """
    return df.hint("merge")


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as it takes to clash with none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def digest(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def id_bucket(column: Column, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % mod


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to the limit at most, one row at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_binary())  # only nulls cost a copy
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bits of one value of bitmap_construct_agg.
BITMAP = 1 << 15


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """2**bits bits, one byte for each eight, set where a key (a long) ends in their number; executors set and merge them.

    Its size is fixed, whatever the number of keys: a filter that lets more through as it fills, and never loses a key.
    """
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    parts = keys.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(BITMAP - 1))).alias("bits"))
    found = np.zeros((max(1, (1 << bits) // BITMAP), BITMAP // 8), np.uint8)
    for part, own in parts.collect():
        found[part] = np.frombuffer(own, np.uint8)
    return found.ravel()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (64-bit, signed or not) is set."""
    place = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
