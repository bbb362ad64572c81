"""Sharding by extendible hashing.

A shard is a prefix of the bits of a row's hash.  All rows start in the shard of
the empty prefix; a shard over `max_bytes` splits on its next bit until every
shard fits.  The split needs no pass per bit: bytes are summed once per cell of
`depth` bits, and a row's shard is the shortest prefix of its cell whose sum fits.

Rows with one id share a hash, and cells may still be too large: rows of a cell
over the limit go on with bits of a second hash, of the row's id, text and number among equal rows, which tells
repeats apart; again one sum per cell finds the shortest prefix that fits.  A row that
is over the limit by itself is a shard of its own (marked `oversized`).  Shards depend on the rows alone, not on how files
or partitions hold them: equal rows are numbered by partition, with the counts of the partitions before.

Nulls: a null id counts as the empty text, a null text as 0 bytes.  Repeated rows each have a shard.  An
empty table gives no shards.  Only the id and the text are read, so other columns may have any name (but
for `shard` where shards are written).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, named, stash, table


def _prefix(hashed: Column, bits: Column | int) -> Column:
    """The upper bits of a hash, as a number."""
    return F.when(F.lit(bits) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", hashed, (F.lit(64) - F.lit(bits)).cast("int")))


def directory(cells: DataFrame, key: list[str], depth: int, max_bytes: int) -> DataFrame:
    """cells (key, cell of `depth` bits, bytes) with `bits`: how many bits of the cell name its shard, null if even all are too few."""
    levels = cells.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    above = F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(depth) - F.col("bits")).cast("int"))
    sums = levels.groupBy(*key, "bits", above.alias("above")).agg(F.sum("bytes").alias("all_bytes"))
    fits = levels.withColumn("above", above).join(sums.where(F.col("all_bytes") <= max_bytes).drop("all_bytes"), [*key, "bits", "above"])
    least = fits.groupBy(*key, "cell").agg(F.min("bits").alias("bits"))
    return cells.join(least, [*key, "cell"], "left")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the number (from 0) of each among those of its id and text; a row's upper bits are its partition, so that no group meets in one task."""
    rows = rows.withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("h", "t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has any
    starts = rows.groupBy("h", "t", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("h", "t", "part").orderBy("row")
    return rows.join(starts, ["h", "t", "part"]).withColumn("number", F.col("start") + F.row_number().over(within) - 1).drop("start", "part")


def _assigned(rows: DataFrame, max_bytes: int, depth: int | None, deeper: int) -> DataFrame:
    """rows (id, bytes, h, t, row; row tells them apart) with shard and oversized instead of h and t."""
    if depth is None:
        total = rows.agg(F.sum("bytes")).first()[0] or 0
        depth = min(40, max(4, (int(total) // max_bytes).bit_length() + 3))
    rows = rows.withColumn("cell", _prefix(F.col("h"), depth))
    cells = rows.groupBy("cell").agg(F.sum("bytes").alias("bytes"))
    cells = stash(directory(cells, [], depth, max_bytes).select("cell", "bits"), "directory")
    rows = rows.join(cells, "cell")
    name = lambda h, bits, of: F.substring(F.lpad(F.conv(F.lpad(F.hex(h), 16, "0"), 16, 2), 64, "0"), F.lit(1), F.coalesce(bits, F.lit(of)).cast("int"))
    plain = rows.where("bits IS NOT NULL").select("id", "row", "bytes", name(F.col("h"), F.col("bits"), depth).alias("shard"), F.lit(False).alias("oversized"))
    rest = _numbered(rows.where("bits IS NULL").drop("bits")).withColumn("h2", F.xxhash64(F.lit(7), "h", "t", "number")).withColumnRenamed("cell", "first")
    rest = rest.withColumn("cell", _prefix(F.col("h2"), deeper)).withColumn("alone", F.col("bytes") > max_bytes)
    second = rest.where("NOT alone").groupBy("first", "cell").agg(F.sum("bytes").alias("bytes"))
    second = directory(second, ["first"], deeper, max_bytes).select("first", "cell", "bits")
    rest = rest.join(second, ["first", "cell"], "left")
    # a row alone has all its bits as a name, as have the rows of a cell that no bits could part
    shard = F.concat(name(F.col("h"), F.lit(depth), depth), F.lit("."), F.when(F.col("alone"), F.concat_ws("-", F.lit("row"), F.lower(F.hex("t")), "number")).otherwise(name(F.col("h2"), F.col("bits"), 64)))
    return plain.unionByName(rest.select("id", "row", "bytes", shard.alias("shard"), F.col("alone").alias("oversized")))


def _hashed(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    text, own = F.coalesce(named(text_col), F.lit("")), F.coalesce(named(id_col).cast("string"), F.lit(""))
    return docs.select(named(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(own).alias("h"), F.xxhash64(text).alias("t"), row.alias("row"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 16 << 20, depth: int | None = None, deeper: int = 24) -> DataFrame:
    """id_col, bytes, shard (its bits as text), oversized; the rows of a shard have max_bytes together at most, or it is one row.

    depth: bits of the directory; None: three more than the total asks for, so that it grows with the data.
    deeper: bits that rows of an oversized cell may use beyond.
    """
    rows = stash(_hashed(docs, id_col, text_col, F.monotonically_increasing_id()), "shards")
    return _assigned(rows, max_bytes, depth, deeper).select(F.col("id").alias(id_col), "bytes", "shard", "oversized")


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 16 << 20, depth: int | None = None, deeper: int = 24,
) -> DataFrame:
    """Write docs with their shard (a column `shard`, which docs must not have), one folder per shard, and return the
    assignment.  Each row is written once, also where ids repeat."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the column shard is in the way")
    number, = free([*docs.columns, "shard"], "row")
    numbered = stash(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = stash(_assigned(_hashed(numbered, id_col, text_col, F.col(number)), max_bytes, depth, deeper), "assignment")
    keyed = numbered.join(found.select(F.col("row").alias(number), "shard"), number).drop(number)
    keyed.repartition("shard").write.partitionBy("shard").parquet(path)
    return found.select(F.col("id").alias(id_col), "bytes", "shard", "oversized")


#: Bytes of a shard of the query.
QUERY_BYTES = 1 << 20


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign(table(spark, sf_dir, "documents"), max_bytes=QUERY_BYTES)
