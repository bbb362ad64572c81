"""Readers of the file kinds that evaluation runs leave behind."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled


def there(spark: SparkSession, path: str) -> bool:
    """Whether the path (or a glob) names anything, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_strings(
    spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",", recursive: bool = False, pattern: str | None = None,
    exclude: str | None = None, multiline: bool = True,
) -> DataFrame:
    """CSV or TSV with a header, every column text, missing as blank; plus file_name.

    exclude: files whose name holds this are left out.  multiline: whether fields may hold line breaks; without them large
    files are split among tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).options(header=True, sep=sep, multiLine=multiline, escape='"', enforceSchema=False, recursiveFileLookup=recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(path)
    if exclude:
        df = df.where(~F.contains("_metadata.file_name", F.lit(exclude)))
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("_metadata.file_name").alias("file_name"))


def read_typed(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", multiline: bool = True) -> DataFrame:
    """CSV with a header and types; what does not parse is null, blank text stays blank."""
    return spark.read.schema(schema).options(header=True, sep=sep, multiLine=multiline, escape='"', enforceSchema=False, emptyValue="").csv(path)


def with_row_index(df: DataFrame, name: str = "_row_index") -> DataFrame:
    """A dense index in file order (files by path, as Spark lists them): counts per partition give each its offset, so only the
    counts, one row per partition, meet in one place."""
    numbered = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = numbered.groupBy("_p").count().select("_p", F.coalesce(before, F.lit(0)).alias("_s"))
    return numbered.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")


def unknown_runs(df: DataFrame, models: list[str]) -> DataFrame:
    """(file_name, rows) of the files that run_of_file drops."""
    known = df.select("file_name").distinct()
    known = run_of_file(known, models).select("file_name")
    return df.join(known, "file_name", "left_anti").groupBy("file_name").agg(F.count("*").alias("rows"))


def run_of_file(df: DataFrame, models: list[str], default: str = "clean") -> DataFrame:
    """model and perturbation from file names "<model>_<perturbation>.csv" (model names may hold dots and underscores); unknown models are
    dropped (unknown_runs counts them)."""
    stem = F.regexp_replace("file_name", r"\.csv$", "")
    model = F.lit(None).cast("string")
    for name in sorted(models, key=len):  # the longest name that fits stands last and wins
        model = F.when((stem == name) | stem.startswith(name + "_"), name).otherwise(model)
    rest = F.regexp_replace(F.substring(stem, F.length("model") + 1, F.length(stem)), "^_", "")
    return df.withColumn("model", model).where("model IS NOT NULL").withColumn("perturbation", F.when(rest == "", default).otherwise(rest))


def with_variant(df: DataFrame) -> DataFrame:
    """audio_variant from the first filled of audio_variant, variant, perturbation, else baseline."""
    there = [F.col(c) for c in ("audio_variant", "variant", "perturbation") if c in df.columns]
    return df.withColumn("audio_variant", first_filled(*there, default="baseline"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """One document, over many lines; no row where an optional file is missing."""
    if optional and not there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_speakers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-separated lines, comments after ";"."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep="|", comment=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return df.select(*(F.trim(c).alias(c) for c in columns))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of lines "id text"; lines without a blank are dropped."""
    parts = F.split(F.trim("value"), " ", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("id"), parts[1].alias("text"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=VALUE lines."""
    parts = F.split("value", "=", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """(epoch_ts, util, mem) of "a, b, c" lines; malformed lines are dropped."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(parts) >= 3).select(*(F.trim(parts[i]).try_cast("long").alias(c) for i, c in enumerate(("epoch_ts", "util", "mem"))))
    return rows.where("epoch_ts IS NOT NULL AND util IS NOT NULL AND mem IS NOT NULL")


def filled_down(rows: DataFrame, key: str, pos: str, columns: list[str], block: int = 4096) -> DataFrame:
    """rows with each null of the columns replaced by the last value before it, by position within its key.

    Positions are cut into blocks: each is filled by itself, and its first nulls take what the blocks before it end with, so
    that one long file is many tasks.
    """
    cut = rows.withColumn("_b", F.expr(f"CAST({pos} AS BIGINT) DIV {block}"))
    last = cut.groupBy(key, "_b").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in columns))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = last.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), *(F.last(c, ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns))
    joined = cut.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    within = Window.partitionBy(key, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_before_{c}")) for c in columns})
    return found.drop("_b", "_k", "_c", *(f"_before_{c}" for c in columns))


def parse_sections(lines: DataFrame, file: str = "file_name", number: str = "line_no", text: str = "value", block: int = 4096) -> DataFrame:
    """Interval rows of a log whose sections ("== name"), models ("Model: x") and axes ("Axis: y") head the rows below them.

    A new section forgets model and axis, a new model forgets the axis.  Rows read "group: wer% [low, high]".
    """
    head = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    x = lines.withColumns({"_s": head(r"^== *(.+?) *(?:==)?$"), "_m": head(r"^Model: *(.+)$"), "_a": head(r"^Axis: *(.+)$")})
    # a heading sets what it names and clears what is below it; null leaves what was there
    x = x.withColumns({
        "section": F.col("_s"), "_mm": F.when(F.col("_s").isNotNull() | F.col("_m").isNotNull(), F.coalesce("_m", F.lit(""))),
        "_aa": F.when(F.col("_s").isNotNull() | F.col("_m").isNotNull() | F.col("_a").isNotNull(), F.coalesce("_a", F.lit("")))})
    x = filled_down(x, file, number, ["section", "_mm", "_aa"], block)
    row = r"^\s*(.+?): *([0-9.]+)% *\[([0-9.]+), *([0-9.]+)\]"
    x = x.where(F.col(text).rlike(row) & (F.col("_mm") != "") & (F.col("_aa") != ""))
    return x.select(file, "section", F.col("_mm").alias("model"), F.col("_aa").alias("axis"), F.regexp_extract(text, row, 1).alias("group"),
                    *(F.regexp_extract(text, row, i).cast("double").alias(c) for i, c in ((2, "wer"), (3, "low"), (4, "high"))))


WAV = "path string, sample_rate int, channels int, bit_depth int, frames long, seconds double, codec string, bitrate long"


#: Bytes that are read of a file at once; headers are nearly always within the first such piece.
PIECE = 1 << 12


def wav_header(read_at: Callable[[int, int], bytes]) -> tuple:
    """sample_rate .. bitrate from the chunks of a WAV file, of which read_at(place, bytes) gives a piece; seven nulls if it is none.

    Chunks are stepped over by their sizes, so sound is never read, wherever the header ends.
    """
    start, held = 0, read_at(0, PIECE)

    def at(place: int, size: int) -> bytes:
        nonlocal start, held
        if not start <= place <= place + size <= start + len(held):
            start, held = place, read_at(place, PIECE)
        return held[place - start : place - start + size]

    first, place, found = at(0, 12), 12, None
    if first[:4] != b"RIFF" or first[8:12] != b"WAVE":
        return (None,) * 7
    while len(chunk := at(place, 8)) == 8:
        kind, size = chunk[:4], int.from_bytes(chunk[4:], "little")
        if kind == b"fmt " and len(body := at(place + 8, 16)) == 16:
            found = [int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (12, 14), (14, 16))]
        elif kind == b"data" and found:
            code, channels, rate, align, depth = found
            frames = size // max(1, align)
            return rate, channels, depth, frames, frames / max(1, rate), f"pcm_s{depth}le" if code == 1 else str(code), rate * channels * depth
        place += 8 + size + size % 2
    return (None,) * 7


def wav_headers(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """What the headers of WAV files say; unreadable files have nulls (of empty ones Spark's listing has no row).

    The listing gives paths and lengths without contents; tasks open their files (of any store that pyarrow opens) and read pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch["path"]:
                try:
                    local = re.match("file:/+(.*)", name, re.S)
                    store, inner = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(quote(name, safe=":/@"))
                    with store.open_input_file(inner) as file:
                        size = file.size()
                        out.append((name, *wav_header(lambda a, n, file=file, size=size: file.read_at(max(0, min(n, size - a)), min(a, size)))))
                except (OSError, ValueError):
                    out.append((name, *(None,) * 7))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in WAV.split(", ")])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return listed.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, WAV)


def durations(manifest: DataFrame, headers: DataFrame, path: str, cache: str, fallback: float = 5.0) -> DataFrame:
    """manifest with seconds: from the cache (a table of path and seconds), else from the headers (those of wav_headers), which
    then go to the cache; unreadable files have the fallback and are not cached."""
    spark = manifest.sparkSession
    known = spark.read.parquet(cache) if there(spark, cache) else None
    wanted = manifest.select(F.col(path).alias("path")).distinct()
    fresh = wanted if known is None else wanted.join(known, "path", "left_anti")
    new = headers.select("path", "seconds").join(fresh, "path", "left_semi").where("seconds IS NOT NULL").dropDuplicates(["path"])
    if known is None or fresh.limit(1).count():
        new.write.mode("append").parquet(cache)
    found = spark.read.schema("path string, seconds double").parquet(cache).select(F.col("path").alias(path), "seconds")
    return manifest.join(found, path, "left").withColumn("seconds", F.coalesce("seconds", F.lit(fallback)))


def within_budget(docs: DataFrame, order: str, text: str, doc_cap: int, max_chars: int) -> DataFrame:
    """Texts cut at doc_cap, in order while their sum stays within max_chars (a corpus sample for a tokenizer trainer)."""
    cut = docs.withColumn(text, F.substring(text, 1, doc_cap)).withColumn("_l", F.length(text))
    blocks = cut.withColumn("_b", F.floor(F.col(order) / 4096))
    sums = blocks.groupBy("_b").agg(F.sum("_l").alias("_t"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = F.sum("_l").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.join(before, "_b").where(F.col("_before") < max_chars).withColumn("_sum", F.col("_before") + inside).where(F.col("_sum") <= max_chars).drop("_b", "_l", "_before", "_sum")


def directory_bytes(spark: SparkSession, path: str) -> DataFrame:
    """files and bytes under a path, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
