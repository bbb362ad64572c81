"""Source divergence: how far apart the sources of a language are in their words, and which words set a source apart.

Tasks count the terms of blocks of texts per group (language and source) and pack
the counts by hash bucket of language and term.  A bucket has all of its terms, so
it knows in how many documents of the language each occurs, keeps the frequent ones
and numbers them.  Runs of these numbers are the vocabulary chunks.

The groups of a language are cut into blocks.  A tile compares two blocks: it gets
both blocks' packed count vectors, chunk by chunk, and adds the distances of each
pair of groups up in a submatrix.  A term that neither block has adds the same to a pair as
any other such term, so only terms that occur are looked at one by one.  Where there are fewer tiles than
partitions, a tile's chunks are dealt to several tasks, whose submatrices are added.

Nulls: a null text, language or source counts as the empty string.  A group without
terms takes part in all pairs; with no frequent term at all, distances are 0.
Repeated rows count each time; ties rank by item in UTF-8 bytes.  A text of any length
is counted whole, one longer than a block in a block of its own.  Empty tables give an empty result.  Only
the three columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, kept, named, scratch, table, utf8

#: Bytes of text that a task counts before it packs.
BLOCK = 1 << 23
#: Terms of a chunk at most; groups of a block at most.
CHUNK, SIDE = 4096, 32
#: p is a share in parts of this, floored, plus 1, of counts that have PRIOR added.
SCALE, PRIOR = 1_000_000_000, 2
#: Bytes of terms: A-Z become a-z, those of other code points stay, 0 is between terms.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.large_string()), ("count", pa.int64()), ("docs", pa.int64())])
ENTRIES = "array<struct<slot: int, place: int, count: bigint>>"
COUNTED = "lang string, source string, term string, count long, total long, first boolean, chunk long, place int"


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the row of each."""
    data, offsets = utf8(column)
    low = LETTERS[data]
    inside = np.concatenate([low != 0, [False]])
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1]] = False  # a text begins
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[offsets[1:][offsets[1:] > 0] - 1] = False  # a text ends
    stops = np.flatnonzero(inside & ~after) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[inside[:-1]])])
    return terms, np.searchsorted(offsets, starts, "right") - 1


def _partial(buckets: int, names: tuple[str, str, str]):
    """Texts -> (bucket, data): the packed counts of a block's terms by group, and in how many of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = (batch.column(batch.schema.get_field_index(c)) for c in names)
            for start, stop in blocks(np.diff(utf8(text)[1]), BLOCK):
                own = slice(start, stop)
                terms, row = terms_of(text[own])
                coded = terms.dictionary_encode()
                word, dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
                size = max(len(dictionary), 1)
                langs, sources = lang[own].dictionary_encode(), source[own].dictionary_encode()
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                in_doc, often = np.unique(row * size + word, return_counts=True)
                key, back = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
                count, docs = np.bincount(back, often).astype(np.int64), np.bincount(back)
                bucket = (pd.util.hash_array(np.array(dictionary.to_pylist(), object), categorize=False) % np.uint64(buckets)).astype(np.int64)[key % size] if len(key) else key
                order = np.argsort(bucket, kind="stable")
                key, of = key[order], key[order] // size
                rows = pa.table([
                    langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                    dictionary.take(pa.array(key % size)), pa.array(count[order]), pa.array(docs[order])], schema=PARTIAL)
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, PARTIAL, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(rows.slice(bounds[b], bounds[b + 1] - bounds[b]))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "data"])

    return run


def _summed(rows: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(rows).group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    return found.rename_columns(["lang", "source", "term", "count", "docs"]).select(PARTIAL.names).cast(PARTIAL)


def _merged(least: int, most: int = 1 << 20):
    """Packed counts of whole buckets -> the counts of frequent terms, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["data"], strict=True):
                own = held.setdefault(bucket, [])
                own.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
                if len(own) > 1 and sum(x.num_rows for x in own) > max(most, 2 * own[0].num_rows):
                    own[:] = [_summed(own)]
        for bucket in sorted(held):
            rows = _summed(held.pop(bucket))
            total = rows.group_by(["lang", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum"), ("source", "min")])
            total = total.rename_columns(["lang", "term", "total", "docs", "least"])
            total = total.filter(pa.compute.greater_equal(total["docs"], least)).drop_columns("docs").sort_by([("lang", "ascending"), ("term", "ascending")])
            langs = total["lang"].combine_chunks().dictionary_encode()
            code = langs.indices.to_numpy()
            place = np.arange(len(code)) - np.searchsorted(code, code)  # langs are sorted, so codes are
            total = total.append_column("place", pa.array(place))
            found = rows.drop_columns("docs").join(total, ["lang", "term"], join_type="inner", use_threads=False)
            place = found["place"].to_numpy()
            out = pa.table({
                "lang": found["lang"], "source": found["source"], "term": found["term"].cast(pa.string()), "count": found["count"], "total": found["total"],
                "first": pa.compute.equal(found["source"], found["least"]), "chunk": (bucket << 32) + place // CHUNK, "place": pa.array((place % CHUNK).astype(np.int32))})
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    return run


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10) -> DataFrame:
    """lang, source, term, count, total (of the language), first (true for one group of each term), chunk, place: terms in `least` documents of their language."""
    text = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(_partial(buckets, ("lang", "source", "text")), "bucket int, data binary")
    return packed.repartition(buckets, "bucket").mapInArrow(_merged(least), COUNTED)


def groups(docs: DataFrame, counts: DataFrame, tasks: int, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, n (its counts), n_lang, v (frequent terms), slot, block, sides (blocks of the language), shards (tasks of a tile)."""
    text = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    found = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))
    found = found.join(own, ["lang", "source"], "left").fillna(0, ["n", "v"])
    whole = Window.partitionBy("lang")
    found = found.select(
        "lang", "source", "n", F.sum("n").over(whole).alias("n_lang"), F.sum("v").over(whole).alias("v"), (F.row_number().over(whole.orderBy("source")) - 1).alias("slot"),
        F.ceil(F.count("*").over(whole) / SIDE).cast("int").alias("sides"))
    tiles = F.col("sides").cast("long") * (F.col("sides") + 1) / 2
    return found.withColumn("block", F.expr(f"CAST(slot DIV {SIDE} AS INT)")).withColumn("slot", F.col("slot") % SIDE).withColumn(
        "shards", F.greatest(F.lit(1), F.least(F.floor(F.lit(tasks) / tiles), F.ceil(F.col("v") / CHUNK))).cast("int"))


def shares(count: np.ndarray, n, v) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR * v)), exact: a thousand at a time stays within 64 bits."""
    below = n + PRIOR * v
    whole, rest = np.divmod(count + PRIOR, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Tile:
    """The submatrix of two blocks of groups over the chunks that come by."""

    def __init__(self, key: tuple):
        self.key, self.names, self.totals, self.v = key, {}, {}, 0
        self.value = self.base = None

    def meet(self, side: int, v: int, names: list[str], totals: np.ndarray) -> None:
        self.names[side], self.totals[side], self.v = names, totals, v

    def start(self) -> None:
        """Once all groups of both blocks are there."""
        if self.value is not None:
            return
        if self.key[1] == self.key[2]:
            self.names[1], self.totals[1] = self.names[0], self.totals[0]
        self.absent = [shares(np.zeros(len(self.totals[s]), np.int64), self.totals[s], self.v) if self.v else np.ones(len(self.totals[s]), np.int64) for s in (0, 1)]
        self.base = distances(self.absent[0][:, None], self.absent[1][None])
        self.value = self.base * (self.v if self.key[3] == 0 else 0)  # as if no term occurred; one task of the tile adds it

    def add(self, sides: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.start()
        if self.key[1] == self.key[2]:
            sides = {0: sides[0], 1: sides[0]}
        places = np.unique(np.concatenate([x[1] for x in sides.values()]))
        dense = []
        for s in (0, 1):
            p = np.repeat(self.absent[s][:, None], len(places), axis=1)
            if s in sides:
                slot, place, count = sides[s]
                p[slot, np.searchsorted(places, place)] = shares(count, self.totals[s][slot], self.v)
            dense.append(p)
        for i, row in enumerate(dense[0]):
            self.value[i] += distances(row[None], dense[1]).sum(axis=1) - len(places) * self.base[i]

    def rows(self) -> pa.RecordBatch:
        self.start()
        i, j = np.indices(self.value.shape).reshape(2, -1)
        value, same = self.value.ravel(), self.key[1] == self.key[2]
        if same:
            i, j, value = i[i != j], j[i != j], value[i != j]
        left, right = pa.array(self.names[0], pa.string()).take(pa.array(i)), pa.array(self.names[1], pa.string()).take(pa.array(j))
        ways = [(left, right)] if same else [(left, right), (right, left)]
        return pa.RecordBatch.from_arrays([
            pa.array([self.key[0]] * len(value) * len(ways), pa.string()), pa.concat_arrays([a for a, _ in ways]), pa.concat_arrays([b for _, b in ways]), pa.array(np.tile(value, len(ways)))],
            names=["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by tile, the blocks' groups (chunk -1) before the chunks in turn -> the tile's pairs."""
    tile, chunk, sides = None, -1, {}
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("lang", "left", "right", "shard")), strict=True))
        fixed = [batch[c].to_pylist() for c in ("chunk", "side", "v", "names", "totals")]
        entries = batch["entries"]
        for i, key in enumerate(keys):
            at, side, v, names, totals = (x[i] for x in fixed)
            if tile is None or key != tile.key or at != chunk:
                if sides:
                    tile.add(sides)
                if tile is not None and key != tile.key:
                    yield tile.rows()
                if tile is None or key != tile.key:
                    tile = _Tile(key)
                chunk, sides = at, {}
            if at < 0:
                tile.meet(side, v, names, np.array(totals, np.int64))
            else:
                own = entries[i].values
                sides[side] = tuple(own.field(c).to_numpy().astype(np.int64) for c in ("slot", "place", "count"))
    if tile is not None:
        if sides:
            tile.add(sides)
        yield tile.rows()


def pair_distances(counts: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of groups of a language, both ways."""
    meet = known.groupBy("lang", "block", "sides", "shards", "v").agg(F.sort_array(F.collect_list(F.struct("slot", "source", "n"))).alias("own"))
    meet = meet.select(
        "lang", "block", "sides", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(-1).cast("long").alias("chunk"), F.col("own.source").alias("names"),
        F.col("own.n").alias("totals"), F.array().cast(ENTRIES).alias("entries"))
    packed = counts.join(known.select("lang", "source", "slot", "block", "sides", "shards"), ["lang", "source"]).groupBy("lang", "block", "sides", "shards", "chunk").agg(
        F.collect_list(F.struct("slot", "place", "count")).alias("entries"))
    packed = packed.select(
        "lang", "block", "sides", F.lit(0).cast("long").alias("v"), F.pmod(F.xxhash64("chunk"), F.col("shards")).cast("int").alias("shard"), "chunk", F.array().cast("array<string>").alias("names"),
        F.array().cast("array<long>").alias("totals"), "entries")
    rows = meet.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select(
        "lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "shard", "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "v", "names", "totals",
        "entries")
    key = ["lang", "left", "right", "shard"]
    found = rows.repartition(*key).sortWithinPartitions(*key, "chunk", "side").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def outstanding_terms(counts: DataFrame, known: DataFrame, best: int) -> DataFrame:
    """lang, source, item, value, rank of the terms that a group has more of than its language, the `best` of each group."""
    share = lambda count, n: F.expr(f"1 + (CAST({count} + {PRIOR} AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) DIV CAST({n} + {PRIOR} * v AS DECIMAL(20, 0))")
    found = counts.select("lang", "source", "term", "count", "total").join(known.select("lang", "source", "n", "n_lang", "v"), ["lang", "source"])
    found = found.select("lang", "source", F.col("term").alias("item"), share("count", "n").alias("p"), share("total", "n_lang").alias("q")).where("p > q")
    found = found.select("lang", "source", "item", F.expr("(p - q) * (p - q) DIV (p + q)").alias("value"))
    return _ranked(found).where(F.col("rank") <= best)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, best: int = 10) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    spark = docs.sparkSession
    with scratch(spark):
        counts = kept(term_counts(docs, text_col, lang_col, source_col, least), "counts")
        known = kept(groups(docs, counts, int(spark.conf.get("spark.sql.shuffle.partitions")), lang_col, source_col), "groups")
    pairs, terms = _ranked(pair_distances(counts, known)), outstanding_terms(counts, known, best)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a language against each other, and the ten words that set each apart."""
    return audit(table(spark, sf_dir, "documents"))
