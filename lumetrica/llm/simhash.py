"""SimHash near-dedup with multi-index hashing.

Fingerprint: 64 bits; a bit is 1 if it is set in over half the XXH64 values
(seed 42) of a text's word shingles.  Two fingerprints link if they differ in
`radius` = 3 bits or fewer.  Of their two 32-bit halves one then differs in one
bit at most, so each distinct fingerprint looks up the 33 values of that small
ball in the table of the others' halves, and whole distances verify the matches.
Buckets that hold very many fingerprints are divided by the bytes of the other
half (of four bytes that differ in three bits, one is equal), and then by six of
the 24 bits left.  Equal fingerprints are one node, so exact copies never make
pairs; a fingerprint has 43,744 others within three bits at most, however large
its group.

Nulls: a null or blank text has no shingle and fingerprint zero, which links
like any other.  A null id keeps its row and is never a component's id unless
no other is there.  Repeated rows stay.  An empty table gives an empty result.
A very long text is a block of its own.  Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, blocks, digest, free, in_bitmap, kept, named, scratch, shuffled, stash, table, utf8
from .components import connected_components
from .decontamination import grams, word_hashes

SEED = 42
HALF = 0xFFFFFFFF
#: Blanks are between words, A-Z become a-z, the byte 0 is a letter like any other.
BLANKS = np.array([0 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b or 1 for b in range(256)], np.uint8)
#: A byte -> 8 lanes of 8 bits, of which each holds one bit: 255 of them can be added before a lane runs over.
LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def shingles(text: bytes, words: int) -> list[bytes]:
    """A-Z lower-cased runs of non-blank characters, joined by spaces; fewer words make one shingle, none make none."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return [b" ".join(x) for x in zip(*(found[i:] for i in range(words)), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = LANES[np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(kept: list[str], text_col: str, words: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64 = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
            out, least = [], []
            for start, stop in blocks(np.diff(offsets)):
                raw = data[offsets[start] : offsets[stop]].tobytes()
                for i in range(start, stop):
                    found = shingles(raw[offsets[i] - offsets[start] : offsets[i + 1] - offsets[start]], words)
                    hashes = np.array([hash64(x, SEED) for x in found], np.uint64)
                    out.append(majority(hashes))
                    if sketch:
                        least.append(np.unique(hashes)[:sketch].view(np.int64))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            new = {"fp": pa.array(np.array(out, np.uint64).view(np.int64))}
            if sketch:
                new["sketch"] = pa.array(least, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*own, *new.values()], names=[*kept, *new])

    return run


def simhash(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, extra: tuple[str, ...] = (), sketch: int = 0,
) -> DataFrame:
    """id_col, the columns in `extra`, fp (the fingerprint as a signed long) and, if asked for, sketch (the smallest distinct
    hashes of shingles)."""
    kept = [id_col, *extra]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in kept] + [T.StructField("fp", T.LongType())]
    if sketch:
        fields.append(T.StructField("sketch", T.ArrayType(T.LongType())))
    columns = dict.fromkeys([*kept, text_col])
    return docs.select(*map(named, columns)).mapInArrow(_fingerprints(kept, text_col, words, sketch), T.StructType(fields))


def _half(which, fp="fp"):
    """Bits 32 to 63 for 1, bits 0 to 31 for 0, below a mark that tells which."""
    high = F.shiftrightunsigned(fp, 32)
    low = F.col(fp).bitwiseAND(F.lit(HALF))
    return F.when(which == 1, high.bitwiseOR(F.lit(1 << 32))).otherwise(low)


def near_pairs(fps: DataFrame, radius: int = 3, crowded: int = 200) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints of the column fp that differ in `radius` bits or fewer.

    radius: 0 to 3.  crowded: a half that more fingerprints share is looked up by a byte of the other half as well, and
    where that is crowded, too, by six of the 24 bits left.  Four parts of which three bits differ have one that is equal.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves and balls of one bit find distances up to 3")
    fps = fps.select("fp").distinct()
    halves = fps.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), "fp").select(_half(F.col("which")).alias("key"), "which", "fp")
    probe = fps.select(F.explode(F.sequence(F.lit(0), F.lit(65))).alias("j"), "fp").select(
        (F.col("j") % 2).alias("which"), F.expr("CAST(j DIV 2 AS INT)").alias("bit"), "fp")
    probe = probe.select(
        _half(F.col("which")).bitwiseXOR(F.when(F.col("bit") == 32, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)"))).alias("key"),
        "which", F.col("fp").alias("other"))
    whole = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("left"))

    def by_byte(df: DataFrame, fp: str) -> DataFrame:
        """Rows four times, with one byte of the other half each and the 24 bits that are left."""
        rest = F.when(F.col("which") == 1, F.col(fp)).otherwise(F.shiftrightunsigned(fp, 32)).bitwiseAND(F.lit(HALF))
        parts = F.array(*(F.struct(
            (F.shiftrightunsigned(rest, 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * (i + 1))).cast("long").alias("part"),
            rest.bitwiseAND(F.lit((1 << 8 * i) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(rest, 8 * (i + 1)), 8 * i)).cast("long").alias("left")) for i in range(4)))
        cut = F.when(F.col("hot"), parts).otherwise(F.array(whole)) if "hot" in df.columns else parts
        return df.select("key", F.explode(cut).alias("p"), fp).select("key", "p.part", "p.left", fp)

    hot = stash(halves.groupBy("key").count().where(F.col("count") > crowded).select("key", F.lit(True).alias("hot")), "crowded-halves")
    hotter = by_byte(halves.join(hot.select("key"), "key", "left_semi"), "fp").groupBy("key", "part").count()
    hotter = stash(hotter.where(F.col("count") > crowded).select("key", "part", F.lit(True).alias("hotter")), "crowded-bytes")

    def dealt(df: DataFrame, fp: str) -> DataFrame:
        cut = by_byte(df.join(hot, "key", "left"), fp).join(hotter, ["key", "part"], "left")
        sixes = F.array(*(F.shiftrightunsigned("left", 6 * i).bitwiseAND(F.lit(63)) + F.lit(64 * (i + 1)) for i in range(4)))
        return cut.select("key", "part", F.explode(F.when(F.col("hotter"), sixes).otherwise(F.array(F.lit(0).cast("long")))).alias("six"), fp)

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    found = dealt(halves, "fp").join(shuffled(dealt(probe, "other")), ["key", "part", "six"]).where((F.col("other") < F.col("fp")) & near)
    return found.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, extra: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the smallest id that links reach from the row, its own included),
    component (the same class as a number that no class shares), and the columns in `extra`."""
    rows = stash(simhash(docs, id_col, text_col, words, extra), "fingerprints")
    with scratch(docs.sparkSession):
        fps = stash(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
        linked = connected_components(near_pairs(fps, radius), "a", "b")
        classes = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        best = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = kept(classes.join(best, "component").select("fp", "component", "component_id"), "classes")
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(shuffled(classes), "fp").select(id_col, fingerprint, "component_id", "component", *extra)


#: Bits (as a power of two) of the filter by which tasks leave out what is in no candidate pair.
FILTER_BITS = 24
#: Bounds of sizes give way by so much, so that rounding loses no pair.
ROUNDING = 1e-6


def _prefixes(kept: list[str], text_col: str, words: int, prefix):
    """n, the number of distinct shingles of each text, and their hashes: all, rising, or a prefix.  Fewer words make one shingle.

    prefix: a likeness, and frequent hashes with their counts as a broadcast; rarest first, as many hashes as one of must be
    shared by texts that are so alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = prefix[1].value if prefix else (np.empty(0, np.uint64), None)

        def first(own: np.ndarray) -> np.ndarray:
            if len(often):
                at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                own = own[np.argsort(np.where(often[at] == own, times[at], 0), kind="stable")]
            return own[: len(own) - math.ceil(prefix[0] * len(own) - ROUNDING) + 1]

        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text_col)), words)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            found = [(first(x) if prefix else x).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(len, sets)), pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=[*kept, "n", "shingles"])

    return run


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, rising."""
    data, offsets = utf8(column)
    out = []
    for start, stop in blocks(np.diff(offsets)):
        found, bounds = word_hashes(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], BLANKS)
        hashes = grams(found, words)
        out += [np.unique(hashes[a : b - words + 1] if b - a >= words else grams(found[a:b], int(b - a)) if b > a else hashes[:0]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def _with_prefixes(docs: DataFrame, kept: list[str], words: int, prefix=None) -> DataFrame:
    fields = [T.StructField(c, docs.schema[c].dataType) for c in kept]
    schema = T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return docs.select(*kept, "text").mapInArrow(_prefixes(kept, "text", words, prefix), schema)


def _wanted(bits):
    """The rows whose first column (a long) has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(0).to_numpy())))

    return run


def _compare(words: int, least: float):
    """The pairs (a, b) whose texts x and y have the likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            good = []
            for x, y in zip(shingle_sets(at("x"), words), shingle_sets(at("y"), words), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common) - ROUNDING)
            yield pa.RecordBatch.from_arrays([at("a"), at("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_texts(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with their texts x and y; only texts of pairs move."""
    spark = docs.sparkSession
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(texts.select("node", "key"), "node")
    some = stash(some, "wanted")
    bits = spark.sparkContext.broadcast(bitmap(some.select(F.xxhash64("key").alias("k")), "k", FILTER_BITS))
    found = docs.select(F.xxhash64("key").alias("k"), "key", "text")
    found = found.mapInArrow(_wanted(bits), found.schema).groupBy("key").agg(F.first("text").alias("text"))
    found = stash(found.join(shuffled(some), "key").select("node", "text"), "texts-of-candidates")
    of = lambda end, name: shuffled(found.select(F.col("node").alias(end), F.col("text").alias(name)))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")


def _alike(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose whole shingle sets have the likeness `least`; each candidate's text moves, no other."""
    with scratch(docs.sparkSession):
        pairs = stash(pairs, "candidates")
        return kept(_with_texts(docs, texts, pairs).mapInArrow(_compare(words, least), pairs.schema), "alike")


def _quick_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) that draw large groups together: each text looks up the hashes of its sketch, and a bucket's texts meet
    its representatives (up to four, those whose sketches are most shared: the middle of a group of edits), so a bucket costs
    no more than its size.  Sketches that share less than three eighths are left.  What is missed here the exact join finds."""
    each = texts.select(F.col("node").alias("t"), F.explode("sketch").alias("h"))
    sizes = each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    each = stash(each.join(shuffled(sizes), "h"), "buckets")
    scores = each.groupBy("t").agg(F.sum("size").alias("score"))
    scored = each.join(shuffled(scores), "t").select("h", "t", "score")
    best = scored.groupBy("h", F.pmod(F.hash("t"), F.lit(4)).alias("part")).agg(F.max(F.struct("score", "t")).alias("m")).select("h", F.col("m.t").alias("r"))
    met = scored.join(shuffled(best), "h").where("t != r")
    pairs = met.select(F.least("t", "r").alias("a"), F.greatest("t", "r").alias("b")).distinct()
    of = lambda end, name: shuffled(texts.select(F.col("node").alias(end), F.col("sketch").alias(name)))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(
        F.size(F.array_intersect("x", "y")) >= 0.375 * (least / 0.8) * F.least(F.size("x"), F.size("y"))).select("a", "b")


def _frequent(docs: DataFrame, words: int, share: int = 64, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, rising, that several texts of a sample have, and in how many; at most the `most` most frequent.

    They set the order in which shingles are looked up, and so the cost.  Which pairs are found does not rest on them.
    """
    sample = _with_prefixes(docs.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0), ["key"], words).dropDuplicates(["key"])
    counted = stash(sample.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "frequent")
    floor, left = 1, most
    for c, n in sorted(map(tuple, counted.groupBy("c").count().collect()), reverse=True):
        left -= n
        if left < 0:
            floor = c
            break
    found = counted.where(F.col("c") > floor).toArrow()
    hashes = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["c"].to_numpy()[order]


def _postings(bits):
    """(h, t, c, n) for each hash of a prefix that has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("shingles"))
            counts = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(counts)), counts)
            good = in_bitmap(bits.value, flat)
            t, c, n = (batch.column(batch.schema.get_field_index(x)).to_numpy()[row[good]] for x in ("node", "c", "n"))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (flat[good], t, c, n))), names=["h", "t", "c", "n"])

    return run


#: A shingle that more prefixes share is looked up by what their texts have apart from one of them.
CROWDED = 256


def _whole_pairs(docs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Candidates (a, b) that link all that pairs of likeness `least` in two classes (the column c of texts) link.

    A prefix filter: with all shingles in one order, rarest first, two sets that are so alike share one of the first
    n - least * n + 1 of each.  What they share beyond lies after one of the two prefixes, so what the prefixes share and
    what is left of a set after its prefix add up to the overlap that the likeness asks for.  A pair is a candidate only
    where that holds: of two equally large sets nearly half of the prefixes must be common.
    Only hashes that two classes share are dealt out with their texts.  Where more than CROWDED prefixes share one, it is
    cut into parts by size, each of two neighbouring ranges (sizes so alike lie in one or in two neighbours).  Where a part is
    crowded still, pairs are not made by it but by _crowded_pairs; for a pair in none of these all that the prefixes share counts.
    """
    spark = docs.sparkSession
    prefix = least, spark.sparkContext.broadcast(_frequent(docs, words))
    rows = _with_prefixes(docs, ["key"], words, prefix).groupBy("key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    rows = stash(rows.join(shuffled(texts.select("key", "node", "c")), "key").select("node", "c", "n", "shingles"), "prefixes")
    mixed = rows.select("c", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("h")
    mixed = stash(mixed, "mixed")
    bits = spark.sparkContext.broadcast(bitmap(mixed, "h", FILTER_BITS))
    shared = rows.mapInArrow(_postings(bits), "h long, t long, c long, n int").join(shuffled(mixed), "h", "left_semi")
    shared = stash(shared, "shared-prefixes")
    crowd = shared.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > CROWDED)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / least) if 0 < least < 1 else 1.0) + ROUNDING)
    dealt = shared.join(crowd, "h", "left").withColumn("band", band)
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array("band", F.col("band") + 1))))
    parts = dealt.where("part >= 0").groupBy("h", "part").agg(F.count("*").alias("of")).where(F.col("of") > CROWDED).select("h", "part")
    parts = stash(parts, "crowded-shingles")
    few = dealt.join(parts, ["h", "part"], "left_anti")
    other = few.select("h", "part", *(F.col(c).alias(f"{c}_") for c in ("t", "c", "n", "band")))
    met = few.join(shuffled(other), ["h", "part"]).where((F.col("t") < F.col("t_")) & (F.col("c") != F.col("c_")) & ((F.col("part") < 0) | (F.col("part") == F.greatest("band", "band_"))))
    met = met.where(F.least("n", "n_") >= least * F.greatest("n", "n_") - ROUNDING).groupBy("t", "t_", "n", "n_").agg(F.count("*").alias("common"))
    after = lambda n: F.ceil(least * F.col(n) - ROUNDING) - 1  # noqa: E731  the shingles after the prefix
    wanted = least / (1 + least) * (F.col("n") + F.col("n_"))
    met = met.where(F.col("common") + F.greatest(after("n"), after("n_")) >= wanted - ROUNDING).select(F.col("t").alias("a"), F.col("t_").alias("b"))
    return met if parts.isEmpty() else met.union(_crowded_pairs(docs, texts, dealt.join(parts, ["h", "part"]), words, least)).distinct()


def _differences(words: int):
    """n, d and the hashes that just one of the texts x and y has, of each pair (a, b); n is the number of those of x, d that of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            sets, others = shingle_sets(at("x"), words), shingle_sets(at("y"), words)
            apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(sets, others, strict=True)]
            columns = [at("a"), at("b"), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(len, apart)), pa.int32()), pa.array(apart, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "d", "apart"])

    return run


def _crowded_pairs(docs: DataFrame, texts: DataFrame, postings: DataFrame, words: int, least: float) -> DataFrame:
    """Candidates (a, b) among which are, or which link as well as, all pairs of likeness `least` that share one of the crowded hashes.

    postings: (h, part, t, c, n, size).  The texts of a hash and part have one text r of theirs as reference, that with the
    most crowded hashes: the middle of a group of edits.  What two sets do not have in common is what their differences from r
    do not have in common, and it may be `spare` = (1 - least) / (1 + least) of their sizes together.  With slack = spare * n - d
    (d: the size of a difference), two differences must share -(slack + slack') / 2.  r has the largest slack, so of two texts
    that need share nothing both are linked to r, and each text that is linked to r meets only others that are not.  The rest
    meet by what their differences share, rarest first, and only as far in this order as enough may still be common: what is
    left of a list tells the least slack of the other text.  Slacks are cut into levels, finer near zero, so that two texts
    meet where each is within the other's reach.
    """
    spare = (1 - least) / (1 + least)
    scores = postings.groupBy("t").agg(F.sum("size").alias("score"))
    scored = postings.join(shuffled(scores), "t")
    best = scored.groupBy("h", "part").agg(F.max(F.struct("score", "t")).alias("m")).select("h", "part", F.col("m.t").alias("b"))
    pairs = stash(scored.join(shuffled(best), ["h", "part"]).select(F.col("t").alias("a"), "b").distinct(), "references")
    apart = _with_texts(docs, texts, pairs).mapInArrow(_differences(words), "a long, b long, n int, d int, apart array<long>")
    apart = apart.join(texts.select(F.col("node").alias("a"), "c"), "a").withColumn("slack", spare * F.col("n") - F.col("d"))
    heads = apart.where("a = b").select("b", F.col("c").alias("own"), F.col("slack").alias("top"))
    apart = apart.join(heads, "b").withColumn("near", F.col("slack") + F.col("top") >= -4 * ROUNDING)
    # those that are linked to r are of its class
    apart = stash(apart.withColumn("k", F.when(F.col("near"), F.col("own")).otherwise(F.col("c"))), "differences")
    links = apart.where("near AND c != own").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    each = apart.select("b", "a", "k", F.explode("apart").alias("e"))
    mixed = each.groupBy("b", "e").agg(F.count("*").alias("times"), F.min("k").alias("x"), F.max("k").alias("y")).where("x != y").select("b", "e", "times")
    # what only one class has comes first, and leads nowhere
    listed = each.join(shuffled(mixed), ["b", "e"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("found"))
    listed = apart.drop("apart").join(shuffled(listed), ["b", "a"]).select("*", F.posexplode("found").alias("i", "f"))
    left = F.size("found") - F.col("i")  # hashes from this one on
    level = lambda slack: F.floor(2 * F.asinh(slack / 8)).cast("int")
    most = F.when(F.col("near"), -F.col("top")).otherwise(F.col("top"))  # who is linked to r meets only those that are not
    reach = listed.select("b", "f.e", F.col("a").alias("t"), "k", "n", "slack", "near", left.alias("left"), level(F.col("slack")).alias("own"),
                          level(-F.col("slack") - 2 * left - 4 * ROUNDING).alias("low"), level(most + 4 * ROUNDING).alias("high")).where("low <= high")
    reach = reach.select("b", "e", "t", "k", "n", "slack", "near", "left", "own", F.explode(F.sequence("low", "high")).alias("at"))
    reach = stash(reach, "reaches")
    other = reach.select("b", "e", F.col("own").alias("at"), F.col("at").alias("own"), *(F.col(c).alias(f"{c}_") for c in ("t", "k", "n", "slack", "near", "left")))
    met = reach.join(shuffled(other), ["b", "e", "own", "at"]).where((F.col("t") < F.col("t_")) & (F.col("k") != F.col("k_")) & ~(F.col("near") & F.col("near_"))
        & (F.least("n", "n_") >= least * F.greatest("n", "n_") - ROUNDING) & (2 * F.least("left", "left_") >= -F.col("slack") - F.col("slack_") - 4 * ROUNDING))
    return links.union(met.select(F.col("t").alias("a"), F.col("t_").alias("b")))


def text_groups(docs: DataFrame, words: int = 5, radius: int = 3, least: float = 0.8, sketch: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (id, key: equal for equal texts, text): rows (id, key, fp), texts (key, node), one row per key, and groups (node, component).

    Links: fingerprints within `radius` bits, and whole shingle sets of which at least the share `least` of all distinct
    shingles is common to both; enough of these that they link what all such pairs link.

    Fingerprints of 64 bits lie about 10 bits apart at a likeness of 0.8, too far for small balls, so further candidates
    come from shared shingles.  Quick ones draw large groups together first; then an exact join finds every pair between
    two of the groups so far.  Pairs inside one group link nothing more, so a group's square is never made.
    """
    spark = docs.sparkSession
    rows = stash(simhash(docs, "id", "text", words, ("key",), sketch), "fingerprints")
    one = rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    texts = stash(one.withColumn("node", F.monotonically_increasing_id()), "texts")
    with scratch(spark):
        # the texts of one fingerprint hang on the first of them
        heads = stash(texts.groupBy("fp").agg(F.min("node").alias("head")), "distinct-fingerprints")
        equal = texts.join(heads, "fp").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        near = near_pairs(heads, radius)
        near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(
            heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
        links = stash(equal.union(near), "links")
        quick = _alike(docs, texts, _quick_pairs(texts, least), words, least)
        classes = connected_components(links.union(quick), "a", "b")
        classed = stash(texts.select("key", "node").join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "classes")
        whole = _alike(docs, texts, _whole_pairs(docs, classed, words, least), words, least)
        stars = classed.where("node != c").select(F.col("node").alias("a"), F.col("c").alias("b"))
        linked = kept(connected_components(stars.union(whole), "a", "b"), "groups")
    return rows, texts.select("key", "node"), linked


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, least: float = 0.8) -> DataFrame:
    """The rows of docs, one of each group: that with the smallest id; of several with that id one, whichever text they have.

    Groups: what links of fingerprints (`radius` bits) and of whole shingle sets (likeness `least`) reach.
    Texts are told apart by 128-bit digests; a null text counts as empty.  Other columns may have any name.
    """
    mark, other, own = free(docs.columns, "text_key", "kept_key", "kept_id")
    keyed = docs.select(named(id_col).alias("id"), digest(named(text_col)).alias("key"), named(text_col).alias("text"))
    with scratch(docs.sparkSession):
        rows, texts, linked = text_groups(keyed, words, radius, least)
        # per text, then per group: the first row by id (null last), then by text; whether it is there more than once
        rank = F.struct(F.col("id").isNull(), F.col("id"))
        first = rows.groupBy("key", "id").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by(F.struct("id", "n"), rank).alias("first"))
        groups = first.join(texts, "key").join(linked, "node", "left").select("key", "first.*", F.coalesce("component", "node").alias("component"))
        order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
        best = groups.groupBy("component").agg(F.min_by(F.struct("id", "key", "n"), order).alias("k"))
        best = kept(best.select(F.col("k.id").alias(own), F.col("k.key").alias(other), (F.col("k.n") > 1).alias("repeated")), "kept")
    marked = docs.withColumn(mark, digest(named(text_col)))
    same = named(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other))
    out = marked.join(best.where("NOT repeated"), same, "left_semi")
    if best.where("repeated").limit(1).count():
        out = out.unionByName(marked.join(best.where("repeated"), same, "left_semi").dropDuplicates([id_col, mark]))
    return out.drop(mark)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dedup(table(spark, sf_dir, "documents")).drop("component")
