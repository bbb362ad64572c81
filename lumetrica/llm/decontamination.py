"""Benchmark decontamination by winnowing.

Words are A-Z lower-cased runs of ASCII letters, digits and all other non-ASCII
characters.  Over the word hashes of a text go k-gram hashes (k = 5), and of
every w = window - k + 1 of them in a row the smallest is kept, the rightmost of
equal ones.  Two texts that share `window` = 10 words then share a kept hash at
the same place of that span, so no such span is missed.  An item of fewer words
than a window is one window of its own length: there each k-gram of that length
is kept (w = 1).

A kept hash carries its surroundings: the words that any window around it can
have, that is window - k before its k-gram and as many after.  Kept hashes of
documents and of the benchmark are joined by hash on the executors, and each hit
is extended along both surroundings to the whole run of equal words; runs of at
least a window mark the document's words.  Equal surroundings in one text are
looked up once, with the list of their places, so a text of one repeated word
costs its length.  A bitmap of the benchmark's kept hashes (its size is fixed,
whatever the benchmark) spares the join what cannot match; documents of which
nothing passes it are done in the first pass and never shuffled.

Words are compared by 64-bit hashes.

Nulls: a null text has no words.  An item without words has no window.  A null
item_id counts as the empty one.  An id on several items counts once in the lists; repeated
documents each give a row.  An empty benchmark leaves every document clean, an
empty table gives an empty result.  A very long text is one row of its task and
of the rows that are joined back.  Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, blocks, free, in_bitmap, named, shuffled, stash, table, utf8

#: Bits (as a power of two) of the filter.
FILTER_BITS = 24
#: Bytes that belong to no word become 0; A-Z become a-z.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
RANDOM = np.random.default_rng(20240229)
BYTE_HASH = RANDOM.integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and where each text's words begin (one bound more than texts).

    letters: what each byte stands for, 0 for bytes between words.
    """
    chars = letters[data]
    inside = chars != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    counts = np.concatenate([[0], np.cumsum(first)])
    bounds = counts[offsets]
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    chars, heads = chars[inside], np.flatnonzero(first[inside])
    lengths = np.diff(np.append(heads, len(chars)))
    place = np.arange(len(chars)) - np.repeat(heads, lengths)
    return mix(np.add.reduceat(BYTE_HASH[chars] * powers(int(lengths.max()))[place], heads)), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row, across the bounds of texts too."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i, p in enumerate(powers(k)):
        out += words[i : len(words) - k + 1 + i] * p
    return mix(out)


def winnow(words: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the places of their first words; the texts' words lie one after the other."""
    hashes = grams(words, k)
    w = window - k + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least, at = hashes[:n].copy(), np.zeros(n, np.int8)
    for i in range(1, w):
        other = hashes[i : i + n]
        better = other <= least  # on a tie the right one
        np.copyto(least, other, where=better)
        at[better] = i
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :])
    mark = np.zeros(len(hashes), bool)
    mark[whole + at[whole]] = True
    places = np.flatnonzero(mark)
    return hashes[places], places


def kept_places(words: np.ndarray, bounds: np.ndarray, k: int, window: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The kept hashes for windows of `size` words, told apart by size, their places, and how many words a surrounding
    has on each side.  Only items of `window` words or more have k-grams shorter than their window."""
    own_k = k if size == window else size
    hashes, places = winnow(words, bounds, own_k, size)
    return mix(hashes ^ np.uint64(size)), places, size - own_k


def surroundings(words: np.ndarray, bounds: np.ndarray, places: np.ndarray, reach: int, length: int) -> np.ndarray:
    """(places, length): the words from place - reach on; 0 beyond the text's ends."""
    text = np.searchsorted(bounds, places, "right") - 1
    at = places[:, None] - reach + np.arange(length)
    inside = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None])
    return np.where(inside, words[np.clip(at, 0, max(0, len(words) - 1))], 0).view(np.int64)


def _item_postings(k: int, window: int):
    """(size, hash, around, item) of every kept hash; size: the item's words, `window` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for start, stop in blocks(np.diff(offsets)):
                words, bounds = word_hashes(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
                sizes = np.minimum(np.diff(bounds), window)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    hashes, places, reach = kept_places(words, bounds, k, window, size)
                    text = np.searchsorted(bounds, places, "right") - 1
                    own = sizes[text] == size
                    hashes, places, text = hashes[own], places[own], text[own]
                    around = surroundings(words, bounds, places, reach, size + reach)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(places), size, np.int32)), pa.array(hashes.view(np.int64)),
                        pa.array(list(around), pa.list_(pa.int64())), ids.take(pa.array(start + text))], names=["size", "hash", "around", "item"])

    return run


_CANDIDATE = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("around", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def _candidates(words: np.ndarray, bounds: np.ndarray, sizes: list[int], bits: np.ndarray, k: int, window: int) -> dict[int, list[dict]]:
    """By text: kept hashes that pass the filter, each distinct surrounding once, with its places in the text."""
    out: dict[int, list[dict]] = {}
    for size in sizes:
        hashes, places, reach = kept_places(words, bounds, k, window, size)
        good = in_bitmap(bits, hashes) if len(hashes) else np.zeros(0, bool)
        hashes, places = hashes[good], places[good]
        if not len(places):
            continue
        text = np.searchsorted(bounds, places, "right") - 1
        around = surroundings(words, bounds, places, reach, size + reach)
        keys = np.concatenate([text[:, None], hashes.view(np.int64)[:, None], around], axis=1)
        order = np.lexsort((places, *keys.T[::-1]))
        heads = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            i = order[a]
            out.setdefault(int(text[i]), []).append(
                {"size": size, "hash": int(hashes.view(np.int64)[i]), "around": around[i].tolist(), "places": (places[order[a:b]] - bounds[text[i]]).tolist()})
    return out


def _first_pass(state, text_col: str, names: list[str], new: list[str], candidates: bool):
    """The rows of which something passes the filter (with a number of their own and what passes), or the others, which are clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes, k, window = state.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
            n_words, found = [], []
            for start, stop in blocks(np.diff(offsets)):
                words, bounds = word_hashes(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
                own = _candidates(words, bounds, sizes, bits, k, window)
                n_words += np.diff(bounds).tolist()
                found += [own.get(i) for i in range(stop - start)]
            chosen = pa.array([bool(x) == candidates for x in found], pa.bool_())
            rows = batch.filter(chosen)
            n = pa.array(n_words, pa.int64()).filter(chosen)
            if candidates:
                uids = pa.array(uid + np.arange(len(rows)))
                uid += len(rows)
                more = [n, uids, pa.array([x for x in found if x], pa.list_(_CANDIDATE))]
            else:
                more = [n, pa.array([[]] * len(rows), pa.list_(pa.int64())), pa.array([[]] * len(rows), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*names, *new])

    return run


def _spans(names: list[str], n_words: str, held: str, hits: str, items: str, new_names: list[str]):
    """The merged spans (start, stop, start, ...) of a candidate's hits: numbers of its surroundings, and runs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            spans, listed = [], []
            for n, own, met, ids in zip(at(n_words).to_pylist(), at(held).to_pylist(), at(hits).to_pylist(), at(items).to_pylist(), strict=True):
                change = np.zeros(n + 1, np.int64)
                for hit in met or []:
                    around = own[hit["c"]]
                    begins = np.array(around["places"]) + hit["first"]
                    np.add.at(change, begins, 1)
                    np.add.at(change, begins + hit["run"], -1)
                mark = np.concatenate([[False], np.cumsum(change)[:n] > 0, [False]])
                spans.append(np.flatnonzero(mark[1:] != mark[:-1]))
                listed.append(ids or [])
            new = [at(n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(at, names), *new], names=[*names, *new_names])

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = 5, window: int = 10, names: tuple[str, str, str] = ("_words", "_spans", "_items"),
) -> DataFrame:
    """docs with three columns more, called `names`: how many words, (start, stop, start, ...) of hit words, and the ids of
    items with a hit window."""
    if not 1 <= k <= window:
        raise ValueError("a k-gram must fit the window")
    if clash := {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    spark = docs.sparkSession
    own = docs.columns
    items = benchmark.select(F.coalesce(named(item_col).cast("string"), F.lit("")).alias("item"), named(item_text).alias("text"))
    postings = items.mapInArrow(_item_postings(k, window), "size int, hash long, around array<long>, item string")
    postings = stash(postings.distinct(), "benchmark-fingerprints")
    sizes = sorted(r["size"] for r in postings.select("size").distinct().collect())  # `window` numbers at most
    state = spark.sparkContext.broadcast((bitmap(postings, "hash", FILTER_BITS), sizes, k, window))

    n_words, uid, held, hits, listed = free(own, "n_words", "uid", "held", "hits", "listed")
    fields = docs.schema.fields
    candidate = "array<struct<size:int,hash:bigint,around:array<bigint>,places:array<bigint>>>"
    schema = T.StructType([*fields, T.StructField(n_words, T.LongType()), T.StructField(uid, T.LongType()), T.StructField(held, T._parse_datatype_string(candidate))])
    some = stash(docs.mapInArrow(_first_pass(state, text_col, own, [n_words, uid, held], True), schema), "candidates")
    each = some.select(F.col(uid).alias("uid"), F.posexplode(held).alias("c", "x")).select("uid", "c", "x.size", "x.hash", "x.around")
    met = each.join(shuffled(postings.withColumnRenamed("around", "other")), ["size", "hash"])
    equal = F.array_join(F.zip_with("around", "other", lambda a, b: F.when((a == b) & (a != 0), "1").otherwise("0")), "")
    # a surrounding is shorter than two windows: one run of equal words at most is long enough, and it holds the k-gram
    met = met.select("uid", "c", "item", "size", equal.alias("equal")).withColumn("run", F.expr("regexp_extract(equal, concat('1{', size, ',}'), 0)"))
    met = met.where("run != ''").select("uid", "item", F.struct(
        "c", (F.instr("equal", F.col("run")) - 1 - (F.length("equal") - F.col("size"))).alias("first"), F.length("run").alias("run")).alias("hit"))
    found = met.groupBy("uid").agg(F.collect_set("hit").alias(hits), F.collect_set("item").alias(listed)).withColumnRenamed("uid", uid)
    joined = some.join(found, uid, "left").drop(uid)
    result = lambda a, b, c: T.StructType([*fields, T.StructField(a, T.LongType()), T.StructField(b, T.ArrayType(T.LongType())), T.StructField(c, T.ArrayType(T.StringType()))])
    clean = docs.mapInArrow(_first_pass(state, text_col, own, list(names), False), result(*names))
    return clean.unionByName(joined.mapInArrow(_spans(own, n_words, held, hits, listed, list(names)), result(*names)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    spans = find_contamination(docs.select(*dict.fromkeys([id_col, text_col])), benchmark, text_col, **options)
    hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("sign")),
                      lambda a, x: F.struct((a.s + a.sign * x).alias("s"), (-a.sign).alias("sign")), lambda a: a.s)
    items = F.array_sort(F.array_distinct("_items"))
    return spans.select(
        id_col, F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
