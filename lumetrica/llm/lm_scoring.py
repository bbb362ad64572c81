"""Language-model scores from a causal self-attention model, trained in numpy on subword ids.

Tokens of the base are A-Z lower-cased runs of non-blank characters and one end.
Spark counts them over all training texts; from the distinct words and their
counts come the counts of all subword ids (public tokenizer), over the whole
training corpus.  These fix the output classes of the model and the share of
each id in its class.

The model has one attention layer with positions as a bias by distance:
logits(class) = e W_e + softmax(q k + bias) v W_a + b, with e, q, k, v of the
ids so far, and p(id) = p(class) p(id in class).  It is trained on windows of
`SPAN` ids, one after the other, over every training text from its beginning to
its end; equal windows are one with a weight.

The result depends on the table alone, not on its files: a window's hash deals it
to one of `shards`, whose number follows from the count of all ids; the windows
of least hash (a bounded number) train a first model; from it each shard trains a
copy on its windows, sorted and then shuffled by the shard's number; the copies
are averaged by weight in whole numbers (fixed point), whose sum has no order.

Scoring cuts a text into chunks of `CHUNK` ids; a window is a chunk and the one
before it, of which the chunk's ids are scored, so every id is scored once with
CHUNK to 2 * CHUNK - 1 ids of context (fewer at a text's beginning).  Windows of
many texts go through masked attention in batches of one shape.

Words beyond the `common_words` most frequent ones (a bounded dictionary that
goes to the tasks) are joined with the counts by word, for the base scores; a
text gives each of them once, with its count.

Nulls: a null text counts as empty: one end.  A null id hashes as the empty
text.  Repeated rows each count and each give a row.  An empty table gives an
empty result; without training rows the model is that of the smoothing alone,
and the base score follows its formula (c = 0, N = 0, V = 0).  A very long text is
cut into windows like any other.  Only the id and the text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, id_bucket, stash, table, utf8
from .sentencepiece import default_model, model_bytes

CHUNK = 16
SPAN = 2 * CHUNK
WIDTH = 16
#: Classes: the most frequent ids alone, then bands of equal mass of ids that begin a word and of others.
ALONE, BANDS = 16, 16
#: Rows of the embedding: one for each of the most frequent ids, shared ones for the rest.
OWN_ROWS, SHARED_ROWS = 1536, 512
BOS, EOS = 1, 2
#: Distinct words that a task holds before it starts anew, some 150 bytes each: with fewer, frequent words are met and segmented again.
MOST_WORDS = 300_000


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


class Words:
    """Distinct words, each with a row in the order of first meeting (within a block in any order)."""

    def __init__(self, limit: int = MOST_WORDS):
        self.limit, self.row_of = limit, {}

    def full(self) -> bool:
        return len(self.row_of) > self.limit

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Give rows to words that have none; the new ones."""
        fresh = list(set(words).difference(self.row_of))
        self.row_of.update(zip(fresh, range(len(self.row_of), len(self.row_of) + len(fresh)), strict=True))
        return fresh

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))


def _blocks(batches: Iterator[pa.RecordBatch], text_col: str):
    """Batch, first and last row, and the texts' bytes, for blocks of rows."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
        for start, stop in blocks(np.diff(offsets), 1 << 19):
            raw, at = data[offsets[start] : offsets[stop]].tobytes(), (offsets[start : stop + 1] - offsets[start]).tolist()
            yield batch, start, stop, [raw[x:y] for x, y in zip(at, at[1:], strict=False)]


def _count_words(text_col: str, limit: int = MOST_WORDS):
    """(word, n) of a task's texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            for i in range(0, len(words), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.binary()), pa.array(n[part], pa.int64())], names=["word", "n"])

        for _, _, _, texts in _blocks(batches, text_col):
            for text in texts:
                counts.update(split(text))
            counts[b""] += len(texts)
            if len(counts) > limit:
                yield from out()
                counts.clear()
        yield from out()

    return run


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _pieces(processor, words: list[bytes]) -> list[list[int]]:
    """The ids of each word, marked as a word's beginning; the empty word is the end id."""
    out = processor.encode([x.decode("utf-8", "replace") for x in words], num_threads=1)
    return [x if word else [EOS] for x, word in zip(out, words, strict=True)]


def _count_pieces(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(model)
        counts = np.zeros(processor.vocab_size(), np.int64)
        for batch in batches:
            ids = _pieces(processor, batch.column(0).to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
            counts += np.bincount(flat, np.repeat(batch.column(1).to_numpy(), lengths), len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["piece", "n"])

    return run


class Vocabulary:
    """From the counts of all ids: embedding row, class, and log share in the class, of each id."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray, alpha: float = 0.5):
        mass = counts + alpha
        order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.row = np.where(rank < OWN_ROWS, rank, OWN_ROWS + np.arange(len(order)) % SHARED_ROWS).astype(np.int32)
        self.kind = np.empty(len(order), np.int32)
        self.kind[order[:ALONE]] = np.arange(min(ALONE, len(order)))
        rest = order[ALONE:]
        for flag in (0, 1):
            own = rest[begins[rest] == flag]
            if len(own):
                share = np.cumsum(mass[own]) / mass[own].sum()
                self.kind[own] = ALONE + flag * BANDS + np.minimum((share * BANDS).astype(np.int64), BANDS - 1)
        self.kinds = ALONE + 2 * BANDS
        total = np.bincount(self.kind, mass, self.kinds)
        self.inside = np.log(mass / total[self.kind]).astype(np.float32)
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)
        self.prior[total == 0] = -60.0  # a class that no id is in


SHAPES = {"E": (OWN_ROWS + SHARED_ROWS, WIDTH), "Wq": (WIDTH, WIDTH), "Wk": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH),
          "We": (WIDTH, ALONE + 2 * BANDS), "Wa": (WIDTH, ALONE + 2 * BANDS), "b": (ALONE + 2 * BANDS,), "near": (SPAN,)}
SIZE = sum(math.prod(x) for x in SHAPES.values())


def initial(prior: np.ndarray, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = {k: rng.normal(0, 0.3 if k == "E" else 0.25, x) for k, x in SHAPES.items()} | {"b": prior, "near": -0.05 * np.arange(SPAN)}
    return np.concatenate([np.ravel(parts[k]) for k in SHAPES]).astype(np.float32)


def parts_of(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one flat array."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = math.prod(shape)
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


APART = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
LATER = APART < 0
SCALE = np.float32(1 / math.sqrt(WIDTH))


class Room:
    """Arrays of the shapes of a batch, which every step fills anew: fresh ones may go back to the system after each step and be paged in again."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n or self.held[name].dtype != kind:
            self.held[name] = np.empty(n, kind)
        return self.held[name][:n].reshape(shape)


def gradient(flat: np.ndarray, rows: np.ndarray, kinds: np.ndarray, weights: np.ndarray | None = None, room: Room | None = None) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over windows: rows (windows, SPAN) of the ids read, kinds of the ids to come, -1 for none."""
    p, g, n, kind = parts_of(flat), np.zeros_like(flat), rows.size, flat.dtype
    d, space, width = parts_of(g), room or Room(), p["We"].shape[1]
    by_window = lambda x: x.reshape(*rows.shape, x.shape[-1])
    of, into, onto = rows.ravel().astype(np.intp), np.concatenate([p["Wq"] * SCALE, p["Wk"], p["Wv"]], axis=1), np.concatenate([p["We"], p["Wa"]])
    e = np.take(p["E"], of, axis=0, mode="clip", out=space("e", kind, n, WIDTH))
    qkv = by_window(np.matmul(e, into, out=space("qkv", kind, n, 3 * WIDTH)))
    q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    s = np.matmul(q, k.transpose(0, 2, 1), out=space("s", kind, *rows.shape, SPAN))
    s += np.where(LATER, np.float32(-1e9), p["near"][np.maximum(APART, 0)])
    np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s *= 1 / (s @ np.ones((SPAN, 1), kind))
    both = space("both", kind, n, 2 * WIDTH)
    both[:, :WIDTH] = e
    a = by_window(both)[:, :, WIDTH:]
    np.matmul(s, v, out=a)
    z = np.matmul(both, onto, out=space("z", kind, n, width))
    z += p["b"]
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    total = np.maximum(z @ np.ones(width, kind), 1e-30)
    own = kinds.ravel().astype(np.intp)
    share = (own >= 0).astype(kind)
    if weights is not None:
        share *= np.repeat(weights, SPAN)
    share /= max(1e-9, float(share.sum()))
    cells, at = z.reshape(-1), np.arange(n) * width + np.maximum(own, 0)
    loss = -float(np.log(np.maximum(cells[at] / total, 1e-30)) @ share)
    z *= (share / total)[:, None]
    cells[at] -= share
    d["We"][:], d["Wa"][:] = np.vsplit(both.T @ z, 2)
    d["b"][:] = np.ones(n, kind) @ z
    dboth = np.matmul(z, onto.T, out=space("dboth", kind, n, 2 * WIDTH))
    da = by_window(dboth)[:, :, WIDTH:]
    ds = np.matmul(da, v.transpose(0, 2, 1), out=space("ds", kind, *rows.shape, SPAN))
    ds -= np.einsum("ijk,ijk->ij", a, da)[:, :, None]
    ds *= s
    d["near"][:] = np.bincount(APART[~LATER], ds.sum(axis=0)[~LATER], SPAN)
    dqkv = space("dqkv", kind, n, 3 * WIDTH)
    for i, (x, y) in enumerate(((ds, k), (ds.transpose(0, 2, 1), q), (s.transpose(0, 2, 1), da))):
        np.matmul(x, y, out=by_window(dqkv)[:, :, i * WIDTH : (i + 1) * WIDTH])
    for name, x in zip(("Wq", "Wk", "Wv"), np.hsplit(e.T @ dqkv, 3), strict=True):
        d[name][:] = x
    d["Wq"] *= SCALE
    de = np.matmul(into, dqkv.T, out=space("de", kind, WIDTH, n))
    de += dboth[:, :WIDTH].T
    for i in range(WIDTH):
        d["E"][:, i] = np.bincount(of, de[i], len(d["E"]))
    return loss, g


def fit(
    flat: np.ndarray, rows: np.ndarray, kinds: np.ndarray, weights: np.ndarray, seed: int = 0, batch: int = 128, rate: float = 0.01,
    least_steps: int = 1, most_passes: int = 8,
) -> np.ndarray:
    """The parameters after Adam over the windows, at a rate that falls to a tenth; few windows are passed several times."""
    flat, m, s, step = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
    n = -(-len(rows) // batch)
    turns = max(1, min(most_passes, -(-least_steps // max(1, n))))
    rng, room = np.random.default_rng(seed), Room()
    for _ in range(turns):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            at = order[i : i + batch]
            _, g = gradient(flat, rows[at], kinds[at], weights[at], room)
            own = rate * (1 - 0.9 * step / (turns * n))
            step += 1
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            flat -= own * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return flat


class Ids:
    """Words of blocks of texts, and the ids of the words met so far."""

    def __init__(self, model: bytes):
        self.processor = _processor(model)
        self.clear()

    def clear(self) -> None:
        self.known = Words()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The row of each word (each text's with its end), the words of each text, and the words that are new."""
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = split(text)
            own.append(b"")
            counts[i] = len(own)
            words += own
        fresh = self.known.learn(words)
        if fresh:
            new = _pieces(self.processor, fresh)
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(new), np.int32, int(size.sum()))])
            self.lengths = np.concatenate([self.lengths, size])
        return self.known.rows(words), counts, fresh

    def ids(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        size = self.lengths[rows]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[rows] - ends + size, size) + np.arange(ends[-1])]
        return ids, np.add.reduceat(size, np.cumsum(counts) - counts)


#: What stands in a window where a text has ended.
NOTHING = 0xFFFF


def windows_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(windows, SPAN + 1): the id before (or BOS) and SPAN ids to come, over whole texts."""
    own = -(-counts // SPAN)
    heads = np.cumsum(counts) - counts
    place = np.arange(len(ids)) - np.repeat(heads, counts)
    row = np.repeat(np.cumsum(own) - own, counts) + place // SPAN
    out = np.full((int(own.sum()), SPAN + 1), NOTHING, np.uint16)
    out[row, place % SPAN + 1] = ids
    before = np.empty(len(ids), np.int64)
    before[1:], before[heads] = ids[:-1], BOS
    begins = place % SPAN == 0
    out[row[begins], 0] = before[begins]
    return out


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of bytes in a row, and how many each text has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<u2")[bounds[0] // 2 : bounds[-1] // 2], np.diff(bounds) // 2


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of whole texts as bytes, a block of texts at a time: windows_of takes some 40 bytes for each id of its texts."""
    for batch in batches:
        if not len(batch):
            continue
        ids, counts = _ids_of(batch.column(0))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for start, stop in blocks(counts, 1 << 18):
            found = windows_of(ids[bounds[start] : bounds[stop]], counts[start:stop])
            for i in range(0, len(found), 1 << 15):
                part = found[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([_as_bytes(part.ravel(), np.full(len(part), SPAN + 1))], names=["ids"])


def _as_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])


#: Parameters are averaged as multiples of this.
UNIT = 2.0**-24


def _learn(state, rate: float, least_steps: int):
    """Training on the windows of one shard: (slot, weight times the parameter as a whole number), and the weight under slot -1."""

    def run(own: pa.Table, shard: int) -> pa.Table:
        flat, words = state.value
        row_of, kind_of = np.zeros(NOTHING + 1, np.uint16), np.full(NOTHING + 1, -1, np.int8)
        row_of[: len(words.row)], kind_of[: len(words.kind)] = words.row, words.kind
        own = own.take(pc.sort_indices(own, [("ids", "ascending")])).combine_chunks()
        ids = _ids_of(own["ids"].chunk(0))[0].reshape(-1, SPAN + 1)
        rows, kinds = row_of[ids[:, :-1]], kind_of[ids[:, 1:]]
        found = fit(flat, rows, kinds, own["n"].to_numpy().astype(np.float32), shard, rate=rate, least_steps=least_steps).astype(np.float64)
        weight = len(rows)
        values = np.concatenate([[weight], np.rint(found / UNIT).astype(np.int64) * weight])
        return pa.table({"slot": pa.array(np.arange(-1, len(found)), pa.int32()), "value": pa.array(values.astype(np.int64))})

    return run


def _averaged(grouped, state, rate: float, least_steps: int) -> np.ndarray | None:
    """The mean of the copies that groups of windows (by shard) train; None without windows."""
    learn = _learn(state, rate, least_steps)
    copies = grouped.applyInArrow(lambda key, own: learn(own, key[0].as_py()), "slot int, value long")
    sums = copies.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = stash(sums, "copies").collect()  # SIZE + 1 rows; the windows' shuffle files go with the writing
    if not sums:
        return None
    values = {r["slot"]: int(r["value"]) for r in sums}
    return np.array([values[i] / values[-1] * UNIT for i in range(SIZE)], np.float32)


def summed(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums from each head to the next, of whole multiples of 2**-32, so that they do not depend on where a row stands in its batch."""
    return np.add.reduceat(np.rint(values.astype(np.float64) * 2.0**32).astype(np.int64), heads) / 2.0**32


class Scorer:
    """The trained model with its products per embedding row worked out."""

    def __init__(self, flat: np.ndarray, words: Vocabulary):
        p = parts_of(flat)
        self.words = words
        self.q = p["E"] @ p["Wq"] * SCALE
        # key, value and a one, which adds up to the softmax's denominator
        self.kv = np.concatenate([p["E"] @ p["Wk"], p["E"] @ p["Wv"], np.ones((len(p["E"]), 1), np.float32)], axis=1)
        self.direct = p["E"] @ p["We"] + p["b"]
        self.from_attention = np.ascontiguousarray(p["Wa"])
        # how large weights and logits can get: only beyond exp's range do they need to be held in it
        norm = lambda x: float(np.sqrt((x * x).sum(axis=1).max()))
        self.wide_weights = norm(self.q) * norm(self.kv[:, :WIDTH]) + float(np.abs(p["near"]).max()) > 60
        reach = np.abs(self.kv[:, WIDTH:-1]).max(axis=0) @ np.abs(p["Wa"])
        tops = self.direct.max(axis=1)
        self.wide_logits = float((self.direct + reach).max()) > 60 or float((tops - reach.max()).min()) < -60
        apart = np.arange(CHUNK)[:, None] + CHUNK - np.arange(SPAN)[None, :]
        self.bias = np.where(apart < 0, -1e9, p["near"][np.clip(apart, 0, SPAN - 1)]).astype(np.float32)

    def logs(self, ids: np.ndarray, counts: np.ndarray, batch: int = 64) -> np.ndarray:
        """The natural log probability of each text; ids of all texts in a row, each text's with its end.

        Attention weights and logits are held within exp's range; the classes' probabilities add up to one all the same.
        """
        if not len(counts):
            return np.zeros(0)
        chunks = -(-counts // CHUNK)
        heads, first = np.cumsum(counts) - counts, np.cumsum(chunks) - chunks
        place = np.arange(len(ids)) + np.repeat(first * CHUNK - heads, counts)
        before = np.empty(len(ids), ids.dtype)
        before[1:], before[heads] = ids[:-1], BOS
        n = -(-int(chunks.sum()) // batch) * batch  # batches of one shape, so that a text's score does not depend on its neighbours
        # a chunk of nothing stands before the first
        rows, kinds = np.zeros((n + 1) * CHUNK, np.intp), np.zeros(n * CHUNK, np.intp)
        rows[place + CHUNK], kinds[place] = self.words.row[before], self.words.kind[ids]
        rows, begins = rows.reshape(-1, CHUNK), np.zeros(n, bool)
        begins[first] = True
        out = np.empty(n * CHUNK, np.float32)
        take = lambda x, at: np.take(x, at, axis=0, mode="clip")
        lines, ones = np.arange(batch * CHUNK) * self.words.kinds, np.ones(self.words.kinds, np.float32)
        for a in range(0, n, batch):
            b = a + batch
            parts = take(self.kv, rows[a : b + 1])
            both = np.concatenate([parts[:-1], parts[1:]], axis=1)
            own = rows[a + 1 : b + 1]
            s = np.matmul(take(self.q, own), both[:, :, :WIDTH].transpose(0, 2, 1))
            s += self.bias
            s[begins[a:b], :, :CHUNK] = -1e9
            if self.wide_weights:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            mixed = np.matmul(s, both[:, :, WIDTH:])
            # a product for each chunk: rows of one large product round by their place in it
            z = np.matmul(mixed[:, :, :WIDTH] * (1 / mixed[:, :, WIDTH:]), self.from_attention).reshape(batch * CHUNK, -1)
            z += take(self.direct, own.ravel())
            if self.wide_logits:
                np.clip(z, -60, 60, out=z)
            own_kind = kinds[a * CHUNK : b * CHUNK]
            got = z.ravel()[lines[: len(z)] + own_kind]
            np.exp(z, out=z)
            out[a * CHUNK : b * CHUNK] = got - np.log(z @ ones)
        return summed(out[place] + self.words.inside[ids], heads)


def _encode(state, model: bytes, text_col: str, passed: list[str]):
    """The ids of each text, its base score by common words, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = state.value
        uid = TaskContext.get().partitionId() << 33
        names = [*passed, "uid", "n_tokens", "common_score", "common_known", "rare", "ids"]
        known, base, lists = Ids(model), np.zeros(0), []  # base: log10 of a common word's base probability, nan for others
        for batch, start, stop, texts in _blocks(batches, text_col):
            if known.known.full():
                known.clear()
                base, lists = np.zeros(0), []
            rows, counts, fresh = known.block(texts)
            base = np.concatenate([base, np.fromiter((common.get(x, math.nan) for x in fresh), np.float64, len(fresh))])
            lists += fresh
            ids, sizes = known.ids(rows, counts)
            heads = np.cumsum(counts) - counts
            found = base[rows]
            rare = np.isnan(found)
            sums = summed(np.where(rare, 0.0, found), heads)
            n_rare = np.add.reduceat(rare.astype(np.int64), heads)
            # each text's rare words once, with their counts
            pairs, times = np.unique(np.stack([np.repeat(np.arange(len(texts)), counts)[rare], rows[rare]]), axis=1, return_counts=True)
            bounds = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
            each = pa.StructArray.from_arrays([pa.array([lists[x] for x in pairs[1].tolist()], pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            own = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in passed]
            values = [pa.array(uid + np.arange(len(texts))), pa.array(counts), pa.array(sums), pa.array(counts - n_rare),
                      pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), _as_bytes(ids, sizes)]
            uid += len(texts)
            yield pa.RecordBatch.from_arrays([*own, *values], names=names)

    return run


def _score(state):
    """The last column (ids) gives way to the log10 probability of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = state.value
        for batch in batches:
            ids, counts = _ids_of(batch.column(batch.num_columns - 1))
            logs = [scorer.logs(ids[counts[:a].sum() : counts[:b].sum()].astype(np.intp), counts[a:b]) for a, b in blocks(counts, 1 << 18)]
            score = pa.array(np.concatenate([*logs, np.zeros(0)]) / math.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*batch.schema.names[:-1], "score"])

    return run


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts; the empty word is the end of a text."""
    return texts.select(text_col).mapInArrow(_count_words(text_col), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame, model: bytes) -> tuple[Vocabulary, int]:
    """The vocabulary of the words with their counts, and how many ids they have together."""
    processor = _processor(model)
    if processor.vocab_size() >= NOTHING:
        raise ValueError("ids must fit 16 bits")
    pieces = np.zeros(processor.vocab_size())
    found = counts.mapInArrow(_count_pieces(model), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    pieces[found["piece"].to_numpy()] = found["n"].to_numpy()
    begins = np.array([processor.id_to_piece(i).startswith("▁") for i in range(len(pieces))], np.int64)
    return Vocabulary(pieces, begins), int(pieces.sum())


def train(ids: DataFrame, words: Vocabulary, total: int, shard_windows: int = 1 << 17, first_windows: int = 1 << 14) -> Scorer:
    """A model of the texts; ids: one column, the ids of each text with its end as bytes; total: how many there are.

    shard_windows: windows of a shard, on average.  first_windows: how many windows, those of least hash, train the model
    that all shards start from; every window then trains in its shard.
    """
    spark = ids.sparkSession
    flat = initial(words.prior)
    shards = max(1, -(-total // (SPAN * shard_windows)))
    windows = ids.mapInArrow(_windows, "ids binary").withColumn("h", F.xxhash64("ids"))
    # so few hashes are below the mark that about twice as many windows as wanted pass before anything is shuffled
    share = min(1.0, 2 * first_windows * SPAN / max(1, total))
    some = windows.where(F.col("h") <= int(min(2**63 - 1, -(2**63) + share * 2**64))).groupBy("h", "ids").agg(F.count("*").alias("n"))
    some = some.orderBy("h", "ids").limit(first_windows).select(F.lit(0).alias("shard"), "ids", "n")
    first = _averaged(some.groupBy("shard"), spark.sparkContext.broadcast((flat, words)), 0.01, 400)
    if first is not None:
        each = windows.groupBy("h", "ids").agg(F.count("*").alias("n"))
        dealt = each.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "ids", "n")
        flat = _averaged(dealt.groupBy("shard"), spark.sparkContext.broadcast((first, words)), 0.004, 1)
    return Scorer(flat, words)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0, model_path: str | None = None,
    common_words: int = 200_000, **options,
) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score; crc32(id) modulo folds keeps `fold` out of training."""
    if not 1 <= common_words <= 1_000_000:
        raise ValueError("common_words bounds what goes to every task: 1 to 1,000,000")
    spark = docs.sparkSession
    model = model_bytes(model_path or default_model())
    rows = docs.select(F.col(id_col).alias("id"), (id_bucket(F.col(id_col), folds) == fold).alias("held_out"), F.col(text_col).alias("text"))
    counts = stash(word_counts(rows.where("NOT held_out").select("text")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    unit = total + 0.1 * (distinct + 1)
    top = counts.orderBy(F.desc("c"), "word").limit(common_words).toArrow()
    common = dict(zip(map(bytes, top["word"].to_pylist()), np.log10((top["c"].to_numpy() + 0.1) / unit).tolist(), strict=True))
    words, n_ids = vocabulary(counts, model)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("uid", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("common_score", T.DoubleType()), T.StructField("common_known", T.LongType()),
        T.StructField("rare", T._parse_datatype_string("array<struct<word:binary,n:bigint>>")), T.StructField("ids", T.BinaryType())])
    encoded = stash(rows.mapInArrow(_encode(spark.sparkContext.broadcast(common), model, "text", ["id", "held_out"]), schema), "encoded")
    scorer = spark.sparkContext.broadcast(train(encoded.where("NOT held_out").select("ids"), words, n_ids, **options))
    rare = encoded.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n").join(counts, "word", "left")
    base = F.col("n") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / F.lit(float(unit)))
    # decimals: their sums are the same in any order
    rare = rare.groupBy("uid").agg(F.sum(base.cast("decimal(30,12)")).cast("double").alias("rare_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    kept = encoded.select("id", "held_out", "uid", "n_tokens", "common_score", "common_known", "ids")
    scored = kept.mapInArrow(_score(scorer), T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    return scored.join(rare, "uid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return score(table(spark, sf_dir, "documents"))
