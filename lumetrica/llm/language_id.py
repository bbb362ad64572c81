"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to `orders` characters (lower-cased code points,
whole texts) of every labelled row in 2**bits buckets per language; Spark sums
the tasks' counts.  The matrix of log probabilities (languages x buckets) is
broadcast; its size is languages * 2**bits floats whatever the corpus.  More than `group`
labels are counted, broadcast and scored `group` at a time, and each text carries its best label and the
sum of its posteriors from group to group: memory keeps its bound and the result is the same, at a pass
for each group.  Batches are scored sparsely in numpy:
the rows of the matrix at a text's n-grams are added up per text.

The prediction has the largest posterior, by all n-grams of the text and the
prior.  The score is that posterior tempered: log likelihoods and log prior are
scaled down alike to `evidence` n-grams for longer texts, so that it says how
clear a text is rather than how long, and never points to another language.

Nulls: a null text, or one without a letter (as str.isalpha has it: no digits, fractions
or circled numbers), is "und" with score 0.  Rows
without a label or text teach nothing.  Without any labelled row every text is
"und".  Equal likelihoods go to the first language by name.  Repeated rows each
count and each give a row; other columns are never looked at and may have any
name but those of the two new ones (a parameter).  An empty table gives an empty
result.  A very long text is scored whole, in a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, free, id_bucket, table

FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, and the bounds of each."""
    low = [x.lower() for x in texts]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def buckets(chars: np.ndarray, owner: np.ndarray, orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams inside one text, and the texts they are in."""
    value = np.zeros(len(chars), np.uint32)
    for n in range(1, orders + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        value = (value[:m] ^ chars[n - 1 :]) * FACTORS[(n - 1) % len(FACTORS)] + np.uint32(n)
        slots = ((value ^ (value >> np.uint32(15))) * FACTORS[2]) >> np.uint32(32 - bits)
        if n == 1:
            yield slots, owner
        else:
            same = owner[:m] == owner[n - 1 :]
            yield slots[same], owner[:m][same]


def _texts(batches: Iterator[pa.RecordBatch], text_col: str, block: int = 1 << 18):
    """Blocks of texts, of about `block` characters: batch, start, stop, texts."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        for start, stop in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), block):
            yield batch, start, stop, texts[start:stop]


def _count(labels: list[str], text_col: str, label_col: str, orders: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = {x: i for i, x in enumerate(labels)}
        counts = np.zeros(len(labels) << bits, np.int64)
        for batch, start, stop, texts in _texts(batches, text_col):
            own = batch.column(batch.schema.get_field_index(label_col)).slice(start, stop - start).to_pylist()
            shift = np.array([row[x] for x in own], np.int64) << bits
            chars, bounds = code_points(texts)
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
            for slots, of in buckets(chars, owner, orders, bits):
                counts += np.bincount(slots + shift[of], minlength=len(counts))
        slots = np.flatnonzero(counts)
        for i in range(0, len(slots), 1 << 16):
            part = slots[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    return run


class Model:
    """Languages and the matrix of log probabilities, buckets x languages, with the log prior."""

    def __init__(self, labels: list[str], prior: np.ndarray, matrix: np.ndarray, orders: int, bits: int):
        self.labels, self.prior, self.matrix, self.orders, self.bits = labels, prior, matrix, orders, bits

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log likelihood with the prior of each text and language, and the number of each text's n-grams."""
        chars, bounds = code_points(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for slots, of in buckets(chars, owner, self.orders, self.bits):
            if len(of):
                heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                total[of[heads]] += np.add.reduceat(self.matrix[slots], heads, axis=0, dtype=np.float64)
                n += np.bincount(of, minlength=len(texts))
        return total + self.prior, n


def train(
    docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang",
    orders: int = 3, bits: int = 16, alpha: float = 0.5, group: int = 128,
) -> list[Model]:
    """Models of the rows where `learn` holds and label and text are there, each of `group` labels at most, in the order of labels."""
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias(label_col), text_col)
    known = rows.groupBy(label_col).count().orderBy(label_col).collect()  # a row for each label
    everything, out = sum(x[1] for x in known), []
    for start in range(0, len(known), group):
        labels, n = [x[0] for x in known[start : start + group]], np.array([x[1] for x in known[start : start + group]], np.float64)
        own = rows if len(known) <= group else rows.where(F.col(label_col).between(labels[0], labels[-1]))
        counted = own.mapInArrow(_count(labels, text_col, label_col, orders, bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(labels) << bits)
        found = counted.toArrow()  # at most group * 2**bits rows
        counts[found["slot"].to_numpy()] = found["n"].to_numpy()
        counts = counts.reshape(len(labels), -1) + alpha
        matrix = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
        out.append(Model(labels, np.log(n / everything), np.ascontiguousarray(matrix), orders, bits))
    return out


#: What a text carries from group to group: its best label, that one's total, and the log of the sum of all tempered posteriors.
CARRIED = (("label", "string"), ("total", "double"), ("mass", "double"))


def _score(model, kept: list[str], text_col: str, evidence: int, carried: list[str], begun: bool, new: list[str], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = model and model.value
        for batch, start, stop, texts in _texts(batches, text_col):
            at = lambda c: batch.column(batch.schema.get_field_index(c)).slice(start, stop - start)  # noqa: E731, B023
            letters = np.fromiter((any(map(str.isalpha, x)) for x in texts), bool, len(texts))
            label, total, mass, scale = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts))
            if own:
                totals, n = own.totals(texts)
                best = np.argmax(totals, axis=1)
                label, total = np.array(own.labels, object)[best], totals[np.arange(len(best)), best]
                scale = np.minimum(1, evidence / np.maximum(n, 1))
                mass = np.log(np.exp((totals - total[:, None]) * scale[:, None]).sum(axis=1)) + total * scale
            if begun:  # equal totals stay with the label before
                before = at(carried[1]).to_numpy(zero_copy_only=False)
                mass = np.logaddexp(mass, at(carried[2]).to_numpy(zero_copy_only=False))
                label, total = np.where(total > before, label, np.array(at(carried[0]).to_pylist(), object)), np.maximum(total, before)
            columns = [*map(at, kept)]
            if last:
                score = np.where(letters, np.clip(np.exp(total * scale - mass), 0, 1), 0.0) if own else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(letters, label, "und"), pa.string()), pa.array(score, pa.float64())], names=[*kept, *new])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(label, pa.string()), pa.array(total), pa.array(mass)], names=[*kept, *carried])

    return run


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", evidence: int = 30, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns more, called `names`: the language and its score."""
    if clash := {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    context, fields, carried = docs.sparkSession.sparkContext, docs.schema.fields, free(docs.columns, *(c for c, _ in CARRIED))
    between = T.StructType([*fields, *(T.StructField(c, T._parse_datatype_string(kind)) for c, (_, kind) in zip(carried, CARRIED, strict=True))])
    result = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    found = docs
    for i, model in enumerate(models or [None]):
        last = i + 1 >= len(models)
        held = model and context.broadcast(model)
        found = found.mapInArrow(_score(held, docs.columns, text_col, evidence, carried, i > 0, [*names], last), result if last else between)
    return found


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """docs with held_out, lang_pred, score: learnt from the labelled rows whose crc32(id) modulo `folds` is not `fold`."""
    held_out = id_bucket(F.col(id_col), folds) == fold
    model = train(docs, ~held_out, text_col, label_col, **options)
    return predict(docs.withColumn("held_out", held_out), model, text_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, id_bucket(F.col("doc_id"), 4) != 2)
    found = predict(docs.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
