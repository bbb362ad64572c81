"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model where no piece holds a whitespace marker after another character, a
merge never crosses the place before a marker.  A text then falls into chunks
(markers, then what follows them) that are segmented one by one with the same
ids.  Each task keeps a table of the distinct chunks it has met: every distinct
chunk goes through the library once, and the ids come back to the texts by
position, with numpy.  A chunk's ids depend on nothing but the chunk, so each
task builds the part of the table that it needs; a shared table would shuffle
every occurrence of every word.  The table is emptied at ``max_chunks``.

A model whose pieces do cross markers, or which rewrites its input, is served by
the library on whole texts.

Nulls: a null text counts as empty: begin and end ids only, decoded to "".
Rows are mapped one by one: ties, repeats, null ids and other columns change
nothing, and an empty table gives an empty result.  A very long text is a block
of its own.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: A run of spaces and what follows it, or spaces at the end.
CHUNK = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def model_bytes(path: str) -> bytes:
    """The model's file; it goes along with the tasks (the files are under a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


class PieceTable(dict):
    """Chunk (without its first marker) -> its row in `starts` and `lengths`, which point into `flat`."""

    def __init__(self, model: bytes, max_chunks: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.max_chunks, self.fresh = max_chunks, []
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.by_chunk = (
            spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and not spec.precompiled_charsmap
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == 2  # BPE
            and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        )
        self.mark_id = self.processor.piece_to_id(MARK)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.size = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.fresh.append(chunk)
        return at

    def learn(self) -> None:
        """Segment the chunks met since the last call."""
        if not self.fresh:
            return
        first, new = len(self) - len(self.fresh), self.processor.encode(self.fresh, num_threads=1)
        for i, chunk in enumerate(self.fresh):
            if not chunk:  # one marker at a text's end; the library would see an empty text
                new[i] = [self.mark_id]
        self.fresh = []
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        total = int(lengths.sum())
        while len(self.starts) < len(self):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.flat) < self.size + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        ends = np.cumsum(lengths)
        self.lengths[first : len(self)] = lengths
        self.starts[first : len(self)] = self.size + ends - lengths
        self.flat[self.size : self.size + total] = np.fromiter((x for row in new for x in row), np.int32, total)
        self.size += total

    def join(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the chunks in these rows, one after the other."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, without begin and end, and how many each text has."""
        if not self.by_chunk:
            ids = self.processor.encode(texts, num_threads=1)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for row in ids for x in row), np.int32, int(counts.sum())), counts
        if len(self) > self.max_chunks:
            self.reset()
        chunks: list[str] = []
        n_chunks = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            text = text.replace(MARK, " ")
            if not text:
                continue
            if text[0] == " " or text[-1] == " " or "  " in text:
                # each chunk loses its first space: the library adds that marker itself
                own = [x[1:] for x in CHUNK.findall(" " + text)]
            else:
                own = text.split(" ")
            n_chunks[i] = len(own)
            chunks += own
        rows = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        self.learn()
        ends = np.concatenate([[0], np.cumsum(self.lengths[rows])])
        bounds = np.concatenate([[0], np.cumsum(n_chunks)])
        return self.join(rows), np.diff(ends[bounds])


def _tokens(model: bytes, id_col: str, text_col: str, outputs: list[str], max_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTable(model, max_chunks)
        processor = pieces.processor
        begin, end = np.int32(processor.bos_id()), np.int32(processor.eos_id())
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            key = batch.column(batch.schema.get_field_index(id_col))
            for start, stop in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK_BYTES):
                ids, counts = pieces.encode(texts[start:stop])
                parts = np.split(ids, np.cumsum(counts)[:-1])
                full = [np.concatenate([[begin], x, [end]]).astype("<u4") for x in parts]
                out = {id_col: key.slice(start, stop - start), "n_tokens": pa.array(counts + 2, pa.int64())}
                if "ids" in outputs:
                    out["ids"] = pa.array([x.astype(np.int32) for x in full], pa.list_(pa.int32()))
                if "ids_sha256" in outputs:
                    out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in full])
                if {"decoded", "decoded_sha256"} & set(outputs):
                    decoded = processor.decode([x.tolist() for x in full], num_threads=1)
                    if "decoded" in outputs:
                        out["decoded"] = pa.array(decoded, pa.string())
                    if "decoded_sha256" in outputs:
                        out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])
                yield pa.RecordBatch.from_arrays([out[c] for c in (id_col, "n_tokens", *outputs)], names=[id_col, "n_tokens", *outputs])

    return run


OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
    outputs: tuple[str, ...] = ("ids",), max_chunks: int = 400_000,
) -> DataFrame:
    """id_col, n_tokens (begin and end counted) and the outputs asked for: ids, ids_sha256, decoded, decoded_sha256.

    `decoded` is the library's decode() of the row's ids.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, OUTPUTS[c]) for c in outputs)])
    run = _tokens(model_bytes(model_path or default_model()), id_col, text_col, list(outputs), max_chunks)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))
