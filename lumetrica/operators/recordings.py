"""Transforms of recordings of any length, held as blocks: rows of (ident, start, samples) with `size` samples each, the last of a recording fewer.

No step has a recording whole in one place.  Gains follow from a sample's place, its recording's length and id; a convolution is worked
out for each block and what reaches over its end is added to the blocks after it; frames see the first samples of the next block;
runs of quiet frames are joined at the borders of blocks; the energy that is left is summed from the last block on.
Each gives what the function of the same name in signals gives for the whole recording.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import signals as S

BLOCK = "ident string, start long, samples array<float>"


def in_blocks(rows: DataFrame, ident: str, samples: str, size: int) -> DataFrame:
    """Blocks of arrays (a recording that is read in pieces comes as blocks from its reader)."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(size)))
    cut = rows.where(F.col(samples).isNotNull()).select(F.col(ident).cast("string").alias("ident"), F.col(samples).cast("array<float>").alias("x"), starts.alias("start"))
    return cut.select("ident", F.col("start").cast("long").alias("start"), F.slice("x", F.col("start") + 1, size).alias("samples"))


def with_length(blocks: DataFrame) -> DataFrame:
    """blocks with `length`, that of their recording."""
    own = blocks.groupBy("ident").agg(F.max(F.col("start") + F.size("samples")).alias("length"))
    return blocks.join(own, "ident")


def _mapped(blocks: DataFrame, function, schema: str = BLOCK) -> DataFrame:
    """function(ident, start, samples, length) -> rows, over all blocks."""

    def run(batches):
        for batch in batches:
            out = [r for i, a, x, n in zip(batch["ident"], batch["start"], batch["samples"], batch["length"], strict=True) for r in function(i, int(a), np.asarray(x, np.float32), int(n))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return blocks.select("ident", "start", "samples", "length").mapInPandas(run, schema)


def masked(blocks: DataFrame, share: float, chunks: int, rate: int = 16_000) -> DataFrame:
    return _mapped(with_length(blocks), lambda i, a, x, n: [(i, a, x * S.mask_gain(np.arange(a, a + len(x)), n, i, share, chunks, rate))])


def silenced(blocks: DataFrame, share: float, size: int, rate: int = 16_000) -> DataFrame:
    """Blocks before the gap stay, those behind it move by its length, and the block in which it begins gives way to its two parts and the gap's zeros."""

    def one(ident, start, x, n):
        at, gap = S.silence_place(n, ident, share, rate)
        x = x * S.silence_gain(np.arange(start, start + len(x)), n, at, rate)
        cut = min(max(at - start, 0), len(x))
        out = [(ident, start, x[:cut])] if cut or not gap else []
        if start <= at < start + len(x) or at == n == start + len(x):
            out += [(ident, at + a, np.zeros(min(size, gap - a), np.float32)) for a in range(0, gap, size)]
        return [*out, (ident, start + cut + gap, x[cut:])] if cut < len(x) else out

    return _mapped(with_length(blocks), one)


def reverberant(blocks: DataFrame, kernel: list[float], size: int) -> DataFrame:
    """Overlap-add: each block's whole convolution is cut at the borders of blocks and the parts are added there; then the recording's energy is what it was."""
    k = np.asarray(kernel, np.float64)

    def one(ident, start, x, n):
        y = np.convolve(x.astype(np.float64), k)[: n - start]
        for a in range(start // size * size, start + len(y), size):
            part = np.zeros(min(size, n - a))
            low, high = max(a, start), min(a + len(part), start + len(y))
            part[low - a : high - a] = y[low - start : high - start]
            yield ident, a, start, part, float((x.astype(np.float64) ** 2).sum()) if a == start // size * size else 0.0

    def added(batches):
        for batch in batches:
            totals = [np.sum(np.stack([p["part"] for p in parts]), axis=0) for parts in batch["parts"]]
            yield batch[["ident", "start", "before"]].assign(part=totals, after=[float((x**2).sum()) for x in totals])

    parts = _mapped(with_length(blocks), one, "ident string, start long, source long, part array<double>, before double")
    # as many parts as a kernel reaches over blocks, and one; many blocks go to Python together
    gathered = parts.groupBy("ident", "start").agg(F.sort_array(F.collect_list(F.struct("source", "part"))).alias("parts"), F.sum("before").alias("before"))
    found = gathered.mapInPandas(added, "ident string, start long, before double, part array<double>, after double")
    scale = found.groupBy("ident").agg(F.when(F.sum("after") > 0, F.sqrt(F.sum("before") / F.sum("after"))).otherwise(1.0).alias("scale"))
    return found.join(scale, "ident").select("ident", "start", F.transform("part", lambda v: v * F.col("scale")).cast("array<double>").alias("samples"))


def voiced(blocks: DataFrame, size: int, rate: int = 16_000, floor_db: float = -35.0, least_ms: int = 200) -> DataFrame:
    """Blocks without quiet runs; a block keeps its start, whatever is dropped before or in it.  `size` must hold a frame."""
    frame, hop = rate * 20 // 1000, rate * 10 // 1000
    if size < frame:
        raise ValueError("a block must hold a frame")
    own = F.struct(F.expr(f"start DIV {size}").alias("b"), F.lit(0).alias("after"), "start", "samples")
    ahead = F.struct((F.expr(f"start DIV {size}") - 1).alias("b"), F.lit(1).alias("after"), "start", F.slice("samples", 1, frame).alias("samples"))
    copies = with_length(blocks).select("ident", "length", F.explode(F.when(F.col("start") > 0, F.array(own, ahead)).otherwise(F.array(own))).alias("x")).select("ident", "length", "x.*")

    def runs_of(b: int, n: int, parts) -> list[list[int]]:
        start, x = b * size, np.concatenate([np.asarray(v["samples"], np.float32) for v in parts])
        heads = np.arange(-(-start // hop) * hop, min(start + size, n - frame + 1), hop)
        squares = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
        quiet = S.loudness((squares[heads - start + frame] - squares[heads - start]) / frame) < floor_db
        return (np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]]))).reshape(-1, 2) + -(-start // hop)).tolist()

    def runs(batches):
        for batch in batches:
            out = [(i, *edge) for i, b, n, parts in zip(batch["ident"], batch["b"], batch["length"], batch["parts"], strict=True) for edge in runs_of(int(b), int(n), parts)]
            yield pd.DataFrame(out, columns=["ident", "first", "last"], dtype=object)

    # a block and the head of the next; many blocks go to Python together
    gathered = copies.groupBy("ident", "b").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("after", "start", "samples"))).alias("parts"))
    found = gathered.mapInPandas(runs, "ident string, first long, last long")
    order = Window.partitionBy("ident").orderBy("first")  # a row for each run of a block
    found = found.withColumn("new", F.coalesce((F.lag("last").over(order) < F.col("first")).cast("int"), F.lit(1)))
    found = found.withColumn("run", F.sum("new").over(order)).groupBy("ident", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    gone = found.where(F.col("last") - F.col("first") >= max(1, least_ms // 10)).select("ident", (F.col("first") * hop).alias("a"), (F.col("last") * hop + frame).alias("z"))
    gone = gone.withColumn("b", F.explode(F.sequence(F.expr(f"a DIV {size}"), F.expr(f"(z - 1) DIV {size}")))).groupBy("ident", "b").agg(F.collect_list(F.struct("a", "z")).alias("gone"))
    inside = lambda i: F.exists(F.coalesce("gone", F.array()), lambda g: (F.col("start") + i >= g.a) & (F.col("start") + i < g.z))
    joined = blocks.withColumn("b", F.expr(f"start DIV {size}")).join(gone, ["ident", "b"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("samples")).otherwise(F.filter("samples", lambda v, i: ~inside(i)))
    return joined.select("ident", "start", kept.alias("samples"))


def reverberation_time(blocks: DataFrame, rate: int = 16_000) -> DataFrame:
    """ident, seconds."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    sums = blocks.select("ident", "start", energy.alias("e"))
    later = Window.partitionBy("ident").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)  # a number for each block
    left = sums.select("ident", "start", F.coalesce(F.sum("e").over(later), F.lit(0.0)).alias("later"), F.sum("e").over(Window.partitionBy("ident")).alias("total"))
    levels = (-5, -25, -60)

    def run(batches):
        for batch in batches:
            out = []
            for i, start, x, after, total in zip(batch["ident"], batch["start"], batch["samples"], batch["later"], batch["total"], strict=True):
                here = after + np.cumsum((np.asarray(x, np.float64) ** 2)[::-1])[::-1]
                db = 10 * np.log10(here / total + 1e-12) if total > 0 else np.zeros(len(here))
                below = [np.flatnonzero(db < level) for level in levels]
                out.append((i, *(int(start + w[0]) if len(w) else None for w in below)))
            yield pd.DataFrame(out, columns=["ident", "a", "b", "c"], dtype=object)

    found = blocks.join(left, ["ident", "start"]).mapInPandas(run, "ident string, a long, b long, c long")
    first = found.groupBy("ident").agg(*(F.coalesce(F.min(c), F.lit(0)).alias(c) for c in "abc"))
    return first.select("ident", F.when((F.col("b") > F.col("a")) & (F.col("a") > 0), 3 * (F.col("b") - F.col("a")) / rate).otherwise(F.col("c") / rate).alias("seconds"))
