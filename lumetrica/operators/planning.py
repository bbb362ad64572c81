"""Batch plans, samples, splits and packing."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .order import stable_rank


#: Rows of a chunk that is filled by itself, and chunks whose outcomes are composed at a time.
CHUNK, FAN = 1 << 16, 1 << 10


def batch_ends(values: np.ndarray, budget: float, cap: int, padded: bool) -> np.ndarray:
    """For each place the place behind the batch that would begin there: a batch takes rows while their sum (or, padded, their
    number times the longest) stays within the budget and their number within the cap, one row at least."""
    n = len(values)
    end, cost = np.arange(1, n + 1), values.copy()  # cost: the sum or the longest of the rows so far
    live = np.arange(n)
    for k in range(2, cap + 1):
        live = live[live + k <= n]
        if not len(live):
            break
        more = values[live + k - 1]
        cost[live] = np.maximum(cost[live], more) if padded else cost[live] + more
        live = live[(k * cost[live] if padded else cost[live]) <= budget]
        end[live] = live + k
    return end


def _outcome(end: np.ndarray, own: int, most: int) -> tuple[list[int], list[int]]:
    """For each place 0..most at which a chunk's first batch may begin: where, counted from the chunk's end, the next chunk's first one
    begins, and how many begin here.  Batches that begin at one place go on alike, so all places are followed at once, by doubling."""
    jump, count = np.minimum(end, len(end)), np.ones(len(end), np.int64)
    while len(inner := np.flatnonzero(jump[:own] < own)):
        count[inner] += count[jump[inner]]
        jump[inner] = jump[jump[inner]]
    exits, counts = np.maximum(np.arange(most + 1) - own, 0), np.zeros(most + 1, np.int64)
    here = min(own, most + 1)
    exits[:here], counts[:here] = jump[:here] - own, count[:here]
    return exits.tolist(), counts.tolist()


def _composed(maps: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The outcome of chunks that follow each other, from each state before the first."""
    state, total = None, None
    for exits, counts in zip(maps["exits"], maps["counts"], strict=True):
        exits, counts = np.asarray(exits), np.asarray(counts)
        state = np.arange(len(exits)) if state is None else state
        total = counts[state] + (0 if total is None else total)
        state = exits[state]
    return state.tolist(), total.tolist()


def chunk_starts(maps: DataFrame, group: list[str]) -> DataFrame:
    """(group, chunk, exits, counts) -> (group, chunk, state, before): the state in which each chunk is entered, from state 0 before the first,
    and the sum of the counts before it.

    FAN chunks are composed to one outcome, a group's outcomes are followed in turn, and then the chunks of each by themselves.
    """
    keys = ", ".join(f"{c} {maps.schema[c].dataType.simpleString()}" for c in group)
    outcome = "exits array<int>, counts array<long>"
    maps = settled(maps.withColumn("upper", F.expr(f"chunk DIV {FAN}")))

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        exits, counts = _composed(part)
        return pd.DataFrame([[*part[[*group, "upper"]].iloc[0], exits, counts]], columns=[*group, "upper", "exits", "counts"])

    def followed(name: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(name)
            state, before, out = int(part["state"].iloc[0]) if "state" in part else 0, int(part["before"].iloc[0]) if "before" in part else 0, []
            for exits, counts in zip(part["exits"], part["counts"], strict=True):
                out.append((state, before))
                before += int(counts[state])
                state = int(exits[state])
            return part[[*group, name]].assign(state=[x for x, _ in out], before=[x for _, x in out])

        return run

    upper = maps.groupBy(*group, "upper").applyInPandas(composed, f"{keys}, upper long, {outcome}")
    upper = upper.groupBy(*group).applyInPandas(followed("upper"), f"{keys}, upper long, state int, before long")
    return maps.join(upper, [*group, "upper"]).groupBy(*group, "upper").applyInPandas(followed("chunk"), f"{keys}, chunk long, state int, before long")


def greedy_batches(placed: DataFrame, group: list[str], pos: str, duration: str, budget: float, cap: int, costs: dict[str, bool], chunk: int = CHUNK) -> DataFrame:
    """placed (with `pos`, from 1 in each group) with a batch number, from 0 in each group, for each of `costs` (column: whether padded):
    each batch takes rows in order while it has room.

    A batch that begins at a place takes the same rows whatever was before it, and `cap` rows at most.  So each chunk of places, with the
    `cap` rows after it, is filled from each of the cap + 1 places where its first batch may begin; the outcomes are
    composed, and then each chunk is filled from the one place that holds.
    """
    chunk, placed = max(chunk, cap), settled(placed)
    at = F.col(pos) - 1
    own = F.struct(F.expr(f"({pos} - 1) DIV {chunk}").alias("chunk"), F.lit(True).alias("own"))
    ahead = F.struct(F.expr(f"({pos} - 1) DIV {chunk} - 1").alias("chunk"), F.lit(False).alias("own"))
    copies = F.when((at % chunk < cap) & (at >= chunk), F.array(own, ahead)).otherwise(F.array(own))
    cut = placed.withColumn("_c", F.explode(copies)).withColumns({"chunk": F.col("_c.chunk"), "_own": F.col("_c.own")}).drop("_c")
    keys, columns = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in group), [*placed.columns, *costs]

    def ordered(part: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray], int]:
        part = part.sort_values(pos)
        values = part[duration].fillna(0).to_numpy(float)
        return part, {name: batch_ends(values, budget, cap, padded) for name, padded in costs.items()}, int(part["_own"].sum())

    def outcome(part: pd.DataFrame) -> pd.DataFrame:
        part, ends, own = ordered(part)
        key = [*part[[*group, "chunk"]].iloc[0]]
        return pd.DataFrame([[*key, name, *_outcome(end, own, cap)] for name, end in ends.items()], columns=[*group, "chunk", "_cost", "exits", "counts"])

    def filled(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part, ends, own = ordered(part)
        start, numbers = start.set_index("_cost"), {}
        for name, end in ends.items():
            begins, i = np.zeros(own, np.int64), int(start["state"][name])
            while i < own:
                begins[i] = 1
                i = int(end[i])
            numbers[name] = int(start["before"][name]) + np.cumsum(begins) - 1
        return part.iloc[:own].assign(**numbers)[columns]

    maps = cut.select(*group, pos, duration, "chunk", "_own").groupBy(*group, "chunk").applyInPandas(outcome, f"{keys}, chunk long, _cost string, exits array<int>, counts array<long>")
    starts = chunk_starts(maps, [*group, "_cost"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    fields += "".join(f", `{name}` long" for name in costs)
    return settled(cut.groupBy(*group, "chunk").cogroup(starts.groupBy(*group, "chunk")).applyInPandas(filled, fields))


def batch_plans(rows: DataFrame, ident: str, duration: str, edges: list[float], budget: float, cap: int, costs: dict[str, bool], chunk: int = CHUNK) -> DataFrame:
    """ident, duration, bucket, and a batch number for each of `costs` (column: whether padded): rows are ranked and shuffled once for all."""
    bucket = F.lit(0)
    for edge in edges:
        bucket = bucket + (F.col(duration) > edge).cast("int")
    cut = rows.select(ident, F.col(duration).cast("double").alias(duration)).withColumn("bucket", bucket)
    ranked = stable_rank(cut, ["bucket"], duration, ident, name="_pos")
    plan = greedy_batches(ranked, ["bucket"], "_pos", duration, budget + 1e-9, cap, costs, chunk)
    ends = plan.groupBy("bucket").agg(*((F.max(c) + 1).alias(c) for c in costs))  # one row per bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in costs))
    return plan.join(F.broadcast(starts), "bucket").select(ident, duration, "bucket", *((F.col(f"_{c}") + F.col(c)).alias(c) for c in costs))


def batch_plan(rows: DataFrame, ident: str, duration: str, edges: list[float], budget: float, cap: int, padded: bool = False, chunk: int = CHUNK) -> DataFrame:
    """ident, duration, bucket, batch_id: buckets by duration, rows in each by duration, then id, filled greedily; a row over the
    budget is a batch by itself.  Chunks of a bucket are filled side by side, however many rows or durations it has."""
    return batch_plans(rows, ident, duration, edges, budget, cap, {"batch_id": padded}, chunk)


def plan_summary(plan: DataFrame, duration: str) -> DataFrame:
    """batch_id, n, total, padded."""
    return plan.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(duration).alias("total"), (F.count("*") * F.max(duration)).alias("padded"))


def validate_plans(plan: DataFrame, rows: DataFrame, ident: str, duration: str, budget: float, cap: int, costs: list[str]) -> DataFrame:
    """A row for each of `costs` (columns of batch numbers): cost, rows, planned rows, batches, batches over the cap or the budget, ids that the plan lacks,
    has besides or has twice, and the status; every row must be planned exactly once.  Then the most rows, seconds and padded seconds of a batch,
    and the median of rows.  One pass over the ids serves all plans.
    """
    r, null = F.col("_r"), F.col(ident).isNull()  # a null id is no other's
    counted = plan.select(ident, F.lit(0).alias("_r"), *(F.col(c).isNotNull().cast("int").alias(c) for c in costs))
    given = rows.select(ident, F.lit(1).alias("_r"), *(F.lit(0).alias(c) for c in costs))
    ids = counted.unionByName(given).groupBy(ident).agg(*(F.sum(c).alias(c) for c in ("_r", *costs)))
    out = ids.agg(F.sum("_r").alias("rows"), *(F.struct(
        F.sum(p).alias("planned"), F.count(F.when((r > 0) & ((p == 0) | null), 1)).alias("missing"), F.count(F.when((p > 0) & ((r == 0) | null), 1)).alias("extra"),
        F.count(F.when(p > 1, 1)).alias("planned_twice")).alias(f"_ids_{c}") for c in costs for p in [F.col(c)]))
    for c in costs:
        over = (F.col("total") > budget + 1e-6) & (F.col("n") > 1)
        own = plan_summary(plan.withColumnRenamed(c, "batch_id"), duration).agg(
            F.count("*").alias("batches"), F.count(F.when(F.col("n") > cap, 1)).alias("over_cap"), F.count(F.when(over, 1)).alias("over_budget"),
            F.max("n").alias("most_rows"), F.max("total").alias("most_total"), F.max("padded").alias("most_padded"), F.median("n").alias("median_rows"))
        out = out.crossJoin(own.select(F.struct("*").alias(f"_own_{c}")))  # one row each
    each = out.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("cost"), F.col(f"_ids_{c}").alias("i"), F.col(f"_own_{c}").alias("o")) for c in costs))).alias("x"))
    found = each.select("x.cost", "x.o.batches", "x.o.over_cap", "x.o.over_budget", "rows", "x.i.*", "x.o.most_rows", "x.o.most_total", "x.o.most_padded", "x.o.median_rows")
    bad = sum((F.col(c) for c in ("over_cap", "over_budget", "missing", "extra", "planned_twice")), F.lit(0))
    return found.withColumn("status", F.when(bad == 0, "pass").otherwise("fail"))


def validate_plan(plan: DataFrame, rows: DataFrame, ident: str, duration: str, budget: float, cap: int) -> DataFrame:
    """The row of validate_plans for a plan with `batch_id`, without the measures of its batches."""
    found = validate_plans(plan, rows, ident, duration, budget, cap, ["batch_id"])
    return found.select("batches", "over_cap", "over_budget", "rows", "planned", "missing", "extra", "planned_twice", "status")


def _gathered(tiny: DataFrame, least: int, chunk: int) -> DataFrame:
    """(batch, n) of batches below `least` rows -> (batch, gather): those that come together have one number; the last may stay below.

    What waits has fewer than `least` rows, so a chunk of batches has an outcome for each such number, and outcomes are composed.
    """
    ranked = stable_rank(tiny.withColumn("_all", F.lit(0)), ["_all"], "batch", "batch", name="_pos")
    ranked = settled(ranked.withColumn("chunk", F.expr(f"(_pos - 1) DIV {chunk}")))

    def outcome(part: pd.DataFrame) -> pd.DataFrame:
        sizes, exits, counts = part.sort_values("batch")["n"].tolist(), [], []
        for waiting in range(least):
            full = 0
            for n in sizes:
                waiting += n
                if waiting >= least:
                    waiting, full = 0, full + 1
            exits.append(waiting)
            counts.append(full)
        return pd.DataFrame([[0, part["chunk"].iloc[0], exits, counts]], columns=["_all", "chunk", "exits", "counts"])

    def numbered(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("batch")
        waiting, full, out = int(start["state"].iloc[0]), int(start["before"].iloc[0]), []
        for n in part["n"].tolist():
            out.append(full)
            waiting += n
            if waiting >= least:
                waiting, full = 0, full + 1
        return part[["batch"]].assign(gather=out)

    starts = chunk_starts(ranked.groupBy("_all", "chunk").applyInPandas(outcome, "_all int, chunk long, exits array<int>, counts array<long>"), ["_all"])
    return settled(ranked.groupBy("_all", "chunk").cogroup(starts.groupBy("_all", "chunk")).applyInPandas(numbered, "batch long, gather long"))


def mega_batches(rows: DataFrame, ident: str, duration: str, budget: float, cap: int, factor: int = 50, least: int = 4, chunk: int = CHUNK) -> DataFrame:
    """ident, duration, mega, batch: a fixed shuffle is cut into mega-batches of `factor` typical batches, each is sorted by duration
    (then id), and batches are filled greedily through all of them while rows times the longest stay within the budget and
    rows within the cap; a batch that a mega-batch leaves open goes on in the next one.  Batches below `least` rows wait for
    the next such ones until they have as many together; batches count in the order in which they are complete, and what still
    waits at the end comes last.
    """
    median = rows.agg(F.percentile_approx(duration, 0.5)).first()[0] or 0.0
    size = max(1, int(budget / (median + 1e-6))) * factor
    shuffled = stable_rank(rows.select(ident, F.col(duration).cast("double").alias(duration), digest_order(F.col(ident)).alias("_o"), F.lit(0).alias("_all")), ["_all"], "_o", ident)
    dealt = shuffled.select("_all", ident, duration, F.expr(f"(rank - 1) DIV {size}").alias("mega"))  # a mega-batch has `size` rows
    within = Window.partitionBy("mega").orderBy(duration, ident)
    placed = dealt.withColumn("_pos", F.col("mega") * size + F.row_number().over(within))
    filled = greedy_batches(placed, ["_all"], "_pos", duration, budget, cap, {"batch": True}, chunk)
    sizes = settled(filled.groupBy("batch").agg(F.count("*").alias("n")))
    gathered = _gathered(sizes.where(F.col("n") < least), least, chunk)
    # a batch is complete at its own number, one that was gathered at that of its last part, what still waits behind all
    parts = gathered.join(sizes, "batch").groupBy("gather").agg(F.max("batch").alias("_last"), F.sum("n").alias("_n"))
    done = gathered.join(parts, "gather").select("batch", F.when(F.col("_n") >= least, F.col("_last")).otherwise(F.lit((1 << 62))).alias("_done"))
    done = settled(done.unionByName(sizes.where(F.col("n") >= least).select("batch", F.col("batch").alias("_done"))))
    order = stable_rank(done.select("_done").distinct().withColumn("_all", F.lit(0)), ["_all"], "_done", "_done", name="_number")
    numbers = done.join(order, "_done").select("batch", (F.col("_number") - 1).alias("_number"))
    return filled.join(numbers, "batch").select(ident, duration, "mega", F.col("_number").alias("batch"))


def calibration_subset(rows: DataFrame, group: str, value: str, ident: str) -> DataFrame:
    """Per group the rows at the first, middle, 90 % and last place by value, each once."""
    ranked = stable_rank(rows, [group], value, ident)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    joined = ranked.join(sizes, group)
    n, at = F.col("n"), F.col("rank") - 1
    picks = F.array(F.lit(0).cast("long"), F.floor(n / 2), F.ceil(n * 0.9) - 1, n - 1)
    return joined.where(F.array_contains(picks, at)).select(group, ident, value)


def digest_order(key: Column) -> Column:
    """A fixed shuffle: the first 32 bits of the md5 of the key."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def oversample(rows: DataFrame, group: str, ident: str, floor: int) -> DataFrame:
    """Rows of groups below the floor repeat in turn until it is reached; the rest stays. Adds copy (0, 1, ...)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    joined = rows.join(sizes, group)
    few = joined.where((F.col("n") < floor) & (F.col(group) != ""))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(ident)))  # below `floor` rows each
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(floor / F.col("n")).cast("int") - 1))).where(F.col("copy") * F.col("n") + F.col("r") <= floor)
    many = joined.where((F.col("n") >= floor) | (F.col(group) == "")).withColumn("copy", F.lit(0))
    return few.drop("r", "n").unionByName(many.drop("n"))


def stratified_subset(rows: DataFrame, stratum: str, ident: str, total: int) -> DataFrame:
    """max(1, floor(share * total)) rows of each stratum, in the fixed shuffle's order."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    quota = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).withColumn("quota", F.greatest(F.lit(1), F.expr(f"CAST({total} AS BIGINT) * n DIV `all`")))
    ranked = stable_rank(rows.withColumn("_o", digest_order(F.col(ident))), [stratum], "_o", ident)
    return ranked.join(quota, stratum).where("rank <= quota").select(*rows.columns)


def disjoint_split(rows: DataFrame, speaker: str, eval_percent: int) -> DataFrame:
    """rows with split: whole speakers go to eval, those whose digest falls below the share."""
    return rows.withColumn("split", F.when(digest_order(F.col(speaker)) % 100 < eval_percent, "eval").otherwise("train"))


def group_folds(rows: DataFrame, speaker: str, stratum: str, folds: int) -> DataFrame:
    """speaker, fold: within its commonest stratum (the first by name) each speaker takes the next fold in the fixed shuffle's order."""
    main = rows.groupBy(speaker, stratum).count().groupBy(speaker).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(stratum))).alias("m"))
    main = main.select(speaker, F.col(f"m.{stratum}").alias(stratum), digest_order(F.col(speaker)).alias("_o"))
    ranked = stable_rank(main, [stratum], "_o", speaker)
    return ranked.select(speaker, stratum, ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def balanced_folds(rows: DataFrame, speaker: str, label: str, folds: int, classes_at_once: int = 20_000) -> DataFrame:
    """speaker, fold: whole speakers, dealt so that each fold has about the same number of rows of each label.

    Speakers with the same count of every label are one class.  A class of m speakers gives each fold the same m DIV folds of them, in
    the fixed shuffle's order; the fewer than `folds` that are over go, largest classes of speakers first, each to
    the fold (of those that the class has not used) where the squares of the labels' counts, each over the label's total, grow least.
    Only the table of classes is gone through in turn, and where there are more than `classes_at_once` of them,
    parts of it are gone through side by side.
    """
    kind = rows.schema[speaker].dataType.simpleString()
    counts = rows.groupBy(speaker, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).agg(F.count("*").alias("_n"))
    vectors = settled(counts.groupBy(speaker).agg(F.sort_array(F.collect_list(F.struct("_l", "_n"))).alias("_v")).withColumn("_class", F.xxhash64("_v")))
    classes = vectors.groupBy("_class").agg(F.count("*").alias("_m"), F.first("_v").alias("_v"))
    totals = {r["_l"]: r["t"] for r in counts.groupBy("_l").agg(F.sum("_n").alias("t")).collect()}  # a row for each label
    names = {x: i for i, x in enumerate(sorted(totals))}
    weight = np.array([1 / max(1, totals[x]) for x in names])
    parts = classes.withColumn("_part", F.pmod(F.xxhash64(F.lit(5), "_class"), F.lit(-(-max(1, classes.count()) // classes_at_once))))

    def dealt(part: pd.DataFrame) -> pd.DataFrame:
        state, out = np.zeros((folds, len(names))), []
        size = part["_v"].map(lambda v: sum(x["_n"] for x in v))
        part = part.assign(_size=size).sort_values(["_size", "_class"], ascending=[False, True])
        for name, m, v in zip(part["_class"], part["_m"], part["_v"], strict=True):
            own = np.zeros(len(names))
            for x in v:
                own[names[x["_l"]]] = x["_n"]
            free, extra = list(range(folds)), []
            for _ in range(int(m) % folds):
                cost = ((2 * state[free] + own) * own * weight**2).sum(axis=1)
                extra.append(free.pop(int(np.argmin(np.round(cost, 12)))))
                state[extra[-1]] += own
            out.append((name, int(m) // folds * folds, extra))
        return pd.DataFrame(out, columns=["_class", "_even", "_extra"])

    plan = parts.groupBy("_part").applyInPandas(dealt, "_class long, _even long, _extra array<int>")
    ranked = stable_rank(vectors.select(speaker, "_class", digest_order(F.col(speaker)).alias("_o")), ["_class"], "_o", speaker)
    at = F.col("rank") - 1
    fold = F.when(at < F.col("_even"), at % folds).otherwise(F.get("_extra", (at - F.col("_even")).cast("int")))
    return ranked.join(plan, "_class").select(F.col(speaker).cast(kind).alias(speaker), fold.cast("int").alias("fold"))


def pack(rows: DataFrame, ident: str, length: str, capacity: int, buffer: int = 1000) -> DataFrame:
    """ident, row, start, used: documents packed into rows of `capacity`, filled to the last place.

    Each row takes the longest document of the buffer that still fits; where none fits, the shortest is cropped to what is
    left, so only a partition's last row may stay short.  The buffer of each task holds `buffer` documents, refilled after
    each pick; documents come in the partition's order, and of equally long ones the first is taken.
    """
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row, left, number = TaskContext.get().partitionId() << 33, capacity, 0
        held: list[tuple[int, int, object]] = []  # (length, order of coming, id)
        for batch in chain(batches, [None]):
            out = []
            incoming = [] if batch is None else list(zip(batch[length], batch[ident], strict=True))
            at = 0
            while at < len(incoming) or batch is None and held:
                while at < len(incoming) and len(held) < buffer:
                    insort(held, (int(incoming[at][0]), number, incoming[at][1]))
                    at, number = at + 1, number + 1
                if len(held) < buffer and batch is not None:
                    break
                fits = bisect_right(held, left, key=lambda x: x[0])
                # the longest that fits, the first of equally long ones; else the shortest, cropped
                pick = bisect_left(held, held[fits - 1][0], key=lambda x: x[0]) if fits else 0
                size, _, key = held.pop(pick)
                out.append((key, row, capacity - left, min(size, left)))
                left -= min(size, left)
                if left == 0:
                    row, left = row + 1, capacity
            if out:
                yield pd.DataFrame(out, columns=[ident, "row", "start", "used"])

    return rows.select(ident, F.coalesce(length, F.lit(0)).alias(length)).mapInPandas(run, f"{ident} {kind}, row long, start long, used long")


def pack_size(costs: DataFrame, key: str, order: str, cost: str, budget: float) -> DataFrame:
    """How many items, in order, fit the budget: at least one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fits = costs.withColumn("_s", F.sum(cost).over(w)).groupBy(key).agg(F.count(F.when(F.col("_s") <= budget, 1)).alias("k"))
    return fits.select(key, F.greatest(F.col("k"), F.lit(1)).cast("long").alias("pack"))
