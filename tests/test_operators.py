"""Operators on small fixtures: nulls, ties, empty tables, skewed groups, brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumetrica.functions import text as X
from lumetrica.operators import cover as C
from lumetrica.operators import metrics as M
from lumetrica.operators import order as O
from lumetrica.operators import planning as P
from lumetrica.operators import resample as R
from lumetrica.operators import signals as S
from lumetrica.operators import validate as V

ROWS = [("m", "base", "A", 1, 0, 0, 0, 2), ("m", "base", "B", 1, 0, 0, 1, 1), ("m", "mp3", "A", 2, 0, 0, 1, 1), ("m", "mp3", "B", 2, 0, 0, 1, 1)]


def rates(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "model string, variant string, `group` string, unit int, s long, i long, d long, h long")
    return M.group_rates(df, ["model", "variant", "group"])


def test_fairness_with_a_group_without_errors(spark):
    found = {r.variant: r for r in M.fairness(rates(spark), ["model", "variant"]).collect()}
    assert found["base"].ratio == float("inf") and found["mp3"].ratio == 1.0
    assert found["base"].best_group == "A" and found["mp3"].best_group == "A"
    skip = M.fairness(rates(spark), ["model", "variant"], policy=M.Policy(zero_best="skip")).collect()
    assert [r.variant for r in skip] == ["mp3"]


def test_small_groups_and_blank_sides(spark):
    df = spark.createDataFrame([("a", 0, 0, 2, 0), ("a", 1, 0, 0, 1), ("b", 0, 3, 0, 0)], "g string, s long, i long, d long, h long")
    assert {r.g: (r.n, r.wer) for r in M.group_rates(df, ["g"]).collect()} == {"a": (2, 0.75)}
    dropped = M.group_rates(df, ["g"], M.Policy(drop_blank_hypotheses=True, rates_over="hits")).first()
    assert (dropped.n, dropped.s_rate) == (1, 1.0)
    assert M.group_rates(df, ["g"], M.Policy(min_rows=3)).count() == 0
    assert M.group_rates(df.limit(0), ["g"]).count() == 0


def test_paired_delta_takes_the_first_baseline(spark):
    df = spark.createDataFrame([("m", "base", "A", 1, 0, 0.0), ("m", "base", "A", 1, 9, 0.9), ("m", "mp3", "A", 1, 1, 0.5), ("m", "mp3", "A", 2, 2, 0.5)],
                               "model string, variant string, `group` string, unit int, row_index int, wer double")
    row = M.paired_delta(df, "base").first()
    assert (row.pairs, row.mean_delta) == (1, 0.5)


def test_paired_bootstrap_strong_and_no_effect(spark):
    rows = [("x", i, 3, 0, 10) for i in range(60)] + [("y", i, 2, 2, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, unit int, a int, b int, w int")
    found = {r.k: r for r in R.paired_bootstrap(df, ["k"], "unit", "a", "b", "w", 40).collect()}
    assert found["x"].p < 0.05 and found["y"].p == 1.0


def test_mann_whitney_against_counting(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 5) + shift) for g, shift in (("a", 0), ("b", 2)) for _ in range(30)]
    df = spark.createDataFrame(rows, "g string, v int")
    row = R.mann_whitney(df.withColumn("k", F.lit(1)), ["k"], "g", "v").first()
    a, b = ([v for g, v in rows if g == x] for x in "ab")
    assert row.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and row.p < 0.001


def greedy(values, budget, cap, padded):
    out, batch, n, total = [], 0, 0, 0.0
    for v in sorted(values):
        cost = (n + 1) * v if padded else total + v
        if n and (cost > budget or n >= cap):
            batch, n, total = batch + 1, 0, 0.0
        n, total = n + 1, total + v
        out.append(batch)
    return out


@pytest.mark.parametrize("padded", [False, True])
def test_batch_plan_equals_row_by_row_greedy(spark, padded):
    rng = random.Random(3)
    values = [float(rng.choice([3, 5, 5, 5, 9, 20, 40, 200])) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, s double")
    plan = P.batch_plan(df, "id", "s", [1000], 80, 8, padded)
    found = [r.batch_id for r in plan.orderBy("s", "batch_id").collect()]
    assert found == greedy(values, 80, 8, padded)
    assert P.batch_plan(df.limit(0), "id", "s", [10], 80, 8).count() == 0


@pytest.mark.parametrize(("values", "sizes"), [([5, 5, 5, 20, 20, 40, 40], [3, 2, 2])])
def test_known_plan(spark, values, sizes):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, s double")
    plan = P.batch_plan(df, "id", "s", [10, 30, 60], 80, 8)
    assert [r["n"] for r in P.plan_summary(plan, "s").orderBy("batch_id").collect()] == sizes


def test_stable_rank_with_one_hot_value(spark):
    df = spark.createDataFrame([(i, "g", 1 if i % 3 else i) for i in range(9000)], "id long, g string, v int")
    found = [r.rank for r in O.stable_rank(df, ["g"], "v", "id").orderBy("v", "id").collect()]
    assert found == list(range(1, 9001))


def test_pareto_against_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(300)]
    found = {r.id for r in O.pareto_frontier(spark.createDataFrame(points, "id int, x double, y double"), "x", "y", 8).collect()}
    assert found == {i for i, x, y in points if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in points)}


def test_oversample_and_quota(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b" if i < 90 else "") for i in range(100)], "id long, g string")
    counts = {r.g: r["count"] for r in P.oversample(df, "g", "id", 50).groupBy("g").count().collect()}
    assert counts == {"a": 50, "b": 85, "": 10}
    sub = {r.g: r["count"] for r in P.stratified_subset(df, "g", "id", 20).groupBy("g").count().collect()}
    assert sub == {"a": 1, "b": 17, "": 2}


def test_splits_are_disjoint_and_folds_even(spark):
    df = spark.createDataFrame([(i % 30, i, "xyz"[i % 3]) for i in range(300)], "speaker long, id long, g string")
    split = P.disjoint_split(df, "speaker", 10)
    assert V.leakage(split, "speaker", "split").first().passed
    folds = {r.fold: r["count"] for r in P.group_folds(df, "speaker", "g", 5).groupBy("fold").count().collect()}
    assert set(folds.values()) == {6}


def test_packing_never_overfills(spark):
    df = spark.createDataFrame([(i, (i * 37) % 120) for i in range(500)], "id long, n long")
    rows = P.pack(df, "id", "n", 100).groupBy("row").agg(F.sum("used").alias("u"), F.count("*").alias("c")).collect()
    assert max(r.u for r in rows) <= 100 and sum(r.c for r in rows) == 500


def test_cover(spark):
    base = spark.createDataFrame([("u1", 1), ("u2", 0), ("u3", 2)], "unit string, base_count long")
    masked = spark.createDataFrame([(0, "u1", 0), (0, "u2", 1), (0, "u3", 2), (1, "u1", 1), (1, "u2", 0), (1, "u3", 1)], "head int, unit string, count long")
    assert [tuple(r) for r in C.coverage_edges(base, masked).collect()] == [("u3", 1)]
    failed = spark.createDataFrame([(1, False)], "head int, regression_ok boolean")
    assert C.coverage_edges(base, masked, failed).count() == 0
    unchecked = spark.createDataFrame([(1, None)], "head int, regression_ok boolean")
    assert C.coverage_edges(base, masked, unchecked).count() == 1
    edges = spark.createDataFrame([(u, h) for h, us in enumerate(["abc", "cd", "de", "e"]) for u in us], "unit string, head int")
    assert C.greedy_cover(edges) == [(0, 3), (2, 2)]
    assert C.exact_cover_size([frozenset(r.heads) for r in C.unit_signatures(edges).collect()], 4) == 2


def test_validators(spark):
    df = spark.createDataFrame([("a", "", "train"), ("a", None, "eval"), ("b", "x", "train"), ("c", "nan", "train")], "k string, label string, split string")
    assert V.completeness(df, ["label"], 0.05).first().value == 0.75
    assert V.leakage(df, "k", "split").first().value == 1
    assert not V.duplicates(df, F.col("k"), "k").first().passed
    sides = {(r.k, r.side) for r in V.missing_and_extra(df, spark.createDataFrame([("a",), ("z",)], "k string"), "k").collect()}
    assert sides == {("z", "missing"), ("b", "extra"), ("c", "extra")}


def test_text_functions(spark):
    df = spark.createDataFrame([(" Hé-LLO  it's ", 'x "a b" y "cd ef"')], "a string, b string")
    row = df.select(X.normalize(F.col("a")).alias("n"), X.longest_quoted(F.col("b")).alias("q"), X.strip_markup(F.lit("a<b>c(d)[e]/f")).alias("m"),
                    X.bucket_label(F.lit(10.0), [10, 30]).alias("l"), X.bucket_label(F.lit(31), [10, 30]).alias("l2"), X.edits_from_rate(F.lit(0.5), F.lit(5)).alias("e"), X.stars(F.lit(0.02)).alias("s")).first()
    assert tuple(row) == ("h llo it's", "cd ef", "a c f", "0-10s", ">30s", 2, "*")
    import hashlib

    assert df.select(X.digest_pick(F.lit("abc"), 97).alias("p")).first().p == int(hashlib.md5(b"abc").hexdigest(), 16) % 97


def test_signals(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 0.0, 0.0, 2.0],)], "x array<double>")
    row = df.select(S.drop_quiet_runs(F.col("x"), 0.1, 3).alias("q"), S.inject_silence(F.col("x"), F.lit(2), 2).alias("i"), S.is_silent(F.array_repeat(F.lit(0.0), 5)).alias("s"),
                    S.find_run(F.col("x"), F.array(F.lit(0.0), F.lit(2.0))).alias("f"), S.find_run(F.col("x"), F.array(F.lit(9.0))).alias("g"), S.decay_index(F.col("x"), 1.0).alias("d"),
                    S.mask_chunks(F.col("x"), F.array(F.lit(5)), 3).alias("m")).first()
    assert row.q == [1.0, -1.0, 2.0] and row.i == [1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0] and row.s and row.f == 4 and row.g == 4 and row.m[-1] == 0.0


def test_ranks_need_no_job_before_the_query_runs(spark):
    import random

    from lumetrica.operators.order import stable_rank

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, 1.5, 1.5, float(rng.randint(0, 50))]), i) for i in rng.sample(range(10_000), 3_000)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    tracker, group = spark.sparkContext.statusTracker(), "plan-time"
    spark.sparkContext.setJobGroup(group, group)
    try:
        ranked = stable_rank(df, ["g"], "v", "i", block=64)
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r.i, r["rank"]) for r in ranked.where(f"g = '{g}'").orderBy("rank").collect()] == [(x[2], n) for n, x in enumerate(own, 1)]
    assert stable_rank(df.limit(0), ["g"], "v", "i").count() == 0


def test_greedy_cover_runs_to_the_end_or_says_what_is_left(spark):
    edges = spark.createDataFrame([(u, h) for h in range(6) for u in range(h * 10, h * 10 + 6 - h)] + [(0, 5), (None, 1), (3, None)], "unit long, head long")
    picked = C.greedy_cover(edges)
    assert picked == [(0, 6), (1, 5), (2, 4), (3, 3), (4, 2), (5, 1)] and sum(n for _, n in picked) == 21
    with pytest.raises(ValueError, match="3 heads leave 6 units"):
        C.greedy_cover(edges, most=3)
    assert C.greedy_cover(edges.limit(0)) == []


@pytest.mark.parametrize("at_once", [20_000, 40])
def test_balanced_folds(spark, at_once):
    rng = random.Random(12)
    rows = [(s, rng.choice("aaaabbc") if s % 3 else "abc"[s % 7 % 3]) for s in range(400) for _ in range(rng.choice([1, 1, 2, 5, 9]))]
    rows += [(1000, "a")] * 30 + [(1001, None)] * 4
    df = spark.createDataFrame(rows, "speaker long, g string")
    folds = P.balanced_folds(df, "speaker", "g", 5, at_once).collect()
    assert len(folds) == len({r.speaker for r in folds}) == 402 and {r.fold for r in folds} == set(range(5))
    fold = {r.speaker: r.fold for r in folds}
    for label in "abc":
        n = [sum(g == label and fold[s] == k for s, g in rows) for k in range(5)]
        largest = max(sum(g == label for s, g in rows if s == x) for x, _ in rows)
        assert max(n) - min(n) <= largest, (label, n)  # no label is further apart than one speaker's rows


def test_balanced_folds_of_nothing(spark):
    assert P.balanced_folds(spark.createDataFrame([], "speaker long, g string"), "speaker", "g", 5).count() == 0


def test_equal_quarters_do_not_fall(spark, tmp_path):
    """Means of the same values in another order are equal; values that no decimal holds have a plain mean."""
    import datetime as dt

    from lumetrica.plans import selection as S

    values = {1: [0.1, 0.2, 0.3, *[5.0] * 6, 0.3, 0.2, 0.1], 2: [0.3, 0.2, 0.1, *[5.0] * 6, 0.1, 0.2, 0.3], 3: [1e300, 2.0, 3.0, 4.0], 4: [2.0, None, None, None]}
    rows = [(u * 100 + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), u, "a", v, "{}") for u, own in values.items() for i, v in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = {r.user_id: tuple(r)[1:] for r in S.loss_trend(spark, str(tmp_path)).collect()}
    assert found == {1: (0.2, 0.2, False), 2: (0.2, 0.2, False), 3: (1e300, 4.0, True), 4: (2.0, None, None)}


def test_weights_of_a_unit_are_drawn_in_one_task(spark):
    from pyspark.sql import functions as F

    from lumetrica.operators import resample as R

    rows = spark.range(600).select((F.col("id") % 40).alias("u"), (F.col("id") % 3).alias("g"), F.lit(2).alias("x"))
    found = R.draws(rows, ["g"], "u", ["x"], 16)
    assert "hashpartitioning(_unit" in found._jdf.queryExecution().executedPlan().toString()
    drawn = R.weights([str(u) for u in range(40)], 16)
    got = {(r.g, r["_draw"]): r.x for r in found.collect()}
    assert got == {(g, k + 1): sum(int(2 * drawn[i % 40][k]) for i in range(600) if i % 3 == g) for g in range(3) for k in range(16)}


def test_words_of_a_document_are_counted_before_the_runs(spark, sf_dir):
    from lumetrica.plans.base import predictions

    plan = predictions(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_" not in plan[: plan.index("REPARTITION_BY_COL")] and plan.count("regexp_") == 1
