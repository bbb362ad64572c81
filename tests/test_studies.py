"""Word lists and rule sets, batch plans and packing, gates and choices, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetrica.functions import align as A
from lumetrica.functions import text as X
from lumetrica.operators import order as O
from lumetrica.operators import planning as P
from lumetrica.operators import resample as R
from lumetrica.operators import validate as V


def test_word_lists():
    assert [len(set(x)) for x in (X.FUNCTION_WORDS, X.FUNCTION_WORDS_86, X.FUNCTION_WORDS_59)] == [94, 86, 59]
    assert set(X.FUNCTION_WORDS_86) < set(X.FUNCTION_WORDS) and "also" in X.FUNCTION_WORDS_59 and "again" not in X.FUNCTION_WORDS_59


def test_rule_sets_by_hand():
    hyp = "blue sky and blue sky The sky umbrella between also".split()
    by = lambda rules: [A.category(hyp, i, rules) for i in range(len(hyp))]
    # "blue sky" ends at place 4 and stands before; at place 3 no such words end yet
    assert by("ngram") == ["content", "content", "function", "content", "repetition", "function", "content", "content", "function", "content"]
    assert by("ngram_or_word") == ["content", "content", "function", "repetition", "repetition", "function", "repetition", "content", "content", "content"]
    assert by("function_first") == ["content", "content", "function", "repetition", "repetition", "function", "repetition", "content", "content", "function"]
    far = ["one", "two", *(f"w{i}" for i in range(19)), "one", "two"]
    assert A.category(far, 22, "ngram") == "content" and A.category(far[:2] + far[3:], 21, "ngram") == "content"
    assert A.category(far[:2] + far[4:], 20, "ngram") == "repetition"  # begins just 20 words before


def test_chatty_and_long(spark):
    rows = [("Sure, it is", True), ("no, sure", False), ("here's it", True), ("a Transcription", True), (None, False), ("The user's", True), ("x written format", True), ("", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", X.chatty(F.col("t")).alias("got")).collect())
    phrases = df.select(X.chatty_phrases(F.col("t")).alias("got")).collect()
    assert [r.got for r in phrases] == [True, True, True, True, None, True, True, False]
    long = spark.createDataFrame([("ab", "x" * 51), ("ab", "x" * 50), ("", "x" * 99), ("x" * 20, "y" * 60)], "a string, b string").select(X.long_hypothesis(F.col("a"), F.col("b")).alias("l"))
    assert [r.l for r in long.collect()] == [True, False, False, False]


def test_word_count_is_that_of_the_normalized_text(spark):
    df = spark.createDataFrame([(t,) for t in ["", " ", "A b", "it's  é x", "--", "é", "a-b_c\nD", "''"]], "t string")
    for r in df.select(X.word_count(F.col("t")).alias("n"), X.normalize(F.col("t")).alias("s")).collect():
        assert r.n == len(r.s.split())


def test_numbers_that_are_required(spark):
    df = spark.createDataFrame([("x", "2"), ("3", "y")], "a string, b string")
    assert [r.n for r in df.select(X.first_number(F.col("a"), F.col("b"), required="duration").alias("n")).collect()] == [2.0, 3.0]
    with pytest.raises(Exception, match="no usable duration"):
        df.select(X.first_number(F.col("b"), required="duration").alias("n")).collect()


def plain_plan(rows, edges, budget, cap, padded):
    out, number = {}, -1
    for bucket in range(len(edges) + 1):
        own = sorted((d, i) for i, d in rows if sum(d > e for e in edges) == bucket)
        batch = []
        for d, i in own:
            cost = (len(batch) + 1) * d if padded else sum(x for x, _ in batch) + d
            if not batch or cost > budget + 1e-9 or len(batch) >= cap:
                batch, number = [], number + 1
            batch.append((d, i))
            out[i] = number
    return out


@pytest.mark.parametrize("padded", [False, True])
def test_batch_plans_and_their_validation(spark, padded):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.5, 1.0, 2.5, 7.0, 12.0, 31.0, 170.0])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, s double")
    plan = P.batch_plan(df, "id", "s", [10, 30], 160, 16, padded)
    found = plan.collect()
    assert {r.id: r.batch_id for r in found} == plain_plan(rows, [10, 30], 160, 16, padded)
    ok = P.validate_plan(plan, df, "id", "s", 160, 16).first()
    assert (ok.status, ok.rows, ok.planned, ok.missing, ok.extra, ok.planned_twice) == ("pass", 700, 700, 0, 0, 0)
    bad = plan.where("id > 1").unionByName(plan.where("id = 5")).withColumn("id", F.when(F.col("id") == 9, 9999).otherwise(F.col("id")))
    no = P.validate_plan(bad, df, "id", "s", 160, 16).first()
    assert (no.status, no.missing, no.extra, no.planned_twice) == ("fail", 3, 1, 1)


@pytest.mark.parametrize("padded", [False, True])
def test_batch_plans_of_distinct_durations_in_chunks(spark, padded):
    """Every chunk has 64 of 1,500 rows with durations of their own, and batches of up to 12 rows reach over its end."""
    rng = random.Random(8)
    rows = [(i, round(rng.uniform(0.01, 30), 6)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, s double")
    plan = P.batch_plan(df, "id", "s", [2, 9], 160, 12, padded, chunk=64)
    assert {r.id: r.batch_id for r in plan.collect()} == plain_plan(rows, [2, 9], 160, 12, padded)


def test_plan_validation_ranks_its_rows_once_for_both_plans(spark, sf_dir, monkeypatch):
    from lumetrica.plans import checks

    ranked, rank = [], P.stable_rank
    monkeypatch.setattr(P, "stable_rank", lambda *a, **k: ranked.append(a) or rank(*a, **k))
    found = {r.cost: r for r in checks.plan_validation(spark, sf_dir).collect()}
    assert len(ranked) == 1
    for cost, query in (("total", checks.batch_plan_total), ("padded", checks.batch_plan_padded)):
        plan = query(spark, sf_dir)
        own = P.plan_summary(plan, "seconds").agg(F.count("*").alias("batches"), F.max("n").alias("most_rows"), F.max(cost).alias("most_seconds")).first()
        assert (found[cost].batches, found[cost].most_rows, found[cost].most_seconds) == tuple(own)


def test_a_null_id_is_missing_and_extra(spark):
    rows = spark.createDataFrame([(1, 2.0), (None, 3.0)], "id long, s double")
    plan = spark.createDataFrame([(1, 2.0, 0), (None, 3.0, 0)], "id long, s double, batch_id long")
    found = P.validate_plan(plan, rows, "id", "s", 160, 16).first()
    assert (found.status, found.rows, found.planned, found.missing, found.extra, found.planned_twice) == ("fail", 2, 2, 1, 1, 0)


def test_outcomes_of_chunks_from_each_start():
    rng = random.Random(9)
    for _ in range(40):
        n, own, cap = rng.randint(1, 60), rng.randint(1, 50), rng.randint(1, 9)
        own = min(n, own)
        ends = P.batch_ends(np.array([rng.choice([1.0, 4.0, 9.0, 50.0]) for _ in range(n)]), 20.0, cap, rng.random() < 0.5)
        exits, counts = P._outcome(ends, own, cap)
        for start in range(cap + 1):
            at, k = start, 0
            while at < own:
                at, k = int(ends[at]), k + 1
            assert (exits[start], counts[start]) == (at - own, k)


@pytest.mark.parametrize(("chunk", "least"), [(1 << 16, 4), (32, 4), (16, 7)])
def test_mega_batches_against_a_plain_version(spark, chunk, least):
    """Batches go on from one mega-batch to the next, and so do those that wait to be gathered."""
    rng = random.Random(6)
    rows = [(i, rng.choice([1.0, 2.0, 5.0, 9.0, 40.0, 90.0])) for i in range(900)]
    found = P.mega_batches(spark.createDataFrame(rows, "id long, s double"), "id", "s", 60.0, 8, factor=3, least=least, chunk=chunk).collect()
    order = sorted(rows, key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16), r[0]))
    median = sorted(s for _, s in rows)[len(rows) // 2 - 1 + len(rows) % 2]
    size = max(1, int(60.0 / (median + 1e-6))) * 3
    mega, batches, longest = {}, [[]], 0.0
    for number, at in enumerate(range(0, len(order), size)):
        for i, s in sorted(order[at : at + size], key=lambda r: (r[1], r[0])):
            mega[i], longest = number, max(longest, s)
            if batches[-1] and ((len(batches[-1]) + 1) * longest > 60.0 or len(batches[-1]) >= 8):
                batches.append([])
                longest = s
            batches[-1].append(i)
    assert max(mega.values()) >= 3
    final, carry = [], []
    for b in batches:
        if len(b) < least:
            carry += b
            if len(carry) >= least:
                final, carry = [*final, carry], []
        else:
            final.append(b)
    wanted = {i: (mega[i], n) for n, b in enumerate([*final, carry]) for i in b}
    assert {r.id: (r.mega, r.batch) for r in found} == wanted


def test_packing_fills_rows_and_crops_the_shortest(spark):
    rng = random.Random(7)
    lengths = [rng.randint(1, 90) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long").coalesce(1)
    found = P.pack(df, "id", "n", 64, buffer=20).collect()
    assert sorted(r.id for r in found) == list(range(300))
    rows = {}
    for r in found:
        rows.setdefault(r.row, []).append(r)
    used = [sum(r.used for r in own) for _, own in sorted(rows.items())]
    assert used[:-1] == [64] * (len(used) - 1) and used[-1] <= 64
    # the same by a plain loop
    held, at, left, row, wanted = [], 0, 64, 0, []
    while held or at < len(lengths):
        while len(held) < 20 and at < len(lengths):
            held, at = [*held, at], at + 1
        fits = [i for i in held if lengths[i] <= left]
        i = min(fits, key=lambda i: (-lengths[i], i)) if fits else min(held, key=lambda i: (lengths[i], i))
        held.remove(i)
        wanted.append((i, row, 64 - left, min(left, lengths[i])))
        left -= min(left, lengths[i])
        if not left:
            row, left = row + 1, 64
    assert [(r.id, r.row, r.start, r.used) for r in found] == wanted


def test_ranks_of_one_group_with_distinct_and_hot_values(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b"]), float(rng.choice([7, rng.random() * 1000]))) for i in range(6000)] + [(7000, "a", None)]
    found = {r.id: r.rank for r in O.stable_rank(spark.createDataFrame(rows, "id long, g string, v double"), ["g"], "v", "id", block=100).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [found[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_weights_are_those_of_the_digest(spark):
    drawn = R.weights(["5", "x"], 20)
    for i, unit in enumerate(("5", "x")):
        for r in range(20):
            bits = int(hashlib.md5(f"{unit}#{r // 8}".encode()).hexdigest()[4 * (r % 8) : 4 * (r % 8) + 4], 16)
            assert drawn[i, r] == sum(bits >= c for c in R.CUTS)
    many = R.weights([str(i) for i in range(300)], 400)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.03
    df = spark.createDataFrame([(i, "g", i % 3, 5) for i in range(40)] + [(i, None, 1, 2) for i in range(5)], "u long, k string, e long, w long")
    for r in R.draws(df, ["k"], "u", ["e", "w"], 20).collect():
        own = [(i, i % 3, 5) for i in range(40)] if r.k == "g" else [(i, 1, 2) for i in range(5)]
        w = R.weights([str(i) for i, _, _ in own], 20)[:, r._draw - 1]
        assert (r.e, r.w) == (sum(a * x[1] for a, x in zip(w, own)), sum(a * x[2] for a, x in zip(w, own)))


def test_pairs_that_are_too_few_make_an_error_row(spark):
    df = spark.createDataFrame([("a", i, 0.5, 0.25) for i in range(30)] + [("b", i, 0.5, 0.25) for i in range(5)], "k string, u long, x double, y double")
    found = {r.k: r for r in R.pairwise_test(df, ["k"], "u", "x", "y", 50).collect()}
    assert (found["a"].n_paired, found["a"].mean_diff, found["a"].p_value, found["a"].error) == (30, 0.25, 0.0, None)
    assert (found["b"].n_paired, found["b"].mean_diff, found["b"].p_value, found["b"].error) == (5, None, None, "too few pairs")


def test_gates(spark):
    deltas = spark.createDataFrame([(0.01,), (-0.001,), (0.0,)], "d double")
    got = {r.gate: r.status for r in V.run_gates(deltas, "d", F.lit(0.05), 0.01, 0.005, 0.02).collect()}
    assert got == {"mixed_sign": "pass", "mean_change": "pass", "max_change": "pass"}
    got = {r.gate: r.status for r in V.run_gates(spark.createDataFrame([(0.03,)], "d double"), "d", F.lit(0.05), 0.01, 0.005, 0.02).collect()}
    assert got == {"mixed_sign": "fail", "mean_change": "fail", "max_change": "fail"}
    assert V.run_gates(deltas, "d", F.lit(0.001), 0.01, 0.005, 0.02).first().status == "warn"
    config = spark.createDataFrame([("a", "16"), ("b", "30"), ("c", "True")], "name string, value string")
    assert {r.name: r.passed for r in V.config_gates(config, {"a": "16.0", "c": "true", "d": "1"}, {"b": 24.0}).collect()} == {"a": True, "b": False, "c": True, "d": False}
    rows = spark.createDataFrame([(1, "t", 2.0), (1, "", 9.0)], "id long, text string, n double")
    one = V.manifest_check(rows, ["id", "gone"], 2, "id", F.lit(False), F.abs(F.length("text") - F.col("n")) > 0.25, F.col("text") == "").first()
    assert (one.rows, one.duplicate_ids, one.duration_mismatches, one.silent, one.missing_columns, one.status) == (2, 1, 2, 1, 1, "fail")
    losses = spark.createDataFrame([(1, 0.1), (2, float("nan")), (3, 0.2), (4, 0.3), (5, float("inf"))], "c int, loss double")
    assert V.stage_gate(losses, losses.where("c <> 1"), ["c"], "loss").first() == (2, "PASSED")


def test_running_and_last_rows_over_blocks(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.8 else "b", i, rng.randint(0, 100)) for i in range(400)]
    df = O.by_time(spark.createDataFrame(rows, "k string, i long, v int").withColumn("ts", F.timestamp_seconds((F.col("i") * 7919) % 50)), "k", "ts", "i")
    low = O.running(df, "k", "pos", F.col("v"), "low", block=16)
    both = O.running(low, "k", "pos", F.col("v"), "high", least=False, inclusive=False, block=16).collect()
    from pyspark.sql import Window

    cut, own = O.last_rows(df, "k", "pos", 3, block=16)
    sums = cut.withColumn("s", F.sum("v").over(Window.partitionBy("k", "_b").orderBy("pos").rowsBetween(-3, 0))).where(own).collect()
    for k in ("hot", "b"):
        own_rows = sorted((r for r in rows if r[0] == k), key=lambda r: ((r[1] * 7919) % 50, r[1]))
        values = [v for _, _, v in own_rows]
        found = sorted((r for r in both if r.k == k), key=lambda r: r.pos)
        assert [r.i for r in found] == [i for _, i, _ in own_rows] and [r.pos for r in found] == list(range(1, len(values) + 1))
        assert [r.low for r in found] == [min(values[: n + 1]) for n in range(len(values))]
        assert [r.high for r in found] == [max(values[:n], default=None) for n in range(len(values))]
        assert [r.s for r in sorted((r for r in sums if r.k == k), key=lambda r: r.pos)] == [sum(values[max(0, n - 3) : n + 1]) for n in range(len(values))]


def test_sweep_gates_count_words_once(spark, sf_dir):
    from lumetrica.plans import studies

    found = studies.sweep_gates(spark, sf_dir)
    assert "regexp_count" not in found._jdf.queryExecution().analyzed().toString().lower()
    assert found.count() == 6
