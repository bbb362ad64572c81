"""Signal transforms against plain versions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lumetrica.operators import signals as S

RATE = 16_000


def seed(ident):
    return int(hashlib.md5(ident.encode()).hexdigest(), 16) % 2**31 + 42


def test_silence_with_fades():
    x = np.ones(8000, np.float32)
    y = S.faded_silence(x, "u1", 0.25, RATE)
    at = int(8000 * np.random.RandomState(seed("u1")).uniform(0.3, 0.7))
    assert len(y) == 10_000 and (y[at : at + 2000] == 0).all() and (y[: at - 80] == 1).all() and (y[at + 2080 :] == 1).all()
    assert np.allclose(y[at - 80 : at], np.linspace(1, 0, 80)) and np.allclose(y[at + 2000 : at + 2080], np.linspace(0, 1, 80))
    assert (S.faded_silence(x[:10], "u1", 0.5, RATE) == 0).sum() == 5


def test_masks_lie_apart():
    x = np.ones(16_000, np.float32)
    for ident in ("a", "b", "c"):
        y = S.masked_chunks(x, ident, 0.3, 3, RATE)
        runs = np.flatnonzero(np.diff(np.concatenate([[0], (y == 0).astype(int), [0]]))).reshape(-1, 2)
        long = runs[runs[:, 1] - runs[:, 0] >= 1600]
        # the last of a fade out and the first of a fade in are 0, too
        assert len(long) == 3 and all(1600 <= b - a <= 1602 for a, b in long)
        assert y.sum() < 16_000 - 3 * 1600 and len(y) == 16_000


def test_quiet_frames_go():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, 16_000).astype(np.float32)
    x[4000:9000] = 0
    frames, hop = 320, 160
    quiet = [20 * np.log10(np.sqrt(np.mean(x[i : i + frames].astype(float) ** 2) + 1e-12) + 1e-12) < -35 for i in range(0, len(x) - frames + 1, hop)]
    keep, i = np.ones(len(x), bool), 0
    while i < len(quiet):
        j = i
        while j < len(quiet) and quiet[j]:
            j += 1
        if j - i >= 20:
            keep[i * hop : j * hop + frames] = False
        i = max(j, i + 1)
    y = S.voiced(x, RATE)
    assert 0 < len(y) < len(x) and (y == x[keep]).all()
    assert len(S.voiced(x[:100], RATE)) == 100 and len(S.voiced(x[:0], RATE)) == 0


def test_reverberation_time():
    t = np.arange(RATE) / RATE
    assert abs(S.reverberation_time(10 ** (-3 * t / 0.5), RATE) - 0.5) < 0.01  # falls by 60 dB in half a second
    assert S.reverberation_time(np.zeros(5), RATE) == 0.0


def test_columns_of_samples(spark):
    df = spark.createDataFrame([("a", [0.5] * 400), ("b", None)], "id string, x array<float>")
    row = df.select("id", F.size(S.with_silence(0.5)("x", "id")).alias("n"), F.size(S.with_masks(0.2, 2)("x", "id")).alias("m"), F.size(S.without_silence()("x", "id")).alias("v"), S.rt60()("x", "id").alias("t")).collect()
    assert (row[0].n, row[0].m, row[0].v) == (600, 400, 400) and row[1].t is None


def test_quiet_runs_in_one_pass(spark):
    rng = np.random.default_rng(2)
    rows = [[float(v) for v in rng.choice([0.0, 0.0, 1.0], n)] for n in (0, 1, 5, 40, 300)] + [[0.0] * 9]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<double>").select("i", S.drop_quiet_runs(F.col("x"), 0.1, 3).alias("y")).collect()
    for r in found:
        x, wanted, at = rows[r.i], [], 0
        while at < len(x):
            end = at
            while end < len(x) and x[end] == 0:
                end += 1
            wanted += x[at:end] if end - at < 3 else []
            wanted += x[end : end + 1]
            at = end + 1
        assert r.y == wanted


def test_blocks_of_recordings_equal_the_whole(spark):
    """Each transform of blocks gives what the function of the whole recording gives."""
    from lumetrica.operators import recordings as L

    rng, rate, size = np.random.default_rng(3), 1000, 50
    own = {"a": rng.normal(0, 0.3, 730), "b": rng.normal(0, 0.3, 50), "c": np.ones(49), "d": np.zeros(300), "e": 10 ** (-3 * np.arange(900) / 400), "f": rng.normal(0, 0.3, 1000), "g": np.ones(1)}
    own["f"][130:520] = 0
    own["a"][600:] = 0.0001
    own = {k: v.astype(np.float32) for k, v in own.items()}
    blocks = L.in_blocks(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in own.items()] + [("null", None)], "ident string, x array<float>"), "ident", "x", size)

    def whole(found):
        rows = {}
        for r in found.orderBy("ident", "start").collect():
            rows.setdefault(r.ident, []).extend(r.samples)
        return {k: np.array(rows.get(k, []), np.float64) for k in own}

    kernel = np.exp(-np.arange(180) / 40)
    found = {
        "masked": whole(L.masked(blocks, 0.3, 3, rate)), "silenced": whole(L.silenced(blocks, 0.4, size, rate)), "voiced": whole(L.voiced(blocks, size, rate)),
        "reverberant": whole(L.reverberant(blocks, kernel.tolist(), size))}
    for k, x in own.items():
        assert np.allclose(found["masked"][k], S.masked_chunks(x, k, 0.3, 3, rate)), k
        assert np.allclose(found["silenced"][k], S.faded_silence(x, k, 0.4, rate)), k
        assert np.allclose(found["voiced"][k], S.voiced(x, rate)), k
        y = np.convolve(x.astype(float), kernel)[: len(x)]
        assert np.allclose(found["reverberant"][k], y * np.sqrt((x.astype(float) ** 2).sum() / (y * y).sum()) if (y * y).sum() else y, atol=1e-6), k
    assert len(found["voiced"]["f"]) < 1000 and len(found["silenced"]["f"]) == 1400
    times = {r.ident: r.seconds for r in L.reverberation_time(blocks, rate).collect()}
    for k, x in own.items():
        assert abs(times[k] - S.reverberation_time(x, rate)) < 0.0021, k


def test_blocks_go_to_python_many_at_a_time(spark):
    """Python is not called for each block by itself, which would cost far more than its samples."""
    from lumetrica.operators import recordings as L

    blocks = L.in_blocks(spark.createDataFrame([("a", [0.5] * 100)], "ident string, x array<float>"), "ident", "x", 32)
    for found in (L.reverberant(blocks, [1.0, 0.5], 32), L.voiced(blocks, 32, 1000)):
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
