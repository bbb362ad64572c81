"""Readers, writers and streams on files written by the tests."""

import struct

import pytest
from pyspark.sql import functions as F

from lumetrica.sources import files as S
from lumetrica.sources import sinks as K
from lumetrica.streaming import jobs as J


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_strings_runs_and_variants(spark, tmp_path):
    write(tmp_path / "p/ada_v1.2_clean.csv", 'utterance_id,hypothesis\nu1,"a, b"\nu2,\n')
    write(tmp_path / "p/ada.csv", "utterance_id,hypothesis\nu3,c\n")
    write(tmp_path / "p/zzz_noise.csv", "utterance_id,hypothesis\nu4,d\n")
    df = S.run_of_file(S.read_strings(spark, str(tmp_path / "p"), ["utterance_id", "hypothesis"]), ["ada", "ada_v1.2"])
    assert {(r.utterance_id, r.hypothesis, r.model, r.perturbation) for r in df.collect()} == {("u1", "a, b", "ada_v1.2", "clean"), ("u2", "", "ada_v1.2", "clean"), ("u3", "c", "ada", "clean")}
    assert [tuple(r) for r in S.unknown_runs(S.read_strings(spark, str(tmp_path / "p"), ["utterance_id", "hypothesis"]), ["ada", "ada_v1.2"]).collect()] == [("zzz_noise.csv", 1)]
    assert {r.audio_variant for r in S.with_variant(df).collect()} == {"clean"}
    assert sorted(r._row_index for r in S.with_row_index(df).collect()) == [0, 1, 2]


def test_line_formats(spark, tmp_path):
    t = S.read_transcripts(spark, write(tmp_path / "t.txt", "id1 HELLO THERE\nid2\nid3 X\n")).collect()
    assert [tuple(r) for r in t] == [("id1", "HELLO THERE"), ("id3", "X")]
    assert [tuple(r) for r in S.read_settings(spark, write(tmp_path / "s.txt", "A=1\nB=x=y\nnone\n")).collect()] == [("A", "1"), ("B", "x=y")]
    assert [tuple(r) for r in S.read_telemetry(spark, write(tmp_path / "g.txt", "1, 50, 900\nbad\n2, x, 3\n3,60,1000\n")).collect()] == [(1, 50, 900), (3, 60, 1000)]
    assert [tuple(r) for r in S.read_speakers(spark, write(tmp_path / "sp.txt", "; head\n14 | F | train\n"), ["id", "sex", "part"]).collect()] == [("14", "F", "train")]


def test_sections(spark):
    lines = ["== FS ==", "Model: a", "Axis: age", " young: 3.5% [3.0, 4.0]", "Model: b", " lost: 1.0% [1.0, 1.0]", "Axis: sex", " f: 2.0% [1.5, 2.5]"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_name string, line_no int, value string")
    found = S.parse_sections(df).orderBy("model").collect()
    assert [(r.section, r.model, r.axis, r.group, r.wer, r.low, r.high) for r in found] == [("FS", "a", "age", "young", 3.5, 3.0, 4.0), ("FS", "b", "sex", "f", 2.0, 1.5, 2.5)]


def test_wav(spark, tmp_path):
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 3200, b"WAVE", b"fmt ", 16, 1, 1, 16000, 32000, 2, 16, b"data", 3200)
    (tmp_path / "a.wav").write_bytes(head + bytes(3200))
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = {r.path[-5:]: r for r in S.wav_headers(spark, str(tmp_path)).collect()}
    assert (rows["a.wav"].sample_rate, rows["a.wav"].channels, rows["a.wav"].frames, rows["a.wav"].seconds) == (16000, 1, 1600, 0.1)
    assert rows["b.wav"].sample_rate is None
    assert S.directory_bytes(spark, str(tmp_path)).first().files == 2


def test_budget(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "id long, text string")
    assert sorted(r.id for r in S.within_budget(df, "id", "text", 4, 13).collect()) == [0, 1, 2]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(2, "z"), (2, "y")], "id int, y string")
    K.write_csv([a, b], str(tmp_path / "u"))
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).columns == ["id", "x", "y"]
    assert K.append_new(b, str(tmp_path / "l"), "id") == 1 and K.append_new(b.union(spark.createDataFrame([(3, "q")], b.schema)), str(tmp_path / "l"), "id") == 1
    safe = K.json_safe(spark.createDataFrame([(float("inf"),), (1.0,)], "v double")).collect()
    assert [(r.v, r.v_note) for r in safe] == [(None, "Infinity"), (1.0, None)]
    assert K.markdown(a).splitlines()[-1] == "| 1 | 2.00 |" and "2.0" in K.latex(a)
    assert K.report("All", {"A": a, "B": None}).splitlines()[-1] == "Not available." and "| 1 | 2.00 |" in K.report("All", {"A": a})
    assert K.nested_report(spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0)], "model string, g string, wer double"), ["model"], "g", ["wer"]).first().report == '{"a":{"wer":1.0},"b":{"wer":2.0}}'


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(2):
        events.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_events(spark, str(tmp_path / "in"))
    J.resume_append(stream, str(tmp_path / "out"), "event_id", str(tmp_path / "c1")).awaitTermination()
    J.resume_append(stream, str(tmp_path / "out"), "event_id", str(tmp_path / "c2")).awaitTermination()  # all again
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = J.telemetry_windows(stream, late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM w").first().n == events.count()
    q = J.patience(stream).writeStream.format("memory").queryName("p").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c4")).start()
    q.awaitTermination()
    best = {r.user_id: r.b for r in spark.sql("SELECT user_id, min(best) AS b FROM p GROUP BY user_id").collect()}
    assert best == {r.user_id: r.b for r in events.groupBy("user_id").agg(F.min("value").alias("b")).collect()}


def test_excluded_typed_and_optional_files(spark, tmp_path):
    write(tmp_path / "p/a.csv", "id,x\n1,2.5\n2,bad\n")
    write(tmp_path / "p/a_checkpoint.csv", "id,x\n9,9\n")
    assert {r.id for r in S.read_strings(spark, str(tmp_path / "p"), ["id", "x"], exclude="checkpoint", multiline=False).collect()} == {"1", "2"}
    assert [tuple(r) for r in S.read_typed(spark, str(tmp_path / "p/a.csv"), "id int, x double").orderBy("id").collect()] == [(1, 2.5), (2, None)]
    assert S.read_json_document(spark, str(tmp_path / "none.json"), "a int", optional=True).count() == 0
    assert S.read_json_document(spark, write(tmp_path / "d.json", '{\n"a": 3}'), "a int", optional=True).first().a == 3
    K.write_csv([], str(tmp_path / "empty"), spark)
    assert spark.read.text(str(tmp_path / "empty")).count() == 0 and S.there(spark, str(tmp_path / "empty"))


def test_durations_and_their_cache(spark, tmp_path):
    headers = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 4.0)], "path string, seconds double")
    manifest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "gone")], "id int, audio string")
    cache = str(tmp_path / "cache")
    first = {r.id: r.seconds for r in S.durations(manifest, headers, "audio", cache).collect()}
    assert first == {1: 2.0, 2: 5.0, 3: 5.0} and spark.read.parquet(cache).count() == 1
    more = manifest.union(spark.createDataFrame([(4, "c")], manifest.schema))
    again = {r.id: r.seconds for r in S.durations(more, headers, "audio", cache).collect()}
    assert again == {**first, 4: 4.0} and spark.read.parquet(cache).count() == 2


def test_sql_functions(spark):
    from lumetrica.functions import sql

    sql.register(spark)
    spark.createDataFrame([(i, "the cat sat", "the the cat sat umbrella", 1, 3) for i in range(40)], "id long, ref string, hyp string, e long, w long").createOrReplaceTempView("pairs")
    rows = spark.sql("SELECT word, category, count(*) AS n FROM pairs, LATERAL classify_insertions(ref, hyp, 'ngram') GROUP BY ALL").collect()
    assert {(r.word, r.category): r.n for r in rows} == {("the", "function"): 40, ("umbrella", "content"): 40}
    same = spark.sql("SELECT x.word, x.category, count(*) AS n FROM (SELECT explode(insertions(ref, hyp)) AS x FROM pairs) GROUP BY ALL").collect()
    assert {(r.word, r.category): r.n for r in same} == {("the", "function"): 40, ("umbrella", "content"): 40}
    interval = spark.sql("SELECT bootstrap_interval(id, e, w) AS b FROM pairs").first().b
    assert all(abs(x - 1 / 3) < 1e-9 for x in interval) and len(interval) == 3
    one = spark.sql("SELECT count_words('A b-c') AS n, edits_of_rate(0.5, 5) AS e, normalize_text('A  b-C') AS t, safe_label('_a b!') AS l").first()
    assert tuple(one) == (3, 2, "a b c", "a_b")


def test_status_and_rolling_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_events(spark, str(tmp_path / "in"))
    J.latest_status(stream).writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    wanted = {r.user_id: r.event_type for r in events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")).collect()}
    assert {r.user_id: r.event_type for r in spark.sql("SELECT * FROM s").collect()} == wanted
    J.rolling_means(stream, 2).writeStream.format("memory").queryName("m").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    last = spark.sql("SELECT event_type, max(batches) AS n, max_by(rolling, batches) AS r FROM m GROUP BY 1").collect()
    means = {}  # of the batches that have the kind, in the order in which files are read
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for f in files:
        for r in spark.read.parquet(str(f)).groupBy("event_type").agg(F.avg("value").alias("m")).collect():
            means.setdefault(r.event_type, []).append(r.m)
    for r in last:
        assert r.n == len(means[r.event_type]) and abs(r.r - sum(means[r.event_type][-2:]) / len(means[r.event_type][-2:])) < 1e-9


def wav_bytes(extra=b"", frames=1600):
    head = b"fmt " + (16).to_bytes(4, "little") + b"".join(x.to_bytes(n, "little") for x, n in ((1, 2), (1, 2), (16000, 4), (32000, 4), (2, 2), (16, 2)))
    body = b"WAVE" + extra + head + b"data" + (2 * frames).to_bytes(4, "little") + bytes(2 * frames)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_headers_are_read_in_pieces(spark, tmp_path):
    """A header behind a large chunk of another kind is found by two small reads; sound is never read."""
    whole = wav_bytes(b"LIST" + (1 << 20).to_bytes(4, "little") + bytes(1 << 20), 10**6)
    read = []

    def read_at(place, size):
        read.append(size)
        return whole[place : place + size]

    assert S.wav_header(read_at) == (16000, 1, 16, 10**6, 62.5, "pcm_s16le", 256000) and sum(read) <= 3 * S.PIECE
    for i in range(0, 44):
        assert S.wav_header(lambda a, n, i=i: wav_bytes()[:i][a : a + n]) == (None,) * 7
    for name, content in (("a.wav", whole), ("b.wav", b"R"), ("c d.wav", wav_bytes())):
        (tmp_path / name).write_bytes(content)
    found = {r.path.rpartition("/")[2]: r.frames for r in S.wav_headers(spark, str(tmp_path)).collect()}
    assert found == {"a.wav": 10**6, "b.wav": None, "c d.wav": 1600}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_sections_are_carried_over_blocks(spark, block):
    """Wherever a log is cut, its rows are those of the whole."""
    lines = ["a: 1.0% [0.5, 1.5]", "== One ==", "Model: m", "Axis: x", "a: 1.0% [0.5, 1.5]", "junk", "b: 2.0% [1, 3]", "Axis: y", "a: 3.0% [1, 4]", "Model: n", "a: 9.0% [1, 9]", "Axis: x", "a: 4.0% [1, 9]",
             "== Two", "a: 5.0% [1, 9]", "Model: m", "Axis: z", "", "a: 6.0% [1, 9]"]
    df = spark.createDataFrame([(f, i, x) for f in "fg" for i, x in enumerate(lines)], "file_name string, line_no long, value string")
    found = S.parse_sections(df, block=block).orderBy("file_name", "wer").collect()
    one = [("One", "m", "x", "a", 1.0), ("One", "m", "x", "b", 2.0), ("One", "m", "y", "a", 3.0), ("One", "n", "x", "a", 4.0), ("Two", "m", "z", "a", 6.0)]
    assert [(r.section, r.model, r.axis, r.group, r.wer) for r in found] == one * 2


def test_a_batch_counts_wholly_or_not_at_all(spark, tmp_path, monkeypatch):
    """A crash between write and mark leaves nothing that counts; the batch comes again, and a third time, and each key is there once."""
    path = str(tmp_path / "t")
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    assert K.read_committed(spark, path) is None and K.append_batch(frame([1, 2, 2]), path, "id", "s-0") == 2
    commit = K._commit
    monkeypatch.setattr(K, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        K.append_batch(frame([2, 3, 4]), path, "id", "s-1")
    assert sorted(r.id for r in K.read_committed(spark, path).collect()) == [1, 2]
    monkeypatch.setattr(K, "_commit", commit)
    assert [K.append_batch(frame([2, 3, 4]), path, "id", "s-1") for _ in range(3)] == [2, 0, 0]
    assert K.append_batch(frame([]), path, "id", "s-2") == 0 and K.append_batch(frame([4, 5]), path, "id", "s-3") == 1
    assert sorted(map(tuple, K.read_committed(spark, path).collect())) == [(i, f"v{i}") for i in range(1, 6)]


def test_patience_goes_on_over_batches_and_restarts(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(u, t, u * 1000 + t, rng.choice([1.0, 1.05, 1.5, 0.9, 2.0]) * (1 if u % 2 else 3 / (t + 1))) for u in range(6) for t in range(12)]
    schema = "user_id long, ts long, event_id long, value double"
    found = {}
    for half in ((0, 1), (2, 3)):  # the stream stops between, and another with the same checkpoint goes on
        for k in half:
            spark.createDataFrame([r for r in rows if r[1] // 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = J.patience(stream, 0.1, 3).writeStream.outputMode("update").foreachBatch(lambda df, _: found.update({r.user_id: (r.best, r.bad, r.stopped) for r in df.collect()}))
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for u in range(6):
        best, bad, stopped = float("inf"), 0, False
        for _, _, _, v in sorted(r for r in rows if r[0] == u):
            bad = bad + 1 if v > best * 1.1 else 0
            best, stopped = min(best, v), stopped or bad >= 3
        assert found[u] == (best, bad, stopped)
