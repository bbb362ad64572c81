"""The pipeline and its stages on odd tables, and each stage against a plain version."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumetrica.llm import decontamination, language_id
from lumetrica.llm.common import id_bucket

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "key", "text_", "_text", "score", "lang_pred", "_words", "_spans", "_items", "words", "spans", "items", "uid", "held", "fp", "node", "row", "shard")


def tables(spark, path, rows, items=((1, "never in any of these texts at all"),), extra=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def make(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(rng, n=30):
    return [(i, make(rng, "abcdefgh" if i % 2 else "qrstuvwx", 60), "en" if i % 2 else "de", "s", 0) for i in range(n)]


def test_empty_tables(spark, tmp_path):
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, [], []))
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "n_tokens"]


def test_nulls_repeats_ties_and_columns_of_any_name(spark, tmp_path):
    rng = random.Random(41)
    rows = corpus(rng)
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "s", 0), (None, make(rng, "abcdefgh", 50), "en", "s", 0), (5, make(rng, "abcdefgh", 50), None, None, None), (60, None, None, None, None),
             (61, "", "en", "s", 0), (62, make(rng, "abcdefgh", 20_000), "en", "s", 0)]
    path = tables(spark, tmp_path, rows, extra=CLASHING)
    found = corpus_pipeline.run(spark, path).collect()
    # of two texts with one id both stay, of equal rows one; a null id goes where another has the text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted([*((False, i) for i in range(30)), (True, 0), (False, 5), (False, 62)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name


def test_language_stage_drops_what_the_method_rejects(spark, tmp_path):
    rng = random.Random(42)
    rows = corpus(rng, 60) + [(100 + i, make(rng, "abcdefghqrstuvwx", 3), "en", "s", 0) for i in range(20)] + [(200, "12 -- 3", "en", "s", 0)]
    path = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs, id_bucket(F.col("doc_id"), 4) != 2)).collect()
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, path).collect()}
    assert kept == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5} and set(range(60)) <= kept and 200 not in kept


def test_decontamination_stage_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(43)
    items = [(i, make(rng, "abc", rng.choice([3, 9, 10, 25]))) for i in range(12)]
    rows = []
    for i in range(80):
        item = items[i % 12][1].split()
        part = item[: rng.choice([2, 9, 10, 30])]
        rows.append((i, " ".join([make(rng, "xyz", 8), *part, make(rng, "xyz", 8)]), "en", "s", 0))
    path = tables(spark, tmp_path, rows, items)

    def contaminated(text):
        words = text.split()
        for _, item in items:
            own = item.split()
            n = min(10, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
                return True
        return False

    kept = {r.doc_id for r in corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert kept == {r[0] for r in rows if not contaminated(r[1])} and 0 < len(kept) < 80
    assert decontamination.FILTER_BITS < 31


def test_near_dedup_stage_against_all_pairs(spark, tmp_path):
    """On the documents of the smallest tables: links of whole shingle sets at 0.8 and of fingerprints at three bits."""
    from lumetrica.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets, prints = [], []
    for _, text in rows:
        found = simhash.shingles(text.encode(), 5)
        sets.append(set(found))
        prints.append(simhash.majority(__import__("numpy").array([simhash.xxhash.xxh64_intdigest(x, 42) for x in found], "u8")))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) or (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(least.values())


@pytest.mark.parametrize("crowded", [12, 10_000])
def test_a_crowd_just_below_the_likeness_makes_no_square(spark, monkeypatch, crowded):
    """Groups of edits of two templates: most texts are far from each other, some are near a few, and all links are found."""
    from lumetrica.llm import simhash
    from lumetrica.llm.common import digest

    rng = random.Random(45)
    texts = []
    for size in (120, 90):
        base = make(rng, "abcdefgh", size).split()
        for _ in range(150):
            words = [*base]
            for at in rng.sample(range(size), rng.choice([1, 2, 4, 5, 6])):
                words[at] = make(rng, "xyz", 1) if rng.random() < 0.8 else ""
            texts.append(" ".join(words))
        # later edits of edited texts, so that some are near others that are far from the template
        texts += [f"{x} {make(rng, 'xyz', rng.choice([1, 2]))}" for x in rng.sample(texts, 20)]
    sets = [set(simhash.shingles(x.encode(), 5)) for x in texts]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", digest(F.col("text")))
    nodes = docs.select(F.col("id").alias("node"), F.col("id").alias("c"), "key")
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    found = {(max(r), min(r)) for r in map(tuple, simhash._whole_pairs(docs, nodes, 5, 0.8).collect())}
    mine = list(range(len(texts)))

    def reach(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for i, j in found & links:
        mine[reach(i)] = reach(j)
    assert all((find(i) == find(j)) == (reach(i) == reach(j)) for i in range(len(texts)) for j in range(i))
    assert 1 < len({find(i) for i in range(len(texts))}) < len(texts)
    if crowded < 100:
        assert len(found - links) < 3 * len(texts), len(found - links)


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Whoever writes a stage: 12 MB of texts in one partition are several batches, and a setting of the session's own stays."""

    def sizes(*_):
        def run(batches):
            for b in batches:
                n = len(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.nbytes] * n), pa.array([[]] * n, pa.list_(pa.int32())), pa.array([""] * n)], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

        return run

    monkeypatch.setattr(corpus_pipeline.sentencepiece, "_tokens", sizes)
    for own in (None, "64m"):
        session = spark.newSession()
        if own:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
        docs = session.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh', 512) AS text")
        most = corpus_pipeline.encode(session, docs, "").agg({"n_tokens": "max"}).first()[0]
        assert most > 10_000_000 if own else most < 4_000_000
