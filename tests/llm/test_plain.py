"""What the methods add, against plain versions: fingerprints and likeness, license labels and scores, shards, language scores."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lumetrica.llm import document_fingerprints, language_id, license_scan, sharding

WORDS = "the of and haus maison perro blue sky, Zug. été 12 ñu a b".split(" ")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_kept(text):
    places = (1 << 28) - 1
    grams = [signed(xxhash.xxh64_intdigest(text[i : i + 8].encode("utf-32-be"), 42)) for i in range(max(1, len(text) - 7))]
    grams = [(x & ~places) | (places - i) for i, x in enumerate(grams)]
    kept = [min(grams)] if len(grams) < 16 else [min(grams[i : i + 16]) for i in range(len(grams) - 15)]
    return list(dict.fromkeys(kept)) if text else []


def plain_likeness(a, b):
    x, y = ({k >> 28 for k in kept} for kept in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_and_likeness_against_plain_versions(spark):
    rng = random.Random(31)
    own = ["", "a", "a b c", None, "x" * 33, "x" * 32, "é" * 40 + " tail", "本" * 50, "one  two"]
    own += [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (3, 4, 5, 10, 11, 12, 40, 200)] + ["".join(rng.choice("abc") for _ in range(90)) + " z"]
    own += ["".join(rng.choice(of) for _ in range(n)) for n in (70, 77, 78, 79, 150, 160, 161, 400, 77, 900) for of in ("ab", "abcdefgh é日😀")]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("part", F.lit(3)).withColumn("key", F.lit(1))
    found = {r.doc_id: r for r in document_fingerprints.compare_with_edits(docs).collect()}
    words = lambda kept: ",".join(map(str, kept))
    order = list(range(len(own) - 1, -1, -1))
    for i, key in enumerate(order):
        text, after = own[key] or "", own[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        kept, edited, other = map(plain_kept, (text, text[: len(text) - half] + after[:half], after))
        r = found[key]
        assert (r.fingerprint, r.edited_fingerprint) == (words(kept), words(edited))
        assert abs(r.near_edited - plain_likeness(kept, edited)) < 1e-12 and abs(r.near_next - plain_likeness(kept, other)) < 1e-12


def test_license_labels_and_scores_against_a_plain_version(spark):
    rng = random.Random(32)
    filler = ["license", "the", "copy", "under", "software", "permission", "word"]
    own = [None, "", "MIT license", "the Apache License, version 2.0"]
    for _, notice, _ in license_scan.NOTICES:
        own += [notice, " ".join(rng.choice(filler) for _ in range(5)) + " " + notice + " " + " ".join(rng.choice(filler) for _ in range(5))]
        cut = notice.split(" ")
        own.append(" ".join(w if rng.random() < 0.9 else "changed" for w in cut) + " mit license")
        own.append(" ".join(cut[: len(cut) * 2 // 3]))
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("places", F.lit(1)).withColumn("begins", F.lit(1))
    texts = [license_scan.split_words(t or "") for t in own]
    templates = license_scan._templates()
    df = Counter(w for t in texts for w in set(t))
    idf = lambda w: math.log((len(own) + 1) / (df[w] + 0.5)) + 1e-9
    for r in license_scan.scan(docs).collect():
        text, wanted = texts[r.doc_id], set()
        for number, (label, base, words, needed) in enumerate(templates):
            for start in range(-len(words), len(text)):
                at = lambda i: text[start + i] if 0 <= start + i < len(text) else None  # noqa: E731,B023
                if all(at(i) == words[i] for i in needed):
                    share = sum(idf(w) for i, w in enumerate(words) if at(i) == w) / sum(map(idf, words))
                    wanted.add((number, base, label, start, round(min(1.0, share), 9)))
        assert {(p.template, p.base, p.label, p.start, round(p.coverage, 9)) for p in r.places} == wanted
        assert len(r.places) == len(wanted)


def test_shards_have_the_shortest_prefix_that_fits(spark):
    rng = random.Random(33)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(500)], "doc_id long, text string")
    bits = {r.doc_id: f"{r.h & (1 << 64) - 1:064b}" for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    size = {r.doc_id: len(r.text) for r in docs.collect()}
    for limit in (1000, 7000, 10**6):
        sums = defaultdict(int)
        for i, b in bits.items():
            for n in range(65):
                sums[b[:n]] += size[i]
        found = {r.doc_id: r for r in sharding.assign(docs, max_bytes=limit, depth=20).collect()}
        assert len(found) == 500
        for i, r in found.items():
            assert r.shard == bits[i][: next(n for n in range(65) if sums[bits[i][:n]] <= limit)] and not r.oversized


def test_written_shards_hold_repeated_rows_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "doc_id long, text string").withColumn("row", F.lit(5))
    sharding.write_shards(docs, str(tmp_path / "out"), max_bytes=1)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text or "", r.row) for r in found.collect()) == [(1, "a", 5), (1, "a", 5), (1, "b", 5), (2, "", 5)]


def test_language_scores_against_a_plain_version(spark):
    rng = random.Random(34)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno"}
    own = [(i, "".join(rng.choice(letters[lang] + " É") for _ in range(rng.randint(1, 90))), lang) for i, lang in enumerate(["aa", "bb", "bb", "cc"] * 12)]
    own += [(100, "½ ²", "aa"), (101, "①", "aa"), (102, None, "bb"), (103, "abc", None)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    orders, bits, alpha, evidence = 3, 10, 0.5, 30
    mask, factors = (1 << 32) - 1, [int(x) for x in language_id.FACTORS]

    def slots(text):
        chars = [ord(c) for c in text.lower()]
        for i in range(len(chars)):
            value = 0
            for n in range(1, min(orders, len(chars) - i) + 1):
                value = ((value ^ chars[i + n - 1]) * factors[n - 1] + n) & mask
                yield (((value ^ (value >> 15)) * factors[2]) & mask) >> (32 - bits)

    learn = [(t, lang) for _, t, lang in own if t is not None and lang is not None]
    labels = sorted({lang for _, lang in learn})
    counts = {lang: Counter(s for t, own_lang in learn if own_lang == lang for s in slots(t)) for lang in labels}
    total = {lang: sum(c.values()) + alpha * (1 << bits) for lang, c in counts.items()}
    prior = Counter(lang for _, lang in learn)
    found = language_id.predict(docs, language_id.train(docs, F.lit(True), orders=orders, bits=bits, alpha=alpha)).collect()
    for r in found:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = list(slots(r.text))
        logs = np.array([sum(math.log((counts[x][i] + alpha) / total[x]) for i in s) + math.log(prior[x] / len(learn)) for x in labels])
        assert r.lang_pred == labels[int(np.argmax(logs))]
        scaled = logs * min(1, evidence / len(s))
        assert abs(r.score - 1 / np.exp(scaled - scaled.max()).sum()) < 1e-4
