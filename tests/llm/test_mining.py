"""Collocations and source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from lumetrica.llm import collocations, divergence
from lumetrica.llm.common import stash


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts).withColumn("rank", F.lit("x")).withColumn("piece", F.lit(1))


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def plain_collocations(rows, longest, least, absorb, best):
    f, n, out = defaultdict(Counter), Counter(), set()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {q for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= absorb * counts[q := p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in inner:
                score, k = min(((1_000_000 * a * a) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


def mixed_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ß", "née", "x-y", "ab", "Zug", "\x00", "'"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", "\n", ",", " ", "!?"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s", "t", None])) for i in range(n)]
    return [*rows, *rows[:7], (None, None, "en", "s"), (1, "", "fr", "u"), (2, " , ; ", None, ""), (3, "a b " * 3000, "en", "s"), (4, "word " * 40 + "end" * 5000, "en", "t")]


@pytest.mark.parametrize(("longest", "least", "absorb", "best"), [(3, 10, 50, 2000), (4, 3, 70, 9), (2, 2, 50, 5)])
def test_collocations_equal_plain_python(spark, longest, least, absorb, best):
    rows = mixed_rows(longest)
    found = collocations.collocations(frame(spark, rows), longest=longest, least=least, absorb=absorb, best=best, shares=3)
    assert [t for _, t in found.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, found.collect())) == sorted(plain_collocations(rows, longest, least, absorb, best))


def test_small_blocks_and_buckets_that_spill_count_alike(spark, monkeypatch):
    rows = stash(collocations.pieces(frame(spark, mixed_rows(9))), "pieces")
    wanted = sorted(map(tuple, collocations.counted(rows, (0, 1, 2, 3), 2).collect()))
    monkeypatch.setattr(collocations, "BLOCK", 64)
    own = collocations._grams  # blocks of a few pieces give the same sums
    with collocations._duck(None, "100MB") as con:
        import pyarrow as pa

        table = pa.Table.from_pylist([r.asDict() for r in rows.collect()])
        total = Counter()
        for block in collocations._gathered(iter(table.to_batches())):
            for grams, _ in own(con, block, (1, 2), None):
                for r in grams.to_pylist():
                    total[r["lang"], r["gram"], r["n"]] += r["f"]
    assert {(a, b, n): f for a, b, n, f, _ in wanted if n in (1, 2)} == {k: v for k, v in total.items() if v >= 2}


def test_scores_pass_64_bits(spark):
    grams = spark.createDataFrame([("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12 + 1)], "lang string, gram string, n tinyint, f long")
    row = collocations.scored(grams, 3, 50).first()
    assert (row.a, row.l, row.r, row.score) == (3 * 10**12, 4 * 10**12, 5 * 10**12 + 1, 10**6 * 9 * 10**24 // (4 * 10**12 * (5 * 10**12 + 1)))


def test_mining_of_empty_tables(spark):
    empty = frame(spark, [], 1)
    assert collocations.collocations(empty).count() == 0
    assert divergence.audit(empty).count() == 0


def plain_audit(rows, least, best):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    far = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        of = {s: [counts[lang, s][t] for t in kept] for s in own}
        total = [sum(of[s][i] for s in own) for i in range(len(kept))]
        p = {s: [share(c, sum(of[s]), len(kept)) for c in of[s]] for s in own}
        q = [share(c, sum(total), len(kept)) for c in total]
        for s in own:
            pairs = [(-sum(map(far, p[s], p[o])), o.encode()) for o in own if o != s]
            terms = [(-far(x, y), t.encode()) for t, c, x, y in zip(kept, of[s], p[s], q, strict=True) if c > 0 and x > y]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out |= {(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("least", "best", "side"), [(10, 10, 32), (2, 3, 4), (10**6, 10, 32)])
def test_audit_equals_plain_python(spark, monkeypatch, least, best, side):
    monkeypatch.setattr(divergence, "SIDE", side)  # few groups to a block: many tiles
    rng = random.Random(least)
    rows = mixed_rows(least)
    rows += [(i, " ".join(rng.choice(["Haus", "baum", "été", "x1y", "ñ", f"w{i % 5}z"]) for _ in range(rng.randint(0, 30))), "de", f"s{i % 11}") for i in range(150)]
    rows += [(1, None, "de", "silent"), (2, "12 34", "it", "only")]
    found = divergence.audit(frame(spark, rows), least=least, best=best)
    assert [t for _, t in found.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_audit(rows, least, best))


def test_terms_of_a_block():
    import pyarrow as pa

    texts = ["Ab1c", None, "", "é-É x", "x", "ßA", "_"]
    terms, row = divergence.terms_of(pa.array(texts, pa.string()))
    assert [*zip(row.tolist(), terms.to_pylist(), strict=True)] == [(0, "ab"), (0, "c"), (3, "é"), (3, "É"), (3, "x"), (4, "x"), (5, "ßa")]


def test_shares_of_large_counts_are_exact():
    import numpy as np

    for c, n, v in product((0, 1, 10**12), (10**12, 10**13 + 7), (1, 999)):
        assert divergence.shares(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)
