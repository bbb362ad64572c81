"""The operators of the llm subpackage against brute force, on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumetrica.llm import common, components, decontamination, document_fingerprints, language_id, license_scan, lm_scoring, sharding, simhash, token_counts, url_filter
from lumetrica.llm import sentencepiece as sp
from lumetrica.llm.queries import QUERIES

WORDS = "the of and haus maison perro blue sky, Zug. été 12 ñu\n".split(" ")


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "-"]) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    own = [None, "", " ", "▁ x", "a" * 5000, *texts(60, 1)]
    own += own[10:14] + [own[20] + " one more word"]
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(own)]
    return frame(spark, [*rows, rows[30], rows[0]]).withColumn("score", F.lit(1)).withColumn("fp", F.lit("x"))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_encoding_equals_the_library(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    found = sp.encode_documents(docs, outputs=("ids", "ids_sha256", "decoded", "decoded_sha256"), max_chunks=20).collect()
    assert len(found) == len(rows)
    for (key, text), r in zip(rows, found, strict=True):
        ids = [lib.bos_id(), *lib.encode(text or ""), lib.eos_id()]
        assert (r.doc_id, r.ids, r.n_tokens, r.decoded) == (key, ids, len(ids), lib.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sp.encode_documents(docs.limit(0)).count() == 0


def test_chunks_on_odd_spaces():
    pieces = sp.PieceTable(sp.model_bytes(sp.default_model()))
    rng = random.Random(5)
    odd = ["", " ", "  ", "a ", " a", "a  b", "▁▁a ▁", *("".join(rng.choice(" ▁ab\nZé日.<s>1😀\x00") for _ in range(rng.randint(0, 25))) for _ in range(800))]
    ids, counts = pieces.encode(odd)
    assert pieces.by_chunk and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == pieces.processor.encode(odd)


def test_token_counts_against_lists(spark, docs):
    lengths = [r.n_tokens for r in sp.encode_documents(docs, outputs=()).collect()]
    found = token_counts.limits(token_counts.histogram(docs), span=16)
    assert found.count() == len(set(lengths))
    for r in found.collect():
        cut = r.length
        assert (r.n_docs, r.docs_up_to, r.docs_over) == (lengths.count(cut), sum(x <= cut for x in lengths), sum(x > cut for x in lengths))
        assert (r.tokens_up_to, r.truncated_tokens, r.total_tokens) == (sum(x for x in lengths if x <= cut), sum(min(x, cut) for x in lengths), sum(lengths))
    wanted = spark.createDataFrame([(1,), (40,), (10**7,)], "limit long")
    assert {r.limit: r.truncated_tokens for r in token_counts.at_limits(found, wanted).collect()} == {k: sum(min(x, k) for x in lengths) for k in (1, 40, 10**7)}
    assert {r.share: r.length for r in token_counts.quantiles(found, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_counts.limits(token_counts.histogram(docs.limit(0))).count() == 0


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def test_url_rules_and_model(spark):
    urls = [None, "", "nourl", "HTTP://Example.ORG/es/1?x#y", "http://a.example.org/en/1", "http://org", "x://b.com/fr/", "x://com/de/?q", "x://xcom/de/", "a://b://c.org/z", "x://h?//p/", *[f"http://h{i % 7}.net/p/{i}" for i in range(40)],
            *[f"http://good{i}.org/q/{i}" for i in range(20)], *[f"http://bad{i}.com/de/{i}" for i in range(20)], "http://good1.net/q/7", "http://bad2.com/es/3", "http://bad2.com/es/3"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = plain_rule(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule and rule[0])
        assert found[i].verdict == rule[1] if rule else found[i].verdict in ("allow", "block")
    assert found[len(urls) - 3].verdict == "allow" and found[len(urls) - 1].verdict == "block" and found[len(urls) - 1].score == found[len(urls) - 2].score
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules=[]).collect()} == {"allow"}


def test_url_scores_against_plain_models(spark):
    rng = random.Random(21)
    urls = [f"http://{rng.choice(['good', 'fine'])}{rng.randint(0, 9)}.org/{rng.choice('abc') * 3}" for _ in range(40)]
    urls += [f"http://{rng.choice(['bad', 'evil'])}{rng.randint(0, 9)}.com/de/{rng.choice('xyz') * 3}" for _ in range(40)]
    urls += [f"http://{rng.choice(['good', 'evil'])}{i}.net/{rng.choice('abcxyz') * 3}" for i in range(30)] + [None, "", "http://good1.net/aaa"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    held = {r.url for r in pages.where("pmod(xxhash64(url), 5) = 0").collect()}
    decided = {u: "allow" if u and ".org/" in u else "block" if u and ".com/de/" in u else None for u in urls}
    grams = lambda u: [p[i : i + 4] for p in ["\x02" * 3 + (u or "") + "\x03"] for i in range(len(p) - 3)]
    counts = {}
    for kind in ("allow", "block"):
        c = counts[kind] = Counter()
        for u in urls:
            if decided[u] == kind and u not in held:
                for g in grams(u):
                    for n in range(4):
                        c["n", g[3 - n :]] += 1
                        c["all", n, g[3 - n : 3]] += 1

    def score(u):
        total = 0.0
        for g in grams(u):
            for kind, sign in (("allow", 1), ("block", -1)):
                p, c = 1 / 256, counts[kind]
                for n in range(4):
                    p = (c["n", g[3 - n :]] + 2 * p) / (c["all", n, g[3 - n : 3]] + 2)
                total += sign * math.log(p)
        return total / len(grams(u))

    mean, var = {}, {}
    for kind in ("allow", "block"):
        x = [score(u) for u in urls if decided[u] == kind and u in held]
        mean[kind], var[kind] = np.mean(x), np.var(x)
    s = {k: math.sqrt(v / 2 + sum(var.values()) / 4) for k, v in var.items()}
    limit = (mean["allow"] * s["block"] + mean["block"] * s["allow"]) / sum(s.values())
    for common in (5, 1000):
        for r in url_filter.judge(pages, common=common).collect():
            u = urls[r.page_id]
            assert abs(r.threshold - limit) < 1e-6
            if decided[u]:
                assert r.score is None and r.verdict == decided[u]
            else:
                assert abs(r.score - score(u)) < 1e-6 and r.verdict == ("allow" if r.score >= r.threshold else "block")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_against_all_windows(spark):
    rng = random.Random(7)
    items = [(0, None), (1, ""), (2, "Haus"), (3, "blue sky"), *[(i, t) for i, t in enumerate(texts(12, 8, 40), 4)], (4, "dup id"), (None, "the of")]
    items += [(20, "same " * 30), (21, "same " * 9 + "end of it all"), (22, "a b a b a b a b a b a b a c")]
    own = [None, "", *(t + (items[rng.randrange(2, 16)][1]).upper() + " " + t for t in texts(40, 9))]
    own += ["same " * 50, "same " * 9, "x " + "same " * 12 + "end of it all " * 2, "a b " * 20 + "a c", "b a " * 7 + "c"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(frame(spark, [(i, t, None, None, None) for i, t in enumerate([*own, own[5]])]), bench).collect()
    assert len(found) == len(own) + 1
    for r in found:
        text = [*own, own[5]][r.doc_id]
        w, hit, ids = words_of(text), set(), set()
        for key, item in items:
            x = words_of(item)
            n = min(10, len(x))
            spans = {tuple(x[q : q + n]) for q in range(len(x) - n + 1)} if x else ()
            for p in range(len(w) - n + 1 if spans else 0):
                if tuple(w[p : p + n]) in spans:
                    hit |= set(range(p, p + n))
                    ids.add("" if key is None else str(key))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), digest, bool(hit))


def test_items_without_an_id_contaminate(spark):
    bench = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    row = decontamination.contamination(frame(spark, [(0, " ".join(f"w{i}" for i in range(30)), None, None, None)]), bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (30, 30, 1, True)


def test_decontamination_of_repeated_words(spark):
    bench = spark.createDataFrame([(1, "same " * 500)], "item_id long, text string")
    found = decontamination.contamination(frame(spark, [(0, "same " * 350_000, None, None, None)]), bench).first()
    assert (found.n_words, found.n_hit, found.n_items) == (350_000, 350_000, 1)


def test_decontamination_with_columns_of_any_name(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "x a b c d e f g h i j z", 1), (1, "clean", 2)], "doc_id long, text string, uid long")
    for name in ("held", "hits", "listed", "n_words", "hit_uid", "words", "spans", "items", "score", "lang_pred"):
        docs = docs.withColumn(name, F.lit(7))
    found = decontamination.find_contamination(docs, bench)
    assert found.columns[:-3] == docs.columns
    assert sorted((r.doc_id, r._words, r._spans, r._items) for r in found.collect()) == [(0, 12, [1, 11], ["1"]), (1, 1, [], [])]


def test_decontamination_of_nothing(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(docs, nothing).collect())
    assert decontamination.contamination(docs.limit(0), nothing).count() == 0
    with pytest.raises(ValueError):
        decontamination.find_contamination(docs.withColumn("_words", F.lit(1)), nothing)


@pytest.mark.parametrize("limit", [200, 3000, 10**6])
def test_shards_fit_and_hold_every_row(spark, docs, limit):
    rows = [(r.doc_id, len((r.text or "").encode())) for r in docs.collect()]
    many = docs.unionByName(docs.where("doc_id = 30").crossJoin(spark.range(200)).drop("id"))
    found = sharding.assign(many, max_bytes=limit).collect()
    assert Counter(r.doc_id for r in found) == Counter([k for k, _ in rows] + [30] * 400)
    per = {}
    for r in found:
        per.setdefault(r.shard, []).append(r)
    for shard in per.values():
        assert sum(r.bytes for r in shard) <= limit or (len(shard) == 1 and shard[0].oversized)
    plain = [s for s in per if "." not in s]
    assert not any(a != b and a.startswith(b) for a in plain for b in plain)  # prefixes of a directory
    assert sharding.assign(docs.limit(0)).count() == 0


def test_shards_depend_on_rows_alone(spark):
    rows = [(7 if i < 300 else None if i < 400 else i, "same text" if i % 3 else f"text {i % 40}", None, None, None) for i in range(420)] + [(9, "x" * 500, None, None, None)] * 2
    table = frame(spark, rows)
    found = [Counter((r.doc_id, r.bytes, r.shard, r.oversized) for r in sharding.assign(x, max_bytes=90).collect()) for x in (table.coalesce(1), table.repartition(4), table.orderBy(F.desc("text")).repartition(7, "text"))]
    assert found[0] == found[1] == found[2]
    sizes = Counter()
    for (_, size, shard, oversized), n in found[0].items():
        sizes[shard] += size * n if not oversized else 0
    assert max(sizes.values()) <= 90


def test_written_shards(spark, docs, tmp_path):
    unique = docs.where("doc_id > 40").dropDuplicates(["doc_id"])
    found = sharding.write_shards(unique, str(tmp_path / "out"), max_bytes=3000)
    assert {(r.doc_id, r.shard) for r in spark.read.schema("doc_id long, shard string").parquet(str(tmp_path / "out")).collect()} == {(r.doc_id, r.shard) for r in found.collect()}


def test_many_labels_are_scored_in_groups(spark):
    rng = random.Random(8)
    word = lambda i: "".join(chr(97 + (i * 7 + j * j + i // 26) % 26) for j in range(4))
    rows = [(k, " ".join(word(i) for _ in range(6)) + " " + rng.choice("abc"), f"l{i:03}", None, None) for k, i in enumerate(list(range(620)) * 2)]
    table = frame(spark, [*rows, (5000, None, "l001", None, None), (5001, "12", "l002", None, None)])
    whole, parts = language_id.train(table, F.lit(True), bits=8, group=1000), language_id.train(table, F.lit(True), bits=8, group=250)
    assert [len(x.labels) for x in whole] == [620] and [len(x.labels) for x in parts] == [250, 250, 120]
    a, b = ({(r.doc_id, r.lang): (r.lang_pred, round(r.score, 9)) for r in language_id.predict(table, m).collect()} for m in (whole, parts))
    assert a == b and a[5000, "l001"] == a[5001, "l002"] == ("und", 0.0)
    assert language_id.identify(table, bits=8).count() == len(rows) + 2  # any number of labels


def test_language_id(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.identify(table).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found)
    model = language_id.train(docs, F.lit(True))
    odd = {r.doc_id: r for r in language_id.predict(docs.drop("score"), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[4].lang_pred in ("de", "en")
    assert {r.lang_pred for r in language_id.predict(docs.drop("score"), language_id.train(docs.where("lang = 'xx'"), F.lit(True))).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.predict(docs, model)
    # the label, the source and the id of a row never matter to its prediction
    again = language_id.predict(docs.drop("score").withColumn("lang", F.lit("fr")).withColumn("source", F.lit("z")), model).collect()
    assert [r.lang_pred for r in again] == [r.lang_pred for r in language_id.predict(docs.drop("score"), model).collect()]


def test_a_rare_language_beside_a_dominant_close_one(spark):
    rng = random.Random(17)
    text = lambda n, share: "".join("a" if rng.random() < share else "b" for _ in range(n))
    rows = [(i, text(40, 0.5), "hot", "s", 0) for i in range(3000)] + [(3000, text(300_000, 0.62), "rare", "s", 0)]  # enough to learn from
    model = language_id.train(frame(spark, rows), F.lit(True), alpha=0.01)
    long = frame(spark, [(i, text(5000, (0.5, 0.62)[i % 2]), None, "s", 0) for i in range(20)] + [(20, "a", None, "s", 0)])
    found = {r.doc_id: r for r in language_id.predict(long, model).collect()}
    assert [found[i].lang_pred for i in range(21)] == ["hot", "rare"] * 10 + ["hot"]  # on a single letter the prior decides
    assert all(0.5 <= r.score <= 1 for r in found.values())


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints, radius=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark, docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = groups_of(prints)
    least = {}
    for (key, _), root in zip(rows, roots, strict=True):
        least[root] = min(key, least.get(root, key))
    wanted = sorted((key, f"{p:016x}", least[root]) for (key, _), p, root in zip(rows, prints, roots, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(docs).collect()) == wanted
    assert simhash.near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [1, 200])
def test_near_pairs_loses_none(spark, crowded):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:60]:
        prints |= {p ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, crowded).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_rows_after_an_explode_are_not_broadcast(spark):
    """Spark sizes them as before it: the looked-up halves of 236,000 fingerprints were a broadcast of 1.9 GB."""
    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    texts = spark.range(50).select("id", F.col("id").alias("node"), F.array(F.xxhash64("id"), F.lit(1).cast("long")).alias("sketch"))
    for df in (simhash.near_pairs(fps, 3), simhash._quick_pairs(texts, 0.8)):
        joins = [x.strip(" +-:") for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert joins[0].startswith("SortMergeJoin") and not any("Inner" in x and "Broadcast" in x for x in joins), joins


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001)], "x long, y long")
    found = {r.node: r.component for r in components.connected_components(edges, "x", "y").collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(edges.limit(0), "x", "y").count() == 0


def test_keep_one_of_each_group(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(150)) for _ in range(6)]
    near = [" ".join([*t.split()[:-2], "other", "end"]) for t in base]  # likeness above 0.9
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*base, *near, base[0], None, ""])]
    docs = frame(spark, [*rows, rows[3], (3, base[5] + " x y", "en", "s", 0), (None, "only null id", "en", "s", 0)])
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(-1, "only null id"), (13, ""), *((i, base[i]) for i in range(5)), (3, base[5] + " x y")])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_similar_texts_loses_no_link_on_templates_and_chains(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = [word() for _ in range(150)]
    own = []
    for _ in range(250):  # pairs of about 0.85 on a passage that makes all others about 0.6
        x = passage + [word() for _ in range(50)]
        own += [x, [*x[:-8], *(word() for _ in range(8))], passage + [word() for _ in range(35 + rng.randint(0, 9))]]
    x = [word() for _ in range(120)]
    for i in range(150):  # a chain of versions
        own.append(x)
        at = rng.randrange(110)
        x = [*x[:at], word(), *x[at + 1 : 110], *(word() for _ in range(5)), *x[115:]]
    keys = list(range(len(own)))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in own]
    wanted = [(i, j) for i in range(len(own)) for j in range(i) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in zip(keys, own, strict=True)], "id long, text string").withColumn("key", common.digest(F.col("text")))
    assert len(wanted) > 250
    assert groups_by_text(table) == linked_groups(keys, wanted)


def linked_groups(keys, pairs):
    """The smallest key that each key reaches."""
    root = {k: k for k in keys}
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in keys]


def groups_by_text(table):
    """The smallest id of each id's group, by text_groups without fingerprints' links (radius 0)."""
    rows, nodes, linked = simhash.text_groups(table, radius=0)
    component = {r.node: r.component for r in linked.collect()}
    of = {bytes(r.key): component.get(r.node, r.node) for r in nodes.collect()}
    own = {r.id: of[bytes(r.key)] for r in rows.collect()}
    least = {}
    for i, c in own.items():
        least[c] = min(i, least.get(c, i))
    return [least[own[i]] for i in sorted(own)]


def test_similar_texts_of_paragraphs(spark):
    """Texts that each draw 10 of 14 paragraphs: many meet in part, some at 0.8 or more."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    parts = [[word() for _ in range(30)] for _ in range(14)]
    own = [sum((parts[i] for i in rng.sample(range(14), 10)), []) for _ in range(60)]
    own += [sum((parts[i] for i in sorted(rng.sample(range(14), 10))), []) for _ in range(240)]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in own]
    wanted = [(i, j) for i in range(len(own)) for j in range(i) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(own)], "id long, text string").withColumn("key", common.digest(F.col("text")))
    assert wanted and groups_by_text(table) == linked_groups(range(len(own)), wanted)


def test_keep_one_with_columns_of_any_name(spark):
    rows = [(i, t, "x") for i, t in enumerate(["a b c d e f", "a b c d e f", "other words are here", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    for name in ("key", "text_", "_text", "text_key", "kept_key", "kept_id", "repeated", "fp", "node", "component"):
        docs = docs.withColumn(name, F.lit(7))
    found = simhash.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == [0, 2, 3]


def test_fingerprints_and_edits(spark, docs, rows):
    found = {(r.doc_id, r.fingerprint): r for r in document_fingerprints.compare_with_edits(docs.where("doc_id IS NOT NULL")).collect()}
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: -x[0])
    prints = {}
    for r in found.values():
        prints.setdefault(r.doc_id, r)
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = prints[key]
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if i + 1 < len(order) and after[0] != key:  # repeated ids follow each other
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for key, text in order:
        assert by_text.setdefault(text, prints[key].fingerprint) == prints[key].fingerprint
    assert document_fingerprints.compare_with_edits(docs.limit(0)).count() == 0
    one = document_fingerprints.compare_with_edits(docs.where("doc_id = 25").limit(1)).first()
    assert one.near_next == 1.0


def plain_winnowed(text, k=8, window=16):
    """(hash, place) of what winnowing keeps, straight from its definition."""
    if not text:
        return []
    grams = [xxhash.xxh64_intdigest(text[i : i + k].encode("utf-32-be"), 42) >> 28 for i in range(max(1, len(text) - k + 1))]
    signed = [x - (1 << 36) if x >> 35 else x for x in grams]
    starts = range(max(1, len(grams) - window + 1))
    places = dict.fromkeys(min(range(i, min(i + window, len(grams))), key=lambda j: (signed[j], -j)) for i in starts)
    return [(signed[i], i) for i in places]


def test_winnowing_equals_its_definition(spark, monkeypatch):
    rng = random.Random(13)
    own = ["", "a", "é" * 9, "x😀y" * 20, "q" * 300, *("".join(rng.choice("abcde é\n😀日") for _ in range(n)) for n in [*range(1, 28), 100, 700])]
    for segment in (1 << 13, 64):  # a text of many segments keeps what one of a single segment does
        monkeypatch.setattr(document_fingerprints, "SEGMENT", segment)
        kept = document_fingerprints.winnowed(F.col("t"))
        df = spark.createDataFrame(list(enumerate(own)), "i int, t string").select("i", F.transform(kept, lambda x: F.shiftright(x, 28)).alias("h"), document_fingerprints.places_of(kept).alias("p"))
        for r in df.collect():
            assert list(zip(r.h, r.p, strict=True)) == plain_winnowed(own[r.i]), own[r.i]


def test_winnowing_guarantee_at_every_offset(spark):
    rng = random.Random(19)
    text = lambda n, of="日本語文字列😀é中国\n\tabc ": "".join(rng.choice(of) for _ in range(n))
    rows = []
    for i in range(30):
        span = text(23)  # k + window - 1 characters
        rows.append((text(i) + span + text(20), text(2 * i + 1) + span + text(9)))
    hashes = lambda c: document_fingerprints.hashes_of(document_fingerprints.winnowed(F.col(c)))
    df = spark.createDataFrame(rows, "a string, b string").select(F.size(F.array_intersect(hashes("a"), hashes("b"))).alias("n"))
    assert all(r.n >= 1 for r in df.collect())


def test_likeness_grows_with_what_clauses_share(spark):
    """60 clauses without spaces, one character inserted into each, at any length of a clause."""
    rng, lengths, rows = random.Random(3), (8, 12, 16, 20, 24, 31, 32, 33, 40, 48, 64), []
    for n in lengths:
        clauses = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(60)]
        edited = [c[:at] + rng.choice("xyz") + c[at:] for c in clauses for at in [rng.randint(0, n)]]
        rows.append((n, " ".join(clauses), " ".join(edited)))
    hashes = lambda c: document_fingerprints.hashes_of(document_fingerprints.winnowed(F.col(c)))
    df = spark.createDataFrame(rows, "n int, a string, b string").select("n", hashes("a").alias("x"), hashes("b").alias("y"))
    found = {r.n: len({*r.x} & {*r.y}) / len({*r.x} | {*r.y}) for r in df.collect()}
    assert found[8] > 0.02 and found[20] > 0.2 and found[64] > 0.6
    assert all(found[b] > found[a] - 0.08 for a, b in zip(lengths, lengths[1:], strict=False))


def test_license_postings_are_intersected(spark):
    rng = random.Random(41)
    templates = license_scan._templates()
    idf = {w: rng.random() for t in templates for w in t[2]}
    postings = license_scan.anchor_postings(templates, idf, 3)
    own = [[rng.choice([*postings, "x"]) for _ in range(rng.randint(0, 60))] for _ in range(60)]
    own += [["x"] * rng.randint(0, 3) + t[2] + t[2][:5] for t in templates] + [t[2][2:] for t in templates]
    df = spark.createDataFrame(list(enumerate(own)), "i int, words array<string>").select("i", license_scan.beginnings(F.col("words"), postings).alias("b"))
    for r in df.collect():
        votes = Counter((t, i - p) for i, w in enumerate(own[r.i]) for t, p in postings.get(w, ()))
        need = Counter(t for at in postings.values() for t, _ in at)
        assert sorted(map(tuple, r.b)) == sorted(k for k, n in votes.items() if n == need[k[0]])


def test_license_scan(spark, docs):
    own = [None, "", "MIT License", "the mit  license; MIT-LICENSE", "Released under the MIT License.", "General Public\nLicense apache License", "mit licens", "license mit", "Licensed under CC BY-NC 4.0.", "x " * 50 + "Licensed under the Apache License, Version 2.0"]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(own)]).withColumn("words", F.lit(1)).withColumn("places", F.lit(1))
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, text in enumerate(own):
        w, starts, labels = words_of(text), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            for at in range(len(w)):
                if w[at : at + len(p)] == p:
                    starts.append(at)
                    labels.add(label)
        base = [p for p in found[i].places if p.base]
        assert (found[i].words, sorted(p.start for p in base), {p.label for p in base}) == (w, sorted(starts), labels)
    assert "cc-by-nc-4.0" in {p.label for p in found[8].places} and {"apache-2.0", "apache"} <= {p.label for p in found[9].places}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_lm_gradient_and_probabilities():
    rng = np.random.default_rng(0)
    words = lm_scoring.Vocabulary(rng.integers(0, 50, 3000).astype(float), rng.integers(0, 2, 3000))
    flat = lm_scoring.initial(words.prior).astype(np.float64)
    rows, kinds = rng.integers(0, 2048, (2, lm_scoring.SPAN)), rng.integers(-1, words.kinds, (2, lm_scoring.SPAN))
    _, g = lm_scoring.gradient(flat, rows, kinds)
    used = [int(i) for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-5), 25, replace=False)]
    for i in used:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric = (lm_scoring.gradient(up, rows, kinds)[0] - lm_scoring.gradient(down, rows, kinds)[0]) / 2e-5
        assert abs(numeric - g[i]) < 1e-5 + 1e-3 * abs(g[i])
    # every id's probability after a context: they add up to one, and batches do not matter
    scorer = lm_scoring.Scorer(flat.astype(np.float32), words)
    context = rng.integers(0, 3000, 40)
    each = np.array([np.append(context, x) for x in range(3000)])
    logs = scorer.logs(each.ravel(), np.full(3000, 41)) - scorer.logs(np.tile(context, 1), np.array([40]))
    assert abs(np.exp(logs).sum() - 1) < 1e-3
    assert np.allclose(scorer.logs(each.ravel(), np.full(3000, 41), 7), scorer.logs(each.ravel(), np.full(3000, 41), 512), atol=1e-3)


def test_lm_windows_cover_whole_texts():
    import pyarrow as pa

    model = sp.model_bytes(sp.default_model())
    processor = lm_scoring._processor(model)
    own = ["", "one", *texts(30, 18, 400), "x" * 20_000, None]
    known = lm_scoring.Ids(model)
    rows, counts, _ = known.block([(x or "").encode() for x in own])
    column = lm_scoring._as_bytes(*known.ids(rows, counts))
    batch = pa.RecordBatch.from_arrays([column], names=["ids"])
    found = [np.frombuffer(w, "<u2").tolist() for out in lm_scoring._windows(iter([batch, batch.slice(3)])) for w in out.column(0).to_pylist()]
    wanted = []
    for text in own + own[3:]:
        ids = [lm_scoring.BOS, *(x for w in lm_scoring._pieces(processor, [*lm_scoring.split((text or "").encode()), b""]) for x in w)]
        for i in range(0, len(ids) - 1, lm_scoring.SPAN):
            wanted.append((ids[i : i + lm_scoring.SPAN + 1] + [lm_scoring.NOTHING] * lm_scoring.SPAN)[: lm_scoring.SPAN + 1])
    assert found == wanted


def test_windows_of_a_large_batch_take_little_memory():
    """A batch of 16 MB of ids (what a stash lets through) makes its windows block by block."""
    counts = np.random.default_rng(5).integers(1, 2000, 8000)
    ids = (np.arange(counts.sum()) % 30_000).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([lm_scoring._as_bytes(ids, counts)], names=["ids"])
    tracemalloc.start()
    found, most = [np.frombuffer(out.column(0).buffers()[2], "<u2").reshape(-1, lm_scoring.SPAN + 1).copy() for out in lm_scoring._windows(iter([batch]))], tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.concatenate(found) == lm_scoring.windows_of(ids, counts)).all()
    assert most < 100e6


def test_lm_steps_reuse_their_arrays():
    """After the first step of a size, none takes much new memory; what a step before left there changes nothing."""
    rng = np.random.default_rng(6)
    words = lm_scoring.Vocabulary(rng.integers(0, 50, 3000).astype(float), rng.integers(0, 2, 3000))
    flat, room = lm_scoring.initial(words.prior), lm_scoring.Room()
    steps = [(rng.integers(0, 2048, (n, lm_scoring.SPAN)), rng.integers(-1, words.kinds, (n, lm_scoring.SPAN)), rng.integers(1, 5, n).astype(np.float32)) for n in (128, 128, 50)]
    lm_scoring.gradient(flat, *steps[0], room)
    for step in steps[1:]:
        tracemalloc.start()
        loss, found = lm_scoring.gradient(flat, *step, room)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        alone, wanted = lm_scoring.gradient(flat, *step)
        assert most < 1 << 20 and loss == alone and (found == wanted).all()


def test_lm_words_of_a_task_are_met_once():
    """200,000 distinct words in a task, each in two batches: one count for each."""
    text = " ".join(map(str, range(200_000)))
    batches = [pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])] * 2
    found = [r for out in lm_scoring._count_words("text")(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert len(found) == 200_001 and {n for _, n in found} == {2}


def test_lm_scores_equal_plain_attention():
    rng = np.random.default_rng(3)
    words = lm_scoring.Vocabulary(rng.integers(0, 50, 3000).astype(float), rng.integers(0, 2, 3000))
    flat = lm_scoring.initial(words.prior)
    flat += rng.normal(0, 0.2, len(flat)).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.parts_of(flat).items()}
    lengths = [1, 15, 16, 17, 31, 32, 33, 100]
    own = [rng.integers(0, 3000, n) for n in lengths]
    found = lm_scoring.Scorer(flat, words).logs(np.concatenate(own), np.array(lengths))
    for ids, score in zip(own, found, strict=True):
        before = np.concatenate([[lm_scoring.BOS], ids[:-1]])
        e = p["E"][words.row[before]]
        total = 0.0
        for t in range(len(ids)):
            first = max(0, t // lm_scoring.CHUNK * lm_scoring.CHUNK - lm_scoring.CHUNK)
            apart = t - np.arange(first, t + 1)
            w = np.exp(e[first : t + 1] @ p["Wk"] @ (e[t] @ p["Wq"]) * float(lm_scoring.SCALE) + p["near"][apart])
            z = e[t] @ p["We"] + (w @ (e[first : t + 1] @ p["Wv"]) / w.sum()) @ p["Wa"] + p["b"]
            total += z[words.kind[ids[t]]] - np.log(np.exp(z).sum()) + words.inside[ids[t]]
        assert abs(total - score) < 1e-3 * len(ids)


def test_lm_scores_are_of_the_table_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    one, many = (lm_scoring.score(x, shard_windows=40, first_windows=64).collect() for x in (docs.coalesce(1), docs.repartition(8, F.rand(4))))
    key = lambda r: r.doc_id
    assert [tuple(r) for r in sorted(one, key=key)] == [tuple(r) for r in sorted(many, key=key)]


def test_lm_scores(spark, docs, rows):
    found = lm_scoring.score(docs, common_words=5).collect()
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows}
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for k, t in rows if not held[k] for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    texts_of = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        own = tokens(texts_of[r.doc_id])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_prefers_its_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(14)
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and 20 < len(r.text.split()) < 400]
    mixed = spark.createDataFrame([(10 * 10**6 + i, " ".join("".join(rng.sample(w, len(w))) for w in r.text.split()), r.lang, r.source, 0) for i, r in enumerate(held)], docs.schema)
    mixed = mixed.withColumn("doc_id", F.expr("doc_id"))
    found = {r.doc_id: r.score for r in lm_scoring.score(docs.unionByName(mixed.where("crc32(CAST(doc_id AS STRING)) % 10 = 0"))).collect()}
    both = [(found[r.doc_id], found[10 * 10**6 + i]) for i, r in enumerate(held) if 10 * 10**6 + i in found]
    assert both and all(a > b for a, b in both)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("de", "qrstuvwx"))}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, make("en", 14)) for i in range(4)]
    own = [(make(lang, 80), lang) for lang in ("en", "de") * 20]
    own += [(own[3][0], "de"), (own[4][0] + " tail", "en"), ("12 34 !!", "en"), (None, "en"), (make("en", 30) + " " + items[2][1] + " " + make("en", 5), "en")]
    frame(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(own)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(range(40))  # copies, near copies, letterless, null and contaminated documents are gone
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    assert all(found[i].ids == [1, *lib.encode(own[i][0]), 2] for i in found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "encode"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_a_row_for_each_document(spark, sf_dir, name):
    table = "pages" if name.startswith(("op3", "url")) else "documents"
    n = QUERIES[name](spark, sf_dir).count()
    assert n > 0 and (name.startswith("op2") or n == spark.read.parquet(f"{sf_dir}/{table}.parquet").count())
