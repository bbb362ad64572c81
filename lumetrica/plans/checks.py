"""Validation, planning, cover and array queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cover as C
from ..operators import planning as P
from ..operators import recordings as L
from ..operators import signals as S
from ..operators import validate as V
from .base import MODELS, VARIANTS, labelled, predictions, rounded, table, with_pred

EVAL_PERCENT = 10


def _orders(spark, sf_dir):
    return P.disjoint_split(table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL"), "o_custkey", EVAL_PERCENT)


def completeness(spark, sf_dir):
    return rounded(V.completeness(labelled(spark, sf_dir), ["lang", "source", "quality", "toxic"], 0.05))


def group_sizes(spark, sf_dir):
    return V.group_sizes(labelled(spark, sf_dir), "source", 50)


def leakage(spark, sf_dir):
    by_order = table(spark, sf_dir, "orders").withColumn("split", F.when(F.col("o_orderkey") % 10 == 0, "eval").otherwise("train"))
    return V.leakage(by_order, "o_custkey", "split").unionByName(V.leakage(_orders(spark, sf_dir), "o_custkey", "split").withColumn("scope", F.lit("o_custkey by speaker")))


def drift(spark, sf_dir):
    return rounded(V.drift(_orders(spark, sf_dir), "split", "train", "eval", "o_orderpriority", 5.0))


def duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return V.duplicates(docs, F.md5(F.col("text").cast("binary")), "text").unionByName(V.duplicates(docs, F.col("doc_id"), "doc_id"))


def charset_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("text").rlike("[^ -~\n]"), 1)).alias("not_ascii"), F.count(F.when(F.col("text").rlike("[0-9]"), 1)).alias("digits"), F.count(F.when(F.trim("text") == "", 1)).alias("blank"))
    return docs


def model_sanity(spark, sf_dir):
    x = predictions(spark, sf_dir).groupBy("model", "variant").agg(
        F.avg("wer").alias("mean_wer"), F.count(F.when(F.col("wer") > 0.8, 1)).alias("over"), F.count(F.when(F.col("s") + F.col("i") + F.col("h") == 0, 1)).alias("blank_hypotheses"))
    return rounded(x.withColumn("passed", (F.col("mean_wer") <= 0.8) & (F.col("blank_hypotheses") == 0)), 5)


def complete_slots(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("NOT (model = 'cor' AND variant = 'harsh' AND source = 'src3')")
    return V.complete_slots(rows, ["model", "variant"], table(spark, sf_dir, "documents").count())


def expected_missing(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("NOT (model = 'cor' AND variant = 'harsh')").select(F.concat_ws("/", "model", "variant").alias("run"))
    expected = spark.createDataFrame([(f"{m}/{v}",) for m, _ in [*MODELS, ("dax", 4)] for v, _ in VARIANTS], "run string")
    return V.missing_and_extra(rows, expected, "run")


def resume_remaining(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


def run_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"))
    from .base import run_matrix as matrix

    return docs.crossJoin(F.broadcast(matrix(spark))).select("model", "variant", "source", "rows")


def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    both = a.withColumn("kind", F.lit("customer")).unionByName(b.withColumn("kind", F.lit("supplier")), allowMissingColumns=True)
    return rounded(both.groupBy("kind", "segment").agg(F.count("*").alias("n"), F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("balance")), 2)


def _plan(spark, sf_dir, costs):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("seconds"))
    return P.batch_plans(rows, "row_id", "seconds", [10, 30], 160, 16, costs)


def batch_plan_total(spark, sf_dir):
    return _plan(spark, sf_dir, {"batch_id": False})


def batch_plan_padded(spark, sf_dir):
    return _plan(spark, sf_dir, {"batch_id": True})


def plan_validation(spark, sf_dir):
    """Both plans: limits kept, every row planned exactly once (line numbers repeat in some orders, which shows here), medians and buckets."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))
    plan = _plan(spark, sf_dir, {"total": False, "padded": True})
    buckets = plan.agg(*(F.count(F.when(F.col("bucket") == i, 1)).alias(f"bucket{i}") for i in range(3)))
    found = P.validate_plans(plan, rows, "row_id", "seconds", 160, 16, ["total", "padded"]).crossJoin(buckets)  # two rows and one
    most = F.when(F.col("cost") == "padded", F.col("most_padded")).otherwise(F.col("most_total")).alias("most_seconds")
    return rounded(found.select(
        "batches", "over_cap", "over_budget", "rows", "planned", "missing", "extra", "planned_twice", "status", "most_rows", most, "median_rows", *(f"bucket{i}" for i in range(3)), "cost"))


def calibration_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return rounded(P.calibration_subset(rows, "o_orderpriority", "o_totalprice", "o_orderkey"))


def oversample_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), "s_suppkey")
    return P.oversample(rows, "nation", "s_suppkey", 6).groupBy("nation", "s_suppkey").agg(F.count("*").alias("copies"))


def stratified_quota(spark, sf_dir):
    return P.stratified_subset(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 200)


def disjoint_split(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("speakers"))


def group_folds(spark, sf_dir):
    return P.group_folds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", 10)


def balanced_folds(spark, sf_dir):
    """Ten folds of whole customers with the same share of each order priority: fold, priority, customers, orders."""
    orders = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL")
    folds = P.balanced_folds(orders, "o_custkey", "o_orderpriority", 10)
    return orders.join(folds, "o_custkey").groupBy("fold", "o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders"))


def pack_size(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("cost"))
    return P.pack_size(rows, "p_brand", "p_partkey", "cost", 100)


def pack_documents(spark, sf_dir):
    packed = P.pack(labelled(spark, sf_dir), "doc_id", "n", 2048)
    return packed.groupBy("row").agg(F.count("*").alias("documents"), F.sum("used").alias("used"))


def _cover(spark, sf_dir):
    """Errors by user, and what is left of them without each head's; only users that a head has errors of are listed with it."""
    e = table(spark, sf_dir, "events").withColumn("head", (F.col("event_id") % 97).cast("int"))
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("unit"), "head")
    base = errors.groupBy("unit").agg(F.count("*").alias("base_count"))
    masked = errors.groupBy("unit", "head").agg(F.count("*").alias("hits")).join(base, "unit")
    return base, masked.select("head", "unit", (F.col("base_count") - F.col("hits")).alias("count"), "hits"), e.select("head").distinct()


def coverage_edges(spark, sf_dir):
    base, masked, _ = _cover(spark, sf_dir)
    return C.coverage_edges(base, masked.drop("hits"))


def greedy_cover(spark, sf_dir):
    picked = C.greedy_cover(coverage_edges(spark, sf_dir))
    return spark.createDataFrame([(i + 1, h, n) for i, (h, n) in enumerate(picked)] or [], "place int, head int, covers long")


def head_scores(spark, sf_dir):
    base, masked, heads = _cover(spark, sf_dir)
    hits = masked.groupBy("head").agg(F.sum("hits").alias("hits"), F.count("*").alias("helped"))
    x = heads.join(hits, "head", "left").crossJoin(F.broadcast(base.agg(F.sum("base_count").alias("before"))))  # one row
    x = x.select("head", "before", (F.col("before") - F.coalesce("hits", F.lit(0))).alias("after"), F.coalesce("helped", F.lit(0)).alias("helped"))
    return rounded(x.withColumn("delta", (F.col("before") - F.col("after")) / F.col("before")))


def signal_power(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(S.power(F.col("embedding")), 5).alias("power"), S.is_silent(F.col("embedding")).alias("silent"), F.size(S.pad_to(F.col("embedding"), F.lit(100))).cast("long").alias("padded"))


def snr_mix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    noise = F.reverse(F.col("embedding"))
    mixed = S.mix_at_snr(F.col("embedding"), noise, 10.0)
    e = e.select("vec_id", mixed.alias("z"))
    return e.select("vec_id", F.round(S.power(F.col("z")), 4).alias("power"), F.size("z").cast("long").alias("n"))


def silence_and_masks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = e.select("vec_id", S.inject_silence(x, F.lit(4), 16).alias("s"), S.mask_chunks(x, F.array(F.lit(2), F.lit(10)), 3).alias("m"))
    return e.select("vec_id", F.size("s").cast("long").alias("longer"), F.size(F.filter("m", lambda v: v == 0)).cast("long").alias("zeros"), S.find_run(F.col("s"), F.array_repeat(F.lit(0.0), 16)).cast("long").alias("silence_at"),
                    F.size(S.drop_quiet_runs(F.col("s"), 1e-12, 10)).cast("long").alias("kept"))


def decay_index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", S.decay_index(F.col("embedding"), 10.0).cast("long").alias("at"))


def reverb(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    y = S.reverb([1.0, 0.5, 0.25])(F.col("embedding"))
    return e.select("vec_id", F.round(S.power(y), 4).alias("power"))


RATE, SIZE = 1000, 32


def _recordings(spark, sf_dir):
    """Embeddings as short recordings, in blocks, so that what reaches over a border is met."""
    return L.in_blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIZE)


def _levels(blocks, name):
    """ident, samples, power, zeros of the transformed recordings."""
    own = blocks.select("ident", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v).alias("e"), F.size(F.filter("samples", lambda v: v == 0)).alias("z"))
    out = own.groupBy("ident").agg(F.sum("n").alias("samples"), F.round(F.sum("e"), 6).alias("power"), F.sum("z").alias("zeros"))
    return out.withColumn("transform", F.lit(name))


def masked_recordings(spark, sf_dir):
    return _levels(L.masked(_recordings(spark, sf_dir), 0.25, 2, RATE), "masked")


def silenced_recordings(spark, sf_dir):
    return _levels(L.silenced(_recordings(spark, sf_dir), 0.5, SIZE, RATE), "silenced")


def reverberant_recordings(spark, sf_dir):
    return _levels(L.reverberant(_recordings(spark, sf_dir), [1.0, 0.0, 0.5, 0.0, 0.25, 0.125], SIZE), "reverberant")


def voiced_recordings(spark, sf_dir):
    return _levels(L.voiced(_recordings(spark, sf_dir), SIZE, RATE, -20.0, 20), "voiced")


def reverberation_times(spark, sf_dir):
    return rounded(L.reverberation_time(_recordings(spark, sf_dir), RATE))


QUERIES = {f.__name__: f for f in (
    masked_recordings, silenced_recordings, reverberant_recordings, voiced_recordings, reverberation_times, completeness, group_sizes, leakage, drift, duplicates, charset_failures, model_sanity, complete_slots, expected_missing, resume_remaining, run_matrix, union_by_name, batch_plan_total,
    batch_plan_padded, plan_validation, calibration_subset, oversample_floor, stratified_quota, disjoint_split, group_folds, balanced_folds, pack_size, pack_documents, coverage_edges, greedy_cover, head_scores,
    signal_power, snr_mix, silence_and_masks, decay_index, reverb)}

_DIG = "('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::BIGINT"
_SPLIT = f"sp AS (SELECT *, CASE WHEN {_DIG.format('o_custkey')} % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM orders WHERE o_custkey IS NOT NULL)"
_COVER = """base AS (SELECT user_id AS unit, count(*) AS base_count FROM events WHERE event_type = 'error' GROUP BY 1),
heads AS (SELECT DISTINCT (event_id % 97)::INT AS head FROM events), hits AS (SELECT user_id AS unit, (event_id % 97)::INT AS head, count(*) AS hits FROM events WHERE event_type = 'error' GROUP BY ALL),
masked AS (SELECT head, unit, base_count, base_count - coalesce(hits, 0) AS c FROM base CROSS JOIN heads LEFT JOIN hits USING (unit, head))"""
_BLANK = "{0} IS NULL OR trim({0}) IN ('', 'nan')"


def plan_sql(padded: bool, name: str) -> str:
    """The greedy plan as a recursion over the distinct durations of each bucket; tables hist, seg and the plan under `name`."""
    spare = "floor((160 + 1e-9) / h.value) - st.n" if padded else "floor((160 + 1e-9 - st.total) / h.value)"
    x = name
    return f"""{x}_rows AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity AS seconds, (l_quantity > 10)::INT + (l_quantity > 30)::INT AS bucket FROM lineitem),
{x}_hist AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value) AS idx FROM (SELECT bucket, seconds AS value, count(*) AS cnt FROM {x}_rows GROUP BY ALL)),
{x}_st AS (SELECT DISTINCT bucket, 0::BIGINT AS idx, 0::BIGINT AS first, 0::BIGINT AS room, 0::BIGINT AS size, 0::BIGINT AS batch, 0::BIGINT AS n, 0::DOUBLE AS total, 0::DOUBLE AS value FROM {x}_hist
  UNION ALL SELECT bucket, idx, batch AS first, room, size, batch + more AS batch, CASE WHEN more = 0 THEN n + room ELSE cnt - room - (more - 1) * size END AS n,
    CASE WHEN more = 0 THEN total + room * value ELSE (cnt - room - (more - 1) * size) * value END AS total, value
  FROM (SELECT *, ceil((cnt - room) / size::DOUBLE)::BIGINT AS more FROM (SELECT *, CASE WHEN n = 0 AND fit = 0 THEN least(1, cnt) ELSE fit END AS room FROM (
    SELECT h.bucket, h.idx, h.cnt, h.value, st.batch, st.n, st.total, greatest(0, least(h.cnt, 16 - st.n, ({spare})::BIGINT)) AS fit,
      greatest(1, least(16, floor((160 + 1e-9) / h.value)::BIGINT)) AS size FROM {x}_st st JOIN {x}_hist h ON h.bucket = st.bucket AND h.idx = st.idx + 1)))),
{x}_starts AS (SELECT bucket, coalesce(sum(k) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT bucket, max(batch) + 1 AS k FROM {x}_st GROUP BY 1)),
{x} AS (SELECT row_id, seconds, r.bucket, (start + CASE WHEN rank <= room THEN first ELSE first + 1 + (rank - room - 1) // size END)::BIGINT AS batch_id
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket, seconds ORDER BY row_id) AS rank FROM {x}_rows) r JOIN {x}_st st ON st.bucket = r.bucket AND st.value = r.seconds AND st.idx > 0 JOIN {x}_starts s ON s.bucket = r.bucket)"""


def _validation_sql(name: str, cost: str) -> str:
    most = "n * longest" if cost == "padded" else "total"
    return f"""SELECT (SELECT count(*) FROM {name}_b) AS batches, (SELECT count(*) FILTER (WHERE n > 16) FROM {name}_b) AS over_cap,
  (SELECT count(*) FILTER (WHERE total > 160 + 1e-6 AND n > 1) FROM {name}_b) AS over_budget, (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM {name}) AS planned,
  0::BIGINT AS missing, 0::BIGINT AS extra, (SELECT count(*) FROM {name}_twice) AS planned_twice, (SELECT CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END FROM {name}_twice) AS status, (SELECT max(n) FROM {name}_b) AS most_rows, (SELECT round(max({most}), 6) FROM {name}_b) AS most_seconds,
  (SELECT median(n) FROM {name}_b) AS median_rows, {", ".join(f"(SELECT count(*) FILTER (WHERE bucket = {i}) FROM {name}) AS bucket{i}" for i in range(3))}, '{cost}' AS cost"""


def _batches_sql(name: str) -> str:
    return f"{name}_b AS (SELECT batch_id, count(*) AS n, sum(seconds) AS total, max(seconds) AS longest FROM {name} GROUP BY 1), {name}_twice AS (SELECT row_id FROM {name} GROUP BY 1 HAVING count(*) > 1)"


ORACLE_SQL = {
    "batch_plan_total": f"WITH RECURSIVE {plan_sql(False, 'plan')} SELECT * FROM plan",
    "batch_plan_padded": f"WITH RECURSIVE {plan_sql(True, 'plan')} SELECT * FROM plan",
    "plan_validation": f"WITH RECURSIVE {plan_sql(False, 'a')}, {plan_sql(True, 'b')}, {_batches_sql('a')}, {_batches_sql('b')} {_validation_sql('a', 'total')} UNION ALL {_validation_sql('b', 'padded')}",
    "decay_index": """WITH v AS (SELECT vec_id, embedding AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), e AS (SELECT vec_id, i, x[i]::DOUBLE * x[i]::DOUBLE AS s FROM v),
c AS (SELECT vec_id, i, sum(s) OVER (PARTITION BY vec_id) AS total, coalesce(sum(s) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM e),
f AS (SELECT vec_id, min(i - 1) AS "at" FROM c WHERE total - gone <= total / 10 GROUP BY 1)
SELECT d.vec_id, "at" FROM embeddings d LEFT JOIN f ON d.vec_id = f.vec_id""",
    "silence_and_masks": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, list_concat(list_concat(x[1:4], list_transform(range(16), lambda i: 0.0)), x[5:]) AS s, len(list_filter(range(len(x)), lambda i: x[i + 1] = 0 OR i BETWEEN 2 AND 4 OR i BETWEEN 10 AND 12)) AS zeros FROM x),
t AS (SELECT vec_id, zeros, len(s) AS longer, list_aggregate(list_transform(s, lambda v: CASE WHEN v = 0 THEN '0' ELSE '1' END), 'string_agg', '') AS z,
  list_aggregate(list_transform(s, lambda v: CASE WHEN abs(v) < 1e-12 THEN '0' ELSE '1' END), 'string_agg', '') AS q FROM s)
SELECT vec_id, longer, zeros, CASE WHEN contains(z, repeat('0', 16)) THEN instr(z, repeat('0', 16)) - 1 ELSE floor(longer * 0.8)::BIGINT END AS silence_at, len(regexp_replace(q, '0{10,}', '', 'g')) AS kept FROM t""",
    "completeness": with_pred(", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS scope, avg(({_BLANK.format(c)})::INT) AS v FROM docs" for c in ("lang", "source", "quality", "toxic")) + ") SELECT 'completeness' AS \"check\", scope, round(v, 6) AS value, v <= 0.05 AS passed FROM x"),
    "group_sizes": "SELECT 'group_size' AS \"check\", source AS scope, count(*)::DOUBLE AS value, count(*) >= 50 AS passed FROM documents GROUP BY source",
    "leakage": f"""WITH {_SPLIT}, a AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 10 = 0) > 1), b AS (SELECT o_custkey FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT 'leakage' AS "check", 'o_custkey' AS scope, (SELECT count(*) FROM a)::DOUBLE AS value, (SELECT count(*) FROM a) = 0 AS passed UNION ALL SELECT 'leakage', 'o_custkey by speaker', (SELECT count(*) FROM b)::DOUBLE, (SELECT count(*) FROM b) = 0""",
    "drift": f"""WITH {_SPLIT}, c AS (SELECT o_orderpriority AS scope, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'eval') AS b FROM sp GROUP BY 1),
d AS (SELECT scope, 100 * abs(a / (SELECT sum(a) FROM c)::DOUBLE - b / (SELECT sum(b) FROM c)::DOUBLE) AS v FROM c) SELECT 'drift' AS "check", scope, round(v, 6) AS value, v <= 5 AS passed FROM d""",
    "duplicates": "SELECT 'duplicates' AS \"check\", 'text' AS scope, (count(text) - count(DISTINCT text) + greatest(count(*) - count(text) - 1, 0))::DOUBLE AS value, count(text) - count(DISTINCT text) = 0 AS passed FROM documents UNION ALL SELECT 'duplicates', 'doc_id', (count(*) - count(DISTINCT doc_id))::DOUBLE, count(*) = count(DISTINCT doc_id) FROM documents",
    "charset_failures": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[^ -~\\n]')) AS not_ascii, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS digits, count(*) FILTER (WHERE trim(text) = '') AS blank FROM documents GROUP BY lang",
    "model_sanity": with_pred(" SELECT model, variant, round(avg(wer), 5) AS mean_wer, count(*) FILTER (WHERE wer > 0.8) AS over, count(*) FILTER (WHERE s + i + h = 0) AS blank_hypotheses, avg(wer) <= 0.8 AND count(*) FILTER (WHERE s + i + h = 0) = 0 AS passed FROM pred GROUP BY ALL"),
    "complete_slots": with_pred(" SELECT model, variant, count(*) AS n FROM pred WHERE NOT (model = 'cor' AND variant = 'harsh' AND source = 'src3') GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM documents)"),
    "expected_missing": "SELECT 'cor/harsh' AS run, 'missing' AS side UNION ALL SELECT 'dax/' || v, 'missing' FROM (VALUES ('clean'), ('mild'), ('harsh')) t(v)",
    "resume_remaining": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "run_matrix": "SELECT model, variant, source, rows FROM (SELECT source, count(*) AS rows FROM documents GROUP BY 1), (VALUES ('ada'), ('bix'), ('cor')) a(model), (VALUES ('clean'), ('mild'), ('harsh')) b(variant)",
    "union_by_name": "SELECT kind, segment, count(*) AS n, round(sum(b::DECIMAL(18,2))::DOUBLE, 2) AS balance FROM (SELECT 'customer' AS kind, c_mktsegment AS segment, c_acctbal AS b FROM customer UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier) GROUP BY ALL",
    "calibration_subset": "SELECT o_orderpriority, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r IN (0, n // 2, ceil(n * 0.9::DOUBLE)::BIGINT - 1, n - 1)",
    "oversample_floor": "WITH a AS (SELECT s_nationkey::VARCHAR AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT nation, s_suppkey, CASE WHEN n >= 6 THEN 1 ELSE (6 - r) // n + 1 END AS copies FROM a",
    "stratified_quota": f"WITH a AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_DIG.format('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM a WHERE r <= greatest(1, 200 * n // (SELECT count(*) FROM orders))",
    "disjoint_split": f"WITH {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS speakers FROM sp GROUP BY 1",
    "group_folds": f"""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority FROM c GROUP BY 1)
SELECT o_custkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_DIG.format('o_custkey')}, o_custkey) - 1) % 10)::INT AS fold FROM m""",
    "pack_size": "WITH a AS (SELECT p_brand, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s FROM part) SELECT p_brand, greatest(1, count(*) FILTER (WHERE s <= 100)) AS pack FROM a GROUP BY 1",
    "coverage_edges": f"WITH {_COVER}, ok AS (SELECT head FROM masked GROUP BY 1 HAVING bool_and(c <= base_count) AND bool_or(c < base_count)) SELECT unit, head FROM masked WHERE c < base_count AND base_count > 0 AND head IN (SELECT head FROM ok)",
    "head_scores": f"WITH {_COVER} SELECT head, sum(base_count)::BIGINT AS before, sum(c)::BIGINT AS after, count(*) FILTER (WHERE c < base_count) AS helped, round((sum(base_count) - sum(c)) / sum(base_count)::DOUBLE, 6) AS delta FROM masked GROUP BY 1",
    "signal_power": "SELECT vec_id, round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding), 0), 5) AS power, len(list_filter(embedding[1:8] || embedding[greatest(len(embedding) // 2, 1):greatest(len(embedding) // 2, 1) + 7] || embedding[greatest(len(embedding) - 7, 1):], lambda x: x <> 0)) = 0 AS silent, greatest(len(embedding), 100) AS padded FROM embeddings",
    "snr_mix": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS y FROM embeddings WHERE len(embedding) > 0),
m AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] + sqrt(0.1::DOUBLE) * y[i]) AS z FROM g), p AS (SELECT vec_id, z, list_max(list_transform(z, lambda v: abs(v))) AS peak FROM m)
SELECT vec_id, round(list_sum(list_transform(z, lambda v: v * v)) / len(z) / CASE WHEN peak > 1 THEN peak * peak ELSE 1 END, 4) AS power, len(z) AS n FROM p""",
}
