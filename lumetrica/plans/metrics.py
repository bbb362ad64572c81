"""Error-rate, fairness, degradation and resampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import resample as R
from .base import BASELINE, predictions, rounded, with_pred

AXES = ["lang", "source", "quality", "toxic"]


def _rates(spark: SparkSession, sf_dir: str, axes: list[str] = AXES, policy: M.Policy = M.Policy()) -> DataFrame:
    rows = M.by_axes(predictions(spark, sf_dir), axes, ["model", "variant", *"sidh"])
    return M.group_rates(rows, ["model", "variant", "axis", "group"], policy)


_RATES = """, long AS (
  SELECT model, variant, s, i, d, h, 'lang' AS axis, lang AS "group" FROM pred UNION ALL
  SELECT model, variant, s, i, d, h, 'source', source FROM pred UNION ALL
  SELECT model, variant, s, i, d, h, 'quality', quality FROM pred UNION ALL
  SELECT model, variant, s, i, d, h, 'toxic', toxic FROM pred),
rates AS (SELECT model, variant, axis, "group", count(*) AS n, sum(s + d + h) AS ref_words, sum(s) AS s, sum(i) AS i, sum(d) AS d, sum(h) AS h,
  sum(s + i + d)::DOUBLE / sum(s + d + h) AS wer FROM long WHERE s + d + h > 0 AND "group" IS NOT NULL AND trim("group") NOT IN ('', 'nan') GROUP BY ALL)
"""
_FAIR = """, fair AS (SELECT model, axis, variant, count(*) AS groups, min(wer) AS best_wer, max(wer) AS worst_wer, stddev_pop(wer) AS spread,
  arg_min("group", (wer, "group")) AS best_group, arg_min("group", (-wer, "group")) AS worst_group FROM rates {where} GROUP BY ALL HAVING count(*) >= 2)
"""


def wer_by_group(spark, sf_dir):
    return rounded(_rates(spark, sf_dir))


def error_decomposition(spark, sf_dir):
    return rounded(M.decomposition(_rates(spark, sf_dir), ["model", "variant", "axis", "group"]))


def rates_over_hits(spark, sf_dir):
    policy = M.Policy(drop_blank_hypotheses=True, rates_over="hits", min_rows=50)
    return rounded(_rates(spark, sf_dir, ["lang", "source"], policy).select("model", "variant", "axis", "group", "n", "wer", "s_rate", "i_rate", "d_rate"))


def fairness_table(spark, sf_dir):
    return rounded(M.fairness(_rates(spark, sf_dir), ["model", "axis", "variant"]))


def mmr_nonzero(spark, sf_dir):
    found = M.fairness(_rates(spark, sf_dir), ["model", "axis", "variant"], policy=M.Policy(zero_best="skip"))
    return rounded(found.select("model", "axis", "variant", "groups", "ratio", "gap"))


def named_gap(spark, sf_dir):
    return rounded(M.named_gap(_rates(spark, sf_dir, ["lang"]), ["model", "variant"], "de", "en"))


def paired_delta(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("wer IS NOT NULL").select("model", "variant", F.col("lang").alias("group"), F.col("doc_id").alias("unit"), F.col("doc_id").alias("row_index"), "wer")
    return rounded(M.paired_delta(rows, BASELINE), 4)


def gap_amplification(spark, sf_dir):
    return rounded(M.amplification(_rates(spark, sf_dir, ["lang", "source"]), BASELINE), 5)


def werd_long(spark, sf_dir):
    return rounded(M.degradation(_rates(spark, sf_dir), BASELINE), 5)


def wer_pivot(spark, sf_dir):
    rates = _rates(spark, sf_dir, ["lang"])
    return rounded(rates.groupBy("model", "variant").pivot("group", ["de", "en", "es", "fr"]).agg(F.max("wer")))


def insertion_pivot(spark, sf_dir):
    rates = _rates(spark, sf_dir, ["lang"])
    wide = rates.groupBy("model").pivot("variant", ["clean", "mild", "harsh"]).agg(F.try_divide(F.sum("i").cast("double"), F.sum("ref_words").cast("double")))
    spread = rates.where("i_rate > 0").groupBy("model").agg((F.max("i_rate") / F.min("i_rate")).alias("max_over_min"))
    return rounded(wide.join(spread, "model", "left"))


def overall(spark, sf_dir):
    return rounded(M.group_rates(predictions(spark, sf_dir), ["model", "variant"]))


def cube_rates(spark, sf_dir):
    rows = M.usable(predictions(spark, sf_dir), M.Policy())
    out = rows.cube("model", "variant", "lang").agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("words"), F.count("*").alias("n"))
    return rounded(out.withColumn("wer", F.try_divide(F.col("errors").cast("double"), F.col("words").cast("double"))))


def bootstrap_ci(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("ref_words > 0").select("model", "variant", F.col("lang").alias("group"), "doc_id", "errors", "ref_words")
    return rounded(R.bootstrap_ci(rows, ["model", "variant", "group"], "doc_id"))


def ci_overlap(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("ref_words > 0").select("model", "variant", F.col("lang").alias("group"), "doc_id", "errors", "ref_words")
    return M.ci_overlap(R.bootstrap_ci(rows, ["model", "variant", "group"], "doc_id"), ["model", "variant"])


def _pairs(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("ref_words > 0")
    wide = rows.groupBy("model", "lang", "doc_id", "ref_words").pivot("variant", ["clean", "harsh"]).agg(F.max("errors"))
    return wide.withColumnRenamed("lang", "group")


def paired_bootstrap_p(spark, sf_dir):
    return rounded(R.paired_bootstrap(_pairs(spark, sf_dir), ["model", "group"], "doc_id", "clean", "harsh", "ref_words"))


def mann_whitney(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("variant = 'clean'")
    return rounded(R.mann_whitney(rows, ["model"], "lang", "wer", 50), 5)


def ratio_bootstrap(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("model", "variant", "source", "doc_id", "wer", "ref_words")
    return rounded(R.ratio_bootstrap(rows, "source", "source", "doc_id"))


def pairwise_test(spark, sf_dir):
    """Two models on the same documents, by language and source; blank sides as in reports."""
    rows = predictions(spark, sf_dir).where("variant = 'mild' AND n > 0").select("lang", "source", "doc_id", "model", F.round(X.utterance_wer(F.col("errors"), F.col("n"), F.expr("s + i + h")), 4).alias("w"))
    wide = rows.groupBy("lang", "source", "doc_id").pivot("model", ["ada", "cor"]).agg(F.max("w"))
    return rounded(R.pairwise_test(wide, ["lang", "source"], "doc_id", "ada", "cor"))


def utterance_rates(spark, sf_dir):
    """Mean rate of utterances, a blank reference counting as reports and as rewards do."""
    w = lambda empty: F.avg(X.utterance_wer(F.col("errors"), F.col("n"), F.expr("s + i + h"), empty))
    return rounded(predictions(spark, sf_dir).groupBy("model", "variant").agg(F.count("*").alias("n"), w(0.0).alias("as_reported"), w(1.0).alias("as_rewarded")))


def degradation_area(spark, sf_dir):
    rates = M.group_rates(predictions(spark, sf_dir), ["model", "variant", "lang"])
    level = F.when(F.col("variant") == "clean", 0.0).when(F.col("variant") == "mild", 1.0).otherwise(2.0)
    return rounded(M.area_under(rates.withColumn("level", level), ["model", "lang"], "level", "wer"))




def boot_sql(draws: int) -> str:
    """units (doc_id, draw, k): the weight k of each document in each draw."""
    return f""", cuts AS (SELECT unnest([{', '.join(map(str, R.CUTS))}]) AS cut),
digests AS (SELECT doc_id, b, md5(doc_id || '#' || b) AS x FROM (SELECT DISTINCT doc_id FROM documents), (SELECT unnest(range(0, {-(-draws // 8)})) AS b)),
units AS (SELECT doc_id, draw, k FROM (SELECT doc_id, b * 8 + j + 1 AS draw, (SELECT count(*) FROM cuts WHERE cut <= ('0x' || substr(x, (4 * j + 1)::BIGINT, 4))::BIGINT) AS k
  FROM digests, (SELECT unnest(range(0, 8)) AS j)) WHERE draw <= {draws} AND k > 0)
"""


_CI = boot_sql(1000) + """, xs AS (SELECT model, variant, lang AS "group", draw, sum(errors * k)::DOUBLE / nullif(sum(ref_words * k), 0) AS x FROM pred JOIN units USING (doc_id) WHERE ref_words > 0 GROUP BY ALL),
point AS (SELECT model, variant, lang AS "group", count(*) AS n, sum(errors)::DOUBLE / sum(ref_words) AS wer FROM pred WHERE ref_words > 0 GROUP BY ALL),
ci AS (SELECT model, variant, "group", any_value(n) AS n, any_value(wer) AS wer, CASE WHEN any_value(n) >= 10 THEN avg(x) END AS mean,
  CASE WHEN any_value(n) >= 10 THEN quantile_cont(x, 0.025) END AS low, CASE WHEN any_value(n) >= 10 THEN quantile_cont(x, 0.975) END AS high FROM xs JOIN point USING (model, variant, "group") GROUP BY ALL)
"""
R6 = 'model, variant, axis, "group"'

QUERIES = {f.__name__: f for f in (
    wer_by_group, error_decomposition, rates_over_hits, fairness_table, mmr_nonzero, named_gap, paired_delta, gap_amplification, werd_long, wer_pivot,
    insertion_pivot, overall, cube_rates, bootstrap_ci, ci_overlap, paired_bootstrap_p, mann_whitney, ratio_bootstrap, pairwise_test, utterance_rates, degradation_area)}

ORACLE_SQL = {
    "wer_by_group": with_pred(_RATES + f"SELECT {R6}, n, ref_words::BIGINT AS ref_words, s::BIGINT AS s, i::BIGINT AS i, d::BIGINT AS d, h::BIGINT AS h, round(wer, 6) AS wer, round(s / ref_words, 6) AS s_rate, round(i / ref_words, 6) AS i_rate, round(d / ref_words, 6) AS d_rate FROM rates"),
    "error_decomposition": with_pred(_RATES + f"SELECT {R6}, n, round(wer, 6) AS wer, round(100.0 * s / greatest(1, s + i + d), 6) AS s_percent, round(100.0 * i / greatest(1, s + i + d), 6) AS i_percent, round(100.0 * d / greatest(1, s + i + d), 6) AS d_percent FROM rates"),
    "rates_over_hits": with_pred(""", long AS (SELECT model, variant, s, i, d, h, 'lang' AS axis, lang AS "group" FROM pred UNION ALL SELECT model, variant, s, i, d, h, 'source', source FROM pred)
SELECT model, variant, axis, "group", count(*) AS n, round(sum(s + i + d)::DOUBLE / sum(s + d + h), 6) AS wer, round(sum(s)::DOUBLE / nullif(sum(h), 0), 6) AS s_rate, round(sum(i)::DOUBLE / nullif(sum(h), 0), 6) AS i_rate, round(sum(d)::DOUBLE / nullif(sum(h), 0), 6) AS d_rate
FROM long WHERE s + d + h > 0 AND s + i + h > 0 GROUP BY ALL HAVING count(*) >= 50"""),
    "fairness_table": with_pred(_RATES + _FAIR.format(where="") + "SELECT model, axis, variant, groups, best_group, round(best_wer, 6) AS best_wer, worst_group, round(worst_wer, 6) AS worst_wer, round(CASE WHEN best_wer = 0 THEN CASE WHEN worst_wer = 0 THEN 1.0 ELSE 'Infinity'::DOUBLE END ELSE worst_wer / best_wer END, 6) AS ratio, round(worst_wer - best_wer, 6) AS gap, round(CASE WHEN best_wer > 0 THEN 100 * (worst_wer - best_wer) / best_wer END, 6) AS gap_percent, round(spread, 6) AS spread FROM fair"),
    "mmr_nonzero": with_pred(_RATES + _FAIR.format(where="WHERE wer > 0") + "SELECT model, axis, variant, groups, round(worst_wer / best_wer, 6) AS ratio, round(worst_wer - best_wer, 6) AS gap FROM fair"),
    "named_gap": with_pred(_RATES + "SELECT model, variant, round(a, 6) AS wer_a, round(b, 6) AS wer_b, round(CASE WHEN b <> 0 THEN 100 * (a - b) / b END, 6) AS gap_percent FROM (SELECT model, variant, max(wer) FILTER (WHERE \"group\" = 'de') AS a, max(wer) FILTER (WHERE \"group\" = 'en') AS b FROM rates WHERE axis = 'lang' GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL"),
    "paired_delta": with_pred(""" SELECT p.model, p.variant, p.lang AS "group", count(*) AS pairs, round(avg(p.wer - b.wer), 4) AS mean_delta FROM pred p JOIN pred b ON p.model = b.model AND p.doc_id = b.doc_id AND b.variant = 'clean' WHERE p.variant <> 'clean' AND p.wer IS NOT NULL AND b.wer IS NOT NULL GROUP BY ALL"""),
    "gap_amplification": with_pred(_RATES + _FAIR.format(where="WHERE wer > 0 AND axis IN ('lang', 'source')") + """, werd AS (SELECT a.model, a.axis, a.variant, a."group" AS g, 100 * (a.wer - b.wer) / b.wer AS werd FROM rates a JOIN rates b ON a.model = b.model AND a.axis = b.axis AND a."group" = b."group" AND b.variant = 'clean' WHERE a.variant <> 'clean' AND b.wer > 0),
per AS (SELECT model, axis, variant, min(werd) AS lo, max(werd) AS hi, arg_min(g, (werd, g)) AS lo_g, arg_min(g, (-werd, g)) AS hi_g FROM werd GROUP BY ALL)
SELECT f.model, f.axis, f.variant, round(f.worst_wer / f.best_wer, 5) AS ratio, round(b.worst_wer / b.best_wer, 5) AS base_ratio, round((f.worst_wer / f.best_wer) / (b.worst_wer / b.best_wer), 5) AS amplification, lo_g AS least_degraded, round(lo, 5) AS least_werd, hi_g AS most_degraded, round(hi, 5) AS most_werd
FROM fair f JOIN fair b ON f.model = b.model AND f.axis = b.axis AND b.variant = 'clean' JOIN per ON per.model = f.model AND per.axis = f.axis AND per.variant = f.variant WHERE f.variant <> 'clean'"""),
    "werd_long": with_pred(_RATES + """SELECT a.model, a.variant, a.axis, a."group", round(a.wer, 5) AS wer, round(b.wer, 5) AS base_wer, round(CASE WHEN b.wer <> 0 THEN 100 * (a.wer - b.wer) / b.wer END, 5) AS werd FROM rates a JOIN rates b ON a.model = b.model AND a.axis = b.axis AND a."group" = b."group" AND b.variant = 'clean' WHERE a.variant <> 'clean'"""),
    "wer_pivot": with_pred(_RATES + "SELECT model, variant, " + ", ".join(f"round(max(wer) FILTER (WHERE \"group\" = '{g}'), 6) AS {g}" for g in ("de", "en", "es", "fr")) + " FROM rates WHERE axis = 'lang' GROUP BY ALL"),
    "insertion_pivot": with_pred(_RATES + ", r AS (SELECT * FROM rates WHERE axis = 'lang') SELECT model, " + ", ".join(f"round((sum(i) FILTER (WHERE variant = '{v}'))::DOUBLE / sum(ref_words) FILTER (WHERE variant = '{v}'), 6) AS {v}" for v in ("clean", "mild", "harsh")) + ", round((max(i / ref_words) FILTER (WHERE i > 0)) / (min(i / ref_words) FILTER (WHERE i > 0)), 6) AS max_over_min FROM r GROUP BY ALL"),
    "overall": with_pred(" SELECT model, variant, count(*) AS n, sum(n)::BIGINT AS ref_words, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, sum(h)::BIGINT AS h, round(sum(errors) / sum(n)::DOUBLE, 6) AS wer, round(sum(s) / sum(n)::DOUBLE, 6) AS s_rate, round(sum(i) / sum(n)::DOUBLE, 6) AS i_rate, round(sum(d) / sum(n)::DOUBLE, 6) AS d_rate FROM pred WHERE n > 0 GROUP BY ALL"),
    "cube_rates": with_pred(" SELECT model, variant, lang, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS words, count(*) AS n, round(sum(errors) / sum(n)::DOUBLE, 6) AS wer FROM pred WHERE n > 0 GROUP BY CUBE (model, variant, lang)"),
    "bootstrap_ci": with_pred(_CI + 'SELECT model, variant, "group", n, round(wer, 6) AS wer, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM ci'),
    "ci_overlap": with_pred(_CI + """, e AS (SELECT model, variant, arg_min("group", (wer, "group")) AS best_group, arg_min("group", (-wer, "group")) AS worst_group, arg_min(low, (wer, "group")) AS l1, arg_min(high, (wer, "group")) AS h1, arg_min(low, (-wer, "group")) AS l2, arg_min(high, (-wer, "group")) AS h2 FROM ci GROUP BY ALL HAVING count(*) >= 2)
SELECT model, variant, best_group, worst_group, greatest(l1, l2) <= least(h1, h2) AS overlap FROM e"""),
    "paired_bootstrap_p": with_pred(boot_sql(10_000) + """, w AS (SELECT model, lang AS "group", doc_id, any_value(ref_words) AS ref_words, max(errors) FILTER (WHERE variant = 'clean') AS a, max(errors) FILTER (WHERE variant = 'harsh') AS b FROM pred WHERE ref_words > 0 GROUP BY ALL),
x AS (SELECT model, "group", draw, (sum(b * k) - sum(a * k))::DOUBLE / nullif(sum(ref_words * k), 0) AS x FROM w JOIN units USING (doc_id) GROUP BY ALL),
p AS (SELECT model, "group", count(*) AS n, (sum(b) - sum(a))::DOUBLE / sum(ref_words) AS delta FROM w GROUP BY ALL)
SELECT model, "group", any_value(n) AS n, round(any_value(delta), 6) AS delta, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(avg((x >= 0)::INT), 6) AS p, round(least(1.0, 2 * least(avg((x >= 0)::INT), avg((x <= 0)::INT))), 6) AS p_two_sided FROM x JOIN p USING (model, "group") GROUP BY ALL"""),
    "mann_whitney": with_pred(""", c AS (SELECT model, lang AS g, wer AS v FROM pred WHERE variant = 'clean' AND wer IS NOT NULL),
z AS (SELECT model, lang AS g, count(wer) AS size, quantile_cont(wer, 0.5) AS med FROM pred WHERE variant = 'clean' GROUP BY ALL HAVING count(*) >= 50 AND count(wer) >= 10),
pr AS (SELECT x.model, x.g AS a, y.g AS b, x.size AS n_a, y.size AS n_b, x.med AS median_a, y.med AS median_b FROM z x JOIN z y ON x.model = y.model AND x.g < y.g),
rk AS (SELECT pr.*, c.g, rank() OVER (PARTITION BY pr.model, a, b ORDER BY v) + (count(*) OVER (PARTITION BY pr.model, a, b, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY pr.model, a, b, v) AS t FROM pr JOIN c ON pr.model = c.model AND (c.g = a OR c.g = b)),
s AS (SELECT model, a, b, n_a, n_b, median_a, median_b, sum(r) FILTER (WHERE g = a) AS r, sum(t * t - 1.0) AS ties FROM rk GROUP BY ALL),
f AS (SELECT model, a, b, n_a, n_b, median_a, median_b, r - n_a * (n_a + 1) / 2.0 AS u, n_a::DOUBLE * n_b AS ab, (n_a + n_b)::DOUBLE AS n, ties FROM s),
y AS (SELECT *, greatest(abs(u - ab / 2) - 0.5, 0) / sqrt(ab / 12 * ((n + 1) - ties / (n * (n - 1)))) / sqrt(2.0) AS x FROM f),
t AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM y),
p AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p FROM t)
SELECT model, a, b, n_a, n_b, round(median_a, 5) AS median_a, round(median_b, 5) AS median_b, round(u, 5) AS u, round(p, 5) AS p,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p"""),
    "ratio_bootstrap": with_pred(boot_sql(200) + """, sizes AS (SELECT model, variant, source, count(*) AS r FROM pred GROUP BY ALL),
seeds AS (SELECT *, 41 + row_number() OVER (ORDER BY model, variant, source) AS seed FROM sizes),
us AS (SELECT model, variant, source, doc_id, ref_words AS w, CAST(round_even(coalesce(wer, 0) * ref_words, 0) AS BIGINT) AS e FROM pred WHERE ref_words > 0),
point AS (SELECT model, variant, source, count(*) AS n, sum(w) AS w, sum(e) AS e FROM us GROUP BY ALL HAVING count(*) >= 50),
xs AS (SELECT model, variant, source, draw, sum(e * k)::DOUBLE / sum(w * k) AS x FROM us JOIN units USING (doc_id) GROUP BY ALL),
cis AS (SELECT model, variant, source, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM xs GROUP BY ALL)
SELECT model, variant, 'source' AS group_axis, source AS "group", n, w::BIGINT AS ref_words, round(e::DOUBLE / w, 6) AS wer, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
  round(hi - lo, 6) AS ci_width, 200 AS n_resamples, seed FROM point JOIN seeds USING (model, variant, source) JOIN cis USING (model, variant, source) WHERE r >= 50 AND trim(source) <> ''"""),
    "pairwise_test": with_pred(boot_sql(1000) + """, u AS (SELECT lang, source, doc_id, model, round(CASE WHEN s + i + h = 0 THEN 1.0 ELSE errors / n::DOUBLE END, 4) AS w FROM pred WHERE variant = 'mild' AND n > 0),
wide AS (SELECT lang, source, doc_id, max(w) FILTER (WHERE model = 'ada') AS a, max(w) FILTER (WHERE model = 'cor') AS b FROM u GROUP BY ALL),
d AS (SELECT lang, source, doc_id, round((a - b) * 10000)::BIGINT AS d FROM wide WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT lang, source, count(*) AS n, sum(d) AS t FROM d GROUP BY ALL),
x AS (SELECT lang, source, draw, sum(d * k)::DOUBLE / (sum(k) * 10000.0) AS x FROM d JOIN units USING (doc_id) GROUP BY ALL),
p AS (SELECT lang, source, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, avg((x <= 0)::INT) AS down, avg((x >= 0)::INT) AS up FROM x GROUP BY ALL)
SELECT g.lang, g.source, coalesce(n, 0) AS n_paired, round(CASE WHEN n >= 20 THEN t / (n * 10000.0) END, 6) AS mean_diff, round(CASE WHEN n >= 20 THEN lo END, 6) AS ci_lower,
  round(CASE WHEN n >= 20 THEN hi END, 6) AS ci_upper, round(CASE WHEN n >= 20 THEN least(1.0, 2 * CASE WHEN t >= 0 THEN down ELSE up END) END, 6) AS p_value,
  CASE WHEN coalesce(n, 0) < 20 THEN 'too few pairs' END AS error
FROM (SELECT DISTINCT lang, source FROM wide) g LEFT JOIN n ON g.lang IS NOT DISTINCT FROM n.lang AND g.source IS NOT DISTINCT FROM n.source LEFT JOIN p ON g.lang IS NOT DISTINCT FROM p.lang AND g.source IS NOT DISTINCT FROM p.source"""),
    "utterance_rates": with_pred(""" SELECT model, variant, count(*) AS n,
  round(avg(CASE WHEN n = 0 THEN 0.0 WHEN s + i + h = 0 THEN 1.0 ELSE errors / n::DOUBLE END), 6) AS as_reported,
  round(avg(CASE WHEN n = 0 THEN CASE WHEN s + i + h = 0 THEN 0.0 ELSE 1.0 END WHEN s + i + h = 0 THEN 1.0 ELSE errors / n::DOUBLE END), 6) AS as_rewarded FROM pred GROUP BY ALL"""),
    "degradation_area": with_pred(""", r AS (SELECT model, lang, variant, sum(errors) / sum(n)::DOUBLE AS w FROM pred WHERE n > 0 GROUP BY ALL),
w AS (SELECT model, lang, max(w) FILTER (WHERE variant = 'clean') AS a, max(w) FILTER (WHERE variant = 'mild') AS b, max(w) FILTER (WHERE variant = 'harsh') AS c FROM r GROUP BY ALL)
SELECT model, lang, round((a + b) / 2 + (b + c) / 2, 6) AS area FROM w"""),
}
