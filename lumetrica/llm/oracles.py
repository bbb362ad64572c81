"""DuckDB SQL of what SQL can express: contamination in full, and the parts of other operators that follow from rules alone.

Those parts are queries of their own, made of the operators' output: url_rules, edited_digests, license_base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .document_fingerprints import op8_document_fingerprints
from .license_scan import BASE, op9_license_scan
from .url_filter import RULES, op3_url_filter


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule gives it."""
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every edited text."""
    return op8_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base phrases of every document."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _words(x: str) -> str:
    return rf"regexp_extract_all({_lower(f'''coalesce({x}, '')''')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _rule_cases(column: int) -> str:
    out = []
    for rule in sorted(RULES, key=lambda x: -len(x[0])):
        host, _, path = rule[0].partition("/")
        out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[column]}'")
    return "CASE " + " ".join(out) + " END"


def _base_places() -> str:
    parts = []
    for phrase, label in BASE:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        parts.append(f"SELECT rid, i - 1 AS p, '{label}' AS label FROM d, unnest(range(1, len(w) - {len(words)} + 2)) t(i) WHERE {test}")
    return " UNION ALL ".join(parts)


QUERIES = {"url_rules": url_rules, "edited_digests": edited_digests, "license_base": license_base}

ORACLE_SQL = {
    "op4_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_words('text')} AS w FROM benchmark),
bn AS (SELECT id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bn, unnest(range(1, len(w) - n + 2)) t(i)),
sizes AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT rid, w, n FROM d, sizes WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT rid, i, dw.n, id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hits), unnest(range(i, i + n)) t(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)""",
    "op11_collocations": f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g, list_slice(w, i, i + n - 1) AS words, count(*) AS f
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n)) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, n, g, words, f AS a, unnest(range(1, n)) AS k FROM g WHERE n > 1 AND f >= 10),
cut AS (SELECT c.lang, c.n, c.g, c.words, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.g = array_to_string(list_slice(c.words, 1, k), ' ') JOIN g y ON y.lang = c.lang AND y.g = array_to_string(list_slice(c.words, k + 1, c.n), ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_part AS (SELECT lang, array_to_string(list_slice(words, i, i + 1), ' ') AS g, max(f) AS longer FROM (SELECT lang, words, f, unnest([1, 2]) AS i FROM g WHERE n = 3 AND f >= 10) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_part p ON p.lang = b.lang AND p.g = b.g AND b.n = 2 WHERE p.longer IS NULL OR 100 * p.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, total.n AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) <= 2000""",
    "op12_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n.n, 0) AS n, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS n_lang FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (kept.total + 2)) // (g.n_lang + 2 * g.v) AS BIGINT) AS q FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10""",
    "url_rules": f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_rule_cases(0)} AS rule, {_rule_cases(1)} AS verdict FROM h""",
    "edited_digests": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(u, 1, n // 2)) AS edited_sha256 FROM n""",
    "license_base": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents), found AS ({_base_places()}),
f AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN f USING (rid)""",
}
