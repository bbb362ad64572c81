"""URL filter: rules first, then a ratio of two character language models, with DataFrame functions only.

Rules name a host and the start of a path; the longest that fits decides.  The
URLs on which rules decide are the examples: one variable-order Markov model is
learnt from the accepted and one from the rejected.  An n-gram's probability in
either model is its share among those with the same context, smoothed towards
the next shorter context (weight `strength`), down to the uniform distribution.
A URL's score is the difference of the two log likelihoods per character.

One in `folds` of the example URLs, by hash, teaches nothing: on these the
threshold is set.  It lies between the mean scores of accepted and rejected
ones, as far from each in standard deviations (each variance averaged with the
mean of both, as few examples of one kind look more alike than they are); scores
at or above it are allowed.  A kind without held-out examples takes all of its.

Equal URLs are scored once.  Each distinct n-gram's ratio is worked out once.
The `common` most frequent n-grams (a bounded table) go to every task and are
added up where the URL is; only the others are joined by n-gram, so no key of
that join is in more than few URLs.

Nulls: a null URL, or one without "://", has an empty host and path, fits no
rule and is scored like any text (null as empty).  Without examples of both
kinds every score is 0 and the threshold 0, so all that no rule blocks is
allowed.  Repeated rows each give a row; an empty table gives an empty result.
A very long URL is n-grams like any other.  Only the id and the URL are read, so
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, named, stash, table

# The production rules.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
BEGIN, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # (A-Z lower-cased), then what stands up to ? #."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(there, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (the first of equally long ones), else null."""
    choice = None
    for rule, verdict in sorted(rules, key=lambda x: -len(x[0])):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, found) if choice is None else choice.when(fits, found)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """(keep, gram): one row for each character and the end of the URL, with the order - 1 characters before it."""
    padded = F.concat(F.lit(BEGIN * (order - 1)), F.coalesce("url", F.lit("")), F.lit(END))
    return urls.select(*keep, padded.alias("p")).select(
        *keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - (order - 1)), lambda i: F.substring(F.col("p"), i, F.lit(order)))).alias("gram"))


def log_ratios(counts: DataFrame, order: int, strength: float) -> DataFrame:
    """counts (gram, good, bad, ...) with `ratio`: the log ratio of the last character's probability after the others, accepted over rejected."""
    out = counts
    for n in range(order):  # n characters of context
        sums = counts.groupBy(F.right("gram", F.lit(n + 1)).alias(f"g{n}")).agg(F.sum("good").alias(f"good{n}"), F.sum("bad").alias(f"bad{n}"))
        total = [F.sum(f"good{n}").alias(f"all_good{n}"), F.sum(f"bad{n}").alias(f"all_bad{n}")]
        out = out.withColumn(f"g{n}", F.right("gram", F.lit(n + 1))).join(sums, f"g{n}")
        if n:
            out = out.withColumn(f"c{n}", F.left(f"g{n}", F.lit(n))).join(sums.groupBy(F.left(f"g{n}", F.lit(n)).alias(f"c{n}")).agg(*total), f"c{n}")
        else:
            out = out.crossJoin(F.broadcast(sums.agg(*total)))  # one row
    # 1/256 for any character below all counts
    ratio = F.lit(0.0)
    for kind, sign in (("good", 1), ("bad", -1)):
        p = F.lit(1 / 256)
        for n in range(order):
            p = (F.col(f"{kind}{n}") + strength * p) / (F.col(f"all_{kind}{n}") + strength)
        ratio = ratio + sign * F.log(p)
    return out.select(*counts.columns, ratio.alias("ratio"))


def score_urls(urls: DataFrame, order: int, strength: float, folds: int, common: int) -> DataFrame:
    """urls (url, times, decided) with `held` (kept out of training) and `score`."""
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(folds)) == 0).repartition(parts)  # a URL is some forty n-grams: no small file may be one task
    each = _grams(urls, order, "url", "times", "decided", "held")
    learn = lambda verdict: F.sum(F.when((F.col("decided") == verdict) & ~F.col("held"), F.col("times")).otherwise(0))
    counts = stash(each.groupBy("gram").agg(F.count("*").alias("n"), learn("allow").alias("good"), learn("block").alias("bad")), "grams")
    ratios = stash(log_ratios(counts, order, strength).select("gram", "n", "ratio"), "ratios")
    most = ratios.orderBy(F.desc("n"), "gram").limit(common).select("gram", "ratio")  # `common` rows at most
    marked = each.select("url", "gram").join(F.broadcast(most), "gram", "left")
    rare = marked.where("ratio IS NULL").groupBy("url", "gram").agg(F.count("*").alias("n")).join(ratios.select("gram", "ratio"), "gram")
    # decimals: their sums are the same in any order
    part = lambda n: F.sum((n * F.col("ratio")).cast("decimal(28,12)"))
    sums = marked.where("ratio IS NOT NULL").groupBy("url").agg(part(F.lit(1)).alias("sum"), F.count("*").alias("n"))
    sums = sums.unionByName(rare.groupBy("url").agg(part(F.col("n")).alias("sum"), F.sum("n").alias("n")))
    sums = sums.groupBy("url").agg((F.sum("sum").cast("double") / F.sum("n")).alias("score"))
    return urls.join(sums.withColumnRenamed("url", "u"), F.col("url").eqNullSafe(F.col("u"))).drop("u")


def threshold(scores: DataFrame) -> DataFrame:
    """One row: the threshold of examples (score, times, decided, held)."""

    def moments(decided: str) -> tuple[Column, Column]:
        def of(here: Column) -> tuple[Column, Column]:
            here = here & (F.col("decided") == decided)
            x, w = F.when(here, F.col("score")), F.when(here, F.col("times"))
            add = lambda c: F.sum(c.cast("decimal(38,15)")).cast("double")  # noqa: E731  the same in any order
            mean = F.try_divide(add(x * w), F.sum(w))
            return mean, F.try_divide(add(x * x * w), F.sum(w)) - mean * mean

        (mean, variance), (all_mean, all_variance) = of(F.col("held")), of(F.lit(True))
        return F.coalesce(mean, all_mean), F.greatest(F.coalesce(variance, all_variance), F.lit(1e-12))

    (m_good, v_good), (m_bad, v_bad) = moments("allow"), moments("block")
    one = scores.agg(m_good.alias("mg"), v_good.alias("vg"), m_bad.alias("mb"), v_bad.alias("vb"))
    s_good, s_bad = (F.sqrt(F.col(v) / 2 + (F.col("vg") + F.col("vb")) / 4) for v in ("vg", "vb"))
    return one.select(F.coalesce((F.col("mg") * s_bad + F.col("mb") * s_good) / (s_good + s_bad), F.lit(0.0)).alias("threshold"))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, order: int = 4, strength: float = 2.0,
    folds: int = 5, common: int = 20_000,
) -> DataFrame:
    """id_col, host, path, rule, verdict, score (null where rules decide), threshold."""
    if not 1 <= common <= 200_000:
        raise ValueError("common bounds what goes to every task: 1 to 200,000")
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    urls = stash(rows.groupBy("url").agg(F.count("*").alias("times"), F.first("found.verdict").alias("decided")), "urls")
    both = {r["decided"] for r in urls.select("decided").distinct().collect()} >= {"allow", "block"}  # three rows at most
    scores = stash(score_urls(urls, order, strength, folds, common) if both else urls.withColumns({"held": F.lit(True), "score": F.lit(0.0)}), "url-scores")
    out = rows.where("found IS NOT NULL").select("id", "host", "path", "found", F.lit(None).cast("double").alias("score"))
    own = scores.where("decided IS NULL").select(F.col("url").alias("u"), "score")
    out = out.unionByName(rows.where("found IS NULL").join(own, F.col("url").eqNullSafe(F.col("u"))).select("id", "host", "path", "found", "score"))
    out = out.crossJoin(F.broadcast(threshold(scores)))  # one row
    by_score = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", "found.rule", F.coalesce("found.verdict", by_score).alias("verdict"), "score", "threshold")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
