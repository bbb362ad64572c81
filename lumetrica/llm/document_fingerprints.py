"""Document fingerprints by winnowing, with DataFrame functions only.

Every text is a run of characters (code points), with or without spaces.  Each k of them in a
row have a hash, and of every `window` such hashes in a row the smallest is
kept, on ties the rightmost, with its place.  Two texts that share k + window - 1
characters in a row share a kept hash there, wherever it stands in either.
Texts shorter than k have one hash of all they have, texts of fewer hashes than
a window keep the smallest of all; an empty text keeps nothing.

Hash and place share one long, so that a single minimum finds both: the upper
36 bits are the hash, the lower 28 are 2**28 - 1 less the place (a character's number
in its text), by which the rightmost of equal hashes is the smallest.  Minima over a
window come from log2 passes, each over pairs that lie twice as far apart; the window is a
power of two.

Likeness of two fingerprints: the share of kept hashes that both have among
those that either has; two empty ones are alike (1).

Nulls: a null text counts as empty.  Rows follow each other by descending id
(null ids last), then by text; after the last comes the first.  Equal rows follow each other.
A table of one row is its own next.  An empty table gives an empty result.  A text may have
2**28 characters at most.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, named, table

PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1


#: Windows of one segment; a text is gone through segment by segment, so that only what is kept grows with it.
SEGMENT = 1 << 13


def _once(value: Column, then) -> Column:
    """then(value), where value is the one element of an array, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def _least(values: Column, reach: int, window: int) -> Column:
    """The least of each `window` (a power of two) of values in a row, `window` values at least: pairs that lie twice as far apart each time."""
    if reach == window:
        return values
    later = F.slice(values, reach + 1, F.size(values))
    return _once(F.slice(F.zip_with(values, later, lambda a, b: F.least(a, b)), 1, F.size(values) - reach), lambda x: _least(x, 2 * reach, window))


def winnowed(text: Column, k: int = 8, window: int = 16) -> Column:
    """array<bigint> of kept hashes with their places, by place."""
    if window < 1 or window & (window - 1) or k < 1:
        raise ValueError("k must be positive, window a power of two")
    chars = F.encode(text, "UTF-32")  # four bytes a character, so that a run of them is found without a search

    def gram(points: Column, i: Column) -> Column:
        return F.xxhash64(F.substring(points, 4 * i + 1, F.lit(4 * k))).bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i.cast("long"))

    def minima(points: Column, first: Column, grams: Column) -> Column:
        """The least hash of every window that begins in a segment."""
        last = F.least(first + (SEGMENT + window - 2), grams - 1)
        return _once(F.transform(F.sequence(first, last), lambda i: gram(points, i)), lambda g: _least(g, 1, window))

    def kept(points: Column) -> Column:
        grams = F.greatest(F.lit(1), F.floor(F.length(points) / 4).cast("int") - (k - 1))  # of a text shorter than k, one gram of all it has
        few = F.array(F.array_min(F.transform(F.sequence(F.lit(0), grams - 1), lambda i: gram(points, i))))
        begins = F.sequence(F.lit(0), F.greatest(grams - window, F.lit(0)), F.lit(SEGMENT))
        return F.when(grams < window, few).otherwise(F.flatten(F.transform(begins, lambda first: F.array_distinct(minima(points, first, grams)))))

    return F.when(F.length(text) > 0, F.array_distinct(_once(chars, kept))).otherwise(F.array().cast("array<bigint>"))


def hashes_of(kept: Column) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS)))


def places_of(kept: Column) -> Column:
    return F.transform(kept, lambda x: (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("int"))


def likeness(a: Column, b: Column, both: Column) -> Column:
    """Shared hashes among all: of two sets the sizes and the size of what both have."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(both / F.greatest(a + b - both, F.lit(1)))


def as_text(kept: Column) -> Column:
    """Every kept hash with its place as one number (places_of and hashes_of take it apart), comma-joined."""
    return F.array_join(kept.cast("array<string>"), ",")


def with_next(docs: DataFrame, id_col: str, text_col: str, derived: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """docs with the columns in `derived` and next_<column>, the text and the derived ones of the next row by descending id;
    after the last row, the first.

    Quantiles of the ids cut the rows into ranges of about equal size.  The row that follows the last one of a range is
    copied into that range, so each range finds its rows' successors by itself.  Only one row per range meets in one place;
    what is derived is worked out once for each row and each such copy.
    """
    spark = docs.sparkSession
    derived = derived or {}
    parts = parts or max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key, part, halo = free(docs.columns, "key", "part", "halo")
    # ~id falls as the id rises; null ids come last
    number = F.coalesce(F.bitwise_not(named(id_col).cast("long")), F.lit((1 << 63) - 1))
    cuts = docs.select(number.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    ranged = docs.withColumn(key, number).withColumn(part, F.size(F.filter(bounds, lambda b: b < F.col(key))))
    least = ranged.groupBy(part).agg(F.min(key).alias(key))  # `parts` rows at most
    heads = ranged.select(part, key, text_col).join(F.broadcast(least), [part, key]).groupBy(part).agg(
        F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))).alias("head"))
    order = Window.orderBy(part)  # one row per range
    first = heads.select(F.coalesce(F.lag(part).over(order), F.max(part).over(Window.partitionBy())).alias(part), F.col("head.text").alias(text_col), F.lit(1).alias(halo))
    columns, tie = [*docs.columns, *derived], free([*docs.columns, *derived, key, part, halo], "tie")[0]
    # ties by hash, then by text: equal ids of different texts have one order whatever the files
    rows = ranged.withColumn(halo, F.lit(0)).unionByName(first, allowMissingColumns=True).withColumn(tie, F.xxhash64(text_col))
    order = [halo, key, tie, text_col]
    # what is derived is worked out behind the shuffle, which moves texts alone
    rows = rows.repartition(part).sortWithinPartitions(part, *order).withColumns(derived)
    within = Window.partitionBy(part).orderBy(*order)
    after = {f"next_{c}": F.lead(c).over(within) for c in (text_col, *derived)}
    return rows.withColumns(after).where(F.col(halo) == 0).select(*columns, *after)


def winnowed_edit(kept: Column, next_kept: Column, edited: Column, own: Column, other: Column, k: int, window: int) -> Column:
    """winnowed(edited) of a text of the first `own` characters of one text and the first `other` of the next, from what both texts keep.

    Windows inside either part keep what they keep in its text: whatever stands before the part's last window is kept by
    windows of the part.  Only the windows over the seam and the last ones of each part are worked out anew.
    """
    span, place = k + window - 1, lambda x: F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))
    left, right = own - (span - 1), other - (span - 1)  # windows inside the parts
    moved = lambda found, by: F.transform(found, lambda x: x - by.cast("long"))
    piece = lambda start, size: winnowed(F.substring(edited, start + 1, size), k, window)
    seam, last = left - window + 1, own + right - window + 1
    parts = F.concat(
        F.filter(kept, lambda x: place(x) < left), moved(piece(seam, own + (span - 1) - seam), seam),
        moved(F.filter(next_kept, lambda x: place(x) < right), own), moved(piece(last, own + other - last), last))
    return F.when((left >= window) & (right >= window), F.array_distinct(parts)).otherwise(winnowed(edited, k, window))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """docs with `kept` (array<bigint>), `hashes` and `places`."""
    kept = docs.withColumn("kept", winnowed(F.coalesce(text_col, F.lit("")), k, window))
    return kept.withColumns({"hashes": hashes_of(F.col("kept")), "places": places_of(F.col("kept"))})


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, window: int = 16) -> DataFrame:
    """Each text's fingerprint beside that of an edit of it (its second half gives way to the next text's beginning)."""
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", {"kept": winnowed(F.col("text"), k, window)}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("CAST(n_chars DIV 2 AS INT)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", "n_chars", "kept", "next_kept", edited.alias("edited"), (F.col("n_chars").cast("int") - half).alias("own"))
    # a column of its own: within the functions over arrays it would be worked out for each element
    rows = rows.select("*", (F.length("edited") - F.col("own")).alias("other"))
    rows = rows.select(
        "id", "n_chars", "kept", "next_kept", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowed_edit(F.col("kept"), F.col("next_kept"), F.col("edited"), F.col("own"), F.col("other"), k, window).alias("edited_kept"))
    rows = rows.select("*", *(hashes_of(F.col(f"{c}kept")).alias(f"{c}hashes") for c in ("", "edited_", "next_")))
    own, other, after = (F.col(f"{c}hashes") for c in ("", "edited_", "next_"))
    rows = rows.select("*", F.size(F.array_intersect(own, other)).alias("with_edited"), F.size(F.array_intersect(own, after)).alias("with_next"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.size(own), F.size(other), F.col("with_edited")).alias("near_edited"),
        likeness(F.size(own), F.size(after), F.col("with_next")).alias("near_next"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
