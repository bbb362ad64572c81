"""Text and label functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of chatbot wrapper text, and phrases of it (in lower-cased text).
CHATTY = ["^Sure", "^Of course", "^Here(?:'s| is)", "^The user(?:'s)?", "transcri(?:be|ption|bed)", "written format"]
CHATTY_PHRASES = [
    "thank you for watching", "please subscribe", "like and subscribe", "sure", "of course", "here is", "here's", "the user", "transcription", "transcribed",
    "written format",
]
# Function words of the rule sets "ngram" (94), "ngram_or_word" (86) and "function_first" (59).
FUNCTION_WORDS = (
    "the a an in on at to of for is was are were and or but that this it he she they we i you my your his her its our their be been being have has had do does "
    "did will would shall should may might can could not no so if then than as with by from up about into through during before after above below between under "
    "again further there here when where why how all each every both few more most other some such only own same too very just").split()
FUNCTION_WORDS_86 = (
    "the a an in on at to of for is was are were and or but that this it he she they we i you my your his her its our their be been being have has had do does "
    "did will would should may might can could not no so if then than as with by from up about into through during before after again there here when where why "
    "how all each every both more most other some such only same too very just").split()
FUNCTION_WORDS_59 = (
    "the a an is are was were to of in for on at by with and or but that this it he she they we i you my your his her its our their be been being have has had "
    "do does did will would could should can may might shall not no so if than then just also").split()


#: Runs of what is in no word.  Ranges of all that is not a-z, 0-9 or an apostrophe: Java takes several times as long for "[^a-z0-9']+".
NO_WORD = r"[\x00-&(-/:-`{-\x{10ffff}]+"


def normalize(text: Column) -> Column:
    """Lower case; what is no ASCII letter, digit, apostrophe or blank becomes a blank; one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), NO_WORD, " "))


def word_count(text: Column) -> Column:
    """Words that normalize() leaves of a text, in one pass over it."""
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9']+")).cast("long")


def strip_markup(text: Column) -> Column:
    """Without <...>, (...), [...] and slashes, blanks collapsed."""
    out = text
    for pattern in (r"<[^>]*>", r"\([^)]*\)", r"\[[^\]]*\]", "/"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, "[ \t\n\r]+", " "))


def safe_label(text: Column) -> Column:
    """Fit for a file name: runs of other characters become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def longest_quoted(text: Column) -> Column:
    """The longest text between double quotes (the first of equally long ones), else the text without a preamble."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    best = F.aggregate(quoted, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    bare = F.trim(F.regexp_replace(text, "(?i)^(sure|certainly|here is|the transcription is)[^:]*:", ""))
    return F.when(F.size(quoted) > 0, best).otherwise(bare)


def chatty(text: Column) -> Column:
    """Whether a raw hypothesis has wrapper text: any of the patterns, case aside."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(CHATTY))


def chatty_phrases(text: Column) -> Column:
    """Whether any of the phrases is in the lower-cased text."""
    low = F.lower(text)
    found = F.lit(False)
    for phrase in CHATTY_PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    return found


def long_hypothesis(reference: Column, hypothesis: Column) -> Column:
    """Over three times as long as its reference, which is not empty, and over 50 characters."""
    return (F.length(reference) > 0) & (F.length(hypothesis) > 3 * F.length(reference)) & (F.length(hypothesis) > 50)


def bucket_label(value: Column, edges: list[float]) -> Column:
    """"lo-hi s" with the upper edge inside, or ">last s"."""
    low, out = 0, None
    for edge in edges:
        label = f"{low:g}-{edge:g}s"
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
        low = edge
    return out.otherwise(f">{edges[-1]:g}s")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def edits_from_rate(rate: Column, words: Column) -> Column:
    """Half-even rounding of a stored rate times the words."""
    return F.bround(rate * words).cast("long")


def first_number(*columns: Column, required: str | None = None) -> Column:
    """The first that parses as a number; null if none does, or an error that names `required`."""
    found = F.coalesce(*(F.expr("NULL").cast("double"), *(c.try_cast("double") for c in columns)))
    return found if required is None else F.coalesce(found, F.raise_error(F.lit(f"no usable {required}")).cast("double"))


def head_label(layer: Column, head: Column) -> Column:
    """L<layer>_h<head>."""
    return F.format_string("L%d_h%d", layer.cast("int"), head.cast("int"))


def utterance_wer(errors: Column, reference_words: Column, hypothesis_words: Column, empty_reference: float = 0.0) -> Column:
    """An utterance's rate: 1 for a blank hypothesis; for a blank reference 0, or `empty_reference` if words were said (reports
    take 0 there, rewards 1)."""
    return F.when(reference_words == 0, F.when(hypothesis_words == 0, 0.0).otherwise(empty_reference)).when(hypothesis_words == 0, 1.0).otherwise(
        errors / reference_words)


def first_filled(*columns: Column, default: str) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default))


def resolve_column(df: DataFrame, names: list[str]) -> str:
    """The first of the names that df has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} in {df.columns}")


def digest_pick(key: Column, n: int) -> Column:
    """A number in 0..n-1 from the md5 of a key: the 128-bit value modulo n, folded over 8 parts of 16 bits."""
    digest, out = F.md5(key.cast("binary")), F.lit(0).cast("long")
    for i in range(8):
        out = (out * 65536 + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")) % n
    return out


def adapter_megabytes(rank: Column, width: Column, layers: Column, bytes_each: int = 2) -> Column:
    """Memory of low-rank adapters: two matrices of rank x width for each layer, with gradients and two moments."""
    return rank * width * layers * 2 * bytes_each * 4 / (1024 * 1024)


def learning_rate(step: Column, peak: float, warmup: int, total: int, kind: str = "linear") -> Column:
    """Linear warm-up, then a linear or a cosine fall to zero."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    fall = 1 - part if kind == "linear" else 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part))
    return peak * F.when(step < warmup, step / max(1, warmup)).otherwise(fall)
