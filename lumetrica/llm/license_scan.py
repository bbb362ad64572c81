"""License scans with a positional index of rare words, with DataFrame functions only.

Templates are license notices as words, with the key phrases that none may lack.
Document frequencies of the templates' words are counted over all rows.  Of the words
that a template needs, the `anchors` of highest IDF are looked up wherever a file has them: a
word's postings (template, position) say where the template would begin there.  The
postings are intersected by relative position: beginnings are sorted, and only those
stay on which all postings of the template agree.  Such a beginning is
kept if its key phrases stand there word for word; its coverage is the share of
the template's IDF that stands at the right relative positions.

The base phrases are templates of their own whose key phrase is all of them.
The index has some hundred entries, whatever the corpus; matching stays inside
each row, so no row or word is ever shuffled.

Nulls: a null text has no words.  Repeated rows each give a row.  An empty table
gives an empty result.  A very long text is one row like any other.  Only the id
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Label, notice or licence text, key phrases.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["may not use this file except in compliance", "without warranties or conditions of any kind"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["redistribution and use", "source and binary forms"]),
    ("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["published by the free software foundation", "in the hope that it will be useful"]),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee", "appear in all copies"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("mit-notice", "Released under the MIT License", ["under the mit license"]),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy", ["hereby granted free of charge"]),
    ("mit-whole-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["deal in the software without restriction", "shall be included in all copies or substantial portions"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software", "released into the public domain"]),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["alter it and redistribute it freely"]),
]


def split_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda x: x[0].lower(), text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _templates() -> list[tuple[str, bool, list[str], list[int]]]:
    """Label, whether it is a base phrase, words, and the places of words that must be there."""
    out = [(label, True, split_words(phrase), list(range(len(split_words(phrase))))) for phrase, label in BASE]
    for label, notice, keys in NOTICES:
        words, needed = split_words(notice), set()
        for key in keys:
            own = split_words(key)
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            needed |= set(range(at, at + len(own)))
        out.append((label, False, words, sorted(needed)))
    return out


def word_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and how many of them have each word of the vocabulary."""
    found = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the vocabulary at most
    return counts.pop("", 0), counts


def anchor_postings(templates: list, idf: dict[str, float], anchors: int) -> dict[str, list[tuple[int, int]]]:
    """Word -> (template, place) of the rarest of the words that must be there (they are, wherever a template is kept)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for number, (_, _, own, needed) in enumerate(templates):
        for w in sorted({own[i] for i in needed}, key=lambda w: (-idf[w], w))[:anchors]:
            out.setdefault(w, []).extend((number, i) for i in needed if own[i] == w)
    return out


#: A beginning is one long: the template, then the place, which may be before the text.
PLACE_BITS, BEFORE = 40, 1 << 20


def beginnings(words: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """array<struct<t, start>> of the places on which all postings of a template agree."""
    rare = F.array(*map(F.lit, sorted(postings)))
    suggest = F.create_map(*(x for w, at in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.lit((t << PLACE_BITS) + BEFORE - i) for t, i in at)))))
    needed = [0] * (1 + max(t for at in postings.values() for t, _ in at))
    for at in postings.values():
        for t, _ in at:
            needed[t] += 1
    agree = F.array(*map(F.lit, needed))
    met = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x.w))
    found = F.array_sort(F.flatten(F.transform(met, lambda x: F.transform(F.element_at(suggest, x.w), lambda p: p + x.i))))
    template = lambda x: F.shiftright(x, PLACE_BITS).cast("int")
    # equal beginnings stand together: the last of as many as agree is equal to the first
    run = F.transform(F.array(found), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + F.get(agree, template(x)) - 1) == x, F.lit(False))))
    return F.transform(F.array_distinct(F.element_at(run, 1)), lambda x: F.struct(
        template(x).alias("t"), (x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - BEFORE).cast("int").alias("start")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = 3) -> DataFrame:
    """id_col, words, places: array of (template, base, label, start, coverage) whose key phrases all stand there."""
    templates = _templates()
    words = docs.select(id_col, words_of(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t[2]})
    n, df = word_frequencies(words, vocabulary)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}

    postings = anchor_postings(templates, idf, anchors)
    rows = F.array(*(
        F.struct(
            F.lit(label).alias("label"), F.lit(base).alias("base"), F.array(*map(F.lit, own)).alias("own"),
            F.array(*(F.struct(F.lit(i).alias("i"), F.lit(own[i]).alias("w")) for i in needed)).alias("needed"),
            F.array(*(F.lit(idf[w] + 1e-9) for w in own)).alias("weight"), F.lit(sum(idf[w] + 1e-9 for w in own)).alias("total"))
        for label, base, own, needed in templates))
    rare = F.array(*map(F.lit, sorted(postings)))

    at = lambda start, i: F.get(F.col("words"), start + i)
    whole = lambda b: F.forall(F.get(rows, b.t).needed, lambda k: F.coalesce(at(b.start, k.i) == k.w, F.lit(False)))

    def covered(b: Column) -> Column:
        own = F.get(rows, b.t)
        weights = F.transform(own.own, lambda w, i: F.when(at(b.start, i) == w, F.get(own.weight, i)).otherwise(0.0))
        return F.least(F.lit(1.0), F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / own.total)

    places = F.transform(F.filter("begins", whole), lambda b: F.struct(
        b.t.alias("template"), F.get(rows, b.t).base.alias("base"), F.get(rows, b.t).label.alias("label"), b.start.alias("start"), covered(b).alias("coverage")))
    # rows without a rare word (nearly all) take the short way
    some = F.arrays_overlap(F.col("words"), rare)
    begins = F.when(some, beginnings(F.col("words"), postings)).otherwise(F.array().cast("array<struct<t:int,start:int>>"))
    return words.withColumn("begins", begins).withColumn("places", places).drop("begins")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that each document names."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p.base)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    starts = F.transform(base, lambda p: p.start.cast("long"))
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.coverage)), F.lit(0.0)).alias("score"))
