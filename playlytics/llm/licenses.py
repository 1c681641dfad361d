"""License notices in texts, found by MinHash bands over windows and verified by containment.

For templates of n words, windows of n + n/2 words begin every n/2 words, so that an occurrence lies whole in one of them. The
MinHash of a window or template under one hash function is a band of one row; a window holding ``CONTAINED`` of a
template's five-word shingles (a template under five words is one shingle) agrees in a band with at least the probability s = CONTAINED m / (w + (1 - CONTAINED) m), for m and w shingles. So
many bands are taken that one agrees with the probability ``RECALL``. Windows that agree are compared with their
template exactly: the share of the template's shingles that the window holds.

A text that holds none of (1 - CONTAINED) m + 1 of a template's shingles cannot hold the rest in sufficient number. These few
are looked up in the normalised text first (before them, in the text as it is, a few words of which each holds one), and windows without any shingle of a template are left out; neither loses a match.
All steps are expressions of Spark; templates and their bands are parameters, of bounded number, and broadcast.

Null and empty texts, and texts shorter than a notice, hold nothing of it. Very long texts are cut into windows like others. Result rows: one per document id and template found, so that repeated rows
of an id make one; null ids are one id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlytics.llm.license_texts import BODIES, IDENTIFIERS, SHORT_FORMS

SHINGLE = 5
CONTAINED = 0.8
RECALL = 0.9999
MAX_BANDS = 100_000  # rows of the broadcast band table
#: Notices by which texts state their license.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
}
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.lower()) if w]


for _name, _wording in {**BODIES, **SHORT_FORMS, **IDENTIFIERS}.items():  # each wording once
    if words_of(_wording) not in map(words_of, TEMPLATES.values()):
        TEMPLATES[_name] = _wording


def shingle_words(size: int) -> int:
    """The length of the shingles of a template of ``size`` words: a shorter one is a single shingle."""
    return min(SHINGLE, size)


def template_shingles(text: str) -> list[str]:
    words = words_of(text)
    if len(words) < 2:
        raise ValueError(f"a template needs two words: {text!r}")
    run = shingle_words(len(words))
    return list(dict.fromkeys(" ".join(words[i : i + run]) for i in range(len(words) - run + 1)))


def stride(size: int) -> int:
    return max(1, size // 2)


def window_words(size: int) -> int:
    return size + stride(size)


def window_shingles(size: int) -> int:
    return window_words(size) - shingle_words(size) + 1


def bands_needed(size: int, distinct: int, contained: float = CONTAINED, recall: float = RECALL) -> int:
    """Bands after which a window holding ``contained`` of a template agrees in one with probability ``recall``."""
    window = window_shingles(size)
    shared = contained * distinct
    alike = shared / (window + distinct - shared)
    return math.ceil(math.log(1 - recall) / math.log(1 - alike))


def probes(shingles: list[str], contained: float = CONTAINED) -> list[str]:
    """Shingles of which every match holds one, those with the longest words, as these are rare."""
    number = len(shingles) - math.ceil(contained * len(shingles) - 1e-9) + 1
    return sorted(shingles, key=lambda s: -max(map(len, s.split())))[:number]


def heads(needles: list[str]) -> list[str]:
    """Few words of which every needle holds one, long ones, as these are rare."""
    left = [[w for w in n.split() if len(w) >= min(7, max(map(len, n.split())))] for n in needles]
    chosen: list[str] = []
    while left:
        counts = Counter(w for words in left for w in set(words))
        chosen.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
        left = [words for words in left if chosen[-1] not in words]
    return chosen


def normalised(text: Column) -> Column:
    """Lower-case words between single spaces, one at each end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _GAP, " "), F.lit(" "))


def _least(shingles: Column, bands: Column) -> Column:
    """The MinHash of each band."""
    return F.transform(
        F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b.cast("int"))))
    )


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def find_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED, recall: float = RECALL
) -> DataFrame:
    """(doc_id, template, containment, first_word): the best window of each template found and its first word, from 0."""
    shingles = {name: template_shingles(text) for name, text in templates.items()}
    sizes: dict[int, list[str]] = {}
    for name, text in templates.items():
        sizes.setdefault(len(words_of(text)), []).append(name)
    bands = {n: max(bands_needed(n, len(shingles[t]), contained, recall) for t in names) for n, names in sizes.items()}
    if sum(bands[n] * len(names) for n, names in sizes.items()) > MAX_BANDS:
        raise ValueError("too many templates for one broadcast table: scan in parts")
    if not sizes:
        raise ValueError("no templates")
    needles = sorted({f" {p} " for s in shingles.values() for p in probes(s, contained)})

    some = lambda text, parts: F.exists(_array(parts), lambda part: F.contains(text, part))
    lengths = sorted({shingle_words(n) for n in sizes})
    words = F.split(F.trim("norm"), " ")

    def runs(length: int) -> Column:
        start = F.sequence(F.lit(1), F.size("words") - length + 1)
        found = F.transform(start, lambda i: F.array_join(F.slice("words", i, length), " "))
        return F.when(F.size("words") >= length, found).otherwise(F.array().cast("array<string>")).alias(f"runs{length}")

    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.exists(F.array(F.lower("text")), lambda t: some(t, heads(needles))))  # most texts hold no head, and need no normal form
        .select("doc_id", normalised(F.col("text")).alias("norm"))
        .where(F.exists(F.array("norm"), lambda t: some(t, needles)))  # normalises a text once for all probes
        .select("doc_id", words.alias("words"))
        .select("doc_id", *map(runs, lengths))
    )
    places = F.concat(*[_places(n, sorted({s for t in names for s in shingles[t]}), bands[n]) for n, names in sizes.items()])
    windows = texts.select("doc_id", F.inline(places))
    windows = windows.select("doc_id", "size", "first", "window", F.posexplode(_least(F.col("window"), F.col("bands"))).alias("band", "least"))
    known = [
        F.struct(F.lit(t).alias("template"), F.lit(n).alias("size"), F.lit(bands[n]).alias("bands"), _array(shingles[t]).alias("own"))
        for n, names in sizes.items()
        for t in names
    ]
    table = docs.sparkSession.range(1).select(F.inline(F.array(*known)))
    table = table.select("template", "size", "own", F.posexplode(_least(F.col("own"), F.col("bands"))).alias("band", "least"))
    agreeing = windows.join(F.broadcast(table), ["size", "band", "least"])
    share = F.size(F.array_intersect("own", "window")) / F.size("own")
    best = F.max(F.struct(F.col("containment"), (-F.col("first")).alias("before")))
    return (
        agreeing.select("doc_id", "template", "first", share.alias("containment"))
        .where(F.col("containment") >= contained - 1e-9)
        .groupBy("doc_id", "template")
        .agg(best.alias("best"))
        .select("doc_id", "template", "best.containment", (-F.col("best.before")).cast("bigint").alias("first_word"))
    )


def _places(n: int, wanted: list[str], bands: int) -> Column:
    """The windows (size, first, bands, window) for templates of n words that hold a wanted shingle; ``first`` counts from 0."""
    shingles, width = F.col(f"runs{shingle_words(n)}"), window_shingles(n)
    last = F.greatest(F.lit(1), F.size(shingles) - width + 1)
    # the windows go on until one reaches the end of the text
    starts = F.transform(F.sequence(F.lit(0), F.ceil((last - 1) / stride(n)).cast("int")), lambda k: k * stride(n) + 1)
    window = lambda s: F.slice(shingles, s, width)
    held = F.filter(starts, lambda s: F.arrays_overlap(window(s), _array(wanted)))
    rows = F.transform(
        held, lambda s: F.struct(F.lit(n).alias("size"), (s - 1).alias("first"), F.lit(bands).alias("bands"), window(s).alias("window"))
    )
    none = F.array().cast("array<struct<size:int,first:int,bands:int,window:array<string>>>")
    return F.when(F.arrays_overlap(shingles, _array(wanted)), rows).otherwise(none)
