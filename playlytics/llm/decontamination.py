"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are those of ``words.py``. A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. The automaton accepts every run of words of every item. A document's words are streamed
through it, which gives at each word the longest run of item words that ends there; where it reaches the window's
length (or a short item ends), the window's words are hit. Long stretches that hold no run of a few item words
cannot reach a window; they are found by hashes and skipped, so the automaton reads only what may match.

The benchmark is cut into parts of at most ``PART_WORDS`` words (or one item) by a hash of the text. Each part is
a broadcast of bounded size and one narrow pass over the rows, and no document moves. ``PASS_PARTS`` passes are in one stage; after them the
rows and their hits are written and the broadcasts given up, so a benchmark of any size takes bounded memory, and a rewrite of the
documents for each 200,000 of its words beyond the first.

Null and empty texts have no words and no hits. Items without words take no part; equal item ids count once; a null
item id counts as the empty id. Repeated rows are judged one by one. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from playlytics.llm.common import materialise, with_text_columns
from playlytics.llm.words import _WORD, hash_words, hashed_texts, mix, word_list

WINDOW = 10
PART_WORDS = 100_000  # words of the items in one automaton
PASS_PARTS = 2  # automata that a pass over the documents uses, one after the other, each in a Python worker of its own
MAX_COVERAGE = 0.5  # documents with a larger share of hit words are dropped whole
_PROBE = 4  # words hashed to find stretches that may match
_TABLE_BITS = 20

SPAN = "array<struct<first:int,last:int>>"


@dataclass
class SuffixAutomaton:
    """All runs of words of the items of one part, with the items in which each run occurs."""

    window: int
    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[int]] = field(default_factory=lambda: [set()])
    short: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (words, item) of whole short items

    @classmethod
    def of(cls, items: Sequence[list[bytes]], window: int) -> SuffixAutomaton:
        made = cls(window)
        for item in items:
            last = 0
            for word in item:
                last = made._extend(last, word)
        for number, item in enumerate(items):
            made._mark(number, item)
        return made

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.short.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for the shorter runs that ``state`` and its suffixes reach by ``word``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:  # the run occurs in an earlier item
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            exact = self.length[target] == self.length[last] + 1
            self.link[new] = target if exact else self._split(last, word, target)
        return new

    def _mark(self, number: int, item: list[bytes]) -> None:
        """Note the item at the states of its windows."""
        size = min(self.window, len(item))
        for end, (state, matched) in enumerate(self.stream(item)):
            if end + 1 >= size and matched >= size:
                at = self.suffix(state, size)
                if len(item) < self.window:
                    if end + 1 == len(item):
                        self.short[at].add((size, number))
                else:
                    self.items[at].add(number)

    def suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a longer match at ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stream(self, words: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest item run that ends here."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            target = self.next[state].get(word)
            if target is None:
                state = matched = 0
            else:
                state, matched = target, matched + 1
            yield state, matched

    def hits(self, words: Sequence[bytes], offset: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Add the windows in ``words`` (which begin at word ``offset`` of the document) to ``spans`` and ``found``."""
        has_short = any(self.short)
        for end, (state, matched) in enumerate(self.stream(words)):
            if matched >= self.window:
                at = self.suffix(state, self.window)
                if self.items[at]:
                    found |= self.items[at]
                    spans.append((offset + end + 1 - self.window, offset + end))
            while has_short and state:
                for size, item in self.short[state]:
                    if size <= matched:
                        found.add(item)
                        spans.append((offset + end + 1 - size, offset + end))
                state = self.link[state]
                matched = min(matched, self.length[state])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word ranges, as ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


class Part:
    """The automaton of some items and the table of hashed probes that finds where it may match."""

    def __init__(self, rows: Sequence[tuple[str, bytes]], window: int):
        items = [(name, words) for name, text in rows if (words := word_list(text))]
        self.names = [name for name, _ in items]
        self.least = min((min(window, len(words)) for _, words in items), default=0)
        self.automaton = SuffixAutomaton.of([words for _, words in items], window)
        self.probe = min(_PROBE, self.least)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        for _, words in items:
            hashes, _ = hash_words(b" ".join(words))
            self.seen[self._slots(hashes)] = True

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.probe + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(self.probe):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
        return mix(total) >> np.uint64(64 - _TABLE_BITS)

    def scan(self, texts: Sequence[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, merged spans of hit words and the items found."""
        for first, end, hashes, counts in hashed_texts(texts):
            may = self._may_match(hashes) if self.least else np.zeros(0, np.int64)
            starts = np.cumsum(counts) - counts
            owner = np.searchsorted(starts, may[:, 0], side="right") - 1 if len(may) else may
            stretches: dict[int, list[tuple[int, int]]] = {}
            for text, (a, b) in zip(owner, may, strict=True):
                while a < b:  # a stretch may run on into the following texts
                    while a >= starts[text] + counts[text]:
                        text += 1
                    stop = min(b, int(starts[text] + counts[text]))
                    if stop - a >= self.least:
                        stretches.setdefault(int(text), []).append((int(a - starts[text]), int(stop - starts[text])))
                    a = stop
            for i in range(end - first):
                spans: list[tuple[int, int]] = []
                found: set[int] = set()
                if i in stretches:
                    words = word_list(texts[first + i])
                    for a, b in stretches[i]:
                        self.automaton.hits(words[a:b], a, spans, found)
                yield int(counts[i]), merged(spans), {self.names[k] for k in found}

    def _may_match(self, hashes: np.ndarray) -> np.ndarray:
        """Ranges (first word, end) of words all of whose probes are in the table."""
        known = np.zeros(max(len(hashes) - self.probe + 1, 0) + 2, np.int8)
        known[1:-1] = self.seen[self._slots(hashes)]
        turns = np.flatnonzero(np.diff(known))
        ranges = np.stack([turns[::2], turns[1::2] + self.probe - 1], axis=1)
        return ranges[ranges[:, 1] - ranges[:, 0] >= self.least]


def cut(text: bytes, spans: Sequence[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    pairs = zip(texts, spans, strict=True)
    return pd.Series([None if t is None else cut(t.encode(), [(x["first"], x["last"]) for x in s]) for t, s in pairs], dtype=object)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, text: str = "text"
) -> DataFrame:
    """Add ``bm_words`` (number of words), ``bm_spans`` (merged ranges of hit words) and ``bm_items`` (ids as strings)."""
    items = materialise(
        benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
        ),
        "benchmark",
    )
    # a word takes two bytes at least, with its gap
    words = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(words / 2 / part_words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    live: list[Broadcast] = []
    for k in range(parts):
        if len(live) == PASS_PARTS:  # the hits so far are written, and their automata given up
            docs = materialise(docs, "hits")
            for rows in live:
                rows.destroy()
            live = []
        rows = [(r["item"], bytes(r["text"])) for r in items.where(part == k).collect()]
        live.append(docs.sparkSession.sparkContext.broadcast(rows))
        docs = _find_part(docs, live[-1], window, text, first=k == 0)
    return docs


_parts: dict[int, Part] = {}


def _part(rows, window: int) -> Part:
    """The part, built once in each Python worker."""
    key = hash((window, tuple(rows.value)))
    if key not in _parts:
        if len(_parts) > 1:
            _parts.clear()
        _parts[key] = Part(rows.value, window)
    return _parts[key]


def _find_part(docs: DataFrame, rows, window: int, text: str, first: bool) -> DataFrame:
    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        n, spans, items = [], [], []
        for words, ranges, found in _part(rows, window).scan([t or b"" for t in texts]):
            n.append(words)
            spans.append([{"first": a, "last": b} for a, b in ranges])
            items.append(sorted(found))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

    if first:
        return with_text_columns(docs, f"bm_words bigint, bm_spans {SPAN}, bm_items array<string>", compute, text)
    more = with_text_columns(docs, f"bm_words2 bigint, bm_spans2 {SPAN}, bm_items2 array<string>", compute, text)
    return more.withColumns(
        {"bm_spans": merged_column(F.concat("bm_spans", "bm_spans2")), "bm_items": F.array_union("bm_items", "bm_items2")}
    ).drop("bm_words2", "bm_spans2", "bm_items2")


def merged_column(spans: Column) -> Column:
    """Merge overlapping and touching ranges of an array column."""
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(
                F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                )
            ),
        ),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), step)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text: str = "text"
) -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut out; documents hit beyond ``max_coverage`` are dropped.

    Documents without a hit stay as they are. ``n_chars``, if there is one, follows a cut text.
    """
    found = find_benchmark(docs, benchmark, window, text=text)
    covered = hit_words(F.col("bm_spans"))
    kept = found.where((F.size("bm_spans") == 0) | (covered <= max_coverage * F.col("bm_words")))

    hit = F.size("bm_spans") > 0
    shorter = without(F.when(hit, F.col(text)), F.when(hit, F.col("bm_spans")))  # other texts are not sent to Python
    kept = kept.withColumn(text, F.when(hit, shorter).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(hit, length).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)
