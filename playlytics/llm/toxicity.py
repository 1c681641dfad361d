"""Toxicity from a lexicon that is learned from labelled texts and matched with spelling errors.

``fit`` counts, on at most about ``SAMPLE`` labelled rows less near copies (which share a minimum hash), in how many toxic and other texts each word and
each stem (its first 4 to 10 letters) occurs. A term enters the lexicon where such a surplus of toxic texts is
implausible by chance among all terms of three texts or more (a Chernoff bound), the most surprising terms first. A
stem that is accepted stands for its words, but for those that say clearly more; its weight is its log odds. How many terms may enter by
chance is one of ``LEVELS``, chosen by cross-validation inside the sample: texts are dealt by their hash into ``FOLDS``, the terms of
a fold's texts are weighed by the other folds' counts, and of the levels that let any term in the strictest is taken whose log loss on the
left-out texts is within a standard error of the least. So few labels give a loose lexicon and many a strict one. Where no level lets a term in, every word with
a surplus does.

``Trie.near`` intersects the trie of all terms (of a stem the words of the sample that it stands for) with the Levenshtein automaton of a word: one row of edit
distances is the automaton's state, and a branch ends where every entry exceeds the allowed errors. How far a misspelling
counts is learned, for each variant seen in training and, for unseen ones, for each term.

A match counts less inside quotation marks, on a quoted line (``>``) or near a word of reporting; windows are
``WINDOW`` words wide. A logistic model on the largest and the summed weight and the length of a text turns them into a score.

Null and empty texts get the score of a text without matches. Labels that are null take no part. Without labelled rows the
score is 0.5 everywhere. Repeated and nearly equal rows count once in training, and are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.llm.common import materialise, with_text_columns
from playlytics.llm.jaccard import sketches
from playlytics.sources.storage import scratch_scope

SAMPLE = 20_000  # labelled rows from which a model is fitted, in expectation
STEMS = (4, 5, 6, 7, 8, 9, 10)
LEAST = 3  # texts that a term must occur in to be tested
LEVELS = (0.2, 2.0, 20.0, 200.0)  # expected numbers of terms that enter the lexicon by chance; of tens of thousands, and each rare
FOLDS = 4
COUNTED = 1 << 19  # letters of texts whose terms a worker counts before it hands the counts on
NEAR = 3  # minimum hashes any of which two texts must share to count as near copies
REFINED = 0.7  # log odds by which a longer term must exceed an accepted stem
WINDOW = 8
QUOTED = 0.25  # weight of a match that is quoted or reported
_REPORTED = frozenset("said says called calls quote quoted wrote writes word term".split())
_TOKEN = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
_MARK = re.compile("[\"“”„«»\n]")
_QUOTED_LINE = re.compile(r"[ \t]*>")
_CACHE = 200_000


def allowed_errors(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class _Node:
    __slots__ = ("below", "term", "errors")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.term: str | None = None
        self.errors = 0  # the most that a term from here on allows


class Trie:
    """The lexicon's words, for search with errors."""

    def __init__(self, words: Iterable[str]):
        self.root = _Node()
        self.pieces: dict[tuple[int, str], set[int]] = {}  # by the lengths of words that may hold them
        self.middles: dict[str, set[int]] = {}
        for word in words:
            errors = allowed_errors(len(word))
            path = [self.root]
            for letter in word:
                path.append(path[-1].below.setdefault(letter, _Node()))
            path[-1].term = word
            for node in path:
                node.errors = max(node.errors, errors)
            if errors:
                size = len(word) // (errors + 1)
                lengths = set(range(len(word) - errors, len(word) + errors + 1))
                for piece in ((size, word[:size]), (-size, word[-size:])):
                    self.pieces.setdefault(piece, set()).update(lengths)
                if errors > 1:
                    self.middles.setdefault(word[size : len(word) - size], set()).update(lengths)
        self.sizes = sorted({size for size, _ in self.pieces})

    def may_match(self, word: str) -> bool:
        """With k errors one of k + 1 pieces of a term is left whole: at the word's start, its end or inside."""
        for size in self.sizes:
            lengths = self.pieces.get((size, word[:size] if size > 0 else word[size:]))
            if lengths and len(word) in lengths:
                return True
        return any(len(word) in lengths and m in word for m, lengths in self.middles.items())

    def near(self, word: str) -> tuple[str, int] | None:
        """The closest term within its allowed errors, and the number of errors; ties go to the first by code point."""
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            term = node.term
            if term is not None and row[-1] <= allowed_errors(len(term)) and (best is None or (row[-1], term) < best):
                best = (row[-1], term)
            for letter, below in node.below.items():
                nxt = [row[0] + 1]
                for i, seen in enumerate(word):
                    nxt.append(min(nxt[i] + 1, row[i + 1] + 1, row[i] + (seen != letter)))
                if min(nxt) <= below.errors:
                    stack.append((below, nxt))
        return (best[1], best[0]) if best else None


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)  # misspellings seen in training
    unseen: dict[str, float] = field(default_factory=dict)  # by term: weight of other misspellings
    inflected: dict[str, float] = field(default_factory=dict)  # words of the sample under stems: the most a misspelling weighs

    def __post_init__(self):
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.trie = Trie(self.words.keys() | self.inflected.keys())

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "stems", "variants", "unseen", "inflected")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def any(self) -> bool:
        return bool(self.words or self.stems)

    def stem(self, word: str) -> str | None:
        """The longest stem that the word begins with."""
        return next((word[:k] for k in self.sizes if word[:k] in self.stems), None)

    def misspelled(self, word: str) -> tuple[str, int] | None:
        return self.trie.near(word) if len(word) > 3 and self.trie.may_match(word) else None

    def weight(self, word: str) -> float:
        """Evidence of one lower-case word, 0 if it is not like any term."""
        known = _known_by(self)
        found = known.get(word)
        if found is None:
            if len(known) >= _CACHE:
                known.clear()
            found = known[word] = self._weight(word)
        return found

    def _weight(self, word: str) -> float:
        exact = self.words.get(word)
        if exact is not None:
            return exact
        stem = self.stem(word)
        if stem is not None:
            return self.stems[stem]
        if word in self.variants:
            return self.variants[word]
        near = self.misspelled(word)
        return self.unseen.get(near[0], 0.0) / near[1] if near else 0.0

    def features(self, text: str) -> tuple[float, float, float]:
        """The largest weight of a match, the sum of all, each by its context, and the number of words."""
        tokens = _TOKEN.findall(text.lower())
        hits = {w: x for w in set(tokens) if (x := self.weight(w)) > 0}
        if not hits:
            return 0.0, 0.0, float(len(tokens))
        largest = total = 0.0
        places = [(m.start(), m.group().lower()) for m in _TOKEN.finditer(text)]
        words = [w for _, w in places]
        marks = [m.start() for m in _MARK.finditer(text)]
        passed, inside, line = 0, False, 0
        for i, (at, word) in enumerate(places):
            weight = hits.get(word)
            if not weight:
                continue
            while passed < len(marks) and marks[passed] < at:  # quotation marks open and close in turn, within a line
                inside = not inside and text[marks[passed]] != "\n"
                line = marks[passed] + 1 if text[marks[passed]] == "\n" else line
                passed += 1
            end, last = places[min(len(places) - 1, i + WINDOW)]
            closes = passed < len(marks) and text[marks[passed]] != "\n" and marks[passed] <= end + len(last)
            if (inside and closes) or _QUOTED_LINE.match(text, line) or _REPORTED.intersection(words[max(0, i - WINDOW) : i]):
                weight *= QUOTED
            largest = max(largest, weight)
            total += weight
        return largest, total, float(len(tokens))


_last: list = [None, {}]


def _known_by(lexicon: Lexicon) -> dict[str, float]:
    """The weights found so far: one table in each worker, for the lexicon used last, so that models do not pile up."""
    if _last[0] is not lexicon:
        _last[:] = [lexicon, {}]
    return _last[1]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: Sequence[float]  # constant, largest, log of the sum, log of the words

    def score(self, text: str | None) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, design(*self.lexicon.features(text or "")), strict=True))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def design(largest: float, total: float, words: float) -> tuple[float, float, float, float]:
    return 1.0, min(largest, 8.0) / 4, math.log1p(total) / 2, math.log1p(words) / 4 if total else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled documents, or all if fewer, drawn by a hash of the id."""
    rated = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").distinct()
    n = rated.count()
    if n > sample:
        share = F.lit(sample / n)
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * (1 << 40))
    # bounded by the sample; the documents stay where they are
    return docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int"))


def fit(rows: DataFrame) -> Model:
    """Learn a model from rows (text, toxic) of bounded number."""
    with scratch_scope(rows.sparkSession):
        return _fit(rows)


def _fit(rows: DataFrame) -> Model:
    names = [f"near{k}" for k in range(NEAR)]
    rows = with_text_columns(rows.select("text", "toxic"), ", ".join(f"{n} int" for n in names), _near_keys)
    for name in names:  # of the texts that share a hash the first, in every rerun
        rows = rows.groupBy(name, "toxic").agg(F.min(F.struct("text", *names)).alias("kept")).select("kept.*", "toxic")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    rows = materialise(rows.select("text", "toxic", fold.alias("fold")), "toxicity-sample")
    sizes = [[0, 0] for _ in range(FOLDS)]  # texts that are not toxic and that are, by fold
    for r in rows.groupBy("fold", F.expr("toxic <=> 1").cast("int").alias("toxic")).count().collect():
        sizes[r["fold"]][r["toxic"]] = r["count"]
    n, n_toxic = sum(map(sum, sizes)), sum(x[1] for x in sizes)
    if not n_toxic or n_toxic == n:
        rate = 0.5 if not n else (n_toxic + 0.5) / (n + 1)
        return Model(Lexicon(), (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    by_fold = materialise(_term_counts(rows), "toxicity-terms")
    splits = _splits(by_fold, sizes)
    lexicon = _lexicon(splits[-1], _level(rows, splits) if len(splits) > 1 else max(LEVELS))
    if not lexicon.any():
        lexicon = _lexicon(_surpluses(by_fold, n, n_toxic, None, 1), math.inf)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y).alias(c)
    counted = by_fold.select("term", total("toxic"), total("other"))
    lexicon = _with_inflected(lexicon, counted, n, n_toxic)
    _learn_variants(lexicon, counted, n, n_toxic)
    return Model(lexicon, _logistic(_features(rows, lexicon)))


def _near_keys(texts: list[bytes | None]) -> list[pa.Array]:
    """Minimum hashes of the shingles: a near copy shares each with a chance of its similarity, other texts hardly ever."""
    found = np.array([np.frombuffer(k, np.int32)[:NEAR] if k else np.zeros(NEAR, np.int32) for k in sketches(texts)], np.int32)
    return [pa.array(column) for column in found.reshape(-1, NEAR).T]


def terms_of(text: str) -> set[str]:
    """The words of a text and their stems, which end in ``*``."""
    words = set(_TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic texts, other texts), both by fold."""

    def flush(by: list[Counter]) -> pa.RecordBatch:
        terms = list(set().union(*by))
        counts = [pa.array([c[t] for t in terms], pa.int64()) for c in by]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", *cells])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, letters = [Counter() for _ in range(2 * FOLDS)], 0
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by[2 * fold + (toxic == 1)].update(terms_of(text))
                letters += len(text)
                if letters > COUNTED:  # a text has some times as many terms as words, which must not pile up
                    yield flush(by)
                    by, letters = [Counter() for _ in range(2 * FOLDS)], 0
        yield flush(by)

    cells = [f"{name}{k}" for k in range(FOLDS) for name in ("other", "toxic")]
    parts = rows.select("text", "toxic", "fold").mapInArrow(count, "term string, " + ", ".join(f"{c} bigint" for c in cells))
    summed = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in cells])
    return summed.select("term", *[F.array(*[f"{name}{k}" for k in range(FOLDS)]).alias(name) for name in ("toxic", "other")])


@dataclass
class Split:
    """The terms of some texts that pass the loosest level, each with its toxic and other texts, by surplus."""

    terms: list[tuple[str, int, int, float]]
    tested: int
    n: int
    n_toxic: int


def _splits(by_fold: DataFrame, sizes: Sequence[Sequence[int]]) -> list[Split]:
    """One without each fold whose labels can be judged by the others, and last the one of all texts."""
    out = []
    n, n_toxic = sum(map(sum, sizes)), sum(x[1] for x in sizes)
    if all(0 < n_toxic - x[1] < n - sum(x) for x in sizes):
        out = [_surpluses(by_fold, n - sum(x), n_toxic - x[1], k) for k, x in enumerate(sizes)]
    return [*out, _surpluses(by_fold, n, n_toxic, None)]


def _surpluses(by_fold: DataFrame, n: int, n_toxic: int, without: int | None, least: int = LEAST) -> Split:
    def number(column):
        return sum((F.get(column, F.lit(k)) for k in range(FOLDS) if k != without), F.lit(0)).alias(column)

    counted = by_fold.select("term", number("toxic"), number("other")).where(F.col("toxic") + F.col("other") >= least)
    base, seen = n_toxic / n, F.col("toxic") + F.col("other")
    share = F.least(F.col("toxic") / seen, F.lit(1 - 1e-9))
    surplus = seen * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    tested = counted.count()
    limit = math.log(max(1, tested) / max(LEVELS)) if least == LEAST else -1.0
    # each term is in several of the at most SAMPLE toxic texts, so the lexicon is bounded
    found = counted.withColumn("surplus", surplus).where((F.col("surplus") > limit) & (F.col("toxic") > base * seen))
    order = lambda r: (-r["surplus"], r["term"].endswith("*"), r["term"])
    terms = [(r["term"], r["toxic"], r["other"], r["surplus"]) for r in sorted(found.collect(), key=order)]
    return Split(terms, tested, n, n_toxic)


def _level(rows: DataFrame, splits: Sequence[Split]) -> float:
    """The strictest level as good as the best on the texts of each fold, by terms that the other folds weigh."""
    texts = _texts_with_terms(rows, {t[0] for s in splits for t in s.terms})
    losses = {}
    for level in LEVELS:
        if _lexicon(splits[-1], level).any():
            lexicons = [_lexicon(s, level) for s in splits[:-1]]
            losses[level] = np.concatenate([_losses(lexicon, k, texts) for k, lexicon in enumerate(lexicons)])
    if not losses:
        return max(LEVELS)
    best = min(losses, key=lambda x: (round(losses[x].sum(), 6), x))

    def as_good(level: float) -> bool:
        worse = losses[level] - losses[best]
        return worse.sum() <= math.sqrt(len(worse)) * worse.std() + 1e-6

    return min(filter(as_good, losses))


def _texts_with_terms(rows: DataFrame, wanted: set[str]) -> list[tuple[int, int, float, list[str]]]:
    """(fold, toxic, words, wanted terms) of each text of the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [sorted(wanted & terms_of(t)) for t in texts]
            words = pa.array([float(len(_TOKEN.findall(t.lower()))) for t in texts], pa.float64())
            columns = [batch.column(2), batch.column(1), words, pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "toxic", "words", "terms"])

    found = rows.select("text", "toxic", "fold").mapInArrow(run, "fold int, toxic int, words double, terms array<string>")
    return sorted((r["fold"], int(r["toxic"] == 1), r["words"], r["terms"]) for r in found.collect())


def _losses(lexicon: Lexicon, fold: int, texts: Sequence[tuple[int, int, float, list[str]]]) -> np.ndarray:
    """Log loss of each text of ``fold`` by a model fitted on the others; each term counts once a text."""
    terms = {**lexicon.words, **{f"{s}*": w for s, w in lexicon.stems.items()}}
    weights = [[terms[t] for t in row[3] if t in terms] for row in texts]
    cells = np.array([(max(w, default=0.0), sum(w), r[2], r[1], 1.0) for w, r in zip(weights, texts, strict=True)])
    own = np.array([r[0] == fold for r in texts])
    if own.all() or not own.any():
        return np.zeros(int(own.sum()))
    z = np.array([design(*cell) for cell in cells[own, :3]]) @ np.array(_logistic(cells[~own]))
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)
    y = cells[own, 3]
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def log_odds(toxic: int, other: int, n: int, n_toxic: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n - n_toxic + 1))


def _lexicon(split: Split, level: float) -> Lexicon:
    """The terms that pass ``level``: of a family of words the stem, or the words that say more than their stem."""
    limit = math.log(max(1, split.tested) / level) if level < math.inf else -1.0
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    heads: set[str] = set()  # beginnings of accepted terms
    for name, toxic, other, surplus in split.terms:
        term, odds = name.rstrip("*"), log_odds(toxic, other, split.n, split.n_toxic)
        inside = [stems[term[:k]] for k in STEMS if term[:k] in stems]
        if (
            surplus <= limit
            or (name.endswith("*") and term in heads)
            or (inside and odds < max(inside) + REFINED)
            or odds <= 0
        ):
            continue
        (stems if name.endswith("*") else words)[term] = odds
        heads |= {term[:k] for k in STEMS}
    return Lexicon(words, stems)


def _with_inflected(lexicon: Lexicon, counted: DataFrame, n: int, n_toxic: int) -> Lexicon:
    """The lexicon with the words that its stems stand for, so that their misspellings are found as well."""
    if not lexicon.stems:
        return lexicon
    heads = [F.substring("term", 1, k).isin([s for s in lexicon.stems if len(s) == k]) for k in lexicon.sizes]
    # words of the sample that begin like a term of a bounded lexicon: bounded as well
    found = counted.where(~F.col("term").endswith("*")).where(reduce(or_, heads)).collect()
    inflected = {}
    for r in found:
        if r["term"] not in lexicon.words:
            # a misspelling counts as its stem does, as far as the word's own texts bear it out
            inflected[r["term"]] = min(lexicon.stems[lexicon.stem(r["term"])], log_odds(r["toxic"] + 2, r["other"], n, n_toxic))
    return Lexicon(lexicon.words, lexicon.stems, inflected=inflected)


def _learn_variants(lexicon: Lexicon, counted: DataFrame, n: int, n_toxic: int) -> None:
    """Weights of misspellings: of a variant by its own counts with those of its term's variants as prior."""

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                word = row["term"]
                if word not in lexicon.words and not word.endswith("*") and not lexicon.stem(word):
                    near = lexicon.misspelled(word)
                    if near:
                        rows.append({**row, "near": near[0], "errors": near[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64()), ("near", pa.string()), ("errors", pa.int64())])
    # words within two errors of a bounded lexicon: bounded as well
    found = counted.mapInArrow(match, "term string, toxic bigint, other bigint, near string, errors bigint").collect()
    pooled: dict[str, list[int]] = {}
    for r in found:
        sums = pooled.setdefault(r["near"], [0, 0])
        sums[0] += r["toxic"]
        sums[1] += r["other"]
    for term, weight in {**lexicon.inflected, **lexicon.words}.items():
        toxic, other = pooled.get(term, (0, 0))
        # two toxic texts of prior belief: a misspelling means the term until clean texts speak against it
        odds = min(weight, log_odds(toxic + 2, other, n, n_toxic))
        lexicon.unseen[term] = odds if odds > 1 else 0.0
    for r in found:
        if r["other"]:
            lexicon.variants[r["term"]] = max(0.0, min(lexicon.unseen[r["near"]], log_odds(r["toxic"], r["other"], n, n_toxic)))
            if r["toxic"] < 4 * r["other"]:
                lexicon.variants[r["term"]] = 0.0


def _features(rows: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Counted cells (largest, sum, words, label, rows) of the sample."""

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        found = [lexicon.features((t or b"").decode()) for t in texts]
        return [pa.array([x[k] for x in found], pa.float64()) for k in range(3)]

    found = with_text_columns(rows, "largest double, total double, words double", compute)
    cell = [F.round("largest", 1).alias("a"), F.round(F.log1p("total"), 1).alias("b"), F.round(F.log1p("words"), 0).alias("c")]
    grouped = found.groupBy(*cell, "toxic").count().orderBy("a", "b", "c", "toxic")
    return np.array([(r["a"], math.expm1(r["b"]), math.expm1(r["c"]), r["toxic"], r["count"]) for r in grouped.collect()])


def _logistic(cells: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Newton's method on the counted cells, sorted, so that reruns agree. More evidence never lowers a score."""
    x = np.array([design(*cell) for cell in cells[:, :3]])
    y, weight = cells[:, 3], cells[:, 4]
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + ridge * w
            curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(curvature[np.ix_(free, free)], gradient[free])
            w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:3] >= 0).all():
            return tuple(float(v) for v in w)
        free[1 + int(np.argmin(w[1:3]))] = False  # leave out what would count against


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """Add the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded with the lexicon

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([shared.value.score((t or b"").decode()) for t in texts], pa.float64())]

    return with_text_columns(docs, f"{name} double", compute, text)
