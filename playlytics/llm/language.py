"""Language identification by unigram models of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary (a SentencePiece file that is read, never trained, and whose path is a
parameter). A text is its words, the runs of letters, lower-cased and composed (NFC); a word is the mark of a word's begin and
its letters, and letters that the vocabulary lacks are their UTF-8 bytes, as its byte pieces have it. No piece crosses words, so
the probability of a text is the product over its words of the sum over all segmentations of the word, which a forward
pass computes: alpha(end) = sum over pieces from start to end of alpha(start) * P(piece). ``predict`` takes the language with the
largest product with its share of the learned documents; the score is its posterior probability.

``fit`` estimates the pieces' probabilities by expectation maximisation: ``ROUNDS`` times, forward and backward passes over the counted words of
each language give the expected number of uses of each piece, which with ``PRIOR`` added become its next probability. It
learns from about ``SAMPLE`` documents a language (or all, if fewer), drawn by a hash of the id. Expected numbers are
rounded to 1/``GRAIN`` before they are added, so a rerun under another partitioning gives the same model.

Passes run over the distinct words of a batch of whole texts, all words at once, by the position of a piece in its word; texts never leave
their row. Words go to the shuffle of ``fit`` counted per task. The model, a table of languages by pieces, passes through the driver.

Null texts and texts without a letter are ``und`` with score 0; so is every text if there is no labelled document. Ties go to the
language first by code point. Rows with a null language, or a null id (whose remainder is null), are not learned from; all rows are
scored, repeated ones alike. Clashing column names of the input stay, the new ones get underscores in front. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.llm.common import free_name, materialise, with_text_columns
from playlytics.sources.storage import scratch_scope

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 2_000  # documents a language from which a model is fitted, in expectation
ROUNDS = 4
PRIOR = 0.05  # uses of each piece that are added to the expected number
GRAIN = 1 << 12
CHUNK = 1 << 18  # letters of words handled at a time
UNKNOWN = "und"
_BEGIN = "▁"  # the mark of a word's begin in the vocabulary
_END = "\n"
_BYTE = 0xF0000  # symbols of byte pieces lie in a private plane, where no letter is
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = 0x110000  # code points


def words_of(text: bytes | None) -> list[str]:
    """The words of a text that hold a letter, in order."""
    found = _WORD.findall(unicodedata.normalize("NFC", (text or b"").decode("utf-8", "replace").lower()))
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces that can match lower-case words: those of letters, with or without a begin, and single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = set()
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            pieces.add(chr(_BYTE + int(model.id_to_piece(i)[3:-1], 16)))  # <0x..>
        elif not (model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            letters = piece.removeprefix(_BEGIN)
            if piece == _BEGIN or (piece == piece.lower() and _WORD.fullmatch(letters)):
                pieces.add(piece)
    pieces.add(_BEGIN)
    pieces |= {chr(_BYTE + b) for b in range(256)}
    return sorted(pieces)


@dataclass
class Matches:
    """Pieces between the nodes of words; a node lies before each symbol and after the last one of a word."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    turns: np.ndarray  # matches in order of the place of their start in the word: the end of each place's run
    first: np.ndarray  # the first and last node of each word
    last: np.ndarray
    word: np.ndarray  # the word of each node

    def runs(self) -> Iterator[slice]:
        """Runs of matches that start at one place of their words, in order; within a run no two have the same end."""
        before = 0
        for after in self.turns.tolist():
            yield slice(before, after)
            before = after

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations up to each node; ``weight`` holds one row per match (its pieces' logs)."""
        alpha = np.full((len(self.word), weight.shape[1]), -np.inf)
        alpha[self.first] = 0
        for run in self.runs():
            end = self.end[run]
            alpha[end] = np.logaddexp(alpha[end], alpha[self.start[run]] + weight[run])
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations from each node on."""
        beta = np.full((len(self.word), weight.shape[1]), -np.inf)
        beta[self.last] = 0
        for run in reversed(list(self.runs())):
            # one start per word in a run, and its pieces differ in length: add them up length by length
            length = self.end[run] - self.start[run]
            for size in np.unique(length):
                some = np.flatnonzero(length == size) + run.start
                start = self.start[some]
                beta[start] = np.logaddexp(beta[start], beta[self.end[some]] + weight[some])
        return beta


class Pieces:
    """A vocabulary as a trie, walked from all positions of many words at once."""

    def __init__(self, pieces: Sequence[str]):
        self.pieces = list(pieces)
        alphabet = sorted({p for p in pieces if len(p) == 1})
        self.known = frozenset(alphabet)
        self.step = len(alphabet) + 1  # one more symbol ends a word and is in no piece
        self.symbol = np.zeros(_TABLE, np.int64)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.symbol[ord(_END)] = len(alphabet)
        edges: dict[int, int] = {}
        last = [-1]
        for number, piece in enumerate(pieces):
            if not self.known.issuperset(piece):
                continue  # a letter without a piece of its own is read as bytes
            node = 0
            for c in piece:
                node = edges.setdefault(node * self.step + int(self.symbol[ord(c)]), len(last))
                if node == len(last):
                    last.append(-1)
            last[node] = number
        self.keys = np.array(sorted(edges), np.int64)
        self.below = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.last = np.array(last, np.int64)

    def __reduce__(self):
        return Pieces, (self.pieces,)

    def matches(self, words: Sequence[str]) -> Matches:
        """All pieces at all places of ``words``."""
        text = "".join([f"{_BEGIN}{w}{_END}" for w in words])
        strange = set(text) - self.known - {_END}
        if strange:
            text = text.translate({ord(c): "".join(chr(_BYTE + b) for b in c.encode()) for c in strange})
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = symbols == self.step - 1
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
        word = np.cumsum(ends) - ends
        starts, stops, found = [], [], []
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            key = node * self.step + symbols[at + depth]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[slot] == key
            at, node, depth = at[held], self.below[slot[held]], depth + 1
            piece = self.last[node]
            some = piece >= 0
            starts.append(at[some])
            stops.append(at[some] + depth)
            found.append(piece[some])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops, found))
        place = start - first[word[start]] if len(start) else start
        order = np.argsort(place, kind="stable")
        return Matches(start[order], end[order], piece[order], np.cumsum(np.bincount(place)), first, last, word)


def chunks(words: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs of words of about ``CHUNK`` letters together: first, end."""
    first, size = 0, 0
    for i, word in enumerate(words):
        if size and size + len(word) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(word) + 2
    if first < len(words):
        yield first, len(words)


@dataclass
class Model:
    pieces: Pieces
    languages: Sequence[str]
    prior: np.ndarray  # log share of each language
    logs: np.ndarray  # (piece, language) log probabilities

    def word_logs(self, words: Sequence[str]) -> np.ndarray:
        """(word, language): the log of the probability of each word."""
        out = np.empty((len(words), len(self.languages)))
        for first, end in chunks(words):
            found = self.pieces.matches(words[first:end])
            out[first:end] = found.forward(self.logs[found.piece])[found.last]
        return out

    def predict(self, texts: Sequence[bytes | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its posterior probability."""
        known: dict[str, int] = {}
        places = [[known.setdefault(w, len(known)) for w in words_of(t)] for t in texts]
        logs = self.word_logs(list(known)) if self.languages else None
        languages, scores = [], []
        for place in places:
            if not place or logs is None:
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.prior + logs[place].sum(axis=0)
            best = int(np.argmax(total))
            languages.append(self.languages[best])
            scores.append(round(float(1 / np.exp(total - total[best]).sum()), 6))
        return languages, scores


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score"), text: str = "text") -> DataFrame:
    """Add the language of every whole text and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages by pieces of the vocabulary
    first, second = (free_name(docs, n) for n in names)

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        languages, scores = shared.value.predict(texts)
        return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]

    return with_text_columns(docs, f"`{first}` string, `{second}` double", compute, text)


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, lang) of about ``sample`` documents of each language, or all if fewer, drawn by a hash of the id."""
    labelled = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(sample) / F.count(F.lit(1))).alias("share"))
    share = materialise(share, "languages")  # a row per language
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * (1 << 40)
    return labelled.join(share, "lang").where(drawn).select("text", "lang")


def fit(rows: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Learn a model from rows (text, lang) of bounded number."""
    with scratch_scope(rows.sparkSession):
        rows = materialise(rows, "language-sample")
        shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
        languages = sorted(shares)
        pieces = Pieces(read_pieces(path))
        prior = np.log(np.array([shares[x] for x in languages], np.float64) / max(1, sum(shares.values())))
        model = Model(pieces, languages, prior, np.full((len(pieces.pieces), len(languages)), -np.log(len(pieces.pieces))))
        if languages:
            counted = materialise(_word_counts(rows), "language-words")
            for _ in range(rounds):
                uses = _expected(counted, model) + PRIOR
                model = Model(pieces, languages, prior, np.log(uses / uses.sum(axis=0)))
        return model


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = (batch.column(i).to_pylist() for i in (0, 1))
            counts = Counter((x, w) for t, x in zip(texts, languages, strict=True) for w in words_of(t))
            columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    texts = rows.select(F.col("text").cast("binary"), "lang")
    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counted: DataFrame, model: Model) -> np.ndarray:
    """(piece, language): the expected number of uses under ``model``."""
    shared = counted.sparkSession.sparkContext.broadcast(model)
    size = len(model.pieces.pieces)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(size * len(model.languages))
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            words = batch.column(1).to_pylist()
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            n = batch.column(2).to_numpy()
            for first, end in chunks(words):
                found = model.pieces.matches(words[first:end])
                word = found.word[found.start]
                own = lang[first:end][word]
                weight = model.logs[found.piece, own][:, None]
                alpha, beta = found.forward(weight)[:, 0], found.backward(weight)[:, 0]
                share = np.exp(alpha[found.start] + weight[:, 0] + beta[found.end] - alpha[found.last][word])
                # whole numbers add up alike in any order
                grains = np.rint(share * GRAIN) * n[first:end][word]
                total += np.bincount(found.piece * len(model.languages) + own, grains, len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["cell", "n"])

    sums = counted.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * len(model.languages))
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy() / GRAIN
    return out.reshape(size, -1)
