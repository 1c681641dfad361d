"""Strings: identifiers in URIs, search prompts, display names, hashed text vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from playlytics.config import PROMPT, SEARCH_TASK


def uri_field(uri: Column, index: int = 2, separator: str = ":") -> Column:
    """One field of a URI, NULL when it is missing."""
    return F.get(F.split(uri, separator), index)


def search_prompt(text: Column, task: str = SEARCH_TASK) -> Column:
    before, between = PROMPT
    return F.concat(F.lit(before + task + between), F.translate(text, "|", ""))


def display_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("_", " ").title() for c in df.columns])


class _Slots(dict):
    """The slot of each word met so far, of ``slots``; the empty word has the one after the last."""

    def __init__(self, slots: int):
        self.slots = slots

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.slots if word else self.slots
        self[word] = slot
        return slot


_slots: dict[int, _Slots] = {}  # one of each width in a worker


def hashed_word_counts(texts: Iterable[str | None], width: int) -> np.ndarray:
    """Signed word counts hashed into ``width`` positions, one row per text; a NULL text is a row of NaN.

    The first 8 hexadecimal digits of a word's MD5 choose its position and sign: of the 2 ``width`` slots the
    first half counts for a position, the second half against it.
    """
    slots = _slots.setdefault(2 * width, _Slots(2 * width))
    rows = []
    for text in texts:
        if text is None:
            rows.append(np.full(width, np.nan))
            continue
        words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        counts = np.bincount(np.fromiter(map(slots.__getitem__, words), np.intp, len(words)), minlength=2 * width + 1)
        rows.append((counts[:width] - counts[width : 2 * width]).astype(float))
    return np.array(rows).reshape(-1, width)


def embed_texts(
    df: DataFrame,
    text: str = "text",
    output: str = "embedding",
    width: int = 64,
    embedder: Callable[[list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """Unit vectors of whole texts; a vector without direction, as of a text without words, is all zeros.

    ``embedder`` maps a batch of texts to a matrix and runs in Arrow batches on the executors; without one
    the hashed word counts are used.
    """
    embed = embedder or partial(hashed_word_counts, width=width)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for first in range(0, len(batch), 1024):  # texts can be long
                part = batch.iloc[first : first + 1024]
                vectors = np.asarray(embed(part.tolist()), dtype=float).reshape(len(part), -1)
                norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms != 0)
                yield pd.Series([None if np.isnan(v).any() else v for v in unit], index=part.index)

    return df.withColumn(output, run(F.col(text)))
