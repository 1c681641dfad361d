"""URL filtering by rules and by a weighted vocabulary.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest fitting rule decides
(of rules of equal length the first by code point). A url that no rule fits is judged by its words: an Aho-Corasick automaton finds the
terms in the url (per cent signs decoded, A-Z lower-cased), those between other ASCII letters or digits do not count, and the weights of the
distinct terms add up. A strict term weighs enough to block alone, soft terms only together. The terms are a table of four languages, ``url_terms``.

The automaton is built once in each Python worker from the vocabulary, a parameter. Rows are judged one by one, so
nothing is shuffled. Null urls and urls without ``://`` have an empty host and path, fit no rule, and are judged by their
words; null and empty ones are allowed. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from playlytics.llm.common import with_text_columns
from playlytics.llm.url_terms import TERMS

LIMIT = 1.0
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ENDS = frozenset("/?#")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in _ENDS), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Rules:
    """Rules by host, so that a url meets only those of its host and the domains above."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        fitting = []
        at = 0
        while host and at >= 0:
            fitting += [(rule, v) for begin, rule, v in self.by_host.get(host[at:], ()) if path.startswith(begin)]
            at = host.find(".", at) + 1 or -1
        return min(fitting, key=lambda r: (-len(r[0]), r[0]), default=None)


class Vocabulary:
    def __init__(self, weights: Mapping[str, float], limit: float):
        self.limit = limit
        self.finder = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.finder.add_word(term, (term, weight))
        if weights:
            self.finder.make_automaton()

    def weigh(self, url: str) -> tuple[float, list[str]]:
        """The summed weight of the distinct terms that stand alone in the url, and these terms."""
        found: dict[str, float] = {}
        if len(self.finder):
            text = unquote(url).translate(_LOWER)
            for last, (term, weight) in self.finder.iter(text):
                first = last - len(term) + 1
                if not (first and _inside(text[first - 1])) and not (last + 1 < len(text) and _inside(text[last + 1])):
                    found[term] = weight
        return sum(found.values()), sorted(found)


def _inside(letter: str) -> bool:
    return letter.isascii() and letter.isalnum()


_made: dict[tuple, tuple[Rules, Vocabulary]] = {}


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, float] = TERMS,
    limit: float = LIMIT,
    url: str = "url",
) -> DataFrame:
    """Add host, path, rule (or null), verdict, url_weight and url_terms to every row."""
    key = (tuple(rules), tuple(sorted(vocabulary.items())), limit)

    def compute(urls: list[bytes | None]) -> list[pa.Array]:
        if key not in _made:
            _made[key] = Rules(key[0]), Vocabulary(dict(key[1]), key[2])
        known, words = _made[key]
        rows = []
        for raw in urls:
            text = (raw or b"").decode("utf-8", "replace")
            host, path = split_url(text)
            weight, terms = words.weigh(text)
            rule, verdict = known.find(host, path) or (None, "block" if weight >= limit else "allow")
            rows.append((host, path, rule, verdict, weight, terms))
        kinds = [pa.string()] * 4 + [pa.float64(), pa.list_(pa.string())]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    added = "host string, path string, rule string, verdict string, url_weight double, url_terms array<string>"
    return with_text_columns(pages, added, compute, url)
