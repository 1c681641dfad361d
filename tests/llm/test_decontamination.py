import hashlib
import random

import pytest

from playlytics.llm import decontamination
from playlytics.llm.queries import op9_decontamination
from playlytics.llm.words import word_list

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(texts, items, window=10):
    """Number of words, hit positions and items found of each text."""
    windows = {}
    for name, text in items:
        words = word_list((text or "").encode())
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words = word_list((text or "").encode())
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((len(words), hit, found))
    return out


def cases(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)] + ["Aé", "ß9"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice((3, 9, 10, 11, 30))))) for i in range(25)]
    items += [(5, items[5][1]), (40, ""), (41, None), (None, " ".join(some(12))), (42, "?!")]
    items.append((43, items[3][1] + " " + " ".join(some(15))))
    texts = []
    for _ in range(120):
        words = some(rng.randint(0, 60))
        if rng.random() < 0.6:
            passage = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, max(0, len(passage) - 9))
            at = rng.randint(0, len(words))
            words[at:at] = passage[cut : cut + rng.randint(5, 30)]
        texts.append(rng.choice((" ", ", ", "\n")).join(words))
    return items, [*texts, "", None, "v1 " * 30_000, texts[0], texts[0].upper()]


@pytest.mark.parametrize("part_words, pass_parts", [(100_000, 2), (60, 2), (60, 1), (25, 3)])
def test_against_brute_force(spark, monkeypatch, part_words, pass_parts):
    monkeypatch.setattr(decontamination, "PASS_PARTS", pass_parts)
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r for r in decontamination.find_benchmark(docs, spark.createDataFrame(items, ITEMS), part_words=part_words).collect()}
    for k, (words, hit, found) in enumerate(brute(texts, items)):
        spans = {i for s in got[k]["bm_spans"] for i in range(s["first"], s["last"] + 1)}
        assert (got[k]["bm_words"], spans, set(got[k]["bm_items"])) == (words, hit, found)


def test_long_items_only(spark):
    items, texts = cases(9)
    items = [x for x in items if len((x[1] or "").split()) >= 10]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = decontamination.find_benchmark(docs, spark.createDataFrame(items, ITEMS)).collect()
    want = brute(texts, items)
    assert any(hit for _, hit, _ in want)
    for r in got:
        assert {i for s in r["bm_spans"] for i in range(s["first"], s["last"] + 1)} == want[r["doc_id"]][1]


def test_spans_are_cut_and_covered_texts_dropped(spark):
    item = " ".join(f"q{i}" for i in range(15))
    clean = " ".join(f"c{i}" for i in range(40))
    docs = [(1, f"{clean}. {item}! {clean}", 0, "x"), (2, item, 1, "x"), (3, clean, 2, "y"), (4, None, 3, None), (5, "", None, "z")]
    frame = spark.createDataFrame(docs, f"{DOCS}, n_chars bigint, bm_note string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(frame, spark.createDataFrame([(1, item)], ITEMS)).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1]["text"] == f"{clean}. ! {clean}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == clean and got[3]["n_chars"] == 2 and got[4]["text"] is None


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    (row,) = decontamination.find_benchmark(docs, none).collect()
    assert (row["bm_words"], row["bm_spans"], row["bm_items"]) == (2, [], [])
    assert decontamination.decontaminate(docs.limit(0), none).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 2)], f"{DOCS}, BM_WORDS int")
    with pytest.raises(ValueError):
        decontamination.find_benchmark(docs, spark.createDataFrame([], ITEMS))


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute([r["text"] for r in docs], items)
    got = {r["doc_id"]: r for r in op9_decontamination(spark, folder).collect()}
    for r, (words, hit, found) in zip(docs, want, strict=True):
        row = got[r["doc_id"]]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (words, len(hit), len(found), digest)
        assert row["contaminated"] == bool(hit)
