import random
from itertools import combinations

import numpy as np
import pytest

from playlytics.llm import jaccard
from playlytics.llm.queries import op3_jaccard_join
from playlytics.llm.words import word_list

SCHEMA = "doc_id bigint, text string"


def shingle_set(text):
    words = word_list((text or "").encode())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Links and class of each row (by position), from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and shared * 10 >= 8 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    classes = {k: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for k in g}
    return links, classes


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for group in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if group % 3 == 0:
            base[2:2] = shared
        for _ in range(rng.choice((1, 1, 2, 6))):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [rows[0]] * 3 + ["", "", None, "one two", "One, two!", "?!", "x " * 5000, "x " * 6000]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_against_all_pairs(spark, rows):
    got = jaccard.similarity_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    links, classes = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(links))
    assert {r["doc_id"]: r["class_id"] for r in got} == classes


def test_small_blocks_and_deep_trees_find_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    got = jaccard.similarity_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    links, classes = brute(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(links))
    assert {r["doc_id"]: r["class_id"] for r in got} == classes


def test_one_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], f"{SCHEMA}, n_links int, near_rows string")
    kept = jaccard.one_per_class(docs.drop("near_rows"))
    assert kept.columns == ["doc_id", "text", "n_links"]
    links, classes = brute(rows)
    want = {i for i, _ in rows if links[i] == 0} | {c for i, c in classes.items() if links[i]}
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text)] * 4 + [(None, text + " end"), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.similarity_classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] == 7) == [(7, 7, 4)] * 4
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None] .count((None, 1)) == 2
    kept = jaccard.one_per_class(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted(
        [(7, text), (0, "a b c d e f g"), (3, ""), (3, ""), (4, "")]
    )


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.similarity_classes(empty).count() == 0
    assert jaccard.one_per_class(empty).count() == 0


def test_exact_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert (jaccard.overlaps(sets[:5], sets[5:]) == want).all()
    assert (jaccard.overlaps(sets, sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_runs_and_agreement():
    assert jaccard.runs_needed(0.8, 0.9999, 2) == 4  # (1/16)^4 < 1e-4 <= (1/16)^3
    assert 30 < jaccard.least_agreement(0.8) < 45


def test_query_against_all_pairs(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    links, classes = brute(rows)
    got = {r["doc_id"]: r for r in op3_jaccard_join(spark, folder).collect()}
    assert {i: (got[i]["n_links"], got[i]["class_id"]) for i, _ in rows} == {i: (links[k], classes[k]) for k, (i, _) in enumerate(rows)}


def test_clashing_names_stay_as_they_are(spark, rows):
    names = ["near_key", "near_maybe", "NEAR_KEPT", "near_id", "near_again", "near_rows", "plane", "plane_bits", "first", "copies"]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows[:30]], SCHEMA + "".join(f", {n} string" for n in names))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    plain = jaccard.one_per_class(docs.select("doc_id", "text"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r[n] == f"{n}{r['doc_id']}" for r in kept.collect() for n in names)


def test_many_copies_do_not_meet_by_text(spark):
    """The decision is taken on one row per text; rows are first combined by text and id."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(3000)] + [(i, text + " end") for i in range(3000, 3010)] + [(0, text)] * 3
    kept = jaccard.one_per_class(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    known = jaccard._linked_texts(spark.createDataFrame(rows, SCHEMA), jaccard.THRESHOLD, jaccard.RECALL).collect()
    assert sorted((r["copy_id"], r["n_copies"], r["first_rows"]) for r in known) == [(0, 3003, 4), (3000, 10, 1)]
