import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlytics.llm import neighbours
from playlytics.llm.queries import op6_neighbours

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, queries, k=10):
    out = {}
    for q, v in rows:
        if q in queries:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
            out[q] = near[:k]
    return out


def test_hadamard_and_rotation():
    size = 8
    full = np.array([[(-1) ** bin(i & j).count("1") for j in range(size)] for i in range(size)]) / math.sqrt(size)
    x = np.random.default_rng(1).normal(size=(5, size))
    assert np.allclose(neighbours.hadamard(x), x @ full)
    turned = neighbours.rotate(x, neighbours.signs(size, 1, 1)[0, 0])
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))


def test_codes_name_the_nearest_axes():
    x = np.random.default_rng(2).normal(size=(20, 6))
    found = neighbours.codes(x, 3, 1, 4)
    unit = np.zeros((20, 8))
    unit[:, :6] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for t in range(3):
        turned = neighbours.rotate(unit, neighbours.signs(8, 3, 1)[t, 0])
        both = np.concatenate([turned, -turned], axis=1)
        assert np.allclose(np.take_along_axis(both, found[:, t], axis=1), -np.sort(-both, axis=1)[:, :4])
    two = neighbours.codes(x, 1, 2, 3)
    assert two.max() < 16 * 16 and (two[:, :, 0] != two[:, :, 1]).all()


def vectors(n=400, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(size=12) + 2 * (i % 4))]) for i in range(n)]


@pytest.mark.parametrize("block, query_block", [(4096, 512), (40, 3)])
def test_recall_and_exact_scores(spark, monkeypatch, block, query_block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", query_block)
    rows = vectors()
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0).collect()
    want = brute(rows, {i for i, _ in rows if i % 10 == 0})
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["id"]))
    assert set(found) == set(want) and all(len(v) == 10 and v == sorted(v) for v in found.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    by_id = dict(rows)
    for q, near in found.items():
        for score, i in near:
            assert score == pytest.approx(math.dist(by_id[q], by_id[i]), rel=1e-14)


def test_few_candidates_are_completed(spark):
    rows = vectors(60)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, tables=1, probes=1).collect()
    assert len(got) == 6 * 10
    few = neighbours.nearest(spark.createDataFrame(rows[:4], SCHEMA), F.col("id") == 0).collect()
    assert [(r["id"], r["rank"]) for r in few] == [(i, k + 1) for k, (_, i) in enumerate(brute(rows[:4], {0})[0])]


def test_odd_vectors(spark):
    v = [1.0, 2.0, 2.0]
    rows = [(0, v), (1, v), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0])]
    rows += [(7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (9, [1e30, 1e30, 1e-30]), (None, [2.0, 4.0, 4.0]), (0, [3.0, 3.0, 3.0]), (10, v)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 0, None, 9]
    assert [round(r["score"], 6) for r in got[:4]] == [0, 0, round(math.sqrt(6), 6), 3.0]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("id") == 1).count() == 0


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = {}
    for r in op6_neighbours(spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        far[k] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits, total = hits + len(want & found[int(ids[k])]), total + 10
    assert hits >= 0.95 * total


def test_recall_does_not_fall_with_the_number_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: 10**9)  # as if the table were large
    test_query_recall(spark)


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (0, [1.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0, k=2).collect()
    found = sorted((r["rank"], r["id"], round(r["score"], 6)) for r in got)
    assert {r["query_id"] for r in got} == {0}
    assert found == [(1, 1, 0.141421), (1, 2, 0.223607), (2, 1, 1.272792), (2, 2, 1.204159)]
    same = neighbours.nearest(spark.createDataFrame(rows[:2], SCHEMA), F.col("id") == 0).collect()
    assert [(r["rank"], r["id"], round(r["score"], 6)) for r in same] == [(1, 0, 1.414214)] * 2
