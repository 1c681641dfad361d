import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as arrays

from playlytics.llm import centroids, integers, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, cluster string, v int"
ODD = [None, [], [1.0], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]


def rows(n=300, width=4, seed=1, odd=True):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        vector = [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(middles)]
        out.append((i, vector, rng.choice([None, 1, 2]), "k", "c", 1))
    out += [out[5], out[5], (None, out[7][1], None, None, None, None), (9, out[8][1], 2, "", "", 0)]
    if odd:
        out += [(1000 + i, v, 1, "k", "c", 1) for i, v in enumerate(ODD)]
    return out


def usable(data, width):
    ok = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    return [r for r in data if ok(r[1])]


def ints(vector, scale):
    return [math.floor(scale * x) for x in vector]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, entries):
    return min((square(v, c), i) for i, c in enumerate(entries))


def moved(members, entries):
    out = []
    for i, old in enumerate(entries):
        own = [v for v, k in members if k == i]
        out.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else old)
    return out


def brute_centroids(data, n, rounds, scale, width, salt):
    data = [(r[0], ints(r[1], scale)) for r in usable(data, width)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    found = [v for _, v in sorted(data, key=place)[:n]]
    for _ in range(rounds):
        found = moved([(v, nearest(v, found)[1]) for _, v in data], found)
    best = [(i, *nearest(v, found)) for i, v in data]
    inertia = [sum(d for _, d, c in best if c == k) for k in range(len(found))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return [(i, c, d, inertia[c], sum(inertia), found[c], sha[c]) for i, d, c in best]


@pytest.mark.parametrize("n, rounds, scale", [(5, 3, 64), (16, 4, 8), (1, 2, 64), (500, 1, 64)])
def test_clusters_against_a_full_search(spark, n, rounds, scale):
    data = rows()
    got = centroids.cluster(spark.createDataFrame(data, SCHEMA).repartition(5), n=n, rounds=rounds, scale=scale, width=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    want = brute_centroids(data, n, rounds, scale, 4, "1:")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def brute_codes(data, entries, rounds, scale, parts, width):
    data = sorted(usable(data, width), key=lambda r: (r[0] is None, r[0] or 0, ints(r[1], scale)))
    size = width // parts
    cut = [[ints(r[1], scale)[p * size : (p + 1) * size] for p in range(parts)] for r in data]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        books = [moved([(c[p], nearest(c[p], books[p])[1]) for c in cut], books[p]) for p in range(parts)]
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    by_label = lambda label: sum(e for r, e in zip(data, error, strict=True) if r[2] == label)
    out = [(r[0], [i for _, i in b], e, by_label(r[2])) for r, b, e in zip(data, best, error, strict=True)]
    return out, books


@pytest.mark.parametrize("entries, rounds, scale, parts", [(6, 4, 4096, 2), (16, 6, 8, 4), (3, 2, 100, 1), (500, 1, 4096, 2)])
def test_codes_against_a_full_search(spark, entries, rounds, scale, parts):
    data = [r for r in rows() if r[1] is None or len(r[1]) in (0, 4)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    got, books = vector_codes.compress(frame, entries=entries, rounds=rounds, scale=scale, parts=parts)
    want, want_books = brute_codes(data, entries, rounds, scale, parts, 4)
    assert books.tolist() == want_books
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    shown = got.withColumn("code", vector_codes.hex_code(digits=4)).collect()
    assert all(r["code"] == "".join(f"{c:04x}" for c in r["codes"]) for r in shown)


def test_empty_and_unusable_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bad = spark.createDataFrame([(i, v, 1, "", "", 1) for i, v in enumerate(ODD) if v is None or None in v], SCHEMA)
    for frame in (none, bad):
        assert centroids.cluster(frame, width=4).collect() == []
        got, books = vector_codes.compress(frame)
        assert got.collect() == [] and books.shape[1] == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", 1), (2, [1.0], 1, "", "", 1)], SCHEMA)
    with pytest.raises(ValueError):
        vector_codes.compress(mixed, parts=1)
    with pytest.raises(ValueError):
        vector_codes.compress(mixed.where("vec_id = 1"))


def test_too_large_components_stop_the_job(spark):
    frame = spark.createDataFrame([(1, [1e30] * 8, 1, "", "", 1)], SCHEMA)
    with pytest.raises(Exception, match="is not below"):
        centroids.cluster(frame, width=8).collect()
    with pytest.raises(Exception, match="is not below"):
        vector_codes.compress(frame)[0].collect()


few = st.integers(1, 12)


@settings(max_examples=150, deadline=None)
@given(st.data(), few, few, st.sampled_from([1, 2, 5]), st.sampled_from([2, 30, 1 << 20]))
def test_searches_never_miss(data, n, k, width, most):
    part = lambda rows: data.draw(arrays.arrays(np.int64, (rows, width), elements=st.integers(-most, most)))
    vectors, entries = part(n), part(k)
    away = ((vectors[:, None, :] - entries[None]) ** 2).sum(axis=2)
    which, distance = centroids.MeanOrder(entries).nearest(vectors)
    assert which.tolist() == away.argmin(axis=1).tolist() and distance.tolist() == away.min(axis=1).tolist()
    pivots = part(min(k, 3))
    found = vector_codes.Codebook(entries, pivots).nearest(vectors, vector_codes.roots(vectors, pivots))
    assert found[0].tolist() == which.tolist() and found[1].tolist() == distance.tolist()


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    entries = rng.integers(-300, 300, (16, 8)) + rng.integers(-3000, 3000, (16, 1))
    vectors = entries[rng.integers(0, 16, 2000)] + rng.integers(-100, 100, (2000, 8))
    search = centroids.MeanOrder(entries)
    search.nearest(vectors)
    book = vector_codes.Codebook(entries, entries[:4])
    book.nearest(vectors, vector_codes.roots(vectors, entries[:4]))
    assert search.measured < 0.5 * 16 * 2000 and book.measured < 0.5 * 16 * 2000


def test_sums_of_tasks_are_exact(spark):
    big = integers.largest(1, 1) - 1
    data = [(0, 0, 3, [big * 10**6]), (0, 0, 2, [-big * 10**6 - 4])]
    found = spark.createDataFrame(data, integers.MEANS)
    assert integers.moved(found, np.zeros((1, 2, 1), np.int64)).tolist() == [[[-1], [0]]]
