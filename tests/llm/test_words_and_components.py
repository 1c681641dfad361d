import numpy as np
import pyarrow as pa

from playlytics.llm.common import components, free_name, sorted_groups
from playlytics.llm.words import _SEGMENT, hash_words, hashed_texts, shingles, word_list


def brute_words(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, word = [], ""
    for c in lower:
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def test_words_and_hashes_agree():
    texts = ["", "  ", "One two ONE", "Éa-b\x00c ßd's", "x" * 50 + " y", "\x7f{a}[b]"]
    for text in texts:
        assert [w.decode() for w in word_list(text.encode())] == brute_words(text)
    by_hash = {}
    for _, _, hashes, counts in hashed_texts([t.encode() for t in texts]):
        assert list(counts) == [len(brute_words(t)) for t in texts]
        words = [w for t in texts for w in brute_words(t)]
        for h, w in zip(hashes.tolist(), words, strict=True):
            assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(by_hash.values()))


def test_long_texts_are_hashed_in_segments_alike():
    words = [f"w{i % 977}" for i in range(300_000)]
    long = " ".join(words).encode()
    assert len(long) > _SEGMENT
    hashes, firsts = hash_words(long)
    assert len(hashes) == len(words)
    one = {w: hash_words(w.encode())[0][0] for w in set(words)}
    assert all(hashes[i] == one[words[i]] for i in range(0, len(words), 61))
    assert firsts[-1] == len(long) - len(words[-1])
    giant = b"a" * (2 * _SEGMENT + 5)
    assert len(hash_words(giant + b" b")[0]) == 2


def test_shingles_of_each_text():
    texts = ["a b c d e f", "a b", "", "b c d e f", "a b c d e"]
    ((_, _, hashes, counts),) = hashed_texts([t.encode() for t in texts])
    values, number = shingles(hashes, counts)
    assert list(number) == [2, 1, 0, 1, 1]
    assert values[0] == values[4] and values[1] == values[3]
    assert len(set(values.tolist())) == 3


def test_groups_across_batches():
    rows = [("a", i) for i in range(7)] + [("b", 7)] + [("c", i) for i in range(5)]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in rows[i : i + 3]]) for i in range(0, len(rows), 3)]
    seen = []

    def handle(table):
        seen.append(table.to_pylist())
        yield from ()

    list(sorted_groups(batches, ("k",), None, handle))
    assert [(r["k"], r["v"]) for part in seen for r in part] == rows
    for part in seen[:-1]:
        last = part[-1]["k"]
        assert all(r["k"] != last for later in seen[seen.index(part) + 1 :] for r in later)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (220, 2))] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string"), "t").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(found) == linked
    groups, want = {}, {}
    for x in linked:
        groups.setdefault(found[x], set()).add(x)
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([("a", "a")], "a string, b string"), "t").count() == 0


def test_free_names(spark):
    assert free_name(spark.range(1).selectExpr("id as Score", "id as _score"), "score") == "__score"
