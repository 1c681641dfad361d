import math
import random

import numpy as np
import pytest

from playlytics.llm import language
from playlytics.llm.queries import op11_language

SMALL = ["▁", "a", "b", "c", "ab", "▁a", "▁ab", "bc", "abc", "ca", "▁c", *(chr(language._BYTE + b) for b in range(256))]


def segmentations(symbols, pieces):
    if not symbols:
        yield []
    for k in range(1, len(symbols) + 1):
        if symbols[:k] in pieces:
            for rest in segmentations(symbols[k:], pieces):
                yield [symbols[:k], *rest]


def symbols_of(word, pieces):
    return "▁" + "".join(c if c in pieces else "".join(chr(language._BYTE + b) for b in c.encode()) for c in word)


@pytest.fixture
def model():
    rng = np.random.default_rng(1)
    share = rng.random((len(SMALL), 2))
    return language.Model(language.Pieces(SMALL), ["x", "y"], np.log([0.5, 0.5]), np.log(share / share.sum(axis=0)))


def brute(word, model):
    number = {p: i for i, p in enumerate(model.pieces.pieces)}
    sums, uses = np.zeros(2), np.zeros((len(number), 2))
    for pieces in segmentations(symbols_of(word, number), number):
        weight = np.exp(sum(model.logs[number[p]] for p in pieces))
        sums += weight
        for p in pieces:
            uses[number[p]] += weight
    return sums, uses / sums


def test_words_against_all_segmentations(model, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 20)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé語") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    got = model.word_logs(words)
    for word, logs in zip(words, got, strict=True):
        assert logs == pytest.approx(np.log(brute(word, model)[0]), abs=1e-9)
    assert model.word_logs([]).shape == (0, 2)


def test_expected_uses_against_all_segmentations(spark, model):
    rng = random.Random(3)
    counted = [(rng.choice("xy"), "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))), rng.randint(1, 9)) for _ in range(80)]
    counted = list({r[:2]: r for r in counted}.values())
    frame = spark.createDataFrame(counted, "lang string, word string, n bigint")
    want = np.zeros((len(SMALL), 2))
    for lang, word, n in counted:
        want[:, "xy".index(lang)] += n * brute(word, model)[1][:, "xy".index(lang)]
    got = language._expected(frame.repartition(3), model)
    assert got == pytest.approx(want, abs=80 * 9 / language.GRAIN)
    assert (language._expected(frame.repartition(7), model) == got).all()


def test_words():
    assert language.words_of("Él, DIJO: 12 a_b x½ ½ ét éé".encode()) == ["él", "dijo", "a", "b", "x½", "ét", "éé"]
    assert language.words_of(None) == language.words_of(b"") == language.words_of("1 2 ½ !?".encode()) == []
    assert list(language.chunks(["a" * 10] * 3)) == [(0, 3)] and list(language.chunks([])) == []


def sample(n=40):
    rng = random.Random(5)
    texts = {"de": "der und die schule ist ein haus zu mit nicht".split(), "es": "el los que una casa escuela con para del niño".split()}
    return [(i, " ".join(rng.choice(texts[x]) for _ in range(30)), x) for i in range(n) for x in texts]


def test_predictions_of_odd_rows(spark):
    rows = [*sample(), (None, "der die", "de"), (7, "el que", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(language.training_rows(docs))
    again = language.fit(language.training_rows(docs.repartition(7)))
    assert model.languages == ["de", "es"] and (model.logs == again.logs).all()
    odd = [(1, None, 0.5), (1, "", 0.5), (2, "123 !?", 0.5), (None, "die schule", 0.5), (3, "die schule", 0.5), (4, "la escuela para los niños", 0.5)]
    odd += [(5, "der und " * 100_000, None), (6, "x" * 300_000, None), (7, "語" * 50, None)]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string, score double")
    got = language.predict(frame, model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "score", "lang_pred", "_score"]
    assert [r["lang_pred"] for r in got[:7]] == ["und", "und", "und", "de", "de", "es", "de"]
    assert [r["_score"] for r in got[:3]] == [0, 0, 0] and all(0 <= r["_score"] <= 1 for r in got)
    assert [r["score"] for r in got[:6]] == [0.5] * 6
    assert language.predict(frame.where("doc_id > 99"), model).collect() == []


def test_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "ein haus", None), (None, "ein", "de")], "doc_id bigint, text string, lang string")
    for rows in (docs, docs.where("doc_id = 9")):
        model = language.fit(language.training_rows(rows))
        got = language.predict(docs.select("doc_id", "text"), model).collect()
        assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_sample_is_bounded_by_language(spark):
    docs = spark.createDataFrame(sample(500), "doc_id bigint, text string, lang string")
    n = language.training_rows(docs, 100).groupBy("lang").count().collect()
    assert all(60 < r["count"] < 150 for r in n) and len(n) == 2


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.98), ("sf0.1", 0.99)])
def test_held_out_accuracy(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = op11_language(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert 0.15 < len(held) / len(rows) < 0.25
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= least * len(held)


def test_held_out_languages_do_not_matter(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    other.write.parquet(f"{tmp_path}/documents.parquet")
    same = lambda folder: sorted(map(tuple, op11_language(spark, folder).collect()))
    assert same("/root/testdata/sf0.001") == same(str(tmp_path))
    assert math.isclose(sum(r[3] for r in same(str(tmp_path))) / docs.count(), 1, abs_tol=0.1)
