import random

import pytest

from playlytics.llm import toxicity
from playlytics.llm.queries import op7_toxicity
from playlytics.llm.stages import toxicity_model

BAD = ["grobian", "stinkard", "vilelo", "vilema", "vilera", "vilesu", "vileti"]


def sentence(rng, n=40):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou") for _ in range(n))


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for bad in rng.sample(BAD, 3):
                words[rng.randrange(len(words))] = bad
        rows.append((" ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(labelled(), "text string, toxic int"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_search_against_all_distances():
    rng = random.Random(5)
    letters = "abcd"
    terms = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 11))) for _ in range(40)}
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed_errors(len(t))]
        want = min(near, default=None)
        assert trie.near(word) == ((want[1], want[0]) if want else None)
        if want and want[0] and toxicity.allowed_errors(len(want[1])):
            assert trie.may_match(word)


def test_lexicon_holds_words_and_stems(model):
    assert set(model.lexicon.words) >= {"grobian", "stinkard"}
    assert any("vile".startswith(s[:4]) for s in model.lexicon.stems)
    clean = sentence(random.Random(9))
    assert model.score(f"{clean} grobian {clean} stinkard vilenew") > 0.9
    assert model.score(clean) < 0.3
    assert model.score("") == model.score(None) < 0.5


def test_misspellings_count_and_quotations_count_less(model):
    clean = sentence(random.Random(9))
    plain = model.score(f"{clean} grobian stinkard")
    assert model.lexicon.weight("grobjan") > 0 and model.lexicon.weight("st1nkard") > 0
    assert model.score(f"{clean} grobjan stinkerd") > model.score(clean)
    assert model.score(f'{clean} they said "grobian stinkard" once') < plain
    assert model.score(f"{clean}\n> grobian stinkard\n") < plain
    assert model.lexicon.features('"a" b grobian "c" d')[0] == model.lexicon.weight("grobian")


def test_scores_of_odd_rows(spark, model):
    rows = [(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (3, "grobian " * 60_000, None)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string, score double"), model, "toxicity").collect()
    assert len(got) == 4 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_fit_without_evidence(spark):
    schema = "text string, toxic int"
    assert toxicity.fit(spark.createDataFrame([], schema)).score("x") == 0.5
    assert toxicity.fit(spark.createDataFrame([("a", 1), ("b", 1)], schema)).score("x") > 0.5
    docs = spark.createDataFrame([(1, None), (None, "a"), (2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    assert [tuple(r) for r in toxicity.training_rows(docs, labels).collect()] == [("", 1)]


def test_fit_is_stable(spark, model):
    again = toxicity.fit(spark.createDataFrame(labelled(), "text string, toxic int").repartition(5))
    assert again.lexicon.words == model.lexicon.words and again.lexicon.stems == model.lexicon.stems
    assert again.coefficients == pytest.approx(model.coefficients, abs=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op7_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["score"] for r in rows if labels[r["doc_id"]] == 1]
    clean = [r["score"] for r in rows if labels[r["doc_id"]] == 0]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert better / len(toxic) / len(clean) > 0.95
    assert sum(r["predicted"] for r in rows if labels[r["doc_id"]] == 0) <= 0.01 * len(clean)


def test_held_out_labels_do_not_matter(spark, folder, tmp_path):
    from playlytics.llm.stages import held_out

    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.where(~held_out()).unionByName(labels.where(held_out()).selectExpr("doc_id", "quality", "1 - toxic as toxic")).write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    assert toxicity_model(spark, folder).coefficients == toxicity_model(spark, str(tmp_path)).coefficients


def test_misspellings_of_words_under_a_stem(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = sentence(rng).split()
        if i % 5 == 0:
            words[rng.randrange(len(words))] = ["grimolos", "grimolas", "grimoles", "grimolix"][i // 5 % 4]
        rows.append((" ".join(words), int(i % 5 == 0)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int")).lexicon
    assert lexicon.stem("grimolos") and "grimolos" not in lexicon.words
    for wrong in ("gremolos", "qrimolas", "rimoles", "ggrimolix"):
        assert 0 < lexicon.weight(wrong) <= lexicon.weight("grimolos")
    assert lexicon.weight("gremola") == 0  # no word of the sample is as near


def brute_lexicon(texts, labels, level):
    """Terms by surplus from plain counts, as (words, stems)."""
    from math import log

    n, n_toxic = len(texts), sum(labels)
    having = {}
    for text, toxic in zip(texts, labels, strict=True):
        words = set(text.split())
        for term in words | {w[:k] + "*" for w in words for k in range(4, 11) if len(w) > k}:
            having.setdefault(term, [0, 0])[toxic] += 1
    tested = {t: c for t, c in having.items() if sum(c) >= 3}

    def surplus(other, toxic):
        seen, p = toxic + other, min(toxic / (toxic + other), 1 - 1e-9)
        return seen * ((p * log(p * n / n_toxic) if p else 0) + (1 - p) * log((1 - p) * n / (n - n_toxic)))

    found = {t: surplus(*c) for t, c in tested.items() if c[1] * n > sum(c) * n_toxic}
    words, stems = {}, {}
    for term in sorted(found, key=lambda t: (-found[t], t.endswith("*"), t)):
        other, toxic = tested[term]
        odds = log((toxic + 0.5) / (n_toxic + 1)) - log((other + 0.5) / (n - n_toxic + 1))
        bare = term.rstrip("*")
        over = [w for s, w in stems.items() if bare.startswith(s)]
        under = term.endswith("*") and any(a.startswith(bare) and len(bare) in range(4, 11) for a in [*words, *stems])
        if found[term] > log(len(tested) / level) and odds > 0 and not under and not (over and odds < max(over) + 0.7):
            (stems if term.endswith("*") else words)[bare] = odds
    return words, stems


def brute_weight(word, lexicon):
    if word in lexicon.words:
        return lexicon.words[word]
    stems = [s for s in lexicon.stems if word.startswith(s)]
    if stems:
        return lexicon.stems[max(stems, key=len)]
    if word in lexicon.variants:
        return lexicon.variants[word]
    near = [(distance(word, t), t) for t in {*lexicon.words, *lexicon.inflected}]
    near = min(((d, t) for d, t in near if d <= toxicity.allowed_errors(len(t))), default=None)
    return lexicon.unseen.get(near[1], 0.0) / near[0] if near and len(word) > 3 else 0.0


@pytest.mark.parametrize("n", [25, 60, 400])
def test_fit_and_score_against_brute_force(spark, monkeypatch, n):
    import math

    rows = labelled(n, seed=n)
    chosen = []
    level = toxicity._level
    monkeypatch.setattr(toxicity, "_level", lambda *a: chosen.append(level(*a)) or chosen[-1])
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    texts, labels = zip(*rows, strict=True)
    words, stems = brute_lexicon(texts, labels, chosen[0] if chosen else max(toxicity.LEVELS))
    assert words or stems
    assert model.lexicon.words == pytest.approx(words) and model.lexicon.stems == pytest.approx(stems)
    clean = sentence(random.Random(1))
    gradient = [0.0] * 4
    scored = []
    for text, toxic in [*rows, ("", 0), (f"{clean} grobjan vilemo", 1), (f"{clean} stinkardo", 1)]:
        weights = [w for w in (brute_weight(x, model.lexicon) for x in text.split()) if w > 0]
        largest, total, size = max(weights, default=0.0), sum(weights), len(text.split())
        assert model.lexicon.features(text) == pytest.approx((largest, total, size))
        x = [1.0, min(largest, 8) / 4, math.log1p(total) / 2, math.log1p(size) / 4 if weights else 0.0]
        z = sum(c * v for c, v in zip(model.coefficients, x, strict=True))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)
        scored.append((model.score(text), toxic))
    # the coefficients are at the maximum of the likelihood of the rounded features
    for text, toxic in rows:
        a, b, c = model.lexicon.features(text)
        x = toxicity.design(round(a + 1e-12, 1), math.expm1(round(math.log1p(b), 1)), math.expm1(round(math.log1p(c))))
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(k * v for k, v in zip(model.coefficients, x, strict=True))))))
        gradient = [g + (p - toxic) * v for g, v in zip(gradient, x, strict=True)]
    free = [g + 0.01 * k for g, k in zip(gradient, model.coefficients, strict=True) if k]
    assert free == pytest.approx([0] * len(free), abs=0.05)
    toxic, clean = ([s for s, y in scored if y == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) > 0.9 * len(toxic) * len(clean)


def test_few_labels_still_rank(spark, folder):
    """With a dozen toxic texts the lexicon is loose, and scores still differ."""
    from playlytics.llm.stages import held_out

    model = toxicity_model(spark, folder)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").where(held_out()).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    score = {r["doc_id"]: model.score(r["text"]) for r in docs}
    assert len(set(score.values())) > 3
    toxic, clean = ([score[i] for i, y in labels.items() if y == k and i in score] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) > 0.5 * len(toxic) * len(clean)


def test_no_term_of_three_texts(spark):
    rows = [("aa bb grobian", 1), ("aa cc", 0), ("bb cc", 0), ("cc dd", 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert model.lexicon.weight("grobian") > 0 and model.score("grobian") > model.score("cc dd")


def test_near_copies_count_once_in_any_order(spark):
    rows = [(t, y) for t, y in labelled(60) for _ in range(2)] + [(t + " Ab.", y) for t, y in labelled(60)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    models = [toxicity.fit(frame.repartition(k)) for k in (2, 9)]
    assert models[0].lexicon == models[1].lexicon and models[0].coefficients == models[1].coefficients
