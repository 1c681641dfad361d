import pytest

from playlytics.llm import licenses
from playlytics.llm.queries import op8_licenses

DOCS = "doc_id bigint, text string"


def brute(text, templates, contained=0.8):
    """The best window of each template, as (containment, first word)."""
    words = licenses.words_of(text or "")
    out = {}
    for name, notice in templates.items():
        known = set(licenses.template_shingles(notice))
        n = len(licenses.words_of(notice))
        length = min(5, n)
        runs = [" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]
        step, width = licenses.stride(n), licenses.window_words(n) - length + 1
        first = 0
        while runs:
            share = len(known & set(runs[first : first + width])) / len(known)
            if share >= contained - 1e-9 and share > out.get(name, (0, 0))[0]:
                out[name] = (share, first)
            if first + width >= len(runs):
                break
            first += step
    return out


def cases():
    fill = " ".join(f"f{i}" for i in range(33))
    notices = list(licenses.TEMPLATES.values())
    texts = [f"{fill[: 5 * k]} {notice} {fill[: 3 * k]}" for k, notice in enumerate(notices)]
    texts += [f"{fill} {a}. {b} {fill} {a}" for a, b in zip(notices, notices[1:], strict=False)]
    texts += [" ".join(n.split()[1:]) for n in notices] + [n.replace(" ", " x ", 1) for n in notices]
    texts += [n.upper().replace(" ", "\n> ") for n in notices] + ["", None, "mit license", fill, f"{fill} " * 500 + notices[5]]
    return texts


def test_against_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], f"{DOCS}, template string")
    got = {(r["doc_id"], r["template"]): (r["containment"], r["first_word"]) for r in licenses.find_licenses(docs).collect()}
    want = {(k, name): found for k, t in enumerate(texts) for name, found in brute(t, licenses.TEMPLATES).items()}
    assert len(want) > 20 and got == want


def test_repeated_rows_nulls_and_no_rows(spark):
    notice = licenses.TEMPLATES["mit"]
    docs = spark.createDataFrame([(1, notice), (1, notice), (None, notice), (None, "x")], DOCS)
    assert sorted((r["doc_id"] or 0, r["template"]) for r in licenses.find_licenses(docs).collect()) == [(0, "mit"), (1, "mit")]
    assert licenses.find_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_settings():
    assert licenses.probes(["a", "b", "c", "d"], 0.8) == ["a"]
    assert licenses.probes([str(k) for k in range(10)], 0.8) == ["0", "1", "2"]
    for n in (5, 8, 20, 300):
        bands = licenses.bands_needed(n, n - 4)
        window = licenses.window_words(n) - 4
        alike = 0.8 * (n - 4) / (window + 0.2 * (n - 4))
        assert 1 - (1 - alike) ** bands >= licenses.RECALL
    with pytest.raises(ValueError):
        licenses.template_shingles("short")


def test_query_is_native_and_complete(spark, folder):
    frame = op8_licenses(spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    got = {(r["doc_id"], r["template"]): (r["containment"], r["first_word"]) for r in frame.collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == {(r["doc_id"], name): found for r in docs for name, found in brute(r["text"], licenses.TEMPLATES).items()}


def test_bodies_headers_and_short_forms_are_found(spark):
    body = """MIT License. Copyright (c) 2020 A. Permission is hereby granted, free of charge, to any person obtaining a copy of this
    software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
    the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
    the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software."""
    texts = {
        body: "mit-body",
        "This project is Licensed under the MIT License.": "mit-licensed",
        "# Unless required by applicable law\n# Licensed under the Apache License 2.0": "apache-licensed",
        "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n": "gpl-3.0-body",
        "Mozilla Public License Version 2.0\n=====\n1. Definitions\n1.1. \"Contributor\" means each individual or legal entity that creates, "
        "contributes to the creation of, or owns Covered Software.": "mpl-2.0-body",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "spdx-gpl-3.0-or-later",
        "/* SPDX-License-Identifier: MIT */": "spdx-mit",
        "Copyright (c) 2020 A. ALL RIGHTS\n RESERVED.": "all-rights-reserved",
        "All rights reserved": "all-rights-reserved",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {(r["doc_id"], r["template"]) for r in licenses.find_licenses(docs).collect()}
    assert got >= set(enumerate(texts.values()))


def test_every_needle_holds_a_head():
    needles = [p for t in licenses.TEMPLATES.values() for p in licenses.probes(licenses.template_shingles(t))]
    assert all(set(n.split()) & set(licenses.heads(needles)) for n in needles)


def test_long_texts_and_no_rights(spark):
    fill = "all rights are reserved for words of any kind "
    docs = spark.createDataFrame([(1, fill * 20_000 + "All rights reserved."), (2, fill), (3, "rights reserved"), (4, "all rights")], DOCS)
    got = licenses.find_licenses(docs).collect()
    assert [(r["doc_id"], r["template"], r["containment"], r["first_word"]) for r in got] == [(1, "all-rights-reserved", 1.0, 20_000 * 9 - 1)]
