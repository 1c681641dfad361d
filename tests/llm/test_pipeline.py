import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from playlytics.llm import decontamination, jaccard, mixing, toxicity
from playlytics.llm.stages import TOXIC, toxicity_model


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The input and output of every stage, written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_but_the_last_keep_the_columns(stages):
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "slot", "shard"]


def test_toxic_documents_go(spark, folder, stages):
    model = toxicity_model(spark, folder)
    want = [r for r in stages[0].collect() if model.score(r["text"]) < TOXIC]
    assert rows(stages[1]) == sorted(map(tuple, want), key=repr)
    assert 0.8 * stages[0].count() < len(want) < stages[0].count()
    assert isinstance(model, toxicity.Model)


def test_one_of_each_group_stays(stages):
    classes = jaccard.similarity_classes(stages[1]).collect()
    want = {r["class_id"] if r["n_links"] else r["doc_id"] for r in classes}
    got = [r["doc_id"] for r in stages[2].collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r["n_links"] == 0 for r in jaccard.similarity_classes(stages[2]).collect())


def test_benchmark_passages_go(spark, folder, stages):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    before = decontamination.find_benchmark(stages[2], items)
    clean = before.where(F.size("bm_spans") == 0).select(stages[0].columns)
    left = decontamination.find_benchmark(stages[3], items)
    assert left.where(F.size("bm_spans") > 0).count() == 0
    assert set(rows(clean)) <= set(rows(stages[3]))
    assert before.where(F.size("bm_spans") > 0).count() > 0


def test_mix_repeats_rows_of_its_input(stages):
    taken = mixing.assign(stages[3].withColumn("size", mixing.word_count("text")))
    want = {}
    for r in taken.collect():
        want[r["doc_id"]] = sum(2 * c["words"] >= r["size"] for c in r["mix"]["copies"])
    got = {}
    for r in stages[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_run_equals_its_stages(spark, folder, stages):
    assert rows(corpus_pipeline.run(spark, folder)) == rows(stages[-1])


def test_stages_with_nulls_repeats_and_extra_columns(spark, folder):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(1, text, "en", "a", 5, "x")] * 3 + [(None, text + " z", "en", None, None, None), (2, None, None, None, None, "y"), (3, "", "de", "b", 0, "")]
    extra = "score string"
    docs = spark.createDataFrame([(*r[:5], r[5]) for r in data], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in last} >= {1}
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_registration():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(__spark_entry__.oracle_sql()) <= set(names)
