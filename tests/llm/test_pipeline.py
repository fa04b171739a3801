"""The pipeline, stage by stage, against what each stage must do to its input."""

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from orderloom.llm import neardup, quality, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, results[-1], FOLDER).write.parquet(f"{folder}/{name}")
        results.append(spark.read.parquet(f"{folder}/{name}"))
    return results


def test_columns(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    accepted = {r["doc_id"] for r in quality.score(stages[0], model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == accepted
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in accepted for i in good) >= 0.98 * len(good)


def test_one_of_each_group_stays(stages):
    kept = {r["doc_id"] for r in stages[2].collect()}
    groups = {}
    for r in neardup.classes(stages[1]).collect():
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert kept == set(groups)


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(stages[2]).collect()}
    for number, text in before.items():
        assert (after[number]["text"] != text) == bool(found[number])
        assert after[number]["n_chars"] == len(after[number]["text"])
    assert sum(len(r["base_spans"]) for r in secrets.scan(stages[3]).collect()) == 0


def test_all_documents_are_packed(spark, stages):
    packed = stages[4]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in stages[3].collect()}
    whole = registered.queries()["pipeline"](spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(key).collect()) == sorted(packed.select(key).collect())


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_clashing_columns_nulls_and_repeats(spark):
    """Columns named like an operator's own, or with a dot, stay as they are in every stage that keeps documents."""
    kinds = "score string, doc_id bigint, text string, `a.b` int, keep string, predicted string, `text ` string"
    some = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(f"s{i}", i, text, i, "k", "p", "t") for i, text in enumerate([*some, None, "", some[0], "password = hunter22secret"])]
    docs = spark.createDataFrame([*rows, rows[3], (None, None, some[5], None, None, None, None)], kinds)
    for name, stage in corpus_pipeline.STAGES[:3]:
        for table in (docs, docs.limit(0)):
            kept = stage(spark, table, FOLDER)
            assert kept.dtypes == docs.dtypes, name
            found = [tuple(r) for r in kept.collect()]
            assert len(found) <= table.count()
            if name != "secrets":
                assert set(found) <= set(map(tuple, docs.collect()))
    masked = corpus_pipeline.without_secrets(spark, docs, FOLDER).where("doc_id = 43").first()
    assert "hunter22secret" not in masked["text"] and masked["score"] == "s43"
