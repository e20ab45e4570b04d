"""The pipeline against its stages done by brute force."""

import pytest
from tables import SF

import corpus_pipeline as P
from stratalake.llm.common import words_of

from test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs)
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == columns for d in stages[:-1]) and len(P.STAGES) == 5


def test_clean_documents_stay(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stages[0].count() >= 0.97 * docs.count()
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").join(stages[0].select("doc_id"), "doc_id")
    assert clean.join(stages[1], "doc_id").count() >= 0.9 * clean.count()


def test_near_duplicates_go(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    ids = sorted(before)
    links = brute([before[i] for i in ids])
    kept = {r["doc_id"] for r in stages[2].collect()}
    assert all(not any(ids[j] in kept for j in links[k]) for k, i in enumerate(ids) if i in kept)
    assert all(i in kept for k, i in enumerate(ids) if not links[k])


def test_leaks_go(spark, stages):
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = lambda r: any(x in " ".join(words_of(r["text"])) for x in items)
    before = {r["doc_id"]: hit(r) for r in stages[2].collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, h in before.items() if not h}


def test_all_that_is_kept_is_packed(stages):
    rows = stages[4].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[3].collect()}
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_run(spark, stages):
    assert sorted(r["ids_crc32"] for r in P.run(spark, SF).collect()) == sorted(r["ids_crc32"] for r in stages[4].collect())
