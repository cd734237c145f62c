"""The pipeline: what each stage keeps, on its own input."""

import hashlib

import pytest

import corpus_pipeline as pipeline
from outvote.llm import decontamination, mixing

from .test_documents import _dropped_lines, _groups


def rows_of(df):
    return [tuple(None if v is None else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    return "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_return_documents_and_the_last_one_the_mix(spark, corpus):
    sf_dir, docs = corpus
    for name, step in pipeline.STAGES:
        before = docs
        docs = pipeline.stage(step(spark, before, sf_dir))
        assert 0 < docs.count() <= before.count(), name
        assert docs.columns[: len(before.columns)] == before.columns
    assert docs.columns[5:] == ["size", "source_size", "target", "taken"]
    final = docs.toPandas()
    assert (final["taken"] > 0).all() and (final["taken"] <= 2 * final["size"]).all()


def test_quality_stage_keeps_clean_documents(spark, corpus):
    sf_dir, docs = "/root/testdata/sf0.01", spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    kept = set(pipeline.keep_good(spark, docs, sf_dir).toPandas()["doc_id"])
    good, bad = labels.loc[labels["quality"] == 1, "doc_id"], labels.loc[labels["quality"] == 0, "doc_id"]
    assert good.isin(kept).mean() > 0.97 and bad.isin(kept).mean() < 0.03


def test_line_stage_equals_brute_force(spark, corpus):
    sf_dir, docs = corpus
    rows = rows_of(docs)
    got = {r["doc_id"]: r for r in pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    expected = _dropped_lines(rows)
    assert {d: hashlib.sha256(r["text"].encode()).hexdigest() for d, r in got.items()} == dict(zip(expected["doc_id"], expected["kept_sha256"]))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicate_stage_keeps_one_of_each_group(spark, corpus):
    sf_dir, docs = corpus
    expected = _groups(rows_of(docs), 80)
    got = pipeline.keep_one_of_each_group(spark, docs, sf_dir).toPandas()
    assert sorted(got["doc_id"]) == sorted(expected.loc[expected["kept"], "doc_id"])


def test_decontamination_stage_removes_what_holds_a_passage(spark, corpus):
    sf_dir, docs = corpus
    bad = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    got = pipeline.drop_benchmark_passages(spark, docs, sf_dir).toPandas()
    assert bad and set(got["doc_id"]) == set(docs.toPandas()["doc_id"]) - bad


def test_mixing_stage_keeps_what_is_taken(spark, corpus):
    sf_dir, docs = corpus
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["taken"] for r in pipeline.mix_sources(spark, docs, sf_dir).collect()}
    assert got == {d: t for d, t in taken.items() if t}


def test_stages_take_messy_and_empty_tables(spark, messy, nothing):
    for name, step in pipeline.STAGES:
        for docs in (messy, nothing):
            out = step(spark, docs, "/root/testdata/sf0.001")
            n = out.count()
            assert (n == 0) == (docs is nothing), name
            assert set(out.columns) >= {c for c in docs.columns if c not in ("size", "taken")}
