"""The pipeline's stages on a small corpus, each stage's decisions taken one by one."""

from __future__ import annotations

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    secret = [(100_001, "the key is token=abcdefghijklmnopqrst here and more words", "en")]
    item = " ".join(next(t for _, t in texts if t and len(t.split()) > 100).split()[:40])
    planted = [(100_002, item, "en")]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in secret + planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run(spark, folder, texts):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "near_copies", "benchmark_passages", "secrets", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, folder)
    assert kept.columns == columns
    letters = {i for i, t in texts if t and any(c.isalpha() for c in t)} | {100_001, 100_002}
    assert {r.doc_id for r in kept.collect()} == letters
    once = corpus_pipeline.near_copies(spark, kept, folder)
    ids = [r.doc_id for r in once.collect()]
    assert once.columns == columns and len(ids) == len(set(ids)) and set(ids) <= letters
    clean = corpus_pipeline.benchmark_passages(spark, once, folder)
    left = {r.doc_id for r in clean.collect()}
    assert 100_002 not in left and 100_001 in left and clean.columns == columns
    masked = {r.doc_id: r for r in corpus_pipeline.secrets(spark, clean, folder).collect()}
    assert masked[100_001].text == "the key is [SECRET] here and more words"
    assert masked[100_001].n_chars == len(masked[100_001].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == left
