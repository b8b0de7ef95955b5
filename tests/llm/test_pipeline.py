"""The pipeline on a small corpus with a known answer for each stage, and on odd rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, tmp_path):
    import random

    from tests_llm_words import sentence

    rng = random.Random(11)
    docs = [(k, sentence(rng, 60), "en", f"s{k % 3}", None) for k in range(60)]
    docs += [(100, docs[3][1], "en", "s", 5), (101, docs[4][1] + " tail", "en", "s", 5), (102, "??? 123 !!!", "en", "s", 5), (103, None, None, None, None), (None, docs[5][1], "en", "s", 5)]
    item = sentence(rng, 30)
    docs += [(104, sentence(rng, 20) + " " + item + " " + sentence(rng, 20), "en", "s", 5), (105, sentence(rng, 30) + ' token = "abcdef0123456789"', "en", "s", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_decision_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in out.items()}
    clean = set(range(60))
    assert ids["language"] == clean | {100, 101, 104, 105, None}
    assert ids["near_duplicates"] == clean | {104, 105, None}
    assert ids["decontaminate"] == clean | {105, None} == ids["mask_secrets"] == ids["tokenise"]
    masked = next(r for r in out["mask_secrets"] if r.doc_id == 105)
    assert "[secret]" in masked.text and "abcdef" not in masked.text
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids["tokenise"]


def test_different_texts_under_one_id_are_documents_of_their_own(spark, tmp_path):
    import random

    from tests_llm_words import sentence

    rng = random.Random(3)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    rows = [(1, a), (2, b), (2, c), (2, c), (3, a), (3, d), (4, c + " tail"), (4, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())))
    assert got == sorted(map(str, [(1, a), (2, b), (2, c), (3, d), (4, None), (None, a)]))


def test_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).collect() == []


def _shuffled(spark):
    import time

    time.sleep(1)  # for the listener
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch):
    import base64
    import random

    rng = random.Random(9)
    texts = [" ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(300)) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, texts[3]), (1001, texts[4] + " tail"), (None, texts[5]), (None, None), (1002, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(corpus_pipeline.ngram_join, "link_classes", lambda df: classes)
    classes = spark.createDataFrame([(i, 1, {1000: 3, 1001: 4}.get(i, i)) for i, _ in rows], "doc_id long, n_shingles long, component_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path)).collect()
        moved = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in rows if r[0] not in (1000, 1001))
    assert 0 < moved < sum(map(len, texts)) // 4


def test_without_keeps_all_but_the_given_keys(spark, odd_docs):
    from lodestar.llm import bloom

    docs = odd_docs.selectExpr("*", "concat('d', doc_id) AS name")
    for key, some in (("doc_id", [1, 5, None, 77]), ("name", ["d1", "d5", None, "d77"])):
        gone = spark.createDataFrame([(x,) for x in some], f"{key} {dict(docs.dtypes)[key]}")
        got = bloom.without(docs, gone, key)
        assert got.columns == docs.columns
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["2", "3", "4", "6", "7", "None"]
        assert bloom.without(docs, gone.limit(0), key).count() == docs.count() and bloom.without(docs.limit(0), gone, key).collect() == []
