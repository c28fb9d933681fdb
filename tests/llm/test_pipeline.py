"""The pipeline keeps clean documents, drops what each stage decides on, and packs the rest whole."""

import corpus_pipeline
import public_tokenizers
from chromaframe.llm import decontamination, exact_dedup, ngram_join, packing, quality
from chromaframe.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, DIR), "test")
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty(), name
        if name == "exact_dedup":
            assert after.count() == before.select("text").distinct().count()
        if name == "near_dedup":
            assert after.count() == ngram_join.query(before).select("component_id").distinct().count()
        if name == "decontamination":
            items = spark.read.parquet(f"{DIR}/benchmark.parquet")
            assert after.count() == decontamination.query(before, items).where("not contaminated").count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] and exact_dedup and packing and quality and public_tokenizers


SCHEMA = "doc_id bigint, text string, lang string, y double, token bigint, digest string, rep bigint, n bigint"


def test_stages_on_awkward_rows(spark):
    """Nulls, empty texts, repeated ids and rows, and columns named like those the stages use inside."""
    leak = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    words = " ".join(f"w{i}" for i in range(60))
    texts = [(None, None), (1, None), (2, ""), (3, "  "), (4, words), (4, words), (4, f"{words} and more"), (5, f"{words} and"), (None, "no id"), (6, leak), (6, "another text of six"), (7, "x" * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1, "d", 2, 3) for i, t in texts], SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    accepted = written(stages["quality_classifier"](spark, docs, DIR), "test")
    assert accepted.schema == docs.schema and accepted.exceptAll(docs).isEmpty()
    single = written(stages["exact_dedup"](spark, docs, DIR), "test")
    assert sorted(map(repr, ((r.doc_id, r.text) for r in single.collect()))) == sorted(map(repr, [(2, ""), *{(i, t) for i, t in texts if t}]))
    apart = written(stages["near_dedup"](spark, single, DIR), "test")
    assert sorted(r.doc_id for r in apart.collect() if r.doc_id) == [2, 3, 4, 4, 6, 6, 7] and apart.where("doc_id is null").count() == 1
    clean = written(stages["decontamination"](spark, apart, DIR), "test")
    assert [r.text for r in clean.where("doc_id = 6").collect()] == ["another text of six"] and clean.count() == apart.count() - 1
    assert single.schema == apart.schema == clean.schema == docs.schema
    pieces = stages["packing"](spark, clean, DIR).collect()
    assert sum(p.start == 0 for p in pieces) == clean.count()


def test_stages_carry_columns_of_any_name(spark):
    odd = "doc_id bigint, text string, _file int, _row string, _spans bigint, _metadata double, row int, `all` int, spans int, `a.b` string, component_id int"
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, t, 1, "r", 2, 0.5, 3, 4, 5, "x", 6) for i, t in ((1, words), (2, words), (3, f"{words} and more"), (4, None), (5, "apart"))], odd).repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    for name, left in (("quality_classifier", None), ("exact_dedup", [2, 3, 4, 5]), ("near_dedup", [1, 4, 5]), ("decontamination", [1, 2, 3, 4, 5])):
        out = written(stages[name](spark, docs, DIR), "test")
        assert out.schema == docs.schema and out.exceptAll(docs).isEmpty() and (left is None or sorted(r.doc_id for r in out.collect()) == left), name
    assert {r.doc_id for r in stages["packing"](spark, docs, DIR).collect()} == {1, 2, 3, 4, 5}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.isEmpty() and (name == "packing" or out.schema == docs.schema), name


def test_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.filter_quality(docs, labels)
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert good.join(kept.select("doc_id"), "doc_id").count() >= 0.97 * good.count()
