"""Stages of the corpus pipeline on awkward tables and against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.common import AWKWARD, awkward, empty, texts_of
from tests.llm.test_neardup import brute_force


def test_near_duplicate_stage_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pdf = texts_of(f"{small}/documents.parquet")
    want = {i for i, (n, root) in brute_force(pdf.doc_id.tolist(), pdf.text.tolist(), 5).items() if not n or i == root}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want) and got.columns == docs.columns


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, small):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (None, "x y"), (4, "q"), (4, "r")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, small).collect())))
    assert got == sorted(map(str, [(1, "a b c d e f g"), (3, None), (None, "x y"), (4, "q"), (4, "r")]))


def test_stages_take_awkward_and_empty_tables(spark, small):
    for docs, n in ((awkward(spark), len(AWKWARD) - 1), (empty(spark), 0)):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
        assert kept.columns == docs.columns and kept.count() == n
        for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_benchmark_leaks, corpus_pipeline.redact_personal_data):
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.pack_sequences(spark, docs, small).agg(F.sum("length")).first()[0] or n == 0
