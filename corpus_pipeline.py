"""The corpus pipeline: documents by way of five operators to packed training sequences.

Every stage takes whole texts of any length, nulls in any column, empty texts,
repeated rows and further columns as they come, and an empty table to an empty
one; what it makes of them is said at its operator. All stages but the last
return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import packing, pii, quality
from alphaloom.llm._spark import checkpoint, read
from alphaloom.llm.decontaminate import decontaminate
from alphaloom.llm.neardup import BROADCAST_IDS, near_duplicates
from alphaloom.llm.queries import BYTE_BPE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier (op 5) rejects; it learns from the labelled rows among ``docs`` outside the held-out quarter.

    Without labels of both kinds nothing is dropped.
    """
    labels = read(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.keep_good(docs, quality.train_ranker(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group (op 9, five-word shingles, 0.8).

    Of rows that repeat an id and its text one stays; different texts under one
    id that is kept all stay, as do rows without an id. Texts without words are no near-duplicates.
    """
    found = checkpoint(near_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")))
    touched = found.where("doc_id is not null and (n > 1 or not kept)").select("doc_id")
    repeated = found.where("n > 1 and kept").select("doc_id")
    n_touched, n_repeated = touched.count(), repeated.count()
    bounded = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    rest = docs.join(bounded(touched, n_touched), "doc_id", "left_anti").select(docs.columns)
    if not n_repeated:
        return rest
    return rest.union(docs.join(bounded(repeated, n_repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items (op 8): all rows of such an id, none without an id."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind (op 7) and bring ``n_chars`` up to date (null where the text is null)."""
    return pii.redact_column(docs, pii.train_redactor(docs)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 1024 tokens (op 2)."""
    return packing.pack(docs, BYTE_BPE, eos_id=2, max_len=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_redaction", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Learnt scores, signatures and tokenisation are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written once before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
