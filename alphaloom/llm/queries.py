"""Digest queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alphaloom.llm._spark import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alphaloom.llm.toxicity import score_toxicity, train_chain

    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_chain(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.array_join(F.transform(F.map_values("categories"), lambda p: F.round(p, 4).cast("string")), ",").alias("chain"), "score", "toxic")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), BYTE_BPE, eos_id=2, max_len=1024, keep_ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents"), BYTE_BPE)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alphaloom.llm.quality import THRESHOLD, held_out, score_quality, train_ranker

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ranker = train_ranker(docs, labels.where(~held_out()))
    scored = score_quality(docs, ranker)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.audio import align, fingerprints, synthesise

    return align(fingerprints(synthesise(read(spark, sf_dir, "embeddings"))), every=20)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.pii import find_personal_data, train_redactor

    docs = read(spark, sf_dir, "documents")
    return find_personal_data(docs, train_redactor(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alphaloom.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alphaloom.llm.chat import format_chats

    chats = format_chats(read(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.md5("rendered").alias("rendered_md5"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.whiten import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.trie import prefix_trie

    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.webtext import extract_text

    return extract_text(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_license_scan, op4_token_counts, op5_quality_classifier, op6_audio_fingerprints, op7_personal_data, op8_decontamination, op9_near_duplicates, op10_chat_formatting, op11_embedding_whitening, op12_conversation_trie, op13_html_extraction)}


SQL = {
    "op10_chat_formatting": """
WITH placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
  FROM conversations),
chains AS (
  SELECT conv_id, count(*) AS n_turns,
         list(struct_pack(r := role, t := text) ORDER BY place) AS chain,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM placed GROUP BY conv_id),
uniq AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n_turns, chain, any_value(rendered) AS rendered
  FROM chains GROUP BY n_turns, chain),
prefixes AS (
  SELECT DISTINCT chain[1:n] AS chain
  FROM (SELECT chain, unnest(range(1, n_turns)) AS n FROM uniq))
SELECT conv_id, n_turns, n_copies, length(rendered) AS n_chars, md5(rendered) AS rendered_md5
FROM uniq WHERE chain NOT IN (SELECT chain FROM prefixes)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
