"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, chat_format, decontaminate, lm_scoring, pii, quality, secret_scan, spm_codec, toxicity, transport_stream
from .common import remainder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def learnable(col):
    """Labels may be learnt from rows with another remainder than 2."""
    return remainder(col, 4) != 2


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", remainder(F.col("doc_id"), 7) == 2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    back = chat_format.read_back(chat_format.render(chat_format.fold(chat_format.streamed(chat_format.log_of_turns(turns.unionByName(two))))))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), digest(F.col("learnt")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<turn role="') + 2 + length('</turn>') + 1 + length(role) + length(text)
        + length(regexp_replace(role || text, '[^\\<"]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train(secret_scan.findings(spark), secret_scan.vocabulary(tokenizer_path()))
    out = secret_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text", "source", forest)
    return out.select("doc_id", "n_candidates", "n_secrets", "spans", F.length("redacted").cast("long").alias("redacted_chars"), F.sha2(F.encode("redacted", "utf-8"), 256).alias("redacted_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "utf-8"), 256).alias("base_sha256"), "spans")


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", learnable), 0.3)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.digests(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality", learnable), 0.7)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.store_and_read(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_chat_format, op3_secret_scan, op4_pii, op5_bag_minhash, op6_toxicity, op7_sentencepiece, op8_decontaminate, op9_quality, op10_transport_stream)} | {"pipeline": corpus_pipeline.run}

SQL = {"op2_chat_format": OP2_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
