"""The corpus pipeline: five stages, each written and read again by who runs them one by one; `run` stores each stage once.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one those of
the encoding.

Odd rows, in all stages: a null text counts as empty and stays null where the row stays; texts of any length are read
whole; extra columns are kept, whatever their names, by all but the last stage, which returns its own columns only; an empty
table gives no rows. Ids may be null and may repeat: rows are told apart by id and text. What a stage does with them
beyond that is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bag_minhash, decontaminate, secret_scan, spm_codec, toxicity
from annalist.llm.common import remainder, stable, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labelled rows among docs.

    Each row is judged by its text alone: equal texts go or stay together, and an empty text has the score of the
    classifier's intercept. Rows with a null id are judged, but not learnt from. Without labels of both kinds the score is the share of toxic labels.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", lambda c: remainder(c, 4) != 2)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; a null id comes last.

    Of rows equal in id and text one stays; of rows equal in id alone, that with the smallest hash. All texts without words are one group.
    """
    return bag_minhash.keep_first(docs, "doc_id", "text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go, whatever their id. Empty texts and items hold and match nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. A column n_chars follows the text and is null with it. Rows are taken one by one."""
    forest = secret_scan.train(secret_scan.findings(spark), secret_scan.vocabulary(tokenizer_path()))
    out = secret_scan.redact(docs, "text", "source", forest)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the digests of ids and decoded text: one row per row, with its id, null ones too. An empty text has no ids."""
    return spm_codec.digests(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: No stage but the last could be told in SQL: see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages read their input several times, so all but the last are stored, once each."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
