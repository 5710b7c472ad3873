"""Incremental ingestion: append what is new by content key, once per key, with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def only_new(facts: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """facts without the keys that are stored already, each key once."""
    return facts.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def ingest(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append a stream of facts to a Parquet table. A batch that is repeated after a failure adds nothing twice.

    Runs over what is available and stops (availableNow), so the same call serves a schedule.
    """

    def append(batch: DataFrame, _id: int) -> None:
        try:
            stored = batch.sparkSession.read.parquet(target)
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            batch.dropDuplicates(keys).write.parquet(target)
            return
        only_new(batch, stored, keys).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive(spark: SparkSession, facts: DataFrame, target: str, receipts: str, receipt: str, keys: list[str]) -> int:
    """Append a batch under a receipt and return how many facts are new; a receipt that is there already adds nothing.

    The receipt is written last: after a failure in between, the same call finds the facts by key and writes the rest.
    """

    def stored(path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    done = stored(receipts)
    if done is not None and not done.where(F.col("receipt") == receipt).isEmpty():
        return 0
    old = stored(target)
    before = old.count() if old is not None else 0
    (only_new(facts, old, keys) if old is not None else facts.dropDuplicates(keys)).write.mode("append").parquet(target)
    n = spark.read.parquet(target).count() - before
    spark.createDataFrame([(receipt, n)], "receipt string, facts long").write.mode("append").parquet(receipts)
    return n
