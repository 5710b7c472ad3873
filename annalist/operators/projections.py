"""Derived tables that are brought up to date: what is stale, what is new, and what a rewritten history resets."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(sources: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """The sources whose digest is not the one stored for their key; null differs from any. sources: key, digest and more. stored: key, digest."""
    old = stored.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    return sources.join(old, F.col(key).eqNullSafe(F.col("__k")), "left").where(~F.col(digest).eqNullSafe(F.col("__d"))).drop("__k", "__d")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def index_vectors(sources: DataFrame, stored: DataFrame, key: str, text: str, encode: Callable[[Column], Column], model: str, limit: int | None = None) -> DataFrame:
    """stored (key, model, digest, vector) with the vectors of sources that are new or changed, for a model's fingerprint.

    The digest is of key and text, so only changed texts are encoded; a limit takes the first keys, so that repeated runs
    come to an end. encode: a vectorised function of a text column.
    """
    digest = F.sha2(F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))), 256)
    mine = stored.where(F.col("model") == model)
    todo = pending(sources.select(key, text, digest.alias("digest")), mine, key, "digest")
    todo = todo.orderBy(key).limit(limit) if limit else todo
    new = todo.select(key, F.lit(model).alias("model"), "digest", encode(F.col(text)).alias("vector"))
    return stored.where(F.col("model") != model).unionByName(upserted(mine, new, key))


def stale(state: DataFrame, counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, stale: whether any of the names differs from what the state says, or there is no state."""
    was = state.select(F.col(key).alias("__k"), *(F.col(n).alias(f"__{n}") for n in names))
    same = F.col("__k").isNotNull()
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return counts.join(was, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, (~same).alias("stale"))


def resets(checkpoints: DataFrame, refs: DataFrame, reached: DataFrame) -> DataFrame:
    """ref, reason of the indexed refs that force a rebuild: missing (no such ref now), or rewritten (the checkpoint is not in its history).

    checkpoints: ref, oid (null: nothing indexed yet). refs: ref. reached: ref, oid of all commits of a ref.
    """
    now = refs.select("ref").distinct().withColumn("__now", F.lit(True))
    seen = reached.select("ref", "oid").distinct().withColumn("__seen", F.lit(True))
    d = checkpoints.join(now, "ref", "left").join(seen, ["ref", "oid"], "left")
    reason = F.when(F.col("__now").isNull(), "missing").when(F.col("oid").isNotNull() & F.col("__seen").isNull(), "rewritten")
    return d.withColumn("reason", reason).where("reason is not null").select("ref", "reason")


def to_index(checkpoints: DataFrame, commits: DataFrame, reset: bool) -> DataFrame:
    """The commits (ref, position, oid) after each ref's checkpoint; all of them where there is none, or after a reset."""
    at = checkpoints.join(commits, ["ref", "oid"]).groupBy("ref").agg(F.max("position").alias("__at"))
    d = commits.join(at, "ref", "left")
    return d.where(F.lit(reset) | F.col("__at").isNull() | (F.col("position") > F.col("__at"))).drop("__at")


def merged_mentions(mentions: DataFrame, keys: list[str], weight: str, arrays: list[str]) -> DataFrame:
    """One row per key: the greatest weight, and the sorted union of each array column; a null array is empty."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())))))
    return mentions.groupBy(*keys).agg(F.max(weight).alias(weight), *(union(c).alias(c) for c in arrays))


def heads(sources: DataFrame) -> DataFrame:
    """The indexed sources with the commit that each was read to, by ref."""
    return sources.select("ref", "provider", "source_key", "completeness", "head", "indexed_at").orderBy("ref")


def vector_blob(vector: Column) -> Column:
    """A vector as 32-bit little-endian floats; null stays null."""

    @F.pandas_udf("binary")
    def write(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return write(vector)


def blob_vector(blob: Column, dimensions: int) -> Column:
    """The vector of a blob; null where it does not have so many dimensions."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if len(b) == 4 * dimensions else None, na_action="ignore")

    return read(blob)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where a text is no JSON, and null for numbers that are not finite."""

    def one(t: str) -> str | None:
        try:
            return json.dumps(json.loads(t, parse_constant=lambda _: None), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return written(text)
