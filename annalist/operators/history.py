"""Revisions over time: latest states, transitions, histories, gaps, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order given (newest first)."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def transitions(log: DataFrame, entity: Sequence[str], order: Sequence[str], digest: str, path: str, deleted: str | None = None) -> DataFrame:
    """log with prior and kind: each observation against the revision (entity and digest) that was inserted last.

    A revision is inserted the first time its digest occurs for the entity, so going back to an old digest does not
    make it the prior one. moved compares with the path where the prior revision itself was seen last, and
    resurrected means that the prior revision was deleted. A row that is marked as deleted says that the path is gone:
    it ends the revision that was seen last at that path, which is its prior; where none was seen, kind is null.
    Windows over the entity suffice: no state is kept by hand.
    """
    w = W.partitionBy(*entity).orderBy(*order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    d = log.withColumn("__gone", gone).withColumn("__x", F.when(~F.col("__gone"), F.struct(F.col(digest).alias("digest"), F.col(path).alias("path"))))
    first = (F.row_number().over(W.partitionBy(*entity, "__gone", digest).orderBy(*order)) == 1) & ~F.col("__gone")
    here = F.last("__x.digest", ignorenulls=True).over(W.partitionBy(*entity, path).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("__first", first).withColumn("__here", F.when(F.col("__gone"), here))
    d = d.withColumn("__prior", F.last(F.when(F.col("__first"), F.col("__x")), ignorenulls=True).over(past)["digest"])
    # what happened to the prior revision: where it was seen, and from when on it counts as deleted
    seen = F.when(F.col("__first") | (~F.col("__gone") & F.col(digest).eqNullSafe(F.col("__prior"))), F.col("__x"))
    ended = F.when(F.col("__first"), False).when(F.col("__gone") & (F.col("__here") == F.col("__prior")), True)
    d = d.withColumn("__seen", F.last(seen, ignorenulls=True).over(past)["path"]).withColumn("__ended", F.coalesce(F.last(ended, ignorenulls=True).over(past), F.lit(False)))
    prior = F.col("__prior")
    kind = F.when(prior.isNull(), "introduced").when(F.col("__ended"), "resurrected").when(prior != F.col(digest), "modified").when(~F.col("__seen").eqNullSafe(F.col(path)), "moved").otherwise("unchanged")
    d = d.withColumn("prior", F.when(F.col("__gone"), F.col("__here")).otherwise(prior)).withColumn("kind", F.when(~F.col("__gone"), kind).when(F.col("__here").isNotNull(), "deleted"))
    return d.drop("__gone", "__x", "__first", "__here", "__prior", "__seen", "__ended")


def merge_latest(a: DataFrame, b: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Last writer wins; equal times go to the greater tie value."""
    return latest(a.unionByName(b), [key], [F.desc(time), F.desc(tie)])


def gaps(facts: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    return facts.join(found, list(on), "left_anti")


def presence(facts: DataFrame, found: DataFrame, on: str, flag: str) -> DataFrame:
    seen = found.select(on).distinct().withColumn(flag, F.lit(1).cast("long"))
    return facts.join(seen, on, "left").withColumn(flag, F.coalesce(flag, F.lit(0).cast("long")))


def keep_first(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert or ignore: the row that came first."""
    return latest(rows, keys, [F.asc(seq)])


def merge_columns(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Upsert of chosen columns: known keys take update columns that are not null, all else stays; new keys come as they are."""
    new = incoming.select(*keys, *(F.col(c).alias(f"__{c}") for c in incoming.columns if c not in keys), F.lit(True).alias("__new"))
    both = stored.withColumn("__old", F.lit(True)).join(new, list(keys), "full")
    known = F.col("__old").isNotNull()
    return both.select(*keys, *(F.when(known, F.coalesce(f"__{c}", c) if c in update else F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in stored.columns if c not in keys))


def synchronise(a: DataFrame, b: DataFrame, key: str, time: str, tie: str, deleted: str, most: int) -> DataFrame:
    """Records of two sides: the last writer wins, the newest most records stay; marks of deletion take part, so a deletion survives. visible tells the rest."""
    return merge_latest(a, b, key, time, tie).orderBy(F.desc(time), key).limit(most).withColumn("visible", F.col(deleted).isNull())


def exact_lineage(previous: DataFrame, current: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """keys, kind: introduced, deleted, modified or unchanged, by identity alone."""
    p, c = previous.select(*keys, F.col(digest).alias("__p"), F.lit(1).alias("__a")), current.select(*keys, F.col(digest).alias("__c"), F.lit(1).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "introduced").when(F.col("__b").isNull(), "deleted").when(F.col("__p").eqNullSafe(F.col("__c")), "unchanged").otherwise("modified")
    return p.join(c, list(keys), "full").select(*keys, kind.alias("kind"))


def deletions(located: DataFrame, deleted: DataFrame, entity: Sequence[str], path: str, seq: str, revision: str) -> DataFrame:
    """entity, path, revision: for each deleted path, the revision of each entity that was located there last."""
    last = located.groupBy(*entity, path).agg(F.max_by(revision, seq).alias(revision))
    return last.join(deleted.select(path).distinct(), path, "left_semi").select(*entity, path, revision)


def violations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (a rule that gives null is broken)."""
    counted = records.agg(*(F.sum((~F.coalesce(r, F.lit(False))).cast("long")).alias(k) for k, r in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(k, F.lit(0)).cast("long").alias("n")) for k in rules))
    return counted.select(F.explode(pairs).alias("v")).select("v.rule", "v.n")
