"""Names of things as column expressions: ids of entities, keys of sources, and the paths that digests are kept under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(value: Column) -> Column:
    """A value as a part of an id, percent-encoded; null counts as unknown."""
    out = F.replace(F.url_encode(F.coalesce(value.cast("string"), F.lit("unknown"))), F.lit("+"), F.lit("%20"))
    for c in "!'()~":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def entity_id(space: str, provider: Column, source: Column, kind: Column, own: Column) -> Column:
    return F.concat_ws(":", F.lit(space), part(provider), part(source), part(kind), part(own))


def source_key(provider: Column, identity: Column) -> Column:
    return F.concat(provider, F.lit("-"), path_key(F.concat(provider, F.lit("\0"), F.coalesce(identity.cast("string"), F.lit("default"))), 24))


def path_key(value: Column, length: int = 40) -> Column:
    """The first hex digits of the digest of a value."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def digest_path(prefix: str, digest: Column, filename: str = "record.json") -> Column:
    """prefix/first two digits/digest/filename; null for what is no digest."""
    return F.when(digest.rlike("^[A-Fa-f0-9]{32,128}$"), F.concat_ws("/", F.lit(prefix), F.substring(digest, 1, 2), digest, F.lit(filename)))


def provider_segment(provider: Column) -> Column:
    """A provider in a path: lower case; null if it may not stand there."""
    low = F.lower(F.coalesce(provider, F.lit("unknown")))
    return F.when(low.rlike("^[a-z0-9][a-z0-9-]{0,63}$"), low)


def source_ref(space: str, provider: Column, source: Column) -> Column:
    return F.concat(F.lit(f"refs/{space}/sources/"), provider_segment(provider), F.lit("/"), path_key(source, 32))


def source_path(provider: Column, source: Column) -> Column:
    return F.concat(F.lit("sources/"), provider_segment(provider), F.lit("/"), path_key(source), F.lit("/source.json"))


def is_source_ref(space: str, ref: Column) -> Column:
    r = F.coalesce(ref, F.lit(""))
    return r.startswith(f"refs/{space}/sources/") & r.rlike("^refs/[A-Za-z0-9._/-]+$") & ~r.contains("..") & ~r.contains("//") & ~r.endswith("/")


def message_paths(normalized: Column, raw: Column) -> Column:
    """Where a message is kept: struct<normalized,raw>."""
    return F.struct(digest_path("messages", normalized, "message.json").alias("normalized"), digest_path("raw/messages", raw, "message.json").alias("raw"))


def conversation_paths(entity: Column, raw: Column) -> Column:
    """Where a conversation is kept: struct<manifest,raw>."""
    key = F.sha2(entity, 256)
    return F.struct(F.concat_ws("/", F.lit("conversations"), F.substring(key, 1, 2), key, F.lit("manifest.json")).alias("manifest"), digest_path("raw/conversations", raw, "conversation.json").alias("raw"))


def files_fingerprint(files: DataFrame) -> DataFrame:
    """One row, fingerprint: a digest over all files (path, size, sha256) in order of their paths. An export has a bounded number of files."""
    line = F.concat("path", F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), "sha256", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), ""), 256).alias("fingerprint"))
