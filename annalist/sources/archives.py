"""Export files: which of them are read, under which names, and what their records are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annalist.sources.tables import CHAT_SCHEMA

# The limits of an export.
MOST_FILES, MOST_BYTES, MOST_JSON_BYTES = 100_000, 20 << 30, 1 << 30
# Names of the files that hold conversations or tell whose they are.
CONVERSATION_FILE, OWNER_FILES = r"(?i)^conversations(?:[-_]?\d+)?\.json$", ("user.json", "account.json")


def entry_fault(path: Column) -> Column:
    """Why an entry of an archive is not accepted: empty, absolute or upward; null if it is. Backslashes separate like slashes."""
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    return F.when((p == "") | p.contains("\x00"), "empty").when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), "absolute").when(F.exists(F.split(p, "/"), lambda x: x == ".."), "upward")


def unwrapped(files: DataFrame) -> DataFrame:
    """files (path) without the directory that all of them share, where there are two files or more."""
    p = F.translate("path", "\\", "/")
    head = F.substring_index(p, "/", 1)
    shape = files.agg(F.count("*").alias("n"), F.min(F.when(p.contains("/"), head).otherwise("")).alias("a"), F.max(F.when(p.contains("/"), head).otherwise("")).alias("b"))
    d = files.crossJoin(F.broadcast(shape.select("n", "a", "b")))
    shared = (F.col("n") >= 2) & (F.col("a") == F.col("b")) & (F.col("a") != "")
    return d.withColumn("path", F.when(shared, F.substring(p, F.length("a") + 2, F.length(p))).otherwise(p)).select(*files.columns)


def checked(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (path, size) as they are to be read, unwrapped; raises if an entry is not accepted or there is too much."""
    seen = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min(F.when(entry_fault(F.col("path")).isNotNull(), F.col("path"))).alias("fault"), F.count(F.when(entry_fault(F.col("path")).isNotNull(), 1)).alias("faults")).first()
    if seen["faults"]:
        raise ValueError(f"unsafe path in export: {seen['fault']}")
    if seen["n"] > most_files or seen["bytes"] > most_bytes:
        raise ValueError(f"export of {seen['n']} files and {seen['bytes']} bytes exceeds {most_files} files or {most_bytes} bytes")
    return unwrapped(files)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size, location of every file below a folder that Spark can read; no content is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("location"), F.col("length").alias("size"))
    base = root.rstrip("/").split("://")[-1]
    return d.select(F.substring_index("location", f"{base}/", -1).alias("path"), "size", "location")


def conversation_files(files: DataFrame) -> DataFrame:
    return files.where(F.substring_index("path", "/", -1).rlike(CONVERSATION_FILE))


def owner_file(files: DataFrame) -> DataFrame:
    """The first file that tells whose export it is, at most one row."""
    return files.where(F.lower(F.substring_index("path", "/", -1)).isin(*OWNER_FILES)).orderBy("path").limit(1)


def payloads(texts: DataFrame, schema: str = CHAT_SCHEMA) -> DataFrame:
    """Conversations of JSON texts (path, text): arrays of them, {"conversations": [...]} or a single one. path, place, and the record's fields.

    A text that is none of these gives one row with fault; place counts a file's records, so what is later in a file stays later.
    """
    d = texts.select("path", F.from_json("text", f"array<struct<{_fields(schema)}>>").alias("many"), F.from_json("text", f"conversations array<struct<{_fields(schema)}>>").alias("held"), F.from_json("text", schema).alias("one"), F.trim("text").alias("t"))
    single = F.col("one.mapping").isNotNull() | F.col("one.conversation_id").isNotNull() | F.col("one.id").isNotNull()
    records = F.when(F.col("t").startswith("["), F.col("many")).when(F.col("held.conversations").isNotNull(), F.col("held.conversations")).when(single, F.array("one"))
    e = d.select("path", F.posexplode_outer(records).alias("place", "r"), records.isNull().alias("fault"))
    return e.where("fault or r is not null").select("path", "place", "r.*", "fault")


def _fields(schema: str) -> str:
    """A list of columns in the syntax of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def latest_conversations(records: DataFrame) -> DataFrame:
    """The latest update of each conversation; of equal updates the later record (by path and place). A record without an id is named by its content."""
    named = records.withColumn("conversation", F.coalesce("conversation_id", "id", F.sha2(F.to_json(F.struct(*(c for c in records.columns if c not in ("path", "place", "fault")))), 256)))
    w = W.partitionBy("conversation").orderBy(F.coalesce("update_time", F.lit(0.0)).desc(), F.desc("path"), F.desc("place"))
    return named.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def receipt_key(digest: Column, importer: str, raw: bool = True) -> Column:
    """Where the receipt of an import is kept: by the archive's digest, the importer's version and the profile."""
    return F.concat(F.lit("imports/openai/"), digest, F.lit(f"/{importer}/{'raw' if raw else 'normalized'}.json"))


# The paths of a vault that make up its history.
VAULT_PATHS = (r"^sources/[^/]+/[^/]+/source\.json$", r"^imports/.*\.json$", r"^conversations/[^/]+/[^/]+/manifest\.json$")


def relevant(path: Column) -> Column:
    out = F.lit(False)
    for p in VAULT_PATHS:
        out = out | path.rlike(p)
    return out


def issue_artifacts(issues: DataFrame) -> DataFrame:
    """artifact, kind, provider, repository, number, url, revision, blocks of issues (repository, number, revision, updated_at, observed_at, title, body, url)."""
    name = F.concat(F.lit("github:"), "repository", F.lit("#"), F.col("number").cast("string"))
    part = lambda k, kind, style, c: F.struct(F.concat(name, F.lit(f"/{k}")).alias("block"), F.lit(kind).alias("type"), F.col(c).alias("text"), F.lit(style).alias("format"))
    return issues.select(name.alias("artifact"), F.lit("github.issue").alias("kind"), F.lit("github").alias("provider"), "repository", "number", "url", F.coalesce("revision", "updated_at", "observed_at", F.lit("unversioned")).alias("revision"), F.array(part("title", "title", "plain", "title"), part("body", "markdown", "github-markdown", "body")).alias("blocks"))
