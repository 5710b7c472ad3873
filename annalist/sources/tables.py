"""Readers: tables by name, JSON lines of analyses, chat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.graph import ancestry

CHAT_SCHEMA = "conversation_id string, id string, title string, create_time double, update_time double, current_node string, mapping map<string, struct<id:string,parent:string,message:struct<id:string,author:struct<role:string,name:string>,create_time:double,content:struct<content_type:string,parts:array<string>>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, path: str, result_schema: str) -> DataFrame:
    """JSON lines: result (parsed), failed (an error, or no result). Blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"result {result_schema}, error string").alias("r"))
    return parsed.select("r.result", (F.col("r.result").isNull() | F.col("r.error").isNotNull()).alias("failed"))


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of an export (arrays of conversations), the latest update of each id; of equal updates the later record: by file, then by place, as one task reads a whole file."""
    raw = spark.read.schema(CHAT_SCHEMA).json(path, multiLine=True).withColumn("seq", F.struct("_metadata.file_path", F.monotonically_increasing_id()))
    raw = raw.withColumn("conversation", F.coalesce("conversation_id", "id", F.sha2(F.to_json(F.struct("*")), 256)))
    w = W.partitionBy("conversation").orderBy(F.coalesce("update_time", F.lit(0.0)).desc(), F.desc("seq"))
    return raw.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "seq")


def chat_messages(conversations: DataFrame) -> DataFrame:
    """Messages of an export with their parent node: conversation, node, parent, role, text, created."""
    n = conversations.select("conversation", F.explode("mapping").alias("node", "v"))
    text = F.array_join(F.filter(F.col("v.message.content.parts"), lambda p: F.trim(p) != ""), "\n\n")
    t = F.col("v.message.create_time")
    return n.where("v.message is not null").select("conversation", "node", F.col("v.parent").alias("parent"), F.col("v.message.author.role").alias("role"), text.alias("text"), F.timestamp_millis(F.when(t > 1e10, t).otherwise(t * 1000).cast("long")).alias("created"))


def active_paths(conversations: DataFrame) -> DataFrame:
    """conversation, path: nodes with a message from the root to the current node, walked inside the row; a cycle ends the walk."""
    m = F.col("mapping")
    start = F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("met"))

    def step(acc: Column, _: Column) -> Column:
        stop = acc["at"].isNull() | ~F.coalesce(F.map_contains_key(m, F.coalesce(acc["at"], F.lit(""))), F.lit(False)) | F.array_contains(acc["met"], F.coalesce(acc["at"], F.lit("")))
        return F.struct(F.when(~stop, F.try_element_at(m, acc["at"])["parent"]).alias("at"), F.when(stop, acc["met"]).otherwise(F.array_append(acc["met"], acc["at"])).alias("met"))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("mapping"))), start, step)["met"]
    return conversations.select("conversation", F.reverse(F.filter(walked, lambda n: F.try_element_at(m, n)["message"].isNotNull())).alias("path"))


def message_edges(conversations: DataFrame) -> DataFrame:
    """conversation, src, dst: each message under its nearest ancestor that has a message."""
    n = conversations.select("conversation", F.explode("mapping").alias("node", "v")).select("conversation", "node", F.col("v.parent").alias("parent"), F.col("v.message").isNotNull().alias("has"))
    near = ancestry(n, "conversation", "node", "parent", F.col("has"))
    return near.join(n.where("has").select("conversation", "node"), ["conversation", "node"]).where("nearest is not null").select("conversation", F.col("nearest").alias("src"), F.col("node").alias("dst"))


def block(content_type: Column, text: Column) -> Column:
    """A content part as struct<type,text>: code stays code, text kinds are text, media keep their kind, all else is the provider's."""
    t = F.coalesce(content_type, F.lit("text"))
    kind = F.when(t.isin("text", "multimodal_text"), "text").when(t == "code", "code").when(t.rlike("image"), "image").when(t.rlike("audio"), "audio").otherwise("provider")
    return F.struct(kind.alias("type"), text.alias("text"))


def render(blocks: Column, markdown: bool = False) -> Column:
    """Blocks as text, blank ones dropped, joined by an empty line; in markdown, code gets a fence longer than any run of backticks in it."""

    def one(b: Column) -> Column:
        runs = F.array_max(F.transform(F.regexp_extract_all(b["text"], F.lit("`+"), F.lit(0)), F.length))
        fence = F.rpad(F.lit(""), F.greatest(F.lit(3), F.coalesce(runs, F.lit(0)) + 1), "`")
        return F.when(b["type"] == "code", F.concat(fence, F.lit("\n"), b["text"], F.lit("\n"), fence)).otherwise(b["text"]) if markdown else b["text"]

    return F.array_join(F.transform(F.filter(blocks, lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != ""), one), "\n\n")
