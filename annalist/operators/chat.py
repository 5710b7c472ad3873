"""Search and context over message revisions and their observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import token_estimate, truncated_bytes
from annalist.operators.context import neighbours, pack
from annalist.operators.history import latest
from annalist.operators.search import bm25


def current(observations: DataFrame, source: str | None = None) -> DataFrame:
    """The newest observation of each message among the allowed sources; a filter by source changes what is current."""
    o = observations.where(F.col("source") == source) if source else observations
    return latest(o, ["message"], [F.desc_nulls_last("observed"), F.desc("seq")])


def conversation_heads(observations: DataFrame) -> DataFrame:
    """The newest observation of each conversation: by when it was committed or else observed (text; missing comes last), then by seq."""
    return latest(observations, ["conversation"], [F.desc(F.coalesce("committed", "observed", F.lit(""))), F.desc("seq")])


def with_receipts(observations: DataFrame, receipts: DataFrame) -> DataFrame:
    """observations (source, commit and more) with archive, that of the first receipt of their commit by its path. receipts: source, commit, path, archive."""
    first = receipts.groupBy("source", "commit").agg(F.min_by("archive", "path").alias("archive"))
    return observations.join(first, ["source", "commit"], "left")


def capped(messages: DataFrame, most_messages: int, most_bytes: int, each: int = 32 << 10) -> DataFrame:
    """What a client may see of each conversation: conversation, ordinal, content, cut. messages: conversation, ordinal, text.

    Messages come in order while bytes are left; none is longer than each nor than what is left, and the first that had to be cut is the last one.
    """
    w = W.partitionBy("conversation").orderBy("ordinal")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = messages.select("conversation", "ordinal", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.row_number().over(w)).withColumn("size", F.octet_length("text").cast("long"))
    d = d.withColumn("spent", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("long", F.coalesce(F.max("size").over(before), F.lit(0)))
    # as long as nothing was cut, all sizes are whole: what was spent tells what is left
    d = d.where((F.col("place") <= most_messages) & (F.col("long") <= each) & ((F.col("place") == 1) | (F.col("spent") < most_bytes)))
    limit = F.least(F.lit(each), F.lit(most_bytes) - F.col("spent")).cast("int")
    return d.select("conversation", "ordinal", truncated_bytes(F.col("text"), limit).alias("content"), (F.col("size") > limit).alias("cut"))


def search_messages(revisions: DataFrame, observations: DataFrame, query: str | Sequence[str], limit: int = 20, role: str | None = None, since: Column | None = None, until: Column | None = None, source: str | None = None, historical: bool = False) -> DataFrame:
    """The best messages: message, revision, conversation, score.

    revisions: revision, text. observations: message, revision, conversation, source, role, created, observed, seq.
    Candidates are cut before the filters, as the model says: filters can leave fewer rows than limit.
    """
    if since is not None and until is not None and observations.sparkSession.range(1).select((since > until).alias("x")).first()["x"]:
        raise ValueError("since is later than until")
    limit = max(1, min(500, limit))
    n = min(5000, max(8 * limit, 80) if historical else max(30 * limit, 300))
    hits = bm25(revisions, ["revision"], F.col("text"), query, n)
    seen = latest(observations.where(F.col("source") == source) if source else observations, ["message", "revision"], [F.desc_nulls_last("observed"), F.desc("seq")]) if historical else current(observations, source)
    d = hits.join(seen, "revision")
    if role:
        d = d.where(F.col("role") == role)
    if since is not None:
        d = d.where(F.col("created").isNull() | (F.col("created") >= since))
    if until is not None:
        d = d.where(F.col("created").isNull() | (F.col("created") <= until))
    return d.select("message", "revision", "conversation", "score").orderBy(F.desc("score"), "revision", "message").limit(limit)


def context_bundle(turns: DataFrame, query: Sequence[str], budget: int = 12000, conversations: int = 8, radius: int = 2) -> DataFrame:
    """The turns to cite for a query: conv_id, turn, priority, used. turns: conv_id, turn, text.

    The best hits choose the conversations, each conversation shares its hits with the neighbours within radius,
    and every conversation's share of the budget is packed by priority and place.
    """
    return _packed(turns, query, budget, conversations, radius).select("conv_id", "turn", "priority", "used")


def _packed(turns: DataFrame, query: Sequence[str], budget: int, conversations: int, radius: int) -> DataFrame:
    """context_bundle with top, the best score of the conversation."""
    hits = bm25(turns, ["conv_id", "turn"], F.col("text"), query, max(60, 12 * conversations))
    best = hits.groupBy("conv_id").agg(F.max("score").alias("top")).orderBy(F.desc("top"), "conv_id").limit(conversations)
    chosen = neighbours(turns, hits.join(best, "conv_id", "left_semi"), "conv_id", "turn", radius).join(F.broadcast(best), "conv_id")
    costed = chosen.select("conv_id", "turn", "priority", "top", (token_estimate(F.col("text")) + 18).alias("cost"))
    return pack(costed, "conv_id", ["priority", "turn"], "cost", budget // conversations, ["turn", "priority", "top"])


def context_document(turns: DataFrame, query: Sequence[str], budget: int = 12000, conversations: int = 8, radius: int = 2) -> DataFrame:
    """One row, markdown: what context_bundle takes for a query, the best conversation first. turns: conv_id, turn, role, text."""
    taken = _packed(turns, query, budget, conversations, radius).select("conv_id", "turn", "top")
    m = turns.join(F.broadcast(taken), ["conv_id", "turn"])
    m = m.select(F.col("conv_id").alias("conversation"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), (-F.col("top")).alias("rank"), F.col("turn").alias("position"), "role", "text", F.concat_ws(":", "conv_id", "turn").alias("message"), F.sha2("text", 256).alias("revision"), (token_estimate(F.col("text")) + 18).alias("tokens"))
    return markdown(m, " ".join(query), budget)


def snapshot(observations: DataFrame, source: str | None = None) -> DataFrame:
    """The current messages of every conversation with their ordinal: the active path first, then by time and message.

    observations: message, conversation, source, observed, seq, active_position (null off the path), created, and more.
    """
    w = W.partitionBy("conversation").orderBy(F.asc_nulls_last("active_position"), F.asc_nulls_last("created"), "message")
    return current(observations, source).withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def markdown(messages: DataFrame, query: str, budget: int) -> DataFrame:
    """One row, markdown: a bundle of messages with numbered citations and where they are from.

    messages: conversation, title, rank (of the conversation), position, role, text, message, revision, tokens. Taken in order
    while their tokens fit in the budget. A message has one token at least, so no more than budget
    of them are read in order, and one task numbers and joins what fits.
    """
    order = ["rank", "conversation", "position", "message"]
    w = W.orderBy(*order)
    m = messages.orderBy(*order).limit(budget).withColumn("cite", F.concat(F.lit("H"), F.row_number().over(w)))
    m = m.withColumn("__spent", F.sum(F.greatest(F.col("tokens"), F.lit(1))).over(w)).where(F.col("__spent") <= budget)
    each = _conversations(m, ["rank", "conversation"])
    one = each.agg(F.array_sort(F.collect_list(F.struct("rank", "conversation", "part", "sources"))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    head = F.concat(F.lit(f"# Context bundle\n\n- Query: {query}\n- Messages: "), "n", F.lit("\n- Conversations: "), F.size("c"), F.lit("\n- Estimated tokens: "), "tokens", F.lit(f" / {budget}\n\n"))
    body = F.when(F.size("c") == 0, "No matching conversation context was found.").otherwise(F.array_join(F.transform("c", lambda x: x["part"]), "\n\n"))
    return one.select(F.concat(head, body, F.lit("\n\n## Provenance\n\n"), F.array_join(F.transform("c", lambda x: x["sources"]), "\n"), F.lit("\n")).alias("markdown"))


def _conversations(cited: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part (the conversation's text), sources, n, tokens. cited: messages with cite."""
    said = F.concat(F.lit("### ["), "cite", F.lit("] "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    source = F.concat(F.lit("- ["), "cite", F.lit("] message `"), F.col("message"), F.lit("`; revision `"), F.col("revision"), F.lit("`"))
    item = cited.select(*keys, "title", "position", "message", "tokens", said.alias("said"), source.alias("source"))
    each = item.groupBy(*keys).agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("position", "message", "said", "source"))).alias("m"), F.sum("tokens").alias("tokens"))
    part = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled conversation")), F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["said"]), "\n\n"))
    return each.select(*keys, part.alias("part"), F.array_join(F.transform("m", lambda x: x["source"]), "\n").alias("sources"), F.size("m").alias("n"), "tokens")


def transcripts(messages: DataFrame) -> DataFrame:
    """conversation, markdown of every conversation: its messages, cited from H1 on, and where they are from. messages: as for markdown."""
    w = W.partitionBy("conversation").orderBy("position", "message")
    each = _conversations(messages.withColumn("cite", F.concat(F.lit("H"), F.row_number().over(w))), ["conversation"])
    return each.select("conversation", F.concat("part", F.lit("\n\n## Provenance\n\n"), "sources", F.lit("\n")).alias("markdown"))


def checkpoint_status(checkpoints: DataFrame, commits: DataFrame, ancestors: DataFrame, shallow: bool = False) -> DataFrame:
    """ref, status of each checkpoint (ref, oid): empty, checkpoint-missing, blocked-shallow, ready or ref-rewritten.

    commits: oid. ancestors: ref, oid, all commits that the ref reaches. shallow: the repository lacks old commits.
    """
    known = commits.select("oid").distinct().withColumn("__known", F.lit(True))
    reached = ancestors.select("ref", "oid").distinct().withColumn("__reached", F.lit(True))
    d = checkpoints.join(known, "oid", "left").join(reached, ["ref", "oid"], "left")
    return d.select("ref", F.when(F.col("oid").isNull(), "empty").when(F.col("__known").isNull(), "checkpoint-missing").when(F.lit(shallow), "blocked-shallow").when(F.col("__reached").isNull(), "ref-rewritten").otherwise("ready").alias("status"))
