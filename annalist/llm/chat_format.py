"""Chat formatting from an event log, in DataFrame functions only.

A log has one row per event: conversation, message, order (the message's place in its
conversation), seq (the event's place), kind, role and text. Kinds:

    message     the message's text, replacing what came before
    delta       appended to the text
    edit        replaces the text so far; deltas after it are appended
    regenerate  discards the text so far; a new one is streamed by later deltas
    delete      removes the message, unless a later event brings it back

`fold` partitions the log by message and seq and keeps what follows the last event that replaces the
text, and the last role that an event names; `render` writes each conversation in the template, with the spans of its loss mask;
`read_back` parses a rendered conversation. Events of one message are gathered per message first, so
a long conversation costs one row per message when it is put together; its rendered text is one
value by nature.

Template: <turn role="ROLE">TEXT</turn>, one line break after each. In roles and texts the backslash
becomes \\b, "<" becomes \\l and the quotation mark \\q, so no text can hold a control string.

Defined results: null texts and roles = empty; an unknown kind counts as delta; events with equal seq
are taken in the order of kind, role, text; messages with equal order in that of role, text, message; repeated
rows are events of their own; a null conversation is a conversation; an empty log gives no rows;
extra columns are ignored. Spans count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
LEARNT = ("assistant",)
SPANS = 64  # cut out together when read back
REPLACING = ("message", "edit", "regenerate", "delete")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def log_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log of finished turns: one message event per row, each row a message of its own.

    A message is named by its turn, a hash of role and text, and its place among the rows that are equal to it.
    """
    e = turns.select(F.col(conv).alias("conversation"), F.col(turn).cast("long").alias("order"), F.col(role).alias("role"), F.col(text).alias("text"))
    same = W.partitionBy("conversation", "order", "role", "text").orderBy("order")
    name = F.concat_ws(":", F.coalesce(F.col("order").cast("string"), F.lit("")), F.xxhash64("role", "text"), F.row_number().over(same))
    return e.select("conversation", name.alias("message"), "order", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed(log: DataFrame) -> DataFrame:
    """The log as a client would have recorded it: each message event becomes a draft and what replaced it.

    Messages to be learnt are streamed in deltas, are regenerated once on the way and streamed anew; others are
    written, edited, and get their second half as a delta. Folding it gives what folding log gives.
    """
    t, draft = F.coalesce(F.col("text"), F.lit("")), F.lit("a draft </turn> \\l of ")
    half = F.floor(F.length(t) / 2).cast("int")
    head, tail = F.substring(t, F.lit(1), half), F.substring(t, half + 1, F.length(t))
    event = lambda k, kind, text: F.struct(F.lit(k).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    learnt = F.array(event(0, "message", F.lit("")), event(1, "delta", draft), event(2, "delta", head), event(3, "regenerate", F.lit("")), event(4, "delta", head), event(5, "delta", tail))
    others = F.array(event(0, "message", F.concat(draft, tail)), event(1, "delta", head), event(2, "edit", head), event(3, "delta", tail))
    return log.select("conversation", "message", "order", "role", F.explode(F.when(F.col("role").isin(*LEARNT), learnt).otherwise(others)).alias("e")).select("conversation", "message", "order", "e.seq", "e.kind", "role", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """The final messages: conversation, message, order, role, text."""
    empty = F.lit("")
    e = log.select("conversation", "message", "order", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    place = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "kind", "role", "text")
    mine = W.partitionBy("conversation", "message")
    e = e.withColumn("place", place).withColumn("reset", F.max(F.when(F.col("kind").isin(*REPLACING), F.col("place"))).over(mine))
    e = e.withColumn("counts", F.col("reset").isNull() | (F.col("place") >= F.col("reset")))
    g = e.groupBy("conversation", "message").agg(
        F.min("order").alias("order"),
        F.max_by("kind", "place").alias("last"),
        F.coalesce(F.max_by(F.when(F.col("role") != "", F.col("role")), F.when(F.col("role") != "", F.col("place"))), empty).alias("role"),
        F.array_sort(F.collect_list(F.when(F.col("counts") & ~F.col("kind").isin("regenerate", "delete"), F.struct("place.seq", "place.kind", "place.role", "text")))).alias("parts"),
    )
    return g.where(F.col("last") != "delete").select("conversation", "message", "order", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conversation, formatted, loss array<struct<start,end>>."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    m = messages.select("conversation", "order", "role", "text", "message", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    w = W.partitionBy("conversation").orderBy("order", "role", "text", "message")
    m = m.withColumn("at", (F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece")).cast("int"))
    span = F.when(F.col("role").isin(*LEARNT), F.struct((F.col("at") + F.length("head")).alias("start"), (F.col("at") + F.length("head") + F.length("body")).alias("end")))
    g = m.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss"))
    return g.select("conversation", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse the output: conversation, turns array<struct<role,text>>, learnt (the text under the loss mask), formatted.

    The spans (in order) are cut out by blocks: first the text of each block, then its spans out of that, so a long
    conversation is not counted through from its front for each span.
    """
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    inner = len(OPEN) + len(MIDDLE)

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, f"^{OPEN}([^\"]*){MIDDLE}", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, F.length(role) + inner + 1, F.length(p))).alias("text"))

    count = F.greatest(F.ceil(F.size("loss") / SPANS), F.lit(1)).cast("int")
    blocks = F.filter(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("loss", i * SPANS + 1, SPANS)), lambda b: F.size(b) > 0)
    cut = F.transform(blocks, lambda b: F.struct(b.alias("spans"), b[0]["start"].alias("at"), F.substring("formatted", b[0]["start"] + 1, F.element_at(b, -1)["end"] - b[0]["start"]).alias("text")))
    texts = F.transform(cut, lambda b: F.transform(b["spans"], lambda s: unescape(F.substring(b["text"], s["start"] - b["at"] + 1, s["end"] - s["start"]))))
    return rendered.select("conversation", F.transform(pieces, turn).alias("turns"), F.array_join(F.flatten(texts), "").alias("learnt"), "formatted")
