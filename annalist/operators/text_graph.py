"""Text graphs of messages: sentences, references, propositions and speech acts as nodes with byte anchors, and their edges.

Everything is made from column expressions: each sentence gives an array of nodes and one of edges, which are exploded
(outer, as plain explode would have them computed once more in a filter on their size). Ids are digests of what a node
is, so the graph is the same wherever it is computed, and a reference that several sentences of a message share is one
node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as T

Registry = Mapping[str, tuple[str, str, Sequence[str]]]

# The layer of each speech act, the layers of the projections.
ACT_LAYER = {"request": "work", "constraint": "work", "proposal": "work", "decision": "work", "status": "work", "rationale": "work", "question": "discourse", "rejection": "discourse", "acceptance": "discourse", "correction": "discourse"}
PROJECTIONS = {"source": ("source",), "concepts": ("reference", "semantic"), "work": ("discourse", "work")}


def _id(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def _sentences(messages: DataFrame, key: str, text: str, registry: Registry | None) -> DataFrame:
    d = messages.select(F.col(key).alias("message"), F.explode_outer(T.spans(F.col(text))).alias("s")).where("s is not null")
    sid = _id(F.lit("sentence"), F.col("message"), F.col("s.start"), F.col("s.end"))
    return d.select("message", "s", sid.alias("sid"), T.entities(F.col("s.text"), registry).alias("refs"), T.speech_acts(F.col("s.text")).alias("acts"), F.col("s.text").rlike(r"[\p{L}\p{N}]").alias("says"))


def _layer(kind: Column) -> Column:
    return F.when(kind.isin([k for k, v in ACT_LAYER.items() if v == "work"]), "work").otherwise("discourse")


def nodes(messages: DataFrame, key: str, text: str, registry: Registry | None = None) -> DataFrame:
    """message, node, layer, kind, label, start, end: bytes of the first anchor; key must be unique and not null, a text without a sentence gives its message node only."""
    m = F.col("message")

    def node(i: Column, layer: Column, kind: Column, label: Column) -> Column:
        return F.struct(i.alias("node"), layer.alias("layer"), kind.alias("kind"), label.alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))

    l = F.lit
    label = T.compact(F.col("s.text"))
    said = F.when(F.col("says"), F.concat(F.array(node(_id(l("proposition"), F.col("sid")), l("semantic"), l("proposition"), label)), F.transform("acts", lambda a: node(_id(l("act"), a["kind"], F.col("sid")), _layer(a["kind"]), a["kind"], a["kind"]))))
    refs = F.transform("refs", lambda r: node(_id(l("entity"), m, r["key"]), l("reference"), r["kind"], r["label"]))
    own = F.array(node(F.col("sid"), l("source"), l("sentence"), label))
    cut = _sentences(messages, key, text, registry)  # acts are computed for the first branch only, references for the second
    made = cut.select("message", F.explode_outer(F.concat(own, F.coalesce(said, F.slice(own, 1, 0)))).alias("n")).select("message", "n.*")
    referred = cut.select("message", F.explode_outer(refs).alias("n")).where("n is not null").select("message", "n.*")
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    top = messages.select(F.col(key).alias("message"), size.alias("end")).select("message", _id(l("message"), m).alias("node"), l("source").alias("layer"), l("message").alias("kind"), l("message").alias("label"), l(0).cast("long").alias("start"), "end")
    first = F.min(F.struct("start", "end", "label", "layer", "kind")).alias("x")
    shared = referred.groupBy("message", "node").agg(first).select("message", "node", "x.layer", "x.kind", "x.label", "x.start", "x.end")
    return top.unionByName(made).unionByName(shared)


def edges(messages: DataFrame, key: str, text: str, registry: Registry | None = None) -> DataFrame:
    """message, src, dst, kind, layer, confidence."""
    l, sid = F.lit, F.col("sid")
    prop = _id(l("proposition"), sid)

    def edge(a: Column, b: Column, kind: Column, layer: Column, confidence: Column) -> Column:
        return F.struct(a.alias("src"), b.alias("dst"), kind.alias("kind"), layer.alias("layer"), confidence.cast("double").alias("confidence"))

    entity = lambda r: _id(l("entity"), F.col("message"), r["key"])
    one = F.array(edge(_id(l("message"), F.col("message")), sid, l("source:contains"), l("source"), l(1)))
    mentions = F.transform("refs", lambda r: edge(sid, entity(r), l("reference:mentions"), l("reference"), l(1)))
    grounded = F.array(edge(prop, sid, l("source:grounded-in"), l("semantic"), l(1)))
    about = F.transform("refs", lambda r: edge(prop, entity(r), l("semantic:about"), l("semantic"), l(1)))
    acts = F.transform("acts", lambda a: edge(_id(l("act"), a["kind"], sid), prop, F.concat(_layer(a["kind"]), l(":qualifies")), _layer(a["kind"]), a["confidence"]))
    said = F.when(F.col("says"), F.concat(grounded, about, acts)).otherwise(F.slice(one, 1, 0))
    return _sentences(messages, key, text, registry).select("message", F.explode_outer(F.concat(one, mentions, said)).alias("e")).select("message", "e.*").distinct()


def missing(messages: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """The messages that have no graph yet; nodes() and edges() of them are what is to be appended. stored: nodes that are there."""
    return messages.join(stored.select(F.col("message").alias(key)).distinct(), key, "left_anti")


def project(n: DataFrame, e: DataFrame, projection: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a projection: source, concepts, or work, which takes in what it touches in the semantic and reference layers, two steps far."""
    if projection not in PROJECTIONS:
        raise ValueError(f"unknown projection {projection}")
    chosen = n.where(F.col("layer").isin(*PROJECTIONS[projection])).select("message", "node")
    if projection == "work":
        near = n.where("layer in ('semantic', 'reference')").select("message", "node")
        both = e.select("message", "src", "dst").unionByName(e.select("message", F.col("dst").alias("src"), F.col("src").alias("dst")))
        for _ in range(2):
            step = both.join(chosen.withColumnRenamed("node", "src"), ["message", "src"], "left_semi").select("message", F.col("dst").alias("node"))
            chosen = chosen.unionByName(step.join(near, ["message", "node"], "left_semi")).distinct()
    ends = lambda c: chosen.withColumnRenamed("node", c)
    return n.join(chosen, ["message", "node"], "left_semi"), e.join(ends("src"), ["message", "src"], "left_semi").join(ends("dst"), ["message", "dst"], "left_semi")
