"""Bounded walks over edge tables, one join per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.stable import cut


def trace(starts: DataFrame, edges: DataFrame, depth: int, sinks: Column | None = None) -> DataFrame:
    """All simple paths from starts (column node) along edges (src, dst and, if given, doubt): path, depth, terminal.

    terminal: a step into a sink ends with sink, one in doubt with its doubt (dynamic, unresolved, inferred), one back onto
    the path with cycle; where the walk stands after depth steps it ends with max-depth, without edges with leaf. The
    frontier of a step is joined with the edges; the number of steps is the depth, never the number of nodes. A
    path of n nodes is an array, so a cycle shows without a state. An unresolved step may have a null dst.
    """
    doubt = F.col("doubt") if "doubt" in edges.columns else F.lit(None).cast("string")
    step = edges.select("src", "dst", F.when(doubt != "none", doubt).alias("__doubt"))
    out_degree = edges.select(F.col("src").alias("node")).distinct().withColumn("__out", F.lit(True))
    front = starts.select("node", F.array("node").alias("path"), F.lit(None).cast("string").alias("terminal"))
    done: DataFrame | None = None
    for d in range(depth + 1):
        stands = F.lit("max-depth") if d == depth else F.when(F.col("__out").isNull(), "leaf")
        front = front.join(out_degree, "node", "left").withColumn("terminal", F.coalesce("terminal", stands))
        part = front.where("terminal is not null").select("path", F.lit(d).cast("long").alias("depth"), "terminal")
        done = part if done is None else done.unionByName(part)
        if d < depth:
            ends = F.when(sinks, "sink") if sinks is not None else F.lit(None).cast("string")
            n = front.where("terminal is null").join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "path", "__doubt")
            back = F.when(F.array_contains("path", F.col("node")), "cycle")
            front = n.select("node", F.concat("path", F.array("node")).alias("path"), F.coalesce(ends, F.col("__doubt"), back).alias("terminal"))
    return done


def branch_points(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n_children")).where("n_children > 1")


def reach(starts: DataFrame, edges: DataFrame, depth: int = 1000, every: int = 8) -> DataFrame:
    """start, node, depth: everything that starts (column node) reach along edges (src, dst), each once at its least depth.

    A step joins the new frontier only and drops what has been reached; it ends when nothing is new. Lineage is
    cut after each step, as each is used twice, and the parts of the result are gathered into one table in turn.
    """
    front = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).distinct())
    seen = front
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if d % every == 0:
            seen = cut(seen)
    return seen


def ancestry(nodes: DataFrame, group: str, node: str, parent: str, kept: Column) -> DataFrame:
    """group, node, nearest, depth, cyclic: for every node the nearest ancestor where kept holds and the distance to the root.

    Pointers jump twice as far in each round, so the rounds grow with the logarithm of the depth: a chain of a
    million replies takes twenty joins. A node whose parent is missing is a root. A node that has not met a
    root after as many rounds as the largest group needs stands on or behind a cycle; its depth is null.
    """
    d = nodes.select(group, F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(kept, F.lit(False)).alias("kept")).dropDuplicates([group, "node"])
    known = d.select(group, F.col("node").alias("up"), F.col("kept").alias("__k"))
    d = d.join(known, [group, "up"], "left").withColumn("up", F.when(F.col("__k").isNotNull(), F.col("up")))
    # near: the nearest kept node met so far; hop: steps made by the pointer
    state = cut(d.select(group, "node", "up", F.when(F.col("__k"), F.col("up")).alias("near"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hop")))
    rounds = (state.groupBy(group).count().agg(F.max("count")).first()[0] or 1).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        far = state.select(group, F.col("node").alias("up"), F.col("up").alias("__up"), F.col("near").alias("__near"), F.col("hop").alias("__hop"))
        state = cut(state.join(far, [group, "up"], "left").select(group, "node", F.col("__up").alias("up"), F.coalesce("near", "__near").alias("near"), (F.col("hop") + F.coalesce("__hop", F.lit(0))).alias("hop")))
    cyclic = F.col("up").isNotNull()
    return state.select(group, F.col("node").alias(node), F.col("near").alias("nearest"), F.when(~cyclic, F.col("hop")).alias("depth"), cyclic.alias("cyclic"))


def active_positions(paths: DataFrame, group: str, path: str, first: str) -> DataFrame:
    """group, node, position: nodes of the group's paths (arrays), placed as in the path with the least first; others as in the first that has them."""
    e = paths.select(group, first, F.posexplode(path).alias("position", "node"))
    return e.groupBy(group, "node").agg(F.min_by("position", F.struct(first, "position")).alias("position"))
