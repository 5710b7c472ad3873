"""Matching symbols of two versions: weighted similarity, ambiguity, splits, merges and one-to-one matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.stable import cut

# The weights of the similarities, the least confidence, and the distance below which two candidates are ambiguous.
WEIGHTS = {"name": 0.22, "kind": 0.15, "structure": 0.28, "token": 0.12, "signature": 0.14, "references": 0.04, "diff": 0.05}
THRESHOLD, AMBIGUITY = 0.45, 0.05

#: What a symbol must have; arrays may be empty, all else may be null.
COLUMNS = ("name", "kind", "signature", "structural_hash", "shape_hash", "features", "node_count", "depth", "arity", "tokens", "references", "paths")

#: What of it is compared by words.
TEXTS = ("name", "signature", "features", "tokens", "references", "paths")


def words(text: Column) -> Column:
    """Distinct lower-case identifiers of a text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_!?*-]+"), F.lower), lambda w: w != ""))


def numeric(a: Column, b: Column) -> Column:
    near = 1 - F.abs(a - b) / F.greatest(F.lit(1.0), a.cast("double"), b.cast("double"))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def structure(a, b, features: Column) -> Column:
    same = F.when(a("shape_hash") == b("shape_hash"), 1.0).otherwise(0.0)
    parts = same * 0.45 + features * 0.3 + numeric(a("node_count"), b("node_count")) * 0.1 + numeric(a("depth"), b("depth")) * 0.1 + numeric(a("arity"), b("arity")) * 0.05
    return F.when(a("structural_hash") == b("structural_hash"), 1.0).otherwise(F.round(parts, 6))


def structure_at_most(same_hash: Column, same_shape: Column, features: Column) -> Column:
    return F.when(same_hash, 1.0).otherwise(F.when(same_shape, 0.45).otherwise(0.0) + features * 0.3 + 0.25)


def candidates(previous: DataFrame, current: DataFrame, group: Sequence[str], key: str, weights: dict[str, float] | None = None, threshold: float = THRESHOLD, delta: float = AMBIGUITY) -> DataFrame:
    """Pairs of a group's previous and current symbols: group, from, to, confidence, same_name, resolution.

    The group (a commit, its parent and a path) is an equi-join key, so a pair is only made where the
    model compares it. A pair is a candidate if another pair of either end is nearer than delta. key tells the symbols of a group's side apart.

    Symbols that are alike in all that counts are scored as one, and their pairs are made from the result: of two that are alike
    at one end, each is as near to the other end as the other. What is compared by words is compared once for all symbols of a
    group's side that have it in common, and only what can reach the threshold is scored to the end.
    """
    p, c = _alike(previous, group, key, "p_", "from"), _alike(current, group, key, "c_", "to")
    a, b = (lambda x: F.col(f"p_{x}")), (lambda x: F.col(f"c_{x}"))
    compared = ("name_words", "features", "tokens", "signature_words", "references", "paths")
    common = F.transform(F.array(*(F.struct(a(x).alias("a"), b(x).alias("b")) for x in compared)), lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("n"), (F.size(x["a"]) + F.size(x["b"])).alias("of")))
    near = F.transform(common, lambda x: F.when(x["n"] == x["of"], 1.0).otherwise(x["n"] / (x["of"] - x["n"])))  # jaccard of distinct words
    # exploded, it is made once for each pair, and not within the code of what follows, which would be too long to be compiled
    met = p.join(c, list(group)).select("*", F.explode(F.array(near)).alias("__near"))
    same, empty = a("signature") == b("signature"), a("signature").isNull() & b("signature").isNull()
    texts = {
        "name": F.when(a("name") == b("name"), 1.0).otherwise(F.col("__near")[0]),
        "features": F.col("__near")[1],
        "token": F.col("__near")[2],
        "signature": F.when(empty, 0.0).when(same, 1.0).otherwise(F.col("__near")[3]),
        "references": F.col("__near")[4],
        "diff": F.col("__near")[5],
    }
    met = met.select(*group, *(e.alias(f"__{k}") for k, e in texts.items()), a("name").eqNullSafe(b("name")).alias("same_name"), "p_parts", "c_parts", "p_hashes", "c_hashes")
    w = WEIGHTS | (weights or {})
    whole = sum(w.values()) or 1.0

    def total(kind: Column, structure_: Column) -> Column:
        evidence = {k: F.col(f"__{k}") for k in texts if k != "features"} | {"kind": kind, "structure": structure_}
        return sum((evidence[k] * w[k] for k in WEIGHTS), F.lit(0.0)) / whole

    bounded, least = min(w.values()) >= 0 < whole, threshold - 1e-5  # rounding changes less than that
    if bounded:
        met = met.where(total(F.lit(1.0), structure_at_most(F.arrays_overlap("p_hashes", "c_hashes"), F.lit(True), F.col("__features"))) >= least)
    met = met.drop("p_hashes", "c_hashes").select("*", F.explode("p_parts").alias("__p")).drop("p_parts").select("*", F.explode("c_parts").alias("__c")).drop("c_parts")
    a, b = (lambda x: F.col(f"__p.{x}")), (lambda x: F.col(f"__c.{x}"))
    kind = F.when(a("kind") == b("kind"), 1.0).otherwise(0.0)
    if bounded:
        met = met.where(total(kind, structure_at_most(a("structural_hash") == b("structural_hash"), a("shape_hash") == b("shape_hash"), F.col("__features"))) >= least)
    confidence = F.round(total(kind, structure(a, b, F.col("__features"))), 6)
    pairs = met.select(*group, a("from").alias("from"), b("to").alias("to"), a("n").alias("n_from"), b("n").alias("n_to"), confidence.alias("confidence"), "same_name").where(F.col("confidence") >= threshold)
    out = pairs
    for end, other in (("from", "to"), ("to", "from")):
        # the nearest confidence among pairs of the same end is that of a neighbour in sorted order; a number in front makes sorting cheap
        order = W.partitionBy(F.xxhash64(F.col(end)[0]), *group, F.col(end)[0]).orderBy("confidence")
        gap = F.when(F.col(f"n_{other}") > 1, 0.0).otherwise(F.least(F.coalesce(F.col("confidence") - F.lag("confidence").over(order), F.lit(9.0)), F.coalesce(F.lead("confidence").over(order) - F.col("confidence"), F.lit(9.0))))
        out = out.withColumn(f"__{end}", F.round(gap, 9) < delta)
    out = out.withColumn("resolution", F.when(F.col("__from") | F.col("__to"), "candidate").otherwise("resolved"))
    kept = ["confidence", "same_name", "resolution"]
    out = out.select(*group, F.explode("from").alias("f"), "to", *kept).select(*group, "f", F.explode("to").alias("t"), *kept)
    return out.select(*group, F.col("f.key").alias("from"), F.col("t.key").alias("to"), *kept)


def _alike(symbols: DataFrame, group: Sequence[str], key: str, prefix: str, end: str) -> DataFrame:
    """Symbols of a group that have the same TEXTS as one row, with the distinct words of these; its parts are one struct for those that have the same COLUMNS.

    A part has the other COLUMNS, the keys of its symbols as an array named by end, and how many they are as n; hashes has the structural hashes of all parts.
    """
    d = symbols.select(*group, F.struct(F.col(key).alias("key")).alias("__key"), *(F.col(c).alias(f"{prefix}{c}") for c in COLUMNS)).repartition(*group)
    d = d.groupBy(*group, *(f"{prefix}{c}" for c in COLUMNS)).agg(F.array_sort(F.collect_list("__key")).alias("__keys"))
    part = F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in COLUMNS if c not in TEXTS), F.col("__keys").alias(end), F.size("__keys").alias("n"))
    d = d.groupBy(*group, *(f"{prefix}{c}" for c in TEXTS)).agg(F.collect_list(part).alias(f"{prefix}parts"), F.collect_set(f"{prefix}structural_hash").alias(f"{prefix}hashes"))
    own = {f"{prefix}{c}_words": words(F.col(f"{prefix}{c}")) for c in ("name", "signature")}
    return d.withColumns(own | {f"{prefix}{c}": F.array_distinct(f"{prefix}{c}") for c in ("features", "tokens", "references", "paths")})


def match(pairs: DataFrame, group: Sequence[str], multi: float = THRESHOLD) -> DataFrame:
    """Transitions from resolved candidates: group, from, to, confidence, kind.

    Ends with several strong pairs become split, merge or split-merge. What is left is matched one to one
    from the highest confidence down: a pair that is the best of both its ends is taken, its ends go, and
    so on; each round is a window over the pairs, and rounds end when no pair is left.
    """
    r = pairs.where("resolution = 'resolved'").withColumn("strong", F.col("confidence") >= multi)
    n = lambda end: F.sum(F.col("strong").cast("int")).over(W.partitionBy(*group, end)) > 1
    r = r.withColumn("__s", F.col("strong") & n("from")).withColumn("__m", F.col("strong") & n("to"))
    kind = F.when(F.col("__s") & F.col("__m"), "split-merge").when(F.col("__s"), "split").when(F.col("__m"), "merge")
    # both what is done and what is left come from it, and scoring takes nearly all the time
    r = cut(r.withColumn("kind", kind))
    done = r.where("kind is not null")
    used = lambda end: F.max(F.col("kind").isNotNull()).over(W.partitionBy(*group, end))
    left = r.withColumn("__f", used("from")).withColumn("__t", used("to")).where("not __f and not __t")
    left = left.drop("__f", "__t").withColumn("kind", F.when(F.col("same_name"), "modified").otherwise("moved"))
    cols = [*group, "from", "to", "confidence", "kind"]
    out, left = done.select(*cols), left.select(*cols)
    while not left.isEmpty():
        order = [F.desc("confidence"), "from", "to"]
        best = lambda end: F.row_number().over(W.partitionBy(*group, end).orderBy(*order)) == 1
        marked = left.withColumn("__take", best("from") & best("to"))
        out = out.unionByName(marked.where("__take").select(*cols))
        hit = lambda end: F.max("__take").over(W.partitionBy(*group, end))
        left = cut(marked.withColumn("__a", hit("from")).withColumn("__b", hit("to")).where("not __a and not __b").select(*cols))
    return out
