"""Ranked retrieval: BM25, rank fusion, vector similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import count_of, query_terms, terms
from annalist.operators.stable import ship

K1, B, FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60


def bm25(docs: DataFrame, keys: Sequence[str], text: Column, query: str | Sequence[str], limit: int | None = 20) -> DataFrame:
    """keys, score: the best documents for the query's terms or phrases (words joined by a space); ties by keys.

    query: what somebody typed, or its terms as query_terms() gives them; one without terms finds nothing. Nothing is exploded: frequencies are counted in each row, and one row of corpus statistics is joined back.
    """
    query = query_terms(query) if isinstance(query, str) else list(query)
    if not query:
        return docs.select(*keys, F.lit(0.0).alias("score")).where(F.lit(False))
    hits = [count_of(F.col("__t"), q).cast("double").alias(f"__f{i}") for i, q in enumerate(query)]
    d = docs.select(*keys, terms(text).alias("__t")).select(*keys, F.size("__t").cast("double").alias("__len"), *hits)
    stats = d.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *(F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"__d{i}") for i in range(len(query))))
    d = d.where(" or ".join(f"__f{i} > 0" for i in range(len(query)))).crossJoin(F.broadcast(stats))
    return _scored(d, keys, len(query), limit)


def postings(docs: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """An inverted index: term, keys, tf, places (of the term among the document's), size (terms of the document). Made once and stored by
    term, it serves every query: a search reads the rows of the query's terms only.
    """
    d = docs.select(*keys, terms(text).alias("__t")).select(*keys, F.size("__t").alias("size"), F.posexplode_outer("__t").alias("place", "term")).where("term is not null")
    return d.groupBy("term", *keys).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"), F.first("size").alias("size"))


def corpus_size(docs: DataFrame, text: Column) -> DataFrame:
    """One row, documents and mean_size, which is kept beside postings; documents without terms count."""
    return docs.select(F.size(terms(text)).alias("size")).agg(F.count("*").alias("documents"), F.avg("size").alias("mean_size"))


def bm25_indexed(index: DataFrame, corpus: DataFrame, keys: Sequence[str], query: str | Sequence[str], limit: int | None = 20) -> DataFrame:
    """The result of bm25 from postings and corpus_size. A phrase is found where its words' places follow each other."""
    wanted = query_terms(query) if isinstance(query, str) else list(query)
    words = sorted({w for q in wanted for w in q.split(" ")})
    rows = index.where(F.col("term").isin(words) if words else F.lit(False))
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("__m"), F.first("size").cast("double").alias("__len"))

    def count(q: str) -> Column:
        none = F.array().cast("array<int>")
        at = [F.coalesce(F.try_element_at("__m", F.lit(w)), none) for w in q.split(" ")]
        out = at[0]
        for k, places in enumerate(at[1:], 1):
            out = F.array_intersect(out, _moved(places, k))
        return F.size(out).cast("double")

    d = held.select(*keys, "__len", *(count(q).alias(f"__f{i}") for i, q in enumerate(wanted)))
    if not wanted:
        return d.select(*keys, F.lit(0.0).alias("score"))
    d = d.where(" or ".join(f"__f{i} > 0" for i in range(len(wanted))))
    stats = d.agg(*(F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"__d{i}") for i in range(len(wanted)))).crossJoin(corpus.select(F.col("documents").alias("__n"), F.col("mean_size").alias("__avg")))
    return _scored(d.crossJoin(F.broadcast(stats)), keys, len(wanted), limit)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _scored(d: DataFrame, keys: Sequence[str], n_terms: int, limit: int | None) -> DataFrame:
    score = F.lit(0.0)
    for i in range(n_terms):
        n, f = F.col(f"__d{i}"), F.col(f"__f{i}")
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, FLOOR).otherwise(idf)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    out = d.select(*keys, F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(limit) if limit else out


def ranked(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows with their rank from 1; the cut comes before the window, so the window sees few rows."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def rank_fusion(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """key, score: reciprocal ranks summed over the lists (each has key and rank)."""
    union = lists[0].select(key, "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select(key, "rank"))
    return union.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: the mean of each label's vectors, position by position."""
    flat = vectors.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("centroid"))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalized(v: Column) -> Column:
    """v over its Euclidean norm; null where that is zero or not finite."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def classify(vectors: DataFrame, key: str, vector: str, prototypes: DataFrame, label: str, threshold: float = 0.42, most: int = 4, bound: int = 10_000) -> DataFrame:
    """key, label, similarity: for each row its nearest prototypes (label, centroid) at or above threshold, most of them at best.

    Up to bound prototypes become one broadcast row, and every row is compared, cut and sorted in place, without a
    shuffle. More are dealt into blocks of bound: each row meets each block, and the best of all blocks are cut again.
    """
    n = prototypes.count()
    if n > bound:
        parts = math.ceil(n / bound)
        dealt = prototypes.withColumn("__part", F.pmod(F.xxhash64(label), F.lit(parts)))
        best = reduce(DataFrame.unionByName, (classify(vectors, key, vector, dealt.where(F.col("__part") == k).drop("__part"), label, threshold, most, n) for k in range(parts)))
        w = W.partitionBy(key).orderBy(F.desc("similarity"), label)
        return best.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")
    one = prototypes.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("__p"))
    near = F.filter(F.transform("__p", lambda p: F.struct((-F.round(cosine(F.col(vector), p["centroid"]), 6)).alias("s"), p["label"].alias("label"))), lambda x: x["s"] <= -threshold)
    best = vectors.crossJoin(F.broadcast(one)).select(key, F.explode(F.slice(F.array_sort(near), 1, most)).alias("x"))
    return best.select(key, F.col("x.label").alias(label), (-F.col("x.s")).alias("similarity"))


def structural_overlap(a, b) -> Column:
    """a and b name columns of two symbols: features 0.65, node_count 0.15, depth 0.10, arity 0.10."""
    part = lambda c: F.when(a(c).isNull() | b(c).isNull(), 0.0).otherwise(1 - F.abs(a(c) - b(c)) / F.greatest(F.lit(1.0), a(c).cast("double"), b(c).cast("double")))
    return overlap(a("features"), b("features")) * 0.65 + part("node_count") * 0.15 + part("depth") * 0.1 + part("arity") * 0.1


def similar_symbols(symbols: DataFrame, target: DataFrame, query: Sequence[str], limit: int = 20) -> DataFrame:
    """symbol, score: symbols like the one in target (a single row), taken from the best lexical hits for its words.

    symbols and target: symbol, name, kind, text, features, node_count, depth, arity. query: the words of the target's name.
    """
    hits = bm25(symbols, ["symbol"], F.col("text"), query, max(5 * limit, 50))
    hits = ranked(hits, [F.desc("score"), F.col("symbol")], max(5 * limit, 50)).drop("score")
    one = target.limit(1).select(*(F.col(c).alias(f"t_{c}") for c in ("symbol", "name", "kind", "features", "node_count", "depth", "arity")))
    d = hits.join(symbols, "symbol").crossJoin(F.broadcast(one)).where("symbol <> t_symbol")
    words = lambda c: F.array_distinct(terms(F.col(c)))
    space = lambda c: F.regexp_extract(c, "^([^/]*)/", 1)
    same = lambda x, y: F.when(x == y, 1.0).otherwise(0.0)
    score = 0.3 / F.col("rank") + 0.25 * overlap(words("name"), words("t_name")) + 0.15 * same(F.col("kind"), F.col("t_kind")) + 0.05 * same(space("name"), space("t_name")) + 0.25 * structural_overlap(F.col, lambda c: F.col(f"t_{c}"))
    return d.select("symbol", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "symbol").limit(limit)


def hybrid(lexical: DataFrame, dense: DataFrame | None, key: str, limit: int = 50) -> DataFrame:
    """Rank fusion of both lists (key, rank); of the lexical one alone where there are no vectors."""
    return rank_fusion([lexical] if dense is None else [lexical, dense], key).orderBy(F.desc("score"), key).limit(limit)


def blended(mentions: DataFrame, seeds: DataFrame, near: DataFrame, messages: DataFrame, query: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """key, score: 0.58 for topics, 0.34 for the vector's cosine (at least 0), 0.08 for shared labels; only messages that mention a topic.

    mentions: key, topic, weight. seeds: topic, strength. near: topic, score (counts 0.55). messages: key, vector, labels.
    query: a single row of vector, labels.
    """
    w = seeds.select("topic", F.col("strength").alias("__w")).unionByName(near.select("topic", (0.55 * F.col("score")).alias("__w"))).groupBy("topic").agg(F.max("__w").alias("__w"))
    hit = mentions.join(w, "topic").groupBy(key).agg(F.sum(F.col("weight") * F.col("__w")).alias("__x"))
    one = query.limit(1).select(F.col("vector").alias("__v"), F.col("labels").alias("__l"))
    d = hit.join(messages.select(key, "vector", "labels"), key).crossJoin(F.broadcast(one))
    score = 0.58 * (1 - F.exp(-F.col("__x") / 3)) + 0.34 * F.greatest(F.lit(0.0), cosine(F.col("vector"), F.col("__v"))) + 0.08 * overlap(F.col("labels"), F.col("__l"))
    return d.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, threshold: float = 0.28, limit: int = 8) -> DataFrame:
    """key, strength: the rows whose cosine to the query's vector (a single row) is at or above threshold, best first."""
    d = vectors.select(key, vector).crossJoin(F.broadcast(query.limit(1).select(F.col("vector").alias("__v"))))
    d = d.select(key, F.round(cosine(F.col(vector), F.col("__v")), 6).alias("strength")).where(F.col("strength") >= threshold)
    return d.orderBy(F.desc("strength"), key).limit(limit)


def nearest_rows(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int = 10, block: int = 4096) -> DataFrame:
    """query, neighbour, similarity, place: for each row of queries the rows of vectors nearest by cosine, itself among them; ties by key.

    Queries (key, vector) come in blocks: each block is read once, goes to all tasks, and is multiplied with the vectors in
    Arrow batches; a task sends its best limit rows of each query, never all pairs. A zero vector, or one of another
    length, has similarity 0. Null vectors are left out.
    """
    kind = vectors.schema[key].dataType.simpleString()
    ids = queries.where(F.col(vector).isNotNull())
    parts = max(1, math.ceil(ids.count() / block))
    dealt = ids.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    out = None
    for part in range(parts):
        asked = dealt.where(F.col("part") == part).select("k", "v").collect()
        by_size: dict[int, list] = {}
        for r in asked:
            by_size.setdefault(len(r["v"]), []).append((r["k"], r["v"]))
        held = {n: ([k for k, _ in rows], _unit(np.array([v for _, v in rows], np.float64))) for n, rows in by_size.items()}
        every = [r["k"] for r in asked]

        def best(batches, held=held, every=every):
            found: dict = {q: [] for q in every}
            for b in batches:
                keys, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
                near = {q: np.zeros(len(keys)) for q in every}
                for n, (names, unit) in held.items():
                    at = [i for i, v in enumerate(rows) if len(v) == n]
                    if at:
                        for q, line in zip(names, unit @ _unit(np.array([rows[i] for i in at], np.float64)).T, strict=True):
                            near[q][at] = line
                for q, line in near.items():
                    s = np.round(line, 6) + 0.0
                    order = np.argpartition(-s, limit - 1)[:limit] if len(s) > limit else np.arange(len(s))
                    edge = s[order].min()
                    found[q] = sorted(found[q] + [(-s[i], keys[i]) for i in np.flatnonzero(s >= edge)])[:limit]
            rows = [(q, k, -s) for q, top in found.items() for s, k in top]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query", "neighbour", "similarity"])

        found = ship(vectors).where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(best, f"query {kind}, neighbour {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= limit)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def with_evidence(hits: DataFrame, key: str, parts: dict[str, tuple[DataFrame, Sequence[str], int]]) -> DataFrame:
    """hits with an array column for each part: name -> (rows with the key, order, most), the first rows of each key in order.

    Rows are cut to the hits and then to most of each key before they are collected, so an array is bounded. A hit
    without rows has an empty array.
    """
    out, keys = hits, hits.select(key)
    for name, (rows, order, most) in parts.items():
        fields = [*order, *(c for c in rows.columns if c != key and c not in order)]
        top = rows.join(keys, key, "left_semi").withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__rn") <= most)
        got = top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name))
        kind = got.schema[name].dataType
        out = out.join(got, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def hashed_vector(dimensions: int = 1536):
    """A vector that depends on a text alone, as a Pandas UDF: digests of its pieces of 64 characters are laid on the dimensions, one
    after the other, and the sum is brought to length one. Null and empty texts give zeros. It stands in for an encoder in tests.
    """

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            v = np.zeros(dimensions)
            for at in range(0, len(t or ""), 64):
                d = np.frombuffer(hashlib.sha256(f"{at}:{t[at:at + 64]}".encode()).digest(), np.uint8)
                np.add.at(v, (at + np.arange(len(d))) % dimensions, (d - 127.5) / 127.5)
            return v / (np.linalg.norm(v) or 1.0)

        return texts.map(one, na_action=None)

    return encode
