"""Topics: mentions of keywords in contexts, statistics and associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.text import STOP_WORDS, keywords, nfkc
from annalist.operators.search import bm25

PER_CONTEXT = 24

# Words that end a phrase, besides the stop words: generic ones, then verbs and their forms.
GENERIC_WORDS = (
    "actually another better change changes current different example first going good great idea ideas look make making new one part "
    "really same something stuff thing things think version way work working"
).split()
BOUNDARY_VERBS = (
    "add adds added build builds built become becomes create creates created keep keeps link links linked "
    "manage manages managed make makes made provide provides provided store stores stored use uses used"
).split()
BOUNDARY_WORDS = list(dict.fromkeys(["got", *STOP_WORDS, *GENERIC_WORDS, *BOUNDARY_VERBS]))
# Weights of references by kind, factors of facets.
REFERENCE_WEIGHTS = {"project": 1.7, "repository": 1.6, "package": 1.35, "path": 1.3, "url": 1.1, "entity": 1.2}
FACETS = {"decision": 1.35, "constraint": 1.30, "rejection": 1.25, "acceptance": 1.20, "proposal": 1.16, "request": 1.14, "correction": 1.12, "status": 1.10, "rationale": 1.08, "question": 1.05}
PHRASES = 8


def mentions(docs: DataFrame, context: str, text: str, least: int = 5) -> DataFrame:
    """context, topic, weight: a keyword of at least so many characters weighs 0.68 for each message that has it, one row per context and topic."""
    k = docs.select(context, F.explode_outer(keywords(F.col(text))).alias("topic")).where(F.length("topic") >= least)
    return k.groupBy(context, "topic").agg(F.round(F.count("*") * F.lit(0.68), 6).alias("weight"))


def associations(m: DataFrame, context: str, least: int = 1) -> DataFrame:
    """a < b, support, score: pairs of a context's heaviest topics; at most PER_CONTEXT topics of a context meet, as the weight is defined so."""
    top = m.withColumn("__rn", F.row_number().over(W.partitionBy(context).orderBy(F.desc("weight"), "topic"))).where(F.col("__rn") <= PER_CONTEXT).drop("__rn")
    df = m.groupBy("topic").agg(F.count("*").alias("df"))
    l, r = top.select(context, F.col("topic").alias("a"), F.col("weight").alias("wa")), top.select(context, F.col("topic").alias("b"), F.col("weight").alias("wb"))
    p = l.join(r, context).where("a < b").groupBy("a", "b").agg(F.sum(4 * F.sqrt(F.col("wa") * F.col("wb"))).alias("w"), F.count("*").alias("support")).where(F.col("support") >= least)
    p = p.join(df.select(F.col("topic").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("topic").alias("b"), F.col("df").alias("db")), "b")
    return p.select("a", "b", "support", F.round(1 - F.exp(-(F.col("w") / F.sqrt(F.col("da") * F.col("db"))) / 3), 6).alias("score"))


# How many topics of a context, a message and an end of a reply meet, and what their pairs weigh.
EVIDENCE = {"same-context": (PER_CONTEXT, 4.0), "same-message": (36, 0.75), "reply": (18, 1.5)}


def evidence(m: DataFrame, replies: DataFrame) -> DataFrame:
    """a < b, relation, place, weight: pairs of topics of a context, of a message, and across a reply, each place once a pair.

    m: message, context, topic, weight. replies: src, dst. A place gives its heaviest topics only, as the weight is
    defined so; that bounds the pairs of a place whatever the length of a text.
    """

    def top(keys: list[str], relation: str) -> DataFrame:
        one = m.groupBy(*keys, "topic").agg(F.max("weight").alias("weight"))
        w = W.partitionBy(*keys).orderBy(F.desc("weight"), "topic")
        return one.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= EVIDENCE[relation][0]).drop("__rn")

    def side(d: DataFrame, s: str, **names: str) -> DataFrame:
        return d.select(*(F.col(c).alias(names.get(c, c)) for c in d.columns if c not in ("topic", "weight")), F.col("topic").alias(s), F.col("weight").alias(f"w{s}"))

    def weighed(d: DataFrame, relation: str, *place: str) -> DataFrame:
        return d.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), F.lit(relation).alias("relation"), F.to_json(F.array(*(F.col(c).cast("string") for c in place))).alias("place"), (EVIDENCE[relation][1] * F.sqrt(F.col("wl") * F.col("wr"))).alias("w"))

    out = None
    for relation, keys in (("same-context", ["message", "context"]), ("same-message", ["message"])):
        t = top(keys, relation)
        d = weighed(side(t, "l").join(side(t, "r"), keys).where("l < r"), relation, *keys)
        out = d if out is None else out.unionByName(d)
    t, r = top(["message"], "reply"), replies.select("src", "dst").distinct()
    across = r.join(side(t, "l", message="src"), "src").join(side(t, "r", message="dst"), "dst").where("l <> r")
    return out.unionByName(weighed(across, "reply", "src", "dst")).groupBy("a", "b", "relation", "place").agg(F.sum("w").alias("weight"))


def evidence_associations(m: DataFrame, replies: DataFrame, least: int = 1) -> DataFrame:
    """a < b, support (places), score: associations by all evidence over how many messages mention the topics."""
    p = evidence(m, replies).groupBy("a", "b").agg(F.sum("weight").alias("w"), F.count("*").alias("support")).where(F.col("support") >= least)
    df = m.select("message", "topic").distinct().groupBy("topic").agg(F.count("*").alias("df"))
    p = p.join(df.select(F.col("topic").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("topic").alias("b"), F.col("df").alias("db")), "b")
    return p.select("a", "b", "support", F.round(1 - F.exp(-(F.col("w") / F.sqrt(F.col("da") * F.col("db"))) / 3), 6).alias("score"))


def phrases(text: Column) -> Column:
    """Topic candidates of a text as array<struct<kind,label,weight>>, in order, PHRASES at most.

    Words are cut into segments at boundary words and at words below three characters. A single word of five or more
    is a keyword, two to four words are a phrase, and a longer segment gives its windows of four words.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}@/._-]+", " ")), " "), lambda w: w != "")
    ends = lambda w: (F.length(w) < 3) | F.array_contains(F.lit(list(BOUNDARY_WORDS)), w)
    line = F.array_join(F.transform(words, lambda w: F.when(ends(w), "|").otherwise(w)), " ")
    segments = F.filter(F.transform(F.split(line, r"\|"), lambda s: F.split(F.trim(s), " ")), lambda s: s[0] != "")

    def found(kind: str, label: Column, weight: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.round(weight, 6).alias("weight"))

    def of(s: Column) -> Column:
        n = F.size(s)
        none = F.array().cast("array<struct<kind:string,label:string,weight:double>>")
        four = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 3)), lambda i: found("phrase", F.array_join(F.slice(s, i, 4), " "), F.lit(1.28)))
        some = F.array(found("phrase", F.array_join(s, " "), 1.04 + (n - 2) * 0.12))
        return F.when((n == 1) & (F.length(s[0]) >= 5), F.array(found("keyword", s[0], F.lit(0.68)))).when(n == 1, none).when(n <= 4, some).otherwise(four)

    return F.slice(F.array_distinct(F.flatten(F.transform(segments, of))), 1, PHRASES)


def facet_factor(kinds: Column) -> Column:
    """The greatest factor of the speech acts (array<string>), 1 at least."""
    def factor(k: Column) -> Column:
        out = F.lit(1.0)
        for name, f in FACETS.items():
            out = F.when(k == name, f).otherwise(out)
        return out

    return F.aggregate(kinds, F.lit(1.0), lambda m, k: F.greatest(m, factor(k)))


def reference_weight(kind: Column) -> Column:
    out = None
    for k, w in REFERENCE_WEIGHTS.items():
        out = F.when(kind == k, w) if out is None else out.when(kind == k, w)
    return out.otherwise(REFERENCE_WEIGHTS["entity"])


def statistics(known: DataFrame, m: DataFrame, revisions: DataFrame) -> DataFrame:
    """topic, mentions, df, first_seen, last_seen of every known topic, also of those without mentions. m: topic, revision. revisions: revision, created, updated."""
    seen = m.join(revisions, "revision", "left")
    g = seen.groupBy("topic").agg(F.count("*").alias("mentions"), F.countDistinct("revision").alias("df"), F.min(F.coalesce("created", "updated")).alias("first_seen"), F.max(F.coalesce("updated", "created")).alias("last_seen"))
    none = F.lit(0).cast("long")
    return known.select("topic").join(g, "topic", "left").withColumn("mentions", F.coalesce("mentions", none)).withColumn("df", F.coalesce("df", none))


def contributions(m: DataFrame, weights: DataFrame) -> DataFrame:
    """revision, raw_score, direct, associated, facets: what the topics of a query add to each revision.

    m: revision, topic, weight, facets (array). weights: topic, factor, source (direct or associated). All mentions add up; of each
    topic the greatest contribution is listed, in order, and facets are united. The topics of a query bound the lists.
    """
    d = m.join(weights, "topic").withColumn("c", F.col("factor") * F.coalesce("weight", F.lit(0.0)))
    best = d.groupBy("revision", "topic", "source").agg(F.max("c").alias("c"), F.sum("c").alias("sum"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("facets", F.array().cast("array<string>"))))).alias("facets"))
    part = lambda source: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == source, F.struct((-F.round("c", 6)).alias("n"), "topic")))), lambda x: F.struct(x["topic"].alias("topic"), (-x["n"]).alias("contribution")))
    return best.groupBy("revision").agg(F.round(F.sum("sum"), 6).alias("raw_score"), part("direct").alias("direct"), part("associated").alias("associated"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("facets")))).alias("facets"))


def evidence_lists(p: DataFrame, most: int = 16) -> DataFrame:
    """a, b, evidence: the heaviest places of each pair of evidence() as array<struct<relation,place,weight>>, most of them, ties by place."""
    w = W.partitionBy("a", "b").orderBy(F.desc("weight"), "relation", "place")
    top = p.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    held = F.array_sort(F.collect_list(F.struct("__k", F.struct("relation", "place", "weight").alias("e"))))
    return top.groupBy("a", "b").agg(F.transform(held, lambda x: x["e"]).alias("evidence"))


def lookup(stats: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """topic, strength: topics for a typed query: the one that is the query first, then by BM25 over the topics' words and by frequency. stats: topic, df."""
    hits = bm25(stats.select("topic"), ["topic"], F.col("topic"), query, None)
    d = stats.join(hits, "topic", "left").withColumn("__exact", F.col("topic") == F.lower(F.trim(F.lit(query)))).where("__exact or score is not null")
    order = [F.desc("__exact"), F.desc_nulls_last("score"), F.desc("df"), F.col("topic")]
    d = d.orderBy(*order).limit(limit).withColumn("__r", F.row_number().over(W.orderBy(*order)))
    return d.select("topic", F.round(F.when(F.col("__exact"), 1.2).otherwise(1.0) / F.log2(F.col("__r") + 1.0), 6).alias("strength"))


def find(stats: DataFrame, words: Column, exact: str, limit: int = 8) -> DataFrame:
    """topic, strength: topics for a query, exact label first, then by shared words and frequency. stats: topic, df."""
    d = stats.withColumn("__exact", F.col("topic") == exact).withColumn("__shared", words).where("__exact or __shared > 0")
    order = [F.desc("__exact"), F.desc("__shared"), F.desc("df"), F.col("topic")]
    d = d.orderBy(*order).limit(limit).withColumn("__r", F.row_number().over(W.orderBy(*order)))
    return d.select("topic", F.round(F.when(F.col("__exact"), 1.2).otherwise(1.0) / F.log2(F.col("__r") + 1.0), 6).alias("strength"))


def related(seeds: DataFrame, assoc: DataFrame, limit: int = 12, least: int = 1) -> DataFrame:
    """topic, seed, score: one step from the seeds (topic, strength) along associations; each topic keeps its best seed. Seeds do not come back."""
    both = assoc.select("a", "b", "support", "score").unionByName(assoc.select(F.col("b").alias("a"), F.col("a").alias("b"), "support", "score"))
    s = seeds.select(F.col("topic").alias("a"), "strength")
    d = both.where(F.col("support") >= least).join(s, "a").join(s.select(F.col("a").alias("b")), "b", "left_anti")
    scored = d.select(F.col("b").alias("topic"), F.struct(F.round(F.col("strength") * F.col("score"), 6).alias("score"), F.col("a").alias("seed")).alias("x"))
    best = scored.groupBy("topic").agg(F.max("x").alias("x")).select("topic", "x.seed", "x.score")
    return best.orderBy(F.desc("score"), "topic").limit(limit)


def plan(seeds: DataFrame, near: DataFrame, m: DataFrame, context: str, limit: int = 250) -> DataFrame:
    """context, score, topics: contexts by their mentions of the seeds (by strength) and of related topics (0.65 of the score)."""
    w = seeds.select("topic", F.col("strength").alias("w")).unionByName(near.select("topic", (0.65 * F.col("score")).alias("w"))).groupBy("topic").agg(F.max("w").alias("w"))
    hit = m.join(w, "topic").groupBy(context).agg(F.sum(F.col("weight") * F.col("w")).alias("x"), F.count("*").alias("topics"))
    return hit.select(context, F.round(1 - F.exp(-F.col("x") / 3), 6).alias("score"), "topics").orderBy(F.desc("score"), context).limit(limit)


def fuse(lexical: DataFrame, topical: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """key, score: lexical ranks (key, rank) with topic ranks (key, rank, score); the topic score itself adds a hundredth."""
    l = lexical.select(key, (1.0 / (60 + F.col("rank"))).alias("__s"))
    t = topical.select(key, (0.85 / (60 + F.col("rank")) + 0.01 * F.col("score")).alias("__s"))
    return l.unionByName(t).groupBy(key).agg(F.round(F.sum("__s"), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
