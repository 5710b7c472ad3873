"""The registered queries over the driver's tables, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import chat, context, graph, history, search, topics
from annalist.plans.registry import query

TERMS = ("that", "with", "heat")


def _bm25_sql(source: str, keys: str, limit: str) -> str:
    f = [f"len(list_filter(t, lambda x: x = '{q}'))::DOUBLE AS f{i}" for i, q in enumerate(TERMS)]
    idf = lambda i: f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
    part = [f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(TERMS))]
    return f"""
    WITH x AS (SELECT {keys}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
    y AS (SELECT {keys}, len(t)::DOUBLE AS dl, {', '.join(f)} FROM x),
    s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {', '.join(f'sum((f{i} > 0)::INT)::DOUBLE AS d{i}' for i in range(len(TERMS)))} FROM y)
    SELECT {keys}, round(CAST({' + '.join(part)} AS DOUBLE), 6) AS score FROM y, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(TERMS)))} {limit}"""


@query(_bm25_sql("conversations", "conv_id, turn", "ORDER BY score DESC, conv_id, turn LIMIT 20"))
def bm25_search_conversations(t):
    return search.bm25(t("conversations"), ["conv_id", "turn"], F.col("text"), TERMS)


@query(_bm25_sql("documents", "doc_id", "ORDER BY score DESC, doc_id LIMIT 50"))
def bm25_search_documents(t):
    return search.bm25(t("documents"), ["doc_id"], F.col("text"), TERMS, 50)


@query("SELECT conv_id, turn, role, length(text)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_turn_per_conversation(t):
    return history.latest(t("conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, max(turn)::BIGINT AS last_turn, count(*)::BIGINT AS n_turns FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 100")
def list_conversations(t):
    return t("conversations").groupBy("conv_id").agg(F.max("turn").cast("long").alias("last_turn"), F.count("*").alias("n_turns")).orderBy(F.desc("last_turn"), "conv_id").limit(100)


@query("""SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300)
    WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1994-01-01')""")
def late_filter_after_candidates(t):
    c = t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(300)
    return c.where("o_orderstatus = 'F' and (o_orderdate is null or o_orderdate >= timestamp '1994-01-01')").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT a.conv_id, a.turn AS parent, b.turn AS child FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def reply_edges(t):
    c = t("conversations")
    return c.select("conv_id", F.col("turn").alias("parent"), (F.col("turn") + 1).alias("child")).join(c.select("conv_id", F.col("turn").alias("child")), ["conv_id", "child"]).select("conv_id", "parent", "child")


@query("SELECT o_custkey AS src, count(*)::BIGINT AS n_children FROM orders GROUP BY 1 HAVING count(*) > 1")
def branch_points(t):
    return graph.branch_points(t("orders").select(F.col("o_custkey").alias("src")))


@query("SELECT conv_id, string_agg(turn::VARCHAR, '>' ORDER BY turn) AS path, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def active_path(t):
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ">").alias("path"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM conversations")
def token_estimate(t):
    return t("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    w AS (SELECT conv_id, turn, k, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used, cost <= 600 AS taken FROM c WHERE k = 1
        UNION ALL SELECT c.conv_id, c.turn, c.k, CASE WHEN w.used + c.cost <= 600 THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= 600 FROM w JOIN c ON c.conv_id = w.conv_id AND c.k = w.k + 1)
    SELECT conv_id, turn, used::BIGINT AS used FROM w WHERE taken""")
def token_budget_pack(t):
    c = t("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("cost"))
    return context.pack(c, "conv_id", ["turn"], "cost", 600, ["turn"])


_KEYWORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}][\\p{L}\\p{N}_-]*'), lambda x: length(x) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x))"
_FIRST = f"SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, unnest({_KEYWORDS}) AS w, generate_subscripts({_KEYWORDS}, 1) AS i FROM conversations) GROUP BY 1, 2, 3"
_KEPT = f"SELECT conv_id, turn, w, i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM ({_FIRST})) WHERE k <= 24"


@query(f"SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS keywords FROM ({_KEPT}) GROUP BY 1, 2")
def keywords(t):
    return t("conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords")).where("keywords <> ''")


_MENTIONS = f"SELECT conv_id, w AS topic, round(CAST(count(*) * 0.68 AS DOUBLE), 6) AS weight FROM ({_KEPT}) WHERE length(w) >= 5 GROUP BY 1, 2"


@query(f"SELECT topic, count(*)::BIGINT AS df, round(CAST(sum(weight) AS DOUBLE), 6) AS weight, min(conv_id) AS first_seen, max(conv_id) AS last_seen FROM ({_MENTIONS}) GROUP BY topic")
def topic_stats(t):
    m = topics.mentions(t("conversations"), "conv_id", "text")
    return m.groupBy("topic").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 6).alias("weight"), F.min("conv_id").alias("first_seen"), F.max("conv_id").alias("last_seen"))


_ASSOC = f"""m AS ({_MENTIONS}), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, topic) AS k FROM m) WHERE k <= 24),
    df AS (SELECT topic, count(*) AS n FROM m GROUP BY 1),
    p AS (SELECT x.topic AS a, y.topic AS b, sum(4 * sqrt(x.weight * y.weight)) AS w, count(*)::BIGINT AS support FROM top x JOIN top y ON x.conv_id = y.conv_id AND x.topic < y.topic GROUP BY 1, 2 HAVING count(*) >= 2),
    assoc AS (SELECT a, b, support, round(CAST(1 - exp(-(w / sqrt(da.n * db.n)) / 3) AS DOUBLE), 6) AS score FROM p JOIN df da ON da.topic = a JOIN df db ON db.topic = b)"""


@query(f"WITH {_ASSOC} SELECT * FROM assoc")
def topic_associations(t):
    return topics.associations(topics.mentions(t("conversations"), "conv_id", "text"), "conv_id", 2)


@query(f"""WITH {_ASSOC}, seed AS (SELECT topic FROM df ORDER BY n DESC, topic LIMIT 6), e AS (SELECT a AS s, b AS o, score FROM assoc UNION ALL SELECT b, a, score FROM assoc)
    SELECT o AS topic, max(score) AS score FROM e JOIN seed ON s = topic WHERE o NOT IN (SELECT topic FROM seed) GROUP BY o ORDER BY score DESC, o LIMIT 12""")
def related_topics(t):
    m = topics.mentions(t("conversations"), "conv_id", "text")
    seed = m.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(6).select(F.col("topic").alias("s"))
    a = topics.associations(m, "conv_id", 2)
    e = a.select(F.col("a").alias("s"), F.col("b").alias("topic"), "score").unionByName(a.select(F.col("b").alias("s"), F.col("a").alias("topic"), "score"))
    return e.join(seed, "s", "left_semi").join(seed.withColumnRenamed("s", "topic"), "topic", "left_anti").groupBy("topic").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "topic").limit(12)


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*)::BIGINT AS n, max(CAST({c} AS DOUBLE)) AS confidence FROM conversations WHERE regexp_matches(trim(lower(text)), '{_duck('|'.join(p))}') HAVING count(*) > 0" for k, (c, p) in T.SPEECH_ACTS.items()))
def speech_act_histogram(t):
    return t("conversations").select(F.explode_outer(T.speech_acts(F.col("text"))).alias("a")).where("a is not null").groupBy("a.kind").agg(F.count("*").alias("n"), F.max("a.confidence").cast("double").alias("confidence"))


@query("SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_duck('|'.join(p))}') THEN '{k}'" for k, p in T.MODALITY) + f" ELSE 'asserted' END AS modality, CASE WHEN regexp_matches(lower(text), '{_duck('|'.join(T.NEGATION))}') THEN 'negative' ELSE 'positive' END AS polarity, count(*)::BIGINT AS n FROM conversations GROUP BY 1, 2")
def modality_polarity(t):
    return t("conversations").groupBy(T.modality(F.col("text")).alias("modality"), T.polarity(F.col("text")).alias("polarity")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, url AS found FROM (SELECT page_id, unnest(list_transform(regexp_extract_all('see (' || url || '), or ' || html, 'https?://[^\s<>{}\[\]"'']+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))) AS url FROM pages)""")
def url_entities(t):
    return t("pages").select("page_id", F.explode(T.urls(F.concat(F.lit("see ("), F.col("url"), F.lit("), or "), F.col("html")))).alias("found"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, starts_with(url, 'https://') AS secure FROM pages")
def url_without_query(t):
    return t("pages").select("page_id", T.without_query(F.col("url")).alias("clean"), F.col("url").startswith("https://").alias("secure"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50)
    SELECT doc_id, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def rrf_fusion(t):
    d = t("documents").select("doc_id", "n_chars", "lang")
    return search.rank_fusion([search.ranked(d, [F.desc("n_chars"), F.col("doc_id")], 50), search.ranked(d.where("lang = 'en'"), [F.col("doc_id")], 50)], "doc_id")


_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query(f"SELECT e.vec_id, round(CAST({_COS.format(a='e.embedding', b='q.embedding')} AS DOUBLE), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, e.vec_id LIMIT 20")
def cosine_topk(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


@query("""WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    SELECT label, pos::INT AS pos, round(avg(v), 6) AS mean FROM f GROUP BY 1, 2""")
def label_centroids(t):
    c = search.centroids(t("embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("mean"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part)
    SELECT a.p_partkey AS a, b.p_partkey AS b, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 6) AS score
    FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w)))""")
def lineage_candidates(t):
    # parts of the same words are scored as one, and their pairs made from the result
    p = t("part").groupBy("p_brand", "p_size", F.array_distinct(T.terms(F.col("p_name"))).alias("w")).agg(F.array_sort(F.collect_list("p_partkey")).alias("m"))
    b = p.select("p_brand", "p_size", F.col("w").alias("wb"), F.col("m").alias("mb"))
    d = p.join(b, ["p_brand", "p_size"]).where(F.col("m")[0] <= F.col("mb")[0]).withColumn("score", F.round(search.jaccard(F.col("w"), F.col("wb")), 6)).where("score >= 0.5")
    d = d.select(F.col("m")[0].eqNullSafe(F.col("mb")[0]).alias("same"), F.explode("m").alias("x"), "mb", "score").select("same", "x", F.explode("mb").alias("y"), "score").where("not same or x < y")
    return d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


_LOG = "SELECT event_id, ts, user_id, event_type, floor(value / 20)::BIGINT::VARCHAR AS digest, json_extract_string(props, '$.k') AS path FROM events"


def _log(t):
    return t("events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 20).cast("long").cast("string").alias("digest"), F.get_json_object("props", "$.k").alias("path"))


# Observations are numbered within their entity; an insertion is the first row of a digest, the prior revision the latest insertion before a
# row. Its last path and its deletions are looked up by joins on its digest, so nothing is carried along.
_TRANSITIONS = """,
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM l),
    live AS (SELECT * FROM n WHERE NOT gone),
    ins AS (SELECT user_id, event_type, digest, min(i) AS i FROM live GROUP BY ALL),
    p AS (SELECT n.*, ins.digest AS prior FROM n ASOF LEFT JOIN ins ON n.user_id = ins.user_id AND n.event_type = ins.event_type AND n.i > ins.i),
    was AS (SELECT p.event_id, max(struct_pack(i := x.i, path := x.path)).path AS path FROM p JOIN live x ON p.user_id = x.user_id AND p.event_type = x.event_type AND p.prior = x.digest AND x.i < p.i GROUP BY 1),
    dead AS (SELECT g.user_id, g.event_type, x.digest, g.i, g.event_id FROM n g ASOF JOIN live x ON g.user_id = x.user_id AND g.event_type = x.event_type AND g.path = x.path AND g.i > x.i WHERE g.gone),
    ends AS (SELECT DISTINCT p.event_id FROM p JOIN dead d ON p.user_id = d.user_id AND p.event_type = d.event_type AND p.prior = d.digest AND d.i < p.i)
    SELECT p.event_id, CASE WHEN gone THEN d.digest ELSE prior END AS prior, CASE WHEN gone THEN CASE WHEN d.digest IS NOT NULL THEN 'deleted' END WHEN prior IS NULL THEN 'introduced' WHEN p.event_id IN (FROM ends) THEN 'resurrected'
        WHEN prior <> p.digest THEN 'modified' WHEN was.path IS DISTINCT FROM p.path THEN 'moved' ELSE 'unchanged' END AS kind
    FROM p LEFT JOIN was ON was.event_id = p.event_id LEFT JOIN dead d ON d.event_id = p.event_id"""


@query(f"WITH l AS (SELECT *, false AS gone FROM ({_LOG})){_TRANSITIONS}")
def transitions(t):
    return history.transitions(_log(t), ["user_id", "event_type"], ["ts", "event_id"], "digest", "path").select("event_id", "prior", "kind")


@query(f"WITH l AS (SELECT *, event_id % 5 = 2 AS gone FROM ({_LOG})){_TRANSITIONS}")
def transitions_with_deletions(t):
    log = _log(t).withColumn("gone", F.col("event_id") % 5 == 2)
    return history.transitions(log, ["user_id", "event_type"], ["ts", "event_id"], "digest", "path", "gone").select("event_id", "prior", "kind")


@query(f"""WITH l AS ({_LOG}) SELECT event_id, CASE WHEN lag(digest) OVER w IS NULL THEN 'introduced' WHEN lag(digest) OVER w <> digest THEN 'modified' ELSE 'unchanged' END AS kind
    FROM l WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def transitions_lag(t):
    before = F.lag("digest").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return _log(t).select("event_id", F.when(before.isNull(), "introduced").when(before != F.col("digest"), "modified").otherwise("unchanged").alias("kind"))


@query("SELECT user_id, event_type, count(*)::BIGINT AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events FROM events GROUP BY 1, 2")
def symbol_history(t):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["event_id"].cast("string")), ",").alias("events"))


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    w AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS path, 0 AS depth FROM region UNION ALL SELECT e.dst, w.path || '>' || e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 8)
    SELECT path, depth::BIGINT AS depth, 'leaf' AS terminal FROM w WHERE node NOT IN (SELECT src FROM e)""")
def trace_paths(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(t("supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))
    return graph.trace(t("region").select(name("r", "r_regionkey").alias("node")), e, 4).select(F.array_join("path", ">").alias("path"), "depth", "terminal")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def gap_detection(t):
    return history.gaps(t("customer").select("c_custkey", "c_mktsegment"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)::BIGINT AS present FROM customer")
def commit_present(t):
    return history.presence(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "present")


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def job_counts(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, sha256(text) AS revision, sha256(conv_id::VARCHAR || chr(10) || turn::VARCHAR) AS identity FROM conversations")
def content_id(t):
    return t("conversations").select("conv_id", "turn", F.sha2("text", 256).alias("revision"), F.sha2(F.concat_ws("\n", "conv_id", "turn"), 256).alias("identity"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def lww_merge(t):
    e = t("events").select("user_id", "event_id", "ts", "value")
    return history.merge_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ledger_left_join_count(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0).cast("long")))


@query(r"""WITH p AS (SELECT lower(regexp_replace(url, '[?#].*$', '')) AS u, strlen(html) AS n FROM pages)
    SELECT CASE WHEN regexp_matches(u, '(^|/)(node_modules|vendor|third_party)(/|$)') THEN 'vendored' WHEN regexp_matches(u, '(^|/)generated(/|$)|\.generated\.|\.gen\.') THEN 'generated'
      WHEN NOT regexp_matches(u, '\.(tsx?|mts|cts|jsx?|mjs|cjs|cljs|cljc?|bb|py|pyi|pyw)$') THEN 'unsupported-language' WHEN n > 10485760 THEN 'oversized' ELSE 'analysed' END AS reason, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def skip_reason_histogram(t):
    r = T.skip_reason(T.without_query(F.col("url")), F.octet_length("html"))
    return t("pages").groupBy(F.coalesce(r, F.lit("analysed")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT lang, quality, toxic, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def label_quality_join(t):
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS document FROM lineitem GROUP BY 1")
def commit_documents(t):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r["l_partkey"].cast("string")), " ").alias("document"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def nearest_rank_percentiles(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.5) within group (order by l_extendedprice)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by l_extendedprice)").alias("p95"))


@query("""SELECT c.conv_id, c.turn, min(abs(c.turn - h.turn))::BIGINT AS priority FROM conversations c JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'system') h
    ON h.conv_id = c.conv_id AND abs(c.turn - h.turn) <= 2 GROUP BY 1, 2""")
def neighbours_radius(t):
    c = t("conversations").select("conv_id", "turn", "role")
    return context.neighbours(c.select("conv_id", "turn"), c.where("role = 'system'"), "conv_id", "turn", 2)


@query("SELECT doc_id, CASE WHEN strlen(text) <= 16384 THEN 1 ELSE 1 + ceil((strlen(text) - 16384) / 15360.0) END::BIGINT AS n_chunks FROM documents")
def chunk_counts(t):
    n = F.octet_length("text")
    return t("documents").select("doc_id", F.when(n <= 16384, F.lit(1)).otherwise(1 + F.ceil((n - 16384) / 15360.0)).cast("long").alias("n_chunks"))


@query(f"""WITH d AS (SELECT conv_id, count(*) AS n FROM ({_MENTIONS}) JOIN (SELECT topic FROM ({_MENTIONS}) GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 6) USING (topic) GROUP BY 1)
    SELECT conv_id, round(CAST(1 - exp(-n / 3.0) AS DOUBLE), 6) AS score FROM d""")
def topic_message_score(t):
    m = topics.mentions(t("conversations"), "conv_id", "text")
    seed = m.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(6).select("topic")
    return m.join(seed, "topic", "left_semi").groupBy("conv_id").agg(F.round(1 - F.exp(-F.count("*") / 3.0), 6).alias("score"))


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT o_custkey)::BIGINT AS customers, coalesce(max(o_orderkey), 0)::BIGINT AS version FROM orders")
def index_counts(t):
    return t("orders").agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"), F.coalesce(F.max("o_orderkey"), F.lit(0)).cast("long").alias("version"))


@query(r"""WITH m AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.?!]["''’”)\]}」』】》]*)\s', E'\\1\n', 'g'), '([。？！]["''’”)\]}」』】》]*)', E'\\1\n', 'g'), '[\r\n]+')) AS s FROM conversations)
    SELECT conv_id, turn, count(*)::BIGINT AS n, max(length(trim(s)))::BIGINT AS longest FROM m WHERE trim(s) <> '' GROUP BY 1, 2""")
def sentence_counts(t):
    s = t("conversations").select("conv_id", "turn", F.explode_outer(T.sentences(F.col("text"))).alias("s")).where("s is not null")
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query(_bm25_sql("conversations WHERE role <> 'none'", "conv_id, turn", "").replace("SELECT conv_id, turn, round(", "SELECT message, revision, conversation, score FROM (SELECT conv_id || ':' || turn AS message, (SELECT sha256(text) FROM conversations c WHERE c.conv_id = y.conv_id AND c.turn = y.turn) AS revision, conv_id AS conversation, (SELECT role FROM conversations c WHERE c.conv_id = y.conv_id AND c.turn = y.turn) AS role, round(") + " ORDER BY score DESC, revision LIMIT 600) WHERE role = 'assistant' ORDER BY score DESC, revision, message LIMIT 20")
def chat_search_current(t):
    c = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("message"), F.sha2("text", 256).alias("revision"), F.col("conv_id").alias("conversation"), "role", "text", F.lit("main").alias("source"), F.col("turn").alias("seq"), F.lit(None).cast("timestamp").alias("created"), F.lit(None).cast("timestamp").alias("observed"))
    return chat.search_messages(c.select("revision", "text"), c.drop("text"), TERMS, 20, role="assistant")


@query(None)
def context_document(t):
    return chat.context_document(t("conversations").select("conv_id", "turn", "role", "text"), TERMS)
