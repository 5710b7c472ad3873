"""Registered queries: snippets, known names, blended search, rendered context, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import identity as I
from annalist.functions import text as T
from annalist.operators import chat, graph, history, projections, search, text_graph, topics
from annalist.plans.knowledge import _SPLIT
from annalist.plans.queries import _MENTIONS, TERMS, _bm25_sql
from annalist.plans.registry import query
from annalist.sources import archives, tables

_Q = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


@query(rf"""WITH x AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda v: v <> '') AS w FROM documents),
    h AS (SELECT doc_id, w, list_transform(w, lambda v: list_filter({_Q}, lambda q: list_contains(regexp_extract_all(lower(v), '[\p{{L}}\p{{N}}]+'), q))) AS hs FROM x),
    s AS (SELECT doc_id, w, hs, list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN len(hs[i]) > 0 THEN len(list_distinct(flatten(hs[i:i + 17]))) ELSE 0 END) AS n FROM h),
    b AS (SELECT doc_id, w, hs, greatest(0, least(CASE WHEN coalesce(list_max(n), 0) > 0 THEN list_position(n, list_max(n)) - 1 ELSE 0 END, len(w) - 18)) AS st FROM s)
    SELECT doc_id, (CASE WHEN st > 0 THEN '… ' ELSE '' END) || array_to_string(list_transform(range(st + 1, least(st + 18, len(w)) + 1), lambda i: CASE WHEN len(hs[i]) > 0 THEN '[' || w[i] || ']' ELSE w[i] END), ' ') || (CASE WHEN st + 18 < len(w) THEN ' …' ELSE '' END) AS snippet FROM b""")
def best_snippets(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), TERMS).alias("snippet"))


# key: kind, label, names
REGISTRY = {"concept:heat": ("concept", "Heat", ("heat", "heating")), "concept:water": ("concept", "Water", ("water",)), "tool:list": ("tool", "List", ("list", "lists"))}
_NAMES = " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS key, '{v[0]}' AS kind, '{v[1]}' AS label" for k, v in REGISTRY.items() for n in v[2])


@query(rf"""WITH r AS ({_NAMES}), w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_-]', ' ', 'g'), ' ')) AS name FROM documents)
    SELECT doc_id, kind, label, key, count(*)::BIGINT AS n FROM w JOIN r USING (name) GROUP BY ALL""")
def known_names(t):
    found = t("documents").select("doc_id", F.explode_outer(T.known_names(F.col("text"), REGISTRY)).alias("e")).where("e is not null")
    return found.groupBy("doc_id", "e.kind", "e.label", "e.key").agg(F.count("*").alias("n"))


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


@query(f"""WITH q AS (SELECT embedding AS qv, label AS ql FROM embeddings WHERE vec_id = 0),
    f AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT label, list(v ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS v FROM f GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT label AS topic, round({_cos('c', 'qv')}, 6) AS w FROM c, q WHERE round({_cos('c', 'qv')}, 6) >= 0.05 ORDER BY w DESC, topic LIMIT 3),
    e AS (SELECT label AS s, label + 1 AS o FROM c UNION ALL SELECT label + 1, label FROM c),
    n AS (SELECT o AS topic, 0.55 * max(round(CAST(w * 0.5 AS DOUBLE), 6)) AS w FROM e JOIN s ON e.s = s.topic WHERE o NOT IN (SELECT topic FROM s) GROUP BY 1 ORDER BY w DESC, topic LIMIT 12),
    w AS (SELECT * FROM s UNION ALL SELECT * FROM n)
    SELECT vec_id, round(CAST(0.58 * (1 - exp(-(0.68 * w.w) / 3)) + 0.34 * greatest(0, {_cos('embedding', 'qv')}) + 0.08 * (label = ql)::INT AS DOUBLE), 6) AS score
    FROM embeddings JOIN w ON label = w.topic, q ORDER BY score DESC, vec_id LIMIT 20""")
def blended_search(t):
    e = t("embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("vector"), F.array("label").alias("labels"))
    c = search.centroids(e, "label", "embedding").withColumnRenamed("label", "topic")
    seeds = search.nearest(c, "topic", "centroid", one, 0.05, 3)
    chain = c.select(F.col("topic").alias("a"), (F.col("topic") + 1).alias("b"), F.lit(1).alias("support"), F.lit(0.5).alias("score"))
    found = e.select("vec_id", F.col("label").alias("topic"), F.lit(0.68).alias("weight"))
    return search.blended(found, seeds, topics.related(seeds, chain), e.select("vec_id", F.col("embedding").alias("vector"), F.array("label").alias("labels")), one, "vec_id")


@query("""WITH m AS (SELECT conv_id, turn, role, text, 'H' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cite, sha256(text) AS rev FROM conversations)
    SELECT conv_id AS conversation, '## Conversation ' || conv_id || chr(10) || chr(10) || string_agg('### [' || cite || '] ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '## Provenance' || chr(10) || chr(10)
        || string_agg('- [' || cite || '] message `' || conv_id || ':' || turn || '`; revision `' || rev || '`', chr(10) ORDER BY turn) || chr(10) AS markdown FROM m GROUP BY conv_id""")
def context_markdown(t):
    m = t("conversations")
    m = m.select(F.col("conv_id").alias("conversation"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), F.col("turn").alias("position"), "role", "text", F.concat_ws(":", "conv_id", "turn").alias("message"), F.sha2("text", 256).alias("revision"), T.token_estimate(F.col("text")).alias("tokens"))
    return chat.transcripts(m)


@query("""SELECT 'c' || c_custkey AS ref, CASE WHEN last IS NULL THEN 'empty' WHEN last % 7 = 0 THEN 'checkpoint-missing' WHEN last % 5 = 0 THEN 'ref-rewritten' ELSE 'ready' END AS status
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def recovery_status(t):
    o = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("ref"), F.col("o_orderkey").alias("oid"))
    refs = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("ref"))
    at = refs.join(o.groupBy("ref").agg(F.max("oid").alias("oid")), "ref", "left")
    return chat.checkpoint_status(at, o.where("oid % 7 <> 0"), o.where("oid % 5 <> 0"))


@query("""SELECT 'orders.o_custkey' AS link, count(*)::BIGINT AS broken FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
    UNION ALL SELECT 'lineitem.l_suppkey', count(*)::BIGINT FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3)""")
def broken_links(t):
    some = lambda name, link, found, on: history.gaps(t(name), found, [on]).agg(F.lit(link).alias("link"), F.count("*").alias("broken"))
    customers = t("customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    suppliers = t("supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return some("orders", "orders.o_custkey", customers, "o_custkey").unionByName(some("lineitem", "lineitem.l_suppkey", suppliers, "l_suppkey"))


@query("""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS ctx FROM conversations),
    m AS (SELECT conv_id, turn, ctx, topic, 0.5 + 0.01 * length(topic) AS weight FROM (SELECT conv_id, turn, ctx, unnest(list_distinct(regexp_extract_all(lower(s), '[a-z]{7,}'))) AS topic FROM c)),
    tc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, ctx ORDER BY weight DESC, topic) AS k FROM m) WHERE k <= 24),
    u AS (SELECT conv_id, turn, topic, max(weight) AS weight FROM m GROUP BY ALL),
    tm AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, topic) AS k FROM u),
    p AS (SELECT l.topic AS a, r.topic AS b, 'c' || l.conv_id || ':' || l.turn || ':' || l.ctx AS place, 4 * sqrt(l.weight * r.weight) AS w FROM tc l JOIN tc r ON l.conv_id = r.conv_id AND l.turn = r.turn AND l.ctx = r.ctx AND l.topic < r.topic
        UNION ALL SELECT l.topic, r.topic, 'm' || l.conv_id || ':' || l.turn, 0.75 * sqrt(l.weight * r.weight) FROM tm l JOIN tm r ON l.conv_id = r.conv_id AND l.turn = r.turn AND l.topic < r.topic WHERE l.k <= 36 AND r.k <= 36
        UNION ALL SELECT least(l.topic, r.topic), greatest(l.topic, r.topic), 'r' || l.conv_id || ':' || l.turn, 1.5 * sqrt(l.weight * r.weight) FROM tm l JOIN tm r ON l.conv_id = r.conv_id AND r.turn = l.turn + 1 AND l.topic <> r.topic WHERE l.k <= 18 AND r.k <= 18),
    d AS (SELECT topic, count(*) AS n FROM u GROUP BY 1), g AS (SELECT a, b, sum(w) AS w, count(DISTINCT place)::BIGINT AS support FROM p GROUP BY 1, 2 HAVING count(DISTINCT place) >= 3)
    SELECT a, b, support, round(CAST(1 - exp(-(w / sqrt(x.n * y.n)) / 3) AS DOUBLE), 6) AS score FROM g JOIN d x ON x.topic = a JOIN d y ON y.topic = b""")
def evidence_associations(t):
    c = t("conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("message"), "text")
    s = c.select("message", F.posexplode(F.split("text", "[.]")).alias("context", "s"))
    m = s.select("message", "context", F.explode_outer(F.array_distinct(T.terms(F.col("s"), "[a-z]{7,}"))).alias("topic")).where("topic is not null").withColumn("weight", 0.5 + 0.01 * F.length("topic"))
    ids = t("conversations").select("conv_id", "turn")
    replies = ids.join(ids.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("src"), F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") + 1).alias("dst"))
    return topics.evidence_associations(m, replies, 3)


@query("""WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, CASE n_regionkey WHEN 0 THEN 'dynamic' WHEN 1 THEN 'inferred' ELSE 'none' END AS doubt FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n0', 'none' FROM region WHERE r_regionkey IN (2, 3) UNION ALL SELECT 'r' || r_regionkey, NULL, 'unresolved' FROM region WHERE r_regionkey = 4)
    SELECT 'n' || n_nationkey AS start, CASE n_regionkey WHEN 0 THEN 'n' || n_nationkey || '>r0' WHEN 1 THEN 'n' || n_nationkey || '>r1' WHEN 4 THEN 'n' || n_nationkey || '>r4' WHEN 3 THEN 'n' || n_nationkey || '>r3' ELSE 'n' || n_nationkey || '>r2>n0>r0' END AS path,
    CASE n_regionkey WHEN 0 THEN 'dynamic' WHEN 1 THEN 'inferred' WHEN 4 THEN 'unresolved' WHEN 3 THEN 'sink' ELSE 'dynamic' END AS terminal FROM nation""")
def trace_in_doubt(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region = F.col("n_regionkey")
    up = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.when(region == 0, "dynamic").when(region == 1, "inferred").otherwise("none").alias("doubt"))
    back = t("region").where("r_regionkey >= 2").select(name("r", "r_regionkey").alias("src"), F.when(F.col("r_regionkey") < 4, "n0").alias("dst"), F.when(F.col("r_regionkey") < 4, "none").otherwise("unresolved").alias("doubt"))
    paths = graph.trace(t("nation").select(name("n", "n_nationkey").alias("node")), up.unionByName(back), 6, F.col("node") == "r3")
    return paths.select(F.element_at("path", 1).alias("start"), F.array_join("path", ">").alias("path"), "terminal")


@query("""WITH h AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20),
    l AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)
    SELECT p_partkey, rank, coalesce(string_agg(l_orderkey || ':' || l_linenumber, ' ' ORDER BY k), '') AS locations FROM h LEFT JOIN l ON l_partkey = p_partkey AND k <= 5 GROUP BY 1, 2""")
def retrieved_context(t):
    hits = search.ranked(t("part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 20)
    found = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    d = search.with_evidence(hits, "p_partkey", {"locations": (found, ["l_orderkey", "l_linenumber"], 5)})
    return d.select("p_partkey", "rank", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"])), " ").alias("locations"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 <> 1 THEN turn END NULLS LAST, turn) - 1 AS ordinal FROM conversations""")
def conversation_snapshot(t):
    c = t("conversations").select("conv_id", "turn", F.col("conv_id").alias("conversation"), F.concat_ws(":", "conv_id", F.lpad(F.col("turn").cast("string"), 9, "0")).alias("message"), F.lit("main").alias("source"), F.lit(None).cast("timestamp").alias("created"), F.when(F.col("turn") % 3 != 1, F.col("turn")).alias("active_position"))
    seen = c.withColumn("observed", F.lit("1")).withColumn("seq", F.lit(1)).unionByName(c.withColumn("observed", F.lit("0")).withColumn("seq", F.lit(2)).withColumn("active_position", F.lit(0).cast("long")))
    return chat.snapshot(seen).select("conv_id", "turn", "ordinal")


_HITS = _bm25_sql("conversations", "conv_id, turn", "ORDER BY score DESC, conv_id, turn LIMIT 96")


@query(f"""WITH RECURSIVE h AS ({_HITS}), b AS (SELECT conv_id, max(score) AS top FROM h GROUP BY 1 ORDER BY top DESC, conv_id LIMIT 8),
    n AS (SELECT c.conv_id, c.turn, min(abs(c.turn - h.turn))::BIGINT AS priority, any_value(greatest(1, ceil(strlen(c.text) / 4.0))::BIGINT + 18) AS cost FROM conversations c JOIN b USING (conv_id) JOIN h ON h.conv_id = c.conv_id AND abs(c.turn - h.turn) <= 2 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority, turn) AS k FROM n),
    w AS (SELECT conv_id, turn, priority, k, CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS used, cost <= 1500 AS taken FROM k WHERE k = 1
        UNION ALL SELECT k.conv_id, k.turn, k.priority, k.k, CASE WHEN w.used + k.cost <= 1500 THEN w.used + k.cost ELSE w.used END, w.used + k.cost <= 1500 FROM w JOIN k ON k.conv_id = w.conv_id AND k.k = w.k + 1)
    SELECT conv_id, turn, priority, used::BIGINT AS used FROM w WHERE taken""")
def context_bundle(t):
    return chat.context_bundle(t("conversations").select("conv_id", "turn", "text"), TERMS)


@query(f"""WITH l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25_sql('documents', 'doc_id', 'ORDER BY score DESC, doc_id LIMIT 50')})),
    d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, round({_cos('e.embedding', 'q.embedding')}, 6) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY s DESC, e.vec_id LIMIT 50))
    SELECT id, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM d) GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def hybrid_search(t):
    hits = search.bm25(t("documents"), ["doc_id"], F.col("text"), TERMS, 50).withColumnRenamed("doc_id", "id")
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = search.nearest(e, "id", "embedding", e.where("id = 3").select(F.col("embedding").alias("vector")), -1.0, 50)
    return search.hybrid(search.ranked(hits, [F.desc("score"), F.col("id")], 50), search.ranked(near, [F.desc("strength"), F.col("id")], 50), "id", 50)


@query(f"""WITH m AS ({_MENTIONS}), d AS (SELECT topic, count(*) AS df FROM m GROUP BY 1),
    x AS (SELECT topic, topic = 'heathe' AS exact, len(list_filter(['heath', 'erthe', 'that'], lambda q: contains(topic, q))) AS shared, df FROM d),
    r AS (SELECT *, row_number() OVER (ORDER BY exact DESC, shared DESC, df DESC, topic) AS r FROM x WHERE exact OR shared > 0)
    SELECT topic, round(CAST((CASE WHEN exact THEN 1.2 ELSE 1.0 END) / log2(r + 1.0) AS DOUBLE), 6) AS strength FROM r WHERE r <= 8""")
def topic_search(t):
    stats = topics.mentions(t("conversations"), "conv_id", "text").groupBy("topic").agg(F.count("*").alias("df"))
    shared = sum((F.col("topic").contains(q).cast("int") for q in ("heath", "erthe", "that")), F.lit(0))
    return topics.find(stats, shared, "heathe")


@query(rf"""WITH s AS ({_SPLIT}) SELECT 'semantic' AS layer, 'proposition' AS kind, count(*)::BIGINT AS n FROM s WHERE regexp_matches(s, '[\p{{L}}\p{{N}}]') HAVING count(*) > 0
    UNION ALL SELECT 'reference', 'url', count(*)::BIGINT FROM (SELECT DISTINCT conv_id, turn, regexp_replace(unnest(regexp_extract_all(s, 'https?://[^\s<>{{}}\[\]"'']+')), '[.,;:!?)]+$', '') AS u FROM s) HAVING count(*) > 0
    UNION ALL SELECT 'reference', 'path', count(*)::BIGINT FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(s, '(^|[\s`''"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{{1,12}})', 2)) AS u FROM s) HAVING count(*) > 0""")
def text_graph_concepts(t):
    c = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found, _ = text_graph.project(text_graph.nodes(c, "id", "text"), text_graph.edges(c, "id", "text"), "concepts")
    return found.groupBy("layer", "kind").agg(F.count("*").alias("n"))


_CLOSE = T.CLOSERS.replace("'", "''")


@query(rf"""WITH p AS (SELECT conv_id, turn, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.?!]{_CLOSE})(\s)', E'\\1\x01\\2', 'g'), '([。？！]{_CLOSE})', E'\\1\x01', 'g'), '([
])', E'\x01\\1\x01', 'g'), E'\x01') AS x FROM conversations)),
    o AS (SELECT *, coalesce(sum(strlen(p)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(p) - strlen(regexp_replace(p, '^\s+', '')) AS a, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS text FROM p)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS ordinal, a::BIGINT AS start_byte, (a + strlen(text))::BIGINT AS end_byte, text FROM o WHERE text <> ''""")
def sentence_spans(t):
    s = t("conversations").select("conv_id", "turn", F.posexplode(T.spans(F.col("text"))).alias("ordinal", "s"))
    return s.select("conv_id", "turn", "ordinal", F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"), "s.text")


@query("""SELECT conv_id, turn, CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, list_max(list_filter(range(0, 198), lambda n: strlen(left(text, n)) <= 197))) || '…' END AS short FROM conversations""")
def truncated_to_bytes(t):
    return t("conversations").select("conv_id", "turn", T.truncated_bytes(F.col("text"), 200).alias("short"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"b\":[1,{\"x\":null,\"y\":\"é\"}],\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def canonical_properties(t):
    loose = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "b": [1, {"y": "é", "x": null}], "a" : '), "event_id", F.lit("}"))
    return t("events").select("event_id", projections.canonical_json(loose).alias("canonical"))


@query("""SELECT user_id, event_type, max(value) AS value, string_agg(DISTINCT k, ' ' ORDER BY k) AS keys FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL""")
def merged_mentions(t):
    e = t("events").select("user_id", "event_type", "value", F.array(F.get_json_object("props", "$.k")).alias("keys"))
    return projections.merged_mentions(e, ["user_id", "event_type"], "value", ["keys"]).withColumn("keys", F.array_join("keys", " "))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 > 0)""")
def changed_digests(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    stored = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return projections.pending(o, stored, "o_orderkey", "o_orderstatus")


@query("""SELECT 'r' || c_custkey AS ref, CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE 'rewritten' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS oid FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 4 = 0 OR oid % 6 = 1""")
def rewritten_refs(t):
    o = t("orders").select(F.concat(F.lit("r"), "o_custkey").alias("ref"), F.col("o_orderkey").alias("oid"))
    c = t("customer").select(F.concat(F.lit("r"), "c_custkey").alias("ref"), "c_custkey")
    at = c.select("ref").join(o.groupBy("ref").agg(F.max("oid").alias("oid")), "ref", "left")
    return projections.resets(at, c.where("c_custkey % 4 <> 0"), o.where("oid % 6 <> 1"))


@query("""SELECT user_id, (n <> k OR user_id % 3 = 0) AS stale FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 50 > 0) AS k FROM events GROUP BY 1)""")
def stale_projections(t):
    e = t("events")
    now = e.groupBy("user_id").agg(F.count("*").alias("graphs"), F.lit("f1").alias("fingerprint"))
    was = e.where("event_id % 50 > 0 and user_id % 3 > 0").groupBy("user_id").agg(F.count("*").alias("graphs"), F.lit("f1").alias("fingerprint"))
    return projections.stale(was, now, "user_id", ["graphs", "fingerprint"])


_PATH = "CASE page_id % 7 WHEN 0 THEN 'sources/a/' || page_id || '/source.json' WHEN 1 THEN 'imports/x/' || page_id || '.json' WHEN 2 THEN 'conversations/' || page_id || '/h/manifest.json' WHEN 3 THEN '/abs/' || page_id WHEN 4 THEN 'a' || chr(92) || '..' || chr(92) || page_id WHEN 5 THEN 'sources/' || page_id || '/source.json' ELSE 'C:/' || page_id END"


@query(f"""SELECT page_id, CASE WHEN page_id % 7 IN (3, 6) THEN 'absolute' WHEN page_id % 7 = 4 THEN 'upward' END AS fault, page_id % 7 <= 2 AS relevant FROM (SELECT page_id, {_PATH} AS path FROM pages)""")
def archive_entries(t):
    p = t("pages").select("page_id", F.expr(_PATH.replace("chr(92)", "char(92)")).alias("path"))
    return p.select("page_id", archives.entry_fault(F.col("path")).alias("fault"), archives.relevant(F.col("path")).alias("relevant"))


@query("""SELECT conv_id AS conversation, count(*)::BIGINT AS messages, string_agg(role, ' ' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS texts FROM conversations GROUP BY 1""")
def export_messages(t):
    """Conversations written as an export would hold them, read as its records, and their messages along the active path."""
    node = F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.struct(F.col("turn").cast("string").alias("id"), F.struct(F.col("role").alias("role"), F.lit(None).cast("string").alias("name")).alias("author"), (F.col("turn") + 1e9).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content")).alias("message"))
    c = t("conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    one = F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.lit(1.0).alias("update_time"), "current_node", "mapping"))
    text = F.when(F.col("conv_id") % 3 == 0, one).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"conversations": ['), one, F.lit("]}")))
    records = archives.latest_conversations(archives.payloads(c.select(F.concat(F.lit("f"), "conv_id").alias("path"), text.alias("text"))))
    m = tables.chat_messages(records).withColumn("turn", F.col("node").cast("long"))
    line = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return m.groupBy(F.col("conversation").cast("long").alias("conversation")).agg(F.count("*").alias("messages"), F.array_join(F.transform(line, lambda x: x["role"]), " ").alias("roles"), F.sha2(F.array_join(F.transform(line, lambda x: x["text"]), "\n"), 256).alias("texts"))


_QUERIED = "SELECT q.vec_id AS query, e.vec_id AS neighbour, round(CAST({} AS DOUBLE), 6) AS similarity FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q".format(_cos("e.embedding", "q.embedding"))


@query(f"SELECT query, similarity, place FROM (SELECT query, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS place FROM ({_QUERIED})) WHERE place <= 10")
def nearest_of_queries(t):
    e = t("embeddings")
    return search.nearest_rows(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 10).select("query", "similarity", "place")


@query(_bm25_sql("conversations", "conv_id, turn", "ORDER BY score DESC, conv_id, turn LIMIT 20"))
def bm25_search_postings(t):
    c, text = t("conversations"), F.col("text")
    return search.bm25_indexed(search.postings(c, ["conv_id", "turn"], text), search.corpus_size(c, text), ["conv_id", "turn"], " ".join(TERMS))


@query("""SELECT conv_id, turn, 'log:chat:' || url_encode('a b/' || role) || ':message:' || conv_id || '%3A' || turn AS entity, 'chat-' || left(sha256('chat' || chr(0) || conv_id), 24) AS key, 'messages/' || left(sha256(text), 2) || '/' || sha256(text) || '/message.json' AS path,
    'refs/log/sources/chat/' || left(sha256(conv_id::VARCHAR), 32) AS ref FROM conversations""")
def entity_names(t):
    own = F.concat_ws(":", "conv_id", "turn")
    return t("conversations").select(
        "conv_id", "turn", I.entity_id("log", F.lit("chat"), F.concat(F.lit("a b/"), "role"), F.lit("message"), own).alias("entity"), I.source_key(F.lit("chat"), F.col("conv_id")).alias("key"),
        I.message_paths(F.sha2("text", 256), F.lit(None).cast("string"))["normalized"].alias("path"), I.source_ref("log", F.lit("Chat"), F.col("conv_id").cast("string")).alias("ref"),
    )


@query("""SELECT sha256(string_agg(url || chr(0) || strlen(html) || chr(0) || sha256(html) || chr(10), '' ORDER BY url, page_id)) AS fingerprint FROM (SELECT min(page_id) AS page_id, url, any_value(html) AS html FROM pages GROUP BY url HAVING count(*) = 1)""")
def files_fingerprint(t):
    p = t("pages").groupBy("url").agg(F.count("*").alias("n"), F.first("html").alias("html")).where("n = 1")
    return I.files_fingerprint(p.select(F.col("url").alias("path"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256")))


@query(f"""WITH m AS ({_MENTIONS}), d AS (SELECT topic, count(*) AS df FROM m GROUP BY 1), w AS (SELECT topic, df, regexp_extract_all(topic, '[\\p{{L}}\\p{{N}}]+') AS t FROM d), n AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av FROM w),
    f AS (SELECT topic, df, len(t)::DOUBLE AS dl, q, len(list_filter(t, lambda x: x = q))::DOUBLE AS f FROM w, (SELECT unnest(['thing', 'ering', 'thble']) AS q)), g AS (SELECT q, sum((f > 0)::INT)::DOUBLE AS c FROM f GROUP BY 1),
    b AS (SELECT topic, any_value(df) AS df, round(sum(greatest(1e-6, ln((n - c + 0.5) / (c + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM f JOIN g USING (q), n WHERE f > 0 GROUP BY 1)
    SELECT topic, round(CAST(1.0 / log2(row_number() OVER (ORDER BY score DESC, df DESC, topic) + 1.0) AS DOUBLE), 6) AS strength FROM b QUALIFY row_number() OVER (ORDER BY score DESC, df DESC, topic) <= 8""")
def topic_lookup(t):
    return topics.lookup(topics.mentions(t("conversations"), "conv_id", "text").groupBy("topic").agg(F.count("*").alias("df")), "thing ering thble")


@query("""SELECT c_custkey AS commit, x.archive FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice AS archive, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) x ON o_custkey = c_custkey AND k = 1""")
def first_receipts(t):
    o = t("orders").select(F.lit("s").alias("source"), F.col("o_custkey").alias("commit"), F.struct("o_orderpriority", "o_orderkey").alias("path"), F.col("o_totalprice").alias("archive"))
    return chat.with_receipts(t("customer").select(F.lit("s").alias("source"), F.col("c_custkey").alias("commit")), o).select("commit", "archive")


@query("""SELECT user_id AS conversation, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 > 0 THEN lpad((event_id * 7 % 1000)::VARCHAR, 4, '0') WHEN event_id % 2 > 0 THEN lpad((event_id * 3 % 1000)::VARCHAR, 4, '0') ELSE '' END DESC, event_id DESC) = 1""")
def conversation_heads(t):
    at = lambda n: F.lpad((F.col("event_id") * n % 1000).cast("string"), 4, "0")
    o = t("events").select(F.col("user_id").alias("conversation"), F.when(F.col("event_id") % 3 > 0, at(7)).alias("committed"), F.when(F.col("event_id") % 2 > 0, at(3)).alias("observed"), F.col("event_id").alias("seq"))
    return chat.conversation_heads(o).select("conversation", "seq")


@query("""WITH RECURSIVE k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    w AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS turn, ''::VARCHAR AS content, false AS cut, 1500::BIGINT AS remaining FROM k WHERE k.k = 1
        UNION ALL SELECT k.conv_id, k.k, k.turn, CASE WHEN strlen(text) <= least(600, remaining) THEN text ELSE left(text, list_max(list_filter(range(0, 601), lambda n: strlen(left(text, n)) <= greatest(0, least(600, remaining) - 3)))) || '…' END, strlen(text) > least(600, remaining),
            remaining - strlen(text) FROM w JOIN k ON k.conv_id = w.conv_id AND k.k = w.k + 1 WHERE NOT w.cut AND w.remaining > 0 AND w.k < 4)
    SELECT conv_id AS conversation, turn AS ordinal, content, cut FROM w WHERE k > 0""")
def capped_conversations(t):
    return chat.capped(t("conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("ordinal"), "text"), 4, 1500, 600)


@query("""SELECT n.topic, count(p_partkey)::BIGINT AS mentions, count(DISTINCT p_type)::BIGINT AS df, min(r.a) AS first_seen, max(r.b) AS last_seen FROM (SELECT DISTINCT p_brand AS topic FROM part UNION ALL SELECT 'Brand#none') n
    LEFT JOIN part ON p_brand = topic LEFT JOIN (SELECT p_type AS t, min(p_size) AS a, max(p_size) AS b FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1) r ON r.t = p_type GROUP BY 1""")
def topic_statistics(t):
    p = t("part")
    revisions = p.where("p_type <> 'ECONOMY'").groupBy(F.col("p_type").alias("revision")).agg(F.min("p_size").alias("created"), F.max("p_size").alias("updated"))
    known = p.select(F.col("p_brand").alias("topic")).distinct().unionByName(p.sparkSession.range(1).select(F.lit("Brand#none").alias("topic")))
    return topics.statistics(known, p.select(F.col("p_brand").alias("topic"), F.col("p_type").alias("revision")), revisions)


@query("""WITH w AS (SELECT 'AF' AS topic, 1.2 AS factor, 'direct' AS source UNION ALL SELECT 'NO', 0.5, 'associated' UNION ALL SELECT 'RF', 0.9, 'direct'),
    c AS (SELECT l_orderkey AS revision, w.topic, source, factor::DOUBLE * l_quantity AS c, 'f' || l_linenumber % 3 AS facet FROM lineitem JOIN w ON w.topic = l_returnflag || l_linestatus),
    b AS (SELECT revision, topic, source, round(max(c), 6) AS c FROM c GROUP BY ALL)
    SELECT revision, round(sum(c), 6) AS raw_score, (SELECT coalesce(string_agg(topic || ':' || round(c * 10)::BIGINT, ' ' ORDER BY c DESC, topic), '') FROM b WHERE b.revision = c.revision AND source = 'direct') AS direct, string_agg(DISTINCT facet, ' ' ORDER BY facet) AS facets FROM c GROUP BY revision""")
def topic_contributions(t):
    line = t("lineitem").select(F.col("l_orderkey").alias("revision"), F.concat("l_returnflag", "l_linestatus").alias("topic"), F.col("l_quantity").alias("weight"), F.array(F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string"))).alias("facets"))
    weights = line.sparkSession.createDataFrame([("AF", 1.2, "direct"), ("NO", 0.5, "associated"), ("RF", 0.9, "direct")], "topic string, factor double, source string")
    d = topics.contributions(line, weights)
    return d.select("revision", "raw_score", F.array_join(F.transform("direct", lambda x: F.concat_ws(":", x["topic"], F.round(x["contribution"] * 10).cast("long"))), " ").alias("direct"), F.array_join("facets", " ").alias("facets"))
