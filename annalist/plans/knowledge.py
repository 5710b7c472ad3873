"""More registered queries: phrases, entities, topics, fused search, prototypes, similar symbols, walks and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph, history, search, text_graph, topics
from annalist.plans.queries import _ASSOC, TERMS, _bm25_sql
from annalist.plans.registry import query

FOLDED = ("fur", "cion", "etre", "und")
PHRASES = ("of the", "the", "el de la")


def bm25_sql(source: str, keys: str, text: str, queries: Sequence[str], tail: str) -> str:
    def count(q: str) -> str:
        w = q.split(" ")
        return f"len(list_filter(range(1, len(t) - {len(w)} + 2), lambda i: t[i:i + {len(w) - 1}] = [{', '.join(repr(x) for x in w)}]))::DOUBLE"

    idf = lambda i: f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
    part = [f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(queries))]
    return f"""WITH x AS (SELECT {keys}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
    y AS (SELECT {keys}, len(t)::DOUBLE AS dl, {', '.join(f'{count(q)} AS f{i}' for i, q in enumerate(queries))} FROM x),
    s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {', '.join(f'sum((f{i} > 0)::INT)::DOUBLE AS d{i}' for i in range(len(queries)))} FROM y)
    SELECT {keys}, round(CAST({' + '.join(part)} AS DOUBLE), 6) AS score FROM y, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(queries)))} {tail}"""


@query(bm25_sql("conversations", "conv_id, turn", "strip_accents(lower(coalesce(text, '')))", FOLDED, "ORDER BY score DESC, conv_id, turn LIMIT 50"))
def bm25_search_folded(t):
    return search.bm25(t("conversations"), ["conv_id", "turn"], T.folded(F.col("text")), FOLDED, 50)


@query(bm25_sql("documents", "doc_id", "lower(coalesce(text, ''))", PHRASES, "ORDER BY score DESC, doc_id LIMIT 50"))
def bm25_search_phrases(t):
    return search.bm25(t("documents"), ["doc_id"], F.col("text"), PHRASES, 50)


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
    SELECT doc_id, i AS ordinal, i * 3072 AS start_byte, least(n, i * 3072 + 4096) AS end_byte FROM (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 4096) / 3072.0))::BIGINT + 1)) AS i FROM d)""")
def chunk_windows(t):
    w = t("documents").select("doc_id", F.explode(T.windows(F.col("text"), 4096, 1024)).alias("w"))
    return w.select("doc_id", "w.ordinal", F.col("w.start").alias("start_byte"), F.col("w.end").alias("end_byte"))


@query("""SELECT conv_id, turn, CASE WHEN strlen(text) <= 80 THEN text ELSE left(text, list_max(list_filter(range(0, 78), lambda n: strlen(left(text, n)) <= 77))) || '…' END AS short FROM conversations""")
def truncated_to_tokens(t):
    return t("conversations").select("conv_id", "turn", T.truncated(F.col("text"), 20).alias("short"))


@query(r"SELECT doc_id, CASE WHEN length(l) <= 220 THEN l ELSE left(l, 219) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents)")
def fallback_snippets(t):
    return t("documents").select("doc_id", T.compact(F.col("text"), 220).alias("snippet"))


_PAGE = "'use @Acme/p' || page_id || ' at https://github.com/acme/r' || page_id || '.git, see src/p' || page_id || '/main.py (' || url || ').'"


@query(rf"""WITH p AS (SELECT page_id, {_PAGE} AS x FROM pages),
    u AS (SELECT page_id, unnest(list_transform(regexp_extract_all(x, 'https?://[^\s<>{{}}\[\]"'']+'), lambda v: regexp_replace(v, '[.,;:!?)]+$', ''))) AS v FROM p),
    r AS (SELECT page_id, regexp_replace(regexp_extract(v, '^https?://github\.com/+([^/?#]+/+[^/?#]+)', 1), '\.git$', '') AS v FROM u),
    e AS (SELECT page_id, 'url' AS kind, v AS label, v FROM u UNION ALL SELECT page_id, 'repository', v, lower(v) FROM r WHERE v <> ''
        UNION ALL SELECT page_id, 'package', v, lower(v) FROM (SELECT page_id, unnest(regexp_extract_all(x, '(^|[^\p{{L}}\p{{N}}_])(@[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*)', 2)) AS v FROM p)
        UNION ALL SELECT page_id, 'path', v, v FROM (SELECT page_id, unnest(regexp_extract_all(x, '(^|[\s`''"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{{1,12}})', 2)) AS v FROM p))
    SELECT DISTINCT page_id, kind, label, kind || ':' || v AS key FROM e""")
def entity_references(t):
    text = F.concat(F.lit("use @Acme/p"), "page_id", F.lit(" at https://github.com/acme/r"), "page_id", F.lit(".git, see src/p"), "page_id", F.lit("/main.py ("), "url", F.lit(")."))
    return t("pages").select("page_id", F.explode(T.entities(text)).alias("e")).select("page_id", "e.kind", "e.label", "e.key")


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://chat.example.com/c/' || page_id END AS clean FROM pages""")
def allowed_urls(t):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://chat.example.com/c/"), "page_id", F.lit("?utm=1#x"))).otherwise(F.col("url"))
    return t("pages").select("page_id", T.clean_url(u, ["chat.example.com"]).alias("clean"))


_BOUNDARY = "[" + ", ".join(f"'{w}'" for w in topics.BOUNDARY_WORDS) + "]"
_PHRASE_TOPICS = rf"""w AS (SELECT conv_id, turn, text, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}@/._-]+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM conversations),
    g AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(array_to_string(list_transform(l, lambda x: CASE WHEN length(x) < 3 OR list_contains({_BOUNDARY}, x) THEN '|' ELSE x END), ' '), '|'), lambda x: string_split(trim(x), ' ')), lambda x: x[1] <> '') AS gs FROM w),
    c AS (SELECT conv_id, turn, text, flatten(list_transform(gs, lambda s: CASE WHEN len(s) = 1 AND length(s[1]) >= 5 THEN [{{'kind': 'keyword', 'label': s[1], 'weight': 0.68::DOUBLE}}] WHEN len(s) = 1 THEN []
        WHEN len(s) <= 4 THEN [{{'kind': 'phrase', 'label': array_to_string(s, ' '), 'weight': round((1.04 + (len(s) - 2) * 0.12)::DOUBLE, 6)}}]
        ELSE list_transform(range(1, len(s) - 2), lambda i: {{'kind': 'phrase', 'label': array_to_string(s[i:i + 3], ' '), 'weight': 1.28::DOUBLE}}) END)) AS cs FROM g),
    f AS (SELECT conv_id, turn, text, x, min(i) AS i FROM (SELECT conv_id, turn, text, unnest(cs) AS x, generate_subscripts(cs, 1) AS i FROM c) GROUP BY ALL),
    k AS (SELECT conv_id, turn, text, x.kind AS kind, x.label AS label, x.weight AS weight FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM f) WHERE r <= 8)"""


@query(f"WITH {_PHRASE_TOPICS} SELECT conv_id, turn, kind, label, weight FROM k")
def phrase_topics(t):
    return t("conversations").select("conv_id", "turn", F.explode_outer(topics.phrases(F.col("text"))).alias("x")).where("x is not null").select("conv_id", "turn", "x.kind", "x.label", "x.weight")


_FACTOR = "greatest(1.0::DOUBLE, " + ", ".join("CASE WHEN regexp_matches(trim(lower(text)), '" + '|'.join(T.SPEECH_ACTS[k][1]).replace("'", "''") + f"') THEN {f}::DOUBLE ELSE 1.0 END" for k, f in topics.FACETS.items()) + ")"


@query(f"WITH {_PHRASE_TOPICS} SELECT label AS topic, count(*)::BIGINT AS df, round(max(weight * {_FACTOR}), 6) AS heaviest FROM k GROUP BY 1")
def faceted_topics(t):
    acts = F.transform(T.speech_acts(F.col("text")), lambda a: a["kind"])
    once = t("conversations").select(topics.phrases(F.col("text")).alias("p"), topics.facet_factor(acts).alias("f"))
    d = once.select(F.explode_outer("p").alias("x"), "f").where("x is not null")  # outer: explode would compute the array in a filter, too
    return d.groupBy(F.col("x.label").alias("topic")).agg(F.count("*").alias("df"), F.round(F.max(F.col("x.weight") * F.col("f")), 6).alias("heaviest"))


def _seeds(m):
    """The six most frequent topics, strength by rank."""
    top = search.ranked(m.groupBy("topic").agg(F.count("*").alias("df")), [F.desc("df"), F.col("topic")], 6)
    return top.select("topic", F.round(1 / F.log2(F.col("rank") + 1.0), 6).alias("strength"))


_RELATED = f"""{_ASSOC}, sd AS (SELECT topic, round(1 / log2(r + 1.0), 6) AS strength FROM (SELECT topic, row_number() OVER (ORDER BY n DESC, topic) AS r FROM df) WHERE r <= 6),
    e AS (SELECT a AS s, b AS o, score FROM assoc UNION ALL SELECT b, a, score FROM assoc),
    x AS (SELECT o AS topic, s AS seed, round(CAST(strength * score AS DOUBLE), 6) AS score FROM e JOIN sd ON s = sd.topic WHERE o NOT IN (SELECT topic FROM sd)),
    rel AS (SELECT topic, seed, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, seed DESC) AS r FROM x) WHERE r = 1 ORDER BY score DESC, topic LIMIT 12)"""


@query(f"WITH {_RELATED} SELECT topic, seed, score FROM rel")
def topic_expansion(t):
    m = topics.mentions(t("conversations"), "conv_id", "text")
    return topics.related(_seeds(m), topics.associations(m, "conv_id", 2))


_PLAN = f"""{_RELATED}, wt AS (SELECT topic, max(w) AS w FROM (SELECT topic, strength AS w FROM sd UNION ALL SELECT topic, 0.65 * score FROM rel) GROUP BY 1),
    pl AS (SELECT conv_id, round(CAST(1 - exp(-sum(m.weight * w) / 3) AS DOUBLE), 6) AS score, count(*)::BIGINT AS topics FROM m JOIN wt USING (topic) GROUP BY 1 ORDER BY score DESC, conv_id LIMIT 250)"""


def _plan(t):
    m = topics.mentions(t("conversations"), "conv_id", "text")
    seeds = _seeds(m)
    return topics.plan(seeds, topics.related(seeds, topics.associations(m, "conv_id", 2)), m, "conv_id")


@query(f"WITH {_PLAN} SELECT conv_id, score, topics FROM pl")
def topic_query_plan(t):
    return _plan(t)


@query(f"""WITH {_PLAN}, lx AS (SELECT conv_id, max(score) AS score FROM ({_bm25_sql('conversations', 'conv_id, turn', 'ORDER BY score DESC, conv_id, turn LIMIT 600')}) GROUP BY 1),
    ls AS (SELECT conv_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, conv_id)) AS v FROM lx),
    ts AS (SELECT conv_id, 0.85 / (60 + row_number() OVER (ORDER BY score DESC, conv_id)) + 0.01 * score AS v FROM pl)
    SELECT conv_id, round(CAST(sum(v) AS DOUBLE), 6) AS score FROM (SELECT * FROM ls UNION ALL SELECT * FROM ts) GROUP BY 1 ORDER BY score DESC, conv_id LIMIT 20""")
def fused_conversation_search(t):
    hits = search.bm25(t("conversations"), ["conv_id", "turn"], F.col("text"), TERMS, 600)
    lexical = search.ranked(hits.groupBy("conv_id").agg(F.max("score").alias("score")), [F.desc("score"), F.col("conv_id")], 600)
    return topics.fuse(lexical, search.ranked(_plan(t), [F.desc("score"), F.col("conv_id")], 250), "conv_id")


_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"""WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT label, list(v ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS v FROM f GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT vec_id, c.label, round(CAST({_DOT.format(a='embedding', b='c')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='c', b='c')})) AS DOUBLE), 6) AS similarity FROM embeddings, c)
    SELECT vec_id, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS r FROM s WHERE similarity >= 0.42) WHERE r <= 4""")
def prototype_classify(t):
    e = t("embeddings")
    return search.classify(e, "vec_id", "embedding", search.centroids(e, "label", "embedding"), "label")


@query("""WITH d AS (SELECT p_partkey AS k, p_name, p_brand, p_size, length(p_name) AS depth, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t FROM part), q AS (SELECT unnest(list_distinct(t)) AS w FROM d WHERE k = 1),
    n AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av FROM d), f AS (SELECT k, w, len(list_filter(t, lambda x: x = w))::DOUBLE AS f, len(t)::DOUBLE AS dl FROM d, q), df AS (SELECT w, sum((f > 0)::INT)::DOUBLE AS c FROM f GROUP BY 1),
    sc AS (SELECT k, round(sum((CASE WHEN n + 0.5 - c <= c + 0.5 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM f JOIN df USING (w), n WHERE f > 0 GROUP BY 1),
    r AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM sc ORDER BY score DESC, k LIMIT 100),
    j AS (SELECT d.*, rank, o.t AS ot, o.p_brand AS ob, o.p_size AS os, o.depth AS od, list_distinct(d.t) AS x, list_distinct(o.t) AS y FROM r JOIN d USING (k), (SELECT * FROM d WHERE k = 1) o WHERE d.k <> 1),
    v AS (SELECT *, len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE AS ov FROM j)
    SELECT k AS symbol, round(CAST(0.3 / rank + 0.25 * ov + 0.15 * (p_brand = ob)::INT + 0.05 + 0.25 * (0.65 * ov + 0.15 * (1 - abs(p_size - os) / greatest(1.0, p_size, os)) + 0.10 * (1 - abs(depth - od) / greatest(1.0, depth, od)) + 0.10) AS DOUBLE), 6) AS score FROM v ORDER BY score DESC, symbol LIMIT 20""")
def similar_symbols(t):
    words = F.array_distinct(T.terms(F.col("p_name")))
    s = t("part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_name").alias("text"), words.alias("features"), F.col("p_size").alias("node_count"), F.length("p_name").alias("depth"), F.lit(1).alias("arity"))
    target = s.where("symbol = 1")
    return search.similar_symbols(s, target, target.first()["features"])


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
    w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0::BIGINT AS depth FROM supplier UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
    SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2""")
def reachability(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")).unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))
    return graph.reach(t("supplier").select(name("s", "s_suppkey").alias("node")), up.unionByName(t("region").select(name("r", "r_regionkey").alias("src"), F.lit("world").alias("dst"))))


@query("""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS depth, false AS cyclic FROM conversations""")
def nearest_ancestor(t):
    c = t("conversations").select("conv_id", "turn", "role", (F.col("turn") - 1).alias("parent"))
    return graph.ancestry(c, "conv_id", "turn", "parent", F.col("role") == "user")


@query("""SELECT conv_id, turn AS node, (CASE WHEN turn % 2 = 0 THEN row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END - 1)::INT AS position FROM conversations""")
def active_positions(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("path"))
    both = turns.select("conv_id", F.lit(1).alias("first"), "path").unionByName(turns.select("conv_id", F.lit(0).alias("first"), F.filter("path", lambda x: x % 2 == 0).alias("path")))
    return graph.active_positions(both, "conv_id", "path", "first")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def insert_or_ignore(t):
    return history.keep_first(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN b.st ELSE coalesce(b.st, a.o_orderstatus) END AS o_orderstatus, CASE WHEN a.o_orderkey IS NULL THEN b.pr ELSE a.o_totalprice END AS o_totalprice
    FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'X' END AS st, o_totalprice * 2 AS pr FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey""")
def selective_upsert(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return history.merge_columns(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["o_orderstatus"])


@query("""SELECT user_id, event_id, event_type <> 'error' AS visible FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, user_id LIMIT 128""")
def synchronise_records(t):
    e = t("events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted"))
    return history.synchronise(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "user_id", "ts", "event_id", "deleted", 128).select("user_id", "event_id", "visible")


@query("""WITH p AS (SELECT o_custkey, count(*) % 4 AS h FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey, count(*) % 4 AS h FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY 1)
    SELECT o_custkey, CASE WHEN p.h IS NULL THEN 'introduced' WHEN c.h IS NULL THEN 'deleted' WHEN p.h = c.h THEN 'unchanged' ELSE 'modified' END AS kind FROM p FULL JOIN c USING (o_custkey)""")
def exact_lineage(t):
    v = lambda odd: t("orders").where((F.col("o_orderkey") % 2 != 0) == F.lit(odd)).groupBy("o_custkey").agg((F.count("*") % 4).alias("h"))
    return history.exact_lineage(v(False), v(True), ["o_custkey"], "h")


@query("""SELECT l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0)""")
def path_deletions(t):
    gone = t("supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    located = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return history.deletions(located, gone, ["l_partkey"], "l_suppkey", "seq", "l_quantity")


@query("""SELECT 'dated' AS rule, sum((o_orderdate IS NULL)::INT)::BIGINT AS n FROM orders UNION ALL SELECT 'priced', sum((NOT coalesce(o_totalprice > 1000, false))::INT)::BIGINT FROM orders UNION ALL SELECT 'known_status', sum((NOT coalesce(o_orderstatus IN ('F', 'O'), false))::INT)::BIGINT FROM orders""")
def constraint_violations(t):
    return history.violations(t("orders"), {"dated": F.col("o_orderdate").isNotNull(), "priced": F.col("o_totalprice") > 1000, "known_status": F.col("o_orderstatus").isin("F", "O")})


_SPLIT = r"""SELECT conv_id, turn, trim(s, E' \t') AS s FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.?!]["''’”)\]}」』】》]*)\s', E'\\1\n', 'g'), '([。？！]["''’”)\]}」』】》]*)', E'\\1\n', 'g'), '[\r\n]+')) AS s FROM conversations) WHERE trim(s, E' \t') <> ''"""
_ACTS = " UNION ALL ".join(f"SELECT '{text_graph.ACT_LAYER[k]}' AS layer, '{k}' AS kind FROM s WHERE regexp_matches(s, '[\\p{{L}}\\p{{N}}]') AND regexp_matches(lower(s), '" + "|".join(p).replace("'", "''") + "')" for k, (_, p) in T.SPEECH_ACTS.items())


@query(rf"""WITH s AS ({_SPLIT}), n AS (SELECT 'source' AS layer, 'message' AS kind FROM conversations UNION ALL SELECT 'source', 'sentence' FROM s
    UNION ALL SELECT 'semantic', 'proposition' FROM s WHERE regexp_matches(s, '[\p{{L}}\p{{N}}]') UNION ALL {_ACTS}
    UNION ALL SELECT 'reference', 'url' FROM (SELECT DISTINCT conv_id, turn, regexp_replace(unnest(regexp_extract_all(s, 'https?://[^\s<>{{}}\[\]"'']+')), '[.,;:!?)]+$', '') AS u FROM s)
    UNION ALL SELECT 'reference', 'path' FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(s, '(^|[\s`''"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{{1,12}})', 2)) AS u FROM s))
    SELECT layer, kind, count(*)::BIGINT AS n FROM n GROUP BY 1, 2""")
def text_graph_nodes(t):
    c = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return text_graph.nodes(c, "id", "text").groupBy("layer", "kind").agg(F.count("*").alias("n"))
