"""Queries over the facts of a code history. The events table plays the history: an event is an observation of a symbol, or of a path that is gone.

The SQL derives the same facts with joins and groups of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import code_history as C
from annalist.operators import lineage, search
from annalist.operators.stable import cut
from annalist.plans.knowledge import bm25_sql
from annalist.plans.queries import _TRANSITIONS
from annalist.plans.registry import query

_O = """o AS (SELECT event_id AS seq, ts, 'c' || (event_id // 5) AS commit, 'src/' || event_type || json_extract_string(props, '$.k') || '.py' AS path, event_type AS kind, 'pkg.m' || user_id AS qn,
        floor(value / 20)::BIGINT::VARCHAR AS sh, user_id, event_id % 29 = 7 AS gone FROM events),
    s AS (SELECT *, sha256('[1,"' || kind || '","' || qn || '"]') AS lid FROM o WHERE NOT gone),
    r AS (SELECT *, sha256('["' || lid || '","' || sh || '"]') AS rid FROM s),
    sym AS (SELECT DISTINCT lid, qn, kind FROM r),
    rev AS (SELECT rid, any_value(lid) AS lid, any_value(sh) AS sh, arg_min(commit, seq) AS first_commit, arg_max(commit, seq) AS last_commit, min(seq) AS first_seq FROM r GROUP BY rid),
    loc AS (SELECT rid, commit, path, max(seq) AS seq FROM r GROUP BY ALL),
    com AS (SELECT commit, min(ts) AS committed_at, 'fix ' || min(user_id) AS message FROM o GROUP BY commit)"""
_MOVED = f"""{_O}, l AS (SELECT seq || ':' || lid AS event_id, seq AS ts, lid AS user_id, 0 AS event_type, rid AS digest, path, false AS gone, seq, commit FROM r
        UNION ALL SELECT o.seq || ':' || x.lid, o.seq, x.lid, 0, NULL, o.path, true, o.seq, o.commit FROM o JOIN (SELECT DISTINCT path, lid FROM r) x ON x.path = o.path WHERE o.gone){_TRANSITIONS}"""
_T = f"t AS (SELECT split_part(event_id, ':', 1)::BIGINT AS id, split_part(event_id, ':', 2) AS lid, prior, kind FROM (WITH {_MOVED}) WHERE kind IS NOT NULL)"


def _events(t):
    e = t("events")
    return e.select(
        F.lit(1).alias("repository"), F.col("event_id").alias("seq"), F.col("event_id").alias("analysis"), "ts", F.concat(F.lit("c"), F.floor(F.col("event_id") / 5).cast("string")).alias("commit"),
        F.concat(F.lit("src/"), "event_type", F.get_json_object("props", "$.k"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.col("event_type").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.concat(F.lit("pkg.m"), "user_id").alias("qualified_name"), F.floor(F.col("value") / 20).cast("long").cast("string").alias("structural_hash"),
        F.col("value").cast("string").alias("source_hash"), "user_id", (F.col("event_id") % 29 == 7).alias("gone"),
    )


def _seen(t):
    return C.identified(_events(t).where("not gone"))


def _commits(t):
    return _events(t).groupBy("repository", "commit").agg(F.min("ts").alias("committed_at"), F.concat(F.lit("fix "), F.min("user_id").cast("string")).alias("message"))


def _moved(t, symbols=None):
    """All transitions, or those of a few symbols (logical_id), whose observations alone are looked at."""
    e, s = _events(t), _seen(t)
    s = s if symbols is None else s.join(F.broadcast(symbols.select("logical_id")), "logical_id", "left_semi")
    return C.changes(s, e.where("gone").select("repository", "commit", "path", "seq"))


def _names(t):
    e = _events(t)
    return C.changed_names(e.where("not gone"), e.where("gone"))


def _references(t):
    s = _seen(t)
    kind = F.element_at(F.array(*map(F.lit, ("resolved", "exact", "dynamic", "guessed", "resolved"))), (F.col("seq") % 5 + 1).cast("int"))
    target = F.concat(F.lit("pkg.m"), ((F.col("user_id") * 7 + F.col("seq")) % 60).cast("string"))
    return s.select(F.col("seq").alias("id"), F.col("revision_id").alias("revision"), "commit", target.alias("target_text"), F.lit(None).cast("string").alias("target_qualified_name"), kind.alias("resolution"))


_REFS = f"""{_O}, refs AS (SELECT seq AS id, rid AS revision, commit, 'pkg.m' || ((user_id * 7 + seq) % 60) AS tq, ['resolved', 'exact', 'dynamic', 'guessed', 'resolved'][seq % 5 + 1] AS resolution FROM r),
    here AS (SELECT f.id, min(l.rid) AS rid FROM refs f JOIN sym y ON y.qn = f.tq JOIN rev v ON v.lid = y.lid JOIN loc l ON l.rid = v.rid AND l.commit = f.commit GROUP BY 1),
    newest AS (SELECT tq, arg_min(rid, k) AS rid FROM (SELECT y.qn AS tq, v.rid, row_number() OVER (ORDER BY v.last_commit DESC, v.rid) AS k FROM sym y JOIN rev v ON v.lid = y.lid) GROUP BY 1),
    res AS (SELECT f.*, CASE WHEN resolution <> 'dynamic' THEN coalesce(here.rid, newest.rid) END AS target FROM refs f LEFT JOIN here ON here.id = f.id LEFT JOIN newest ON newest.tq = f.tq),
    step AS (SELECT *, CASE WHEN resolution = 'dynamic' THEN 'dynamic' WHEN target IS NULL THEN 'unresolved' WHEN resolution = 'guessed' THEN 'inferred' ELSE 'none' END AS doubt FROM res)"""


@query(f"WITH {_O} SELECT lid AS logical_id, qn AS qualified_name, kind FROM sym")
def code_symbols(t):
    return C.logical_symbols(_seen(t)).select("logical_id", "qualified_name", "kind")


@query(f"WITH {_O} SELECT rid AS revision_id, lid AS logical_id, sh AS structural_hash, first_commit, last_commit, first_seq FROM rev")
def code_revisions(t):
    return C.revisions(_seen(t)).drop("source_hash")


@query(f"""WITH {_O}, st AS (SELECT rid, seq FROM r WHERE seq % 3 > 0)
    SELECT lid AS logical_id, 'shape' || seq % 11 AS shape_hash, seq % 37 AS node_count, seq % 5 AS depth, seq % 4 AS arity
    FROM (SELECT lid, seq, row_number() OVER (PARTITION BY lid ORDER BY first_seq DESC) AS k FROM rev JOIN (SELECT rid, max(seq) AS seq FROM st GROUP BY 1) x USING (rid)) WHERE k = 1""")
def code_structures(t):
    s = _seen(t).select("*", F.when(F.col("seq") % 3 > 0, F.concat(F.lit("shape"), (F.col("seq") % 11).cast("string"))).alias("shape_hash"), (F.col("seq") % 37).alias("node_count"), (F.col("seq") % 5).alias("depth"), (F.col("seq") % 4).alias("arity"), F.array("kind").alias("features"))
    return C.structure_of_symbols(C.revisions(s), C.structures(s)).select("logical_id", "shape_hash", "node_count", "depth", "arity")


@query(f"WITH {_O} SELECT rid AS revision_id, commit, path, seq FROM loc")
def code_locations(t):
    return C.locations(_seen(t))


@query(f"WITH {_O}, {_T} SELECT id, lid AS logical_id, prior AS from_revision, kind FROM t")
def code_transitions(t):
    return _moved(t).select("id", "logical_id", "from_revision", "kind")


@query(f"""WITH {_O}, pc AS (SELECT DISTINCT commit, path, sha1(sh || kind) AS blob FROM o WHERE seq % 13 > 0), ran AS (SELECT DISTINCT sha1(sh || kind) AS blob FROM o WHERE user_id % 3 = 0 AND kind <> 'click')
    SELECT commit, path, blob FROM pc WHERE NOT EXISTS (SELECT 1 FROM ran WHERE ran.blob = pc.blob)""")
def code_analysis_gaps(t):
    e = _events(t).withColumn("blob", F.sha1(F.concat("structural_hash", "kind")))
    changes = e.select("repository", "commit", F.col("path").alias("new_path"), F.when(F.col("seq") % 13 > 0, F.col("blob")).otherwise(C.ZERO_BLOB).alias("new_blob"))
    return C.analysis_gaps(changes, e.where("user_id % 3 = 0 and kind <> 'click'")).select("commit", "path", "blob")


@query(f"WITH {_O} SELECT user_id, max(seq) AS id FROM o WHERE kind = 'click' GROUP BY 1")
def code_latest_analyses(t):
    runs = _events(t).select("user_id", F.col("seq").alias("id"), F.when(F.col("kind") == "click", "complete").otherwise("error").alias("status"))
    return C.latest_analyses(runs, ("user_id",)).select("user_id", "id")


@query(f"""WITH {_O}, x AS (SELECT v.rid, v.lid, l.path, coalesce(l.commit, v.last_commit) AS commit FROM rev v LEFT JOIN loc l ON l.rid = v.rid)
    SELECT revision_id, qualified_name, kind, path, commit, committed_at, message FROM (SELECT x.rid AS revision_id, y.qn AS qualified_name, y.kind, x.path, x.commit, c.committed_at, c.message, row_number() OVER (PARTITION BY x.rid ORDER BY c.committed_at DESC, x.path, x.commit) AS k
        FROM x JOIN sym y ON y.lid = x.lid LEFT JOIN com c ON c.commit = x.commit) WHERE k = 1""")
def code_revision_summaries(t):
    s = _seen(t)
    return C.revision_summaries(C.revisions(s), C.logical_symbols(s), C.locations(s), _commits(t).drop("repository")).select("revision_id", "qualified_name", "kind", "path", "commit", "committed_at", "message")


@query(f"""WITH {_O}, x AS (SELECT v.rid, v.last_commit, CASE WHEN y.qn = 'pkg.m1' THEN 1 WHEN y.qn ILIKE 'PKG.M1%' THEN 2 ELSE 3 END AS o FROM rev v JOIN sym y ON y.lid = v.lid WHERE y.qn ILIKE '%pkg.m1%' OR v.rid IN (SELECT rid FROM loc WHERE path ILIKE '%pkg.m1%'))
    SELECT rid AS node, row_number() OVER (ORDER BY o, last_commit DESC, rid) AS rank FROM x QUALIFY rank <= 20""")
def code_trace_starts(t):
    s = _seen(t)
    return C.starts(C.revisions(s), C.logical_symbols(s), C.locations(s), "pkg.m1", 20)


@query(f"WITH {_REFS} SELECT id, target, doubt FROM step")
def code_reference_steps(t):
    s = _seen(t)
    return C.resolved(_references(t), C.revisions(s), C.logical_symbols(s), C.locations(s)).select("id", "target", "doubt")


@query(f"""WITH RECURSIVE {_REFS}, st AS (SELECT v.rid, row_number() OVER (ORDER BY v.last_commit DESC, v.rid) AS k FROM rev v JOIN sym y ON y.lid = v.lid WHERE y.qn = 'pkg.m1' QUALIFY k <= 3),
    e AS (SELECT id AS seq, revision AS src, target AS dst, doubt FROM step),
    w AS (SELECT rid AS node, [rid] AS path, [k] AS key, 0 AS d, NULL::VARCHAR AS terminal FROM st
        UNION ALL SELECT e.dst, list_append(w.path, e.dst), list_append(w.key, e.seq), w.d + 1, CASE WHEN e.doubt <> 'none' THEN e.doubt WHEN list_contains(w.path, e.dst) THEN 'cycle' END
        FROM w JOIN e ON e.src = w.node WHERE w.terminal IS NULL AND w.d < 2),
    p AS (SELECT path, key, CASE WHEN terminal IS NULL THEN d ELSE d - 1 END AS depth, coalesce(terminal, CASE WHEN d = 2 THEN 'max-depth' WHEN node NOT IN (SELECT src FROM e) THEN 'leaf' END) AS terminal FROM w)
    SELECT row_number() OVER (ORDER BY depth, key) AS place, array_to_string(list_transform(path, lambda x: coalesce(x, '')), '>') AS path, depth::BIGINT AS depth, terminal FROM p WHERE terminal IS NOT NULL QUALIFY place <= 50""")
def code_trace(t):
    s = _seen(t)
    found, symbols, places = cut(C.revisions(s)), cut(C.logical_symbols(s)), C.locations(s)

    def edges(nodes):
        return C.resolved(C.references_of(_references(t), nodes), found, symbols, places).select(F.col("id").alias("seq"), F.col("revision").alias("src"), F.col("target").alias("dst"), "doubt")

    begin = C.starts(found, symbols.where("qualified_name = 'pkg.m1'"), places, "pkg.m1", 3)
    p = C.traced(begin, edges, 2, 50)
    return p.select("place", F.array_join(F.transform("path", lambda x: F.coalesce(x, F.lit(""))), ">").alias("path"), "depth", "terminal")


@query(f"""WITH {_O}, {_T}, y AS (SELECT lid FROM sym WHERE qn ILIKE 'pkg.m1%' ORDER BY qn, lid LIMIT 20)
    SELECT lid AS logical_id, row_number() OVER (PARTITION BY lid ORDER BY committed_at, id) AS place, id, t.kind, message FROM t JOIN y USING (lid) JOIN o ON o.seq = t.id JOIN com USING (commit) QUALIFY place <= 100""")
def code_symbol_history(t):
    s = C.matching_symbols(C.logical_symbols(_seen(t)), "pkg.m1", 20)
    return C.symbol_transitions(_moved(t, s), _commits(t), s, 100).select("logical_id", "place", "id", "kind", "message")


@query(f"""WITH {_O}, {_T}, tt AS (SELECT lid, id, row_number() OVER (PARTITION BY lid ORDER BY committed_at, id) AS k FROM t JOIN o ON o.seq = t.id JOIN com USING (commit)),
    a AS (SELECT lid, string_agg(id::VARCHAR, ',' ORDER BY k) AS transitions FROM tt WHERE k <= 20 GROUP BY 1),
    b AS (SELECT lid, string_agg(rid, ',' ORDER BY k) AS related FROM (SELECT lid, rid, row_number() OVER (PARTITION BY lid ORDER BY first_commit, rid) AS k FROM rev) WHERE k <= 20 GROUP BY 1)
    SELECT rid AS revision_id, lid AS logical_id, transitions, related FROM rev JOIN a USING (lid) JOIN b USING (lid)""")
def code_revision_lineage(t):
    found, e = cut(C.revisions(_seen(t))), _events(t)
    return C.lineage_of_revisions(found, found, C.first_transitions(e.where("not gone"), e.where("gone"), _commits(t), 20), 20)


@query(f"""WITH {_O}, {_T}, x AS (SELECT commit, 0 AS k, seq AS id, CASE WHEN gone THEN 'D ' || path || ' ' ELSE 'M  ' || path END AS part FROM o UNION ALL SELECT o.commit, 1, t.id, sym.qn FROM t JOIN o ON o.seq = t.id JOIN sym ON sym.lid = t.lid)
    SELECT commit, sha256(any_value(message) || ' ' || string_agg(part, ' ' ORDER BY k, id, part)) AS content FROM x JOIN com USING (commit) GROUP BY commit""")
def code_commit_documents(t):
    e = _events(t)
    paths = e.select("commit", F.col("seq").alias("id"), F.when(F.col("gone"), "D").otherwise("M").alias("change_kind"), F.when(F.col("gone"), F.col("path")).alias("old_path"), F.when(~F.col("gone"), F.col("path")).alias("new_path"))
    return C.commit_documents(_commits(t).drop("repository"), paths, _names(t)).select("commit", F.sha2("content", 256).alias("content"))


def _commit_text(t):
    e = _events(t)
    paths = e.select("commit", F.col("seq").alias("id"), F.lit("M").alias("change_kind"), F.lit("").alias("old_path"), F.col("path").alias("new_path"))
    return C.commit_documents(_commits(t).drop("repository"), paths, _names(t))


_COMMIT_TEXT = f"""(WITH {_O}, {_T}, x AS (SELECT commit, 0 AS k, seq AS id, 'M  ' || path AS part FROM o UNION ALL SELECT o.commit, 1, t.id, sym.qn FROM t JOIN o ON o.seq = t.id JOIN sym ON sym.lid = t.lid)
    SELECT commit, lower(any_value(message) || ' ' || string_agg(part, ' ' ORDER BY k, id, part)) AS text FROM x JOIN com USING (commit) GROUP BY commit)"""
_REVISION_TEXT = f"(WITH {_O} SELECT rid, lower(qn || ' ' || kind || ' python ' || (SELECT arg_max(path, seq) FROM loc l WHERE l.rid = rev.rid)) AS text FROM rev JOIN sym USING (lid))"


@query(bm25_sql(_COMMIT_TEXT, "commit", "text", ("fix", "pkg m7"), "ORDER BY score DESC, commit LIMIT 20"))
def code_commit_search(t):
    return search.bm25(_commit_text(t), ["commit"], F.col("content"), "fix pkg.m7", 20)


def _revision_text(t):
    s = _seen(t)
    path = s.groupBy("revision_id").agg(F.max_by("path", "seq").alias("path"))
    return C.revisions(s).join(C.logical_symbols(s), "logical_id").join(path, "revision_id").select("revision_id", F.concat_ws(" ", "qualified_name", "kind", "language", "path").alias("content"))


@query(f"""WITH r AS ({bm25_sql(_REVISION_TEXT, 'rid', 'text', ('pkg m7', 'click'), 'ORDER BY score DESC, rid LIMIT 10')}), c AS ({bm25_sql(_COMMIT_TEXT, 'commit', 'text', ('pkg m7', 'click'), 'ORDER BY score DESC, commit LIMIT 10')}),
    a AS (WITH {_O} SELECT rid, string_agg(commit || ':' || path, ' ' ORDER BY k) AS e FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY commit, path) AS k FROM loc) WHERE k <= 5 GROUP BY 1),
    b AS (WITH {_O} SELECT commit, string_agg(path, ' ' ORDER BY k) AS e FROM (SELECT *, row_number() OVER (PARTITION BY commit ORDER BY seq) AS k FROM o) WHERE k <= 5 GROUP BY 1)
    SELECT 'symbol_revision' AS type, rid AS id, score, e AS evidence FROM r JOIN a USING (rid) UNION ALL SELECT 'commit_change', commit, score, e FROM c JOIN b USING (commit)""")
def code_context(t):
    """Revisions and commits for a query, each with its evidence: where a revision was seen, what a commit changed."""
    asked = "pkg.m7 click"
    # the hits are made once, and are few, so that only what they need is looked at for evidence
    r = cut(search.bm25(_revision_text(t), ["revision_id"], F.col("content"), asked, 10))
    c = cut(search.bm25(_commit_text(t), ["commit"], F.col("content"), asked, 10))
    places = C.locations(_seen(t).join(F.broadcast(r.select("revision_id")), "revision_id", "left_semi")).select(F.col("revision_id").alias("id"), "commit", "path")
    changes = _events(t).join(F.broadcast(c.select("commit")), "commit", "left_semi").select(F.col("commit").alias("id"), "seq", "path")
    r, c = r.withColumnRenamed("revision_id", "id"), c.withColumnRenamed("commit", "id")
    r = search.with_evidence(r, "id", {"e": (places, ["commit", "path"], 5)}).select(F.lit("symbol_revision").alias("type"), "id", "score", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["commit"], x["path"])), " ").alias("evidence"))
    c = search.with_evidence(c, "id", {"e": (changes, ["seq", "path"], 5)}).select(F.lit("commit_change").alias("type"), "id", "score", F.array_join(F.transform("e", lambda x: x["path"]), " ").alias("evidence"))
    return r.unionByName(c)


@query(f"""WITH {_O}, m AS (SELECT 'c' || (seq % 50) AS commit, kind, rid AS a, lid AS b, (seq % 7) / 10.0 AS confidence FROM r UNION ALL SELECT 'c1', 'moved', rid, rid, 0.5 FROM r),
    known AS (SELECT DISTINCT commit, kind, rid AS a FROM r WHERE seq % 2 = 0)
    SELECT commit, kind, a AS from_revision, b AS to_revision, round(max(confidence), 6) AS confidence FROM m WHERE a <> b AND NOT EXISTS (SELECT 1 FROM known k WHERE k.commit = m.commit AND k.kind = m.kind AND k.a = m.a) GROUP BY ALL""")
def code_fuzzy_transitions(t):
    s = _seen(t)
    m = s.select("repository", F.concat(F.lit("c"), (F.col("seq") % 50).cast("string")).alias("commit"), "kind", F.col("revision_id").alias("from_revision"), F.col("logical_id").alias("to_revision"), (F.col("seq") % 7 / 10).alias("confidence"))
    m = m.unionByName(s.select("repository", F.lit("c1").alias("commit"), F.lit("moved").alias("kind"), F.col("revision_id").alias("from_revision"), F.col("revision_id").alias("to_revision"), F.lit(0.5).alias("confidence")))
    stored = s.where("seq % 2 = 0").select("repository", "commit", "kind", F.col("revision_id").alias("from_revision"), F.col("logical_id").alias("to_revision"))
    return C.persisted_matches(m, stored).select("commit", "kind", "from_revision", "to_revision", F.round("confidence", 6).alias("confidence"))


def _part_symbols(t, odd: int):
    """Parts as symbols of a file that their brand and size name; even keys before a commit, odd ones after it."""
    words = F.array_distinct(F.split("p_name", " "))
    none = F.array().cast("array<string>")
    return t("part").where(F.col("p_partkey") % 2 == odd).select(
        "p_brand", "p_size", F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.lit(None).cast("string").alias("signature"), F.concat("p_name", "p_type").alias("structural_hash"), F.col("p_type").alias("shape_hash"),
        words.alias("features"), (F.col("p_partkey") % 10).alias("node_count"), F.lit(2).alias("depth"), F.lit(1).alias("arity"), words.alias("tokens"), none.alias("references"), none.alias("paths"),
    )


def _pairs(t):
    return lineage.candidates(_part_symbols(t, 0), _part_symbols(t, 1), ["p_brand", "p_size"], "key")


_JACCARD = "CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END"
_W = lineage.WEIGHTS
_PAIRS = f"""p AS (SELECT p_partkey AS key, p_brand, p_size, p_name, p_type, list_distinct(string_split(p_name, ' ')) AS w FROM part),
    x AS (SELECT a.p_brand, a.p_size, a.key AS f, b.key AS g, a.p_name = b.p_name AS same_name, {_JACCARD} AS j, (a.p_type = b.p_type)::INT::DOUBLE AS k,
        CASE WHEN a.p_name = b.p_name AND a.p_type = b.p_type THEN 1.0 ELSE round((a.p_type = b.p_type)::INT * 0.45 + ({_JACCARD}) * 0.3 + greatest(0, 1 - abs(a.key % 10 - b.key % 10) / greatest(1.0, a.key % 10, b.key % 10)) * 0.1 + 0.1 + 0.05, 6) END AS st
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.key % 2 = 0 AND b.key % 2 = 1),
    c AS (SELECT *, round(CAST((CASE WHEN same_name THEN 1.0 ELSE j END * {_W['name']} + k * {_W['kind']} + st * {_W['structure']} + j * {_W['token']} + {_W['references']} + {_W['diff']}) / {sum(_W.values())} AS DOUBLE), 6) AS confidence FROM x),
    d AS (SELECT * FROM c WHERE confidence >= 0.45)"""


@query(f"""WITH {_PAIRS} SELECT f AS "from", g AS "to", confidence, CASE WHEN EXISTS (SELECT 1 FROM d y WHERE y.p_brand = d.p_brand AND y.p_size = d.p_size AND ((y.f = d.f AND y.g <> d.g) OR (y.g = d.g AND y.f <> d.f)) AND round(abs(y.confidence - d.confidence), 9) < 0.05) THEN 'candidate' ELSE 'resolved' END AS resolution FROM d""")
def code_lineage_scores(t):
    return _pairs(t).select("from", "to", "confidence", "resolution")


@query(None)
def code_lineage_matches(t):
    return lineage.match(_pairs(t), ["p_brand", "p_size"])
