"""Code history, versions, projections, archives and words on small fixtures, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import code_history, history, projections, search
from annalist.sources import analyzers, archives
from annalist.streaming.versions import Conflict, Versions


def kinds(spark, rows):
    log = spark.createDataFrame([("e", k, d, p, d is None) for k, (d, p) in enumerate(rows)], "entity string, seq long, digest string, path string, gone boolean")
    return [r["kind"] for r in history.transitions(log, ["entity"], ["seq"], "digest", "path", "gone").orderBy("seq").collect()]


def test_transitions_look_at_the_prior_revision_only(spark):
    assert kinds(spark, [("A", "p"), ("B", "p"), ("A", "q"), ("B", "p")]) == ["introduced", "modified", "modified", "unchanged"]
    assert kinds(spark, [("A", "p"), (None, "p"), ("B", "p"), ("C", "p")]) == ["introduced", "deleted", "resurrected", "modified"]
    assert kinds(spark, [("A", "p"), ("A", "q"), ("A", "q"), (None, "q"), ("A", "q"), ("A", "r")]) == ["introduced", "moved", "unchanged", "deleted", "resurrected", "resurrected"]
    assert kinds(spark, [(None, "p"), ("A", "p"), ("B", "q"), (None, "p"), ("B", "q")]) == [None, "introduced", "modified", "deleted", "unchanged"]


def test_words_of_any_script(spark):
    rows = [("Größe übertrifft naïve Работа", "größe übertrifft naïve работа"), ("ﬁne Ｗｏｒｄ été a", "fine word été"), ("x_y-z 10 the", "x_y-z 10"), (None, ""), ("😀 smile", "smile")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
    got = [r["k"] for r in d.select("i", F.array_join(T.keywords(F.col("t")), " ").alias("k")).orderBy("i").collect()]
    assert got == [w for _, w in rows]
    assert d.select(F.max(T.modality(F.lit("ｍｕｓｔ do"))).alias("m")).first()["m"] == "required"


def test_typed_queries(spark):
    assert T.query_terms("src/app.js ＦＯＯ  \"bar\" !") == ["src app js", "foo", "bar"] and T.query_terms("größe") == ["größe"] and T.query_terms("größe", T.CODE_QUERY) == ["gr", "e"]
    assert T.query_terms(None) == T.query_terms("?! ") == []
    d = spark.createDataFrame([(1, "the file src/app.js holds foo"), (2, "app js src"), (3, "Größe über alles")], "id long, text string")
    hits = lambda q: [r["id"] for r in search.bm25(d, ["id"], F.col("text"), q).collect()]
    assert hits("src/app.js") == [1] and hits("GRÖSSE größe") == [3] and hits("?!") == []


def test_truncated_bytes(spark):
    texts = ["", "abc", "é" * 10, "日本語" * 5, "😀" * 5, "a😀b" * 3]
    for most in (3, 4, 7, 11, 12):
        got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.truncated_bytes(F.col("t"), most).alias("s")).collect()]
        for t, s in zip(texts, got):
            n = max((n for n in range(len(t) + 1) if len(t[:n].encode()) <= most - 3), default=0)
            assert s == (t if len(t.encode()) <= most else t[:n] + "…")


def brute_trace(starts, edges, depth, most, sinks=()):
    """A queue, step by step."""
    queue, paths = [([s], 0) for s in starts], []
    out = {}
    for e in sorted(edges):
        out.setdefault(e[1], []).append(e)
    while queue and len(paths) < most:
        path, d = queue.pop(0)
        if d >= depth:
            paths.append((path, "max-depth"))
        elif path[-1] not in out:
            paths.append((path, "leaf"))
        else:
            for _, _, dst, doubt in out[path[-1]]:
                if len(paths) >= most:
                    break
                end = "sink" if dst in sinks else doubt if doubt != "none" else "cycle" if dst in path else None
                paths.append(([*path, dst], end)) if end else queue.append(([*path, dst], d + 1))
    return paths, bool(queue)


@pytest.mark.parametrize("depth, most", [(8, 50), (3, 7), (2, 1000), (0, 5), (4, 1)])
def test_traced_equals_a_queue(spark, depth, most):
    import random

    r = random.Random(depth)
    edges = [(k, f"n{r.randrange(9)}", f"n{r.randrange(11)}", r.choice(["none"] * 5 + ["dynamic", "inferred"])) for k in range(22)]
    starts = ["n1", "n0", "n10"]
    got = code_history.traced(spark.createDataFrame([(s, k) for k, s in enumerate(starts)], "node string, rank long"), spark.createDataFrame(edges, "seq long, src string, dst string, doubt string"), depth, most, F.col("node") == "n7").orderBy("place").collect()
    want, left = brute_trace(starts, edges, depth, most, ("n7",))
    assert [(x["path"], x["terminal"]) for x in got] == want and {x["truncated"] for x in got} == {left}


def test_facts_of_a_history(spark):
    cols = "repository long, commit string, seq long, analysis long, path string, language string, kind string, name string, qualified_name string, structural_hash string, source_hash string"
    rows = [(1, "c1", 1, 1, "a.py", "python", "function", "f", "m.f", "h1", "s1"), (1, "c1", 2, 2, "a.py", "python", "function", "f", "m.f", "h9", "s9"), (1, "c2", 3, 3, "b.py", "python", "function", "f", "m.f", "h1", "s1"), (1, "c3", 5, 4, "b.py", "python", "function", "f", "m.f", "h2", "s2"), (1, "c3", 6, 4, "b.py", "python", "class", "K", None, "h3", None)]
    seen = code_history.identified(code_history.once(spark.createDataFrame(rows, cols)))
    assert seen.count() == 4  # the second analysis of a.py at c1 is a replay
    import hashlib

    lid = hashlib.sha256(json.dumps([1, "function", "m.f"], separators=(",", ":")).encode()).hexdigest()
    assert {r["logical_id"] for r in seen.where("name = 'f'").collect()} == {lid}
    assert {r["revision_id"] for r in seen.where("structural_hash = 'h2'").collect()} == {hashlib.sha256(json.dumps([lid, "h2"], separators=(",", ":")).encode()).hexdigest()}
    gone = spark.createDataFrame([(1, "c4", "a.py", 4), (1, "c5", "b.py", 7)], "repository long, commit string, path string, seq long")
    t = code_history.changes(seen, gone).orderBy("id", "kind", "logical_id").collect()
    assert [(r["id"], r["kind"]) for r in t] == [(1, "introduced"), (3, "moved"), (4, "deleted"), (5, "resurrected"), (6, "introduced"), (7, "deleted"), (7, "deleted")]
    assert code_history.logical_symbols(seen).where("kind = 'class'").first()["qualified_name"] == "K"
    assert code_history.quoted(F.lit('a"b')) is not None and spark.range(1).select(code_history.quoted(F.lit('a"b\n')).alias("q")).first()["q"] == json.dumps('a"b\n')


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/table")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert v.head() == 0 and v.commit(one, 0) == 1
    assert v.put(spark.createDataFrame([(2, "c", False), (1, "x", True), (3, "d", None)], "k long, v string, gone boolean"), ["k"], 1, "gone") == 2
    assert sorted(map(tuple, v.read().collect())) == [(2, "c"), (3, "d")] and sorted(map(tuple, v.read(1).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Conflict):
        v.commit(one, 1)
    late = Versions(spark, v.root)
    late.head = lambda: 1  # a writer that looked before the other one was done
    with pytest.raises(Conflict):
        late.commit(one, 1)
    seen = []

    def grow(df):
        seen.append(df and df.count())
        if len(seen) == 1:  # another writer comes between
            Versions(spark, v.root).put(spark.createDataFrame([(9, "z")], "k long, v string"), ["k"], 2)
        return df.where("k <> 2")

    assert v.update(grow) == 4 and seen == [2, 3] and sorted(r["k"] for r in v.read().collect()) == [3, 9]
    with pytest.raises(Conflict):
        late.update(lambda df: df, tries=2)
    assert v.head() == 4 and v.read(2).count() == 2 and v.manifest(2)["parent"] == 1
    assert v.collect_garbage() >= 3 and v.versions() == [4] and v.read().count() == 2
    v.clear()
    assert v.head() == 0


def test_projections(spark):
    stored = spark.createDataFrame([("a", "m", "old", [1.0]), ("z", "other", "d", [2.0])], "k string, model string, digest string, vector array<double>")
    src = spark.createDataFrame([("a", "text"), ("b", None), ("c", "more")], "k string, text string")
    out = projections.index_vectors(src, stored, "k", "text", search.hashed_vector(4), "m")
    first = {(r["k"], r["model"]): r["digest"] for r in out.collect()}
    assert set(first) == {("a", "m"), ("b", "m"), ("c", "m"), ("z", "other")} and first["a", "m"] != "old"
    again = projections.pending(src.withColumn("digest", F.sha2(F.to_json(F.struct(F.col("k").alias("id"), F.coalesce("text", F.lit("")).alias("text"))), 256)), out.where("model = 'm'"), "k", "digest")
    assert again.count() == 0 and projections.index_vectors(src, stored.limit(0), "k", "text", search.hashed_vector(4), "m", limit=2).count() == 2
    blobs = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(projections.vector_blob(F.col("v")).alias("b"))
    assert [r["v"] for r in blobs.select(projections.blob_vector(F.col("b"), 2).alias("v")).collect()] == [[1.5, -2.0], None]
    assert blobs.select(projections.blob_vector(F.col("b"), 3).alias("v")).first()["v"] is None
    texts = ['{"b": 1, "a": [true, {"y": "é", "x": NaN}]}', "no json", None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(projections.canonical_json(F.col("t")).alias("c")).collect()]
    assert got == ['{"a":[true,{"x":null,"y":"é"}],"b":1}', None, None]
    commits = spark.createDataFrame([("r", k, f"o{k}") for k in range(4)] + [("s", 0, "p0")], "ref string, position long, oid string")
    at = spark.createDataFrame([("r", "o1")], "ref string, oid string")
    assert projections.to_index(at, commits, False).count() == 3 and projections.to_index(at, commits, True).count() == 5


def test_archives(spark, tmp_path):
    (tmp_path / "wrap").mkdir()
    node = {"n": {"id": "n", "parent": None, "message": {"id": "n", "author": {"role": "user", "name": None}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["hi"]}}}}
    one = {"conversation_id": "c1", "update_time": 5.0, "current_node": "n", "mapping": node}
    (tmp_path / "wrap" / "conversations.json").write_text(json.dumps([one, {**one, "conversation_id": "c2"}]))
    (tmp_path / "wrap" / "conversations-2.json").write_text(json.dumps({"conversations": [{**one, "update_time": 9.0, "title": "new"}]}))
    (tmp_path / "wrap" / "Conversations_3.JSON").write_text(json.dumps({**one, "conversation_id": "c3"}))
    (tmp_path / "wrap" / "user.json").write_text("{}")
    (tmp_path / "wrap" / "conversations_bad.json").write_text("{}")
    files = archives.checked(archives.listing(spark, f"file://{tmp_path}"))
    assert sorted(r["path"] for r in archives.conversation_files(files).collect()) == ["Conversations_3.JSON", "conversations-2.json", "conversations.json"] and archives.owner_file(files).first()["path"] == "user.json"
    texts = archives.conversation_files(files).collect()
    texts = spark.createDataFrame([(r["path"], (tmp_path / "wrap" / r["path"]).read_text()) for r in texts] + [("x", '{"other": 1}')], "path string, text string")
    records = archives.payloads(texts)
    assert records.where("fault").count() == 1
    latest = {r["conversation"]: r["title"] for r in archives.latest_conversations(records.where("not fault")).collect()}
    assert latest == {"c1": "new", "c2": None, "c3": None}
    bad = spark.createDataFrame([("a/../b", 1)], "path string, size long")
    with pytest.raises(ValueError, match="unsafe"):
        archives.checked(bad)
    with pytest.raises(ValueError, match="exceeds"):
        archives.checked(spark.createDataFrame([("a", 10), ("b", 10)], "path string, size long"), most_bytes=15)
    issue = spark.createDataFrame([("o/r", 7, None, "2024", None, "t", "b", "u")], "repository string, number long, revision string, updated_at string, observed_at string, title string, body string, url string")
    a = archives.issue_artifacts(issue).first()
    assert a["revision"] == "2024" and [b["text"] for b in a["blocks"]] == ["t", "b"]
    assert spark.range(1).select(archives.receipt_key(F.lit("d"), "v1", False).alias("k")).first()["k"] == "imports/openai/d/v1/normalized.json"


def test_fingerprints_do_not_depend_on_names():
    a, b, c = (analyzers.python_symbols("p.py", s)[0] for s in ("def f(x):\n    return g(x, 1) + 2\n", "def h(y):\n    return k(y, 7) + 9\n", "def f(x):\n    return g(x) + 2\n"))
    assert a["structural_hash"] == b["structural_hash"] != c["structural_hash"] and a["arity"] == 2 and c["arity"] == 1 and a["node_count"] > c["node_count"]
    deep = analyzers.python_symbols("p.py", "def f():\n    return " + "-" * 80 + "1\n")[0]
    assert deep["depth"] > 80 and "Return" in deep["features"]
    x, y = (analyzers.lisp_symbols("p.clj", s)[0] for s in ("(defn f [x] (g x (h x)))", "(defn k [y] (m y (n y)))"))
    assert x["structural_hash"] == y["structural_hash"] and x["references"] == ["g", "h"]


def test_nearest_rows_equal_brute_force(spark):
    import numpy as np

    rows = [(k, [float((k * 7 + i) % 5 - 2) for i in range(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, [1.0, 2.0]), (62, None)]
    d = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = {}
    for r in search.nearest_rows(d, "k", "v", d.where("k % 20 = 0"), 5, block=2).collect():
        got.setdefault(r["query"], []).append((r["place"], r["neighbour"], r["similarity"]))

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return round(float(np.dot(a, b) / n), 6) + 0.0 if n else 0.0

    held = dict(rows)
    for q in (0, 20, 40, 60):
        want = sorted((-cos(held[q], v), k) for k, v in rows if v is not None)[:5]
        assert [(k, s) for _, k, s in sorted(got[q])] == [(k, -s) for s, k in want]


def test_many_prototypes_are_compared_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "k long, v array<double>")
    p = spark.createDataFrame([(f"l{k}", [float(k), 1.0]) for k in range(6)], "label string, centroid array<double>")
    some = lambda bound: sorted(map(tuple, search.classify(v, "k", "v", p, "label", 0.5, 2, bound).collect()))
    assert some(2) == some(100) and len(some(2)) == 18


def test_postings_equal_the_scan(spark):
    import random

    r = random.Random(3)
    d = spark.createDataFrame([(k, " ".join(r.choices(["a", "b", "c", "dd", "é"], k=r.randrange(9)))) for k in range(80)] + [(80, None), (81, "")], "id long, text string")
    index, corpus = search.postings(d, ["id"], F.col("text")), search.corpus_size(d, F.col("text"))
    for q in ("a", ["a b", "dd"], ["é", "a a", "zz"], "b-c é", "", ["zz"]):
        assert search.bm25_indexed(index, corpus, ["id"], q, None).orderBy("id").collect() == search.bm25(d, ["id"], F.col("text"), q, None).orderBy("id").collect(), q


def test_references_and_protocol(spark):
    text = "import os.path\nfrom . import x\n\n@mark\nclass K(Base):\n    def f(self, é: int) -> str:\n        y = g(é)\n        return self.h(y)\n"
    rows = analyzers.python_references("p.py", text)
    got = {(r["kind"], r["target"]): r for r in rows}
    assert set(got) >= {("import", "os.path"), ("import", "."), ("call", "mark"), ("inheritance", "Base"), ("type", "int"), ("type", "str"), ("call", "g"), ("call", "self.h"), ("write", "y"), ("read", "y")}
    assert (got["read", "y"]["resolution"], got["read", "y"]["confidence"], got["call", "g"]["resolution"], got["call", "g"]["owner"]) == ("resolved", 1.0, "unresolved", "K.f") and got["import", "os.path"]["confidence"] == 0.8
    raw = text.encode()
    assert all(raw[r["start_byte"] : r["end_byte"]].decode().endswith(r["target"].split(".")[-1]) for r in rows if r["kind"] != "import") and rows == sorted(rows, key=lambda r: r["start_byte"])
    assert analyzers.python_references("p.py", "def (") == []
    files = spark.createDataFrame([("p.py", "python", text), ("q.py", "python", None), ("a.clj", "clojure", "(f)")], "path string, language string, text string")
    assert analyzers.references(files).count() == len(rows)
    ask = lambda **x: json.loads(analyzers.respond(json.dumps(x))[0])
    about = ask(id=1, op="describe")["result"]
    assert "python" in about["languages"] and ask(id=1, op="describe")["result"] == about and ask(id=2, op="ping") == {"id": 2, "result": {"ok": True}}
    one = ask(id=3, op="analyze", language="python", path="p.py", source=text)
    assert one == ask(id=3, op="analyze", language="python", path="p.py", source=text) and one["result"]["file"]["source_bytes"] == len(raw) and [s["name"] for s in one["result"]["symbols"]] == ["K", "f", "y"]
    assert ask(id=4, op="analyze", language="cobol", path="", source="")["error"] and ask(id=5, op="nothing")["error"] and "error" in json.loads(analyzers.respond("{")[0]) and "error" in json.loads(analyzers.respond("[]")[0])
    assert ask(id=6, op="analyze", language="python", path="p", source="def (")["result"]["diagnostics"] == ["SyntaxError"]
    assert len(list(analyzers.serve(iter(['{"op":"ping"}', '{"op":"shutdown"}', '{"op":"ping"}'])))) == 2


def test_repair_fills_gaps(spark):
    changes = spark.createDataFrame([(1, "c1", "a.py", "b1"), (1, "c1", "b.py", "b2"), (1, "c2", "a.py", "b1"), (1, "c3", "z.py", "0" * 40), (1, "c3", "bad.py", "b3")], "repository long, commit string, new_path string, new_blob string")
    runs = spark.createDataFrame([(1, "b2")], "repository long, blob string")
    files = spark.createDataFrame([("b1", "python", "x = 1\n"), ("b3", "python", "def (")], "blob string, language string, text string")
    rows = analyzers.repair(code_history.analysis_gaps(changes, runs), files).collect()
    assert sorted((r["commit"], r["path"], r["name"], r["error"]) for r in rows if not r["error"]) == [("c1", "a.py", "x", None), ("c2", "a.py", "x", None)] and [(r["commit"], r["path"]) for r in rows if r["error"]] == [("c3", "bad.py")]


def test_git_json_objects_and_refs(spark, tmp_path):
    import subprocess

    from annalist.sources import git

    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True, **k).stdout.strip()
    run("init", "-q")
    oids = [run("hash-object", "-w", "--stdin", input=t) for t in ('{"a": 1}', "no json", '{"a": 2, "b": "x"}')]
    tree = run("mktree", input=f"100644 blob {oids[0]}\ta.json\n")
    for name in ("z", "a"):
        run("update-ref", f"refs/log/sources/{name}", tree)
    wanted = spark.createDataFrame([(str(tmp_path), o) for o in [*oids, tree, "0" * 39 + "1"]], "repository string, oid string")
    got = {r["oid"]: (r["value"]["a"] if r["value"] else None, r["fault"]) for r in git.json_objects(git.objects(wanted), "a long").collect()}
    assert got == {oids[0]: (1, None), oids[1]: (None, "no-json"), oids[2]: (2, None), tree: (None, "not-a-blob"), "0" * 39 + "1": (None, "missing")}
    assert [r["ref"] for r in git.refs(spark.createDataFrame([(str(tmp_path),)], "repository string"), "refs/log/sources/").collect()] == ["refs/log/sources/a", "refs/log/sources/z"]
    with pytest.raises(ValueError):
        git.refs(wanted, "refs/../x")


def test_topics_and_graphs_that_are_missing(spark):
    from annalist.operators import text_graph, topics

    m = spark.createDataFrame([(f"m{k}", c, t, w) for k in range(20) for c, t, w in ((0, "alpha", 1.0 + k), (0, "beta", 1.0), (1, "beta", 2.0), (1, "gamma", 1.0))], "message string, context long, topic string, weight double")
    replies = spark.createDataFrame([("m1", "m2")], "src string, dst string")
    e = topics.evidence(m, replies)
    lists = {(r["a"], r["b"]): r["evidence"] for r in topics.evidence_lists(e).collect()}
    rows = sorted(((-r["weight"], r["relation"], r["place"]) for r in e.where("a = 'alpha' and b = 'beta'").collect()))
    assert [(-x["weight"], x["relation"], x["place"]) for x in lists["alpha", "beta"]] == rows[:16] and len(rows) > 16
    stats = spark.createDataFrame([("red car", 5), ("red", 1), ("blue car", 9), ("sky", 3)], "topic string, df long")
    assert [r["topic"] for r in topics.lookup(stats, "RED ").collect()][:2] == ["red", "red car"] and topics.lookup(stats, "none").count() == 0
    texts = spark.createDataFrame([("a", "We must go."), ("b", "Fine.")], "id string, text string")
    have = text_graph.nodes(texts.where("id = 'a'"), "id", "text")
    assert [r["id"] for r in text_graph.missing(texts, "id", have).collect()] == ["b"]


def test_captures_are_the_same_whenever_they_were_taken(spark):
    from annalist.sources import observations

    a = {"provider": "p", "source_key": "s", "conversation": {"id": "c", "title": "é"}, "messages": [{"id": "m"}], "observed_at": "1", "collector": {"v": 1}}
    rows = [json.dumps(a), json.dumps({**dict(reversed(a.items())), "observed_at": "2"}), json.dumps({**a, "messages": []}), "[]", "x", None]
    got = [r["d"] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(observations.capture_digest(F.col("r")).alias("d")).collect()]
    assert got[0] == got[1] != got[2] and got[3:] == [None, None, None] and observations.unknown_keys({"a": 1, "z": 2}, ["a"]) == ["z"]
