"""Walks, spans, exports and merges on hand-made rows."""

import json
import subprocess

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import graph, history, search, text_graph, topics
from annalist.sources import git, tables

TEXTS = ["One. Two (three.) Four?\n\nFünf ünd sechs!  Sieben", "", None, "。说！」好", " a.b c. ", "x" * 5000 + ". y", "...\r\n?", "nul\x00. z", " é. Ü? x\n" * 1500]


def test_spans_hold_the_bytes_of_sentences(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in d.select("t", T.spans(F.col("t")).alias("s"), T.sentences(F.col("t")).alias("want")).collect():
        raw = (r["t"] or "").encode()
        assert [raw[x["start"] : x["end"]].decode() for x in r["s"]] == [x["text"] for x in r["s"]]
        assert [x["text"] for x in r["s"]] == [w.strip() for w in r["want"] if w.strip()]


def test_truncation_keeps_whole_characters(spark):
    texts = ["", None, "short", "é" * 60, "a" + "é" * 60, "ab" + "漢" * 40, "😀" * 30, "a😀" * 20, "x" * 80, "x" * 81]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.truncated(F.col("t"), 20).alias("s")).collect():
        if r["t"] is None or len(r["t"].encode()) <= 80:
            assert r["s"] == r["t"]
        else:
            want = max((r["t"][:n] for n in range(len(r["t"])) if len(r["t"][:n].encode()) <= 77), key=len)
            assert r["s"] == want + "…"


def test_folding_phrases_windows(spark):
    d = spark.createDataFrame([("Été Ñandú ŻÓŁĆ é",), (None,)], "t string")
    assert [r[0] for r in d.select(T.folded(F.col("t"))).collect()] == ["ete nandu zołc e", ""]
    w = spark.range(1).select(F.split(F.lit("a a a b"), " ").alias("w"))
    assert w.select(T.count_of(F.col("w"), "a a"), T.count_of(F.col("w"), "a b"), T.count_of(F.col("w"), "a"), T.count_of(F.col("w"), "b a")).first()[:] == (2, 1, 3, 0)
    x = spark.createDataFrame([("",), (None,), ("x" * 10,), ("é" * 13,)], "t string").select(T.windows(F.col("t"), 10, 4).alias("w")).collect()
    assert [[(a["start"], a["end"]) for a in r["w"]] for r in x] == [[(0, 0)], [(0, 0)], [(0, 10)], [(0, 10), (6, 16), (12, 22), (18, 26)]]


def test_reach_and_ancestry_end_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in graph.reach(spark.createDataFrame([("a",)], "node string"), e).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None, i == 3) for i in range(40)]
    rows = [*chain, chain[5], (2, "x", "y", False), (2, "y", "x", True), (2, "z", "x", False), (3, "o", "gone", True)]
    got = {(r["g"], r["n"]): (r["nearest"], r["depth"], r["cyclic"]) for r in graph.ancestry(spark.createDataFrame(rows, "g int, n string, p string, k boolean"), "g", "n", "p", F.col("k")).collect()}
    assert len(got) == 44 and got[1, "n39"] == ("n3", 39, False) and got[1, "n3"] == (None, 3, False) and got[1, "n0"] == (None, 0, False)
    assert got[2, "z"][1:] == (None, True) and got[2, "x"][1:] == (None, True) and got[3, "o"] == (None, 0, False)


def test_export_paths_and_edges(spark, tmp_path):
    def node(i, parent, text):
        return {"id": i, "parent": parent, "message": {"id": i, "author": {"role": "user"}, "content": {"content_type": "text", "parts": [text]}} if text else None}

    nodes = {"r": node("r", None, None), "a": node("a", "r", "A"), "gap": node("gap", "a", None), "b": node("b", "gap", "B"), "side": node("side", "a", "S")}
    loop = {"p": node("p", "q", "P"), "q": node("q", "p", "Q")}
    (tmp_path / "c.json").write_text(json.dumps([{"id": "c", "current_node": "b", "mapping": nodes}, {"id": "l", "current_node": "p", "mapping": loop}, {"id": "n", "mapping": {}}]))
    c = tables.chat_export(spark, str(tmp_path / "c.json"))
    assert {r["conversation"]: r["path"] for r in tables.active_paths(c).collect()} == {"c": ["a", "b"], "l": ["q", "p"], "n": []}
    assert {(r["src"], r["dst"]) for r in tables.message_edges(c).where("conversation = 'c'").collect()} == {("a", "b"), ("a", "side")}


def test_render(spark):
    d = spark.range(1).select(F.array(tables.block(F.lit("text"), F.lit("hi")), tables.block(F.lit(None).cast("string"), F.lit(" ")), tables.block(F.lit("code"), F.lit("a ``` b"))).alias("b"))
    assert d.select(tables.render(F.col("b")), tables.render(F.col("b"), True)).first()[:] == ("hi\n\na ``` b", "hi\n\n````\na ``` b\n````")


def test_vectors_topics_and_fusion(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k int, v array<float>").select("k", search.normalized(F.col("v")).alias("n"))
    assert {r["k"]: r["n"] for r in v.collect()} == {1: [0.6, 0.8], 2: None}
    s = spark.createDataFrame([("graph store", 3), ("graph", 9), ("other", 99)], "topic string, df long")
    shared = F.size(F.array_intersect(F.split("topic", " "), F.array(F.lit("graph"), F.lit("store"))))
    got = [(r["topic"], r["strength"]) for r in topics.find(s, shared, "graph store").orderBy(F.desc("strength")).collect()]
    assert got == [("graph store", 1.2), ("graph", round(1 / 1.584962500721156, 6))]
    l = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank long")
    assert [r["id"] for r in search.hybrid(l, spark.createDataFrame([(2, 1)], "id int, rank long"), "id").collect()] == [2, 1]
    assert [r["id"] for r in search.hybrid(l, None, "id").collect()] == [1, 2]
    assert spark.range(1).select(topics.reference_weight(F.lit("path")), topics.reference_weight(F.lit("?"))).first()[:] == (1.3, 1.2)


def test_upsert_keeps_what_is_not_updated(spark):
    a = spark.createDataFrame([(1, "old", 5), (2, "old", 6)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "new", 50), (2, None, 60), (3, "new", 70)], "k int, s string, n int")
    assert {tuple(r) for r in history.merge_columns(a, b, ["k"], ["s"]).collect()} == {(1, "new", 5), (2, "old", 6), (3, "new", 70)}


def test_text_graph(spark):
    text = "Please use @acme/lib now! See src/a/b.py. We must not use @acme/lib here. ..."
    d = spark.createDataFrame([("m", text), ("empty", ""), ("none", None)], "id string, text string")
    n, e = text_graph.nodes(d, "id", "text").collect(), text_graph.edges(d, "id", "text").collect()
    raw, ids = text.encode(), {r["node"] for r in n}
    assert len(ids) == len(n) and all(r["src"] in ids and r["dst"] in ids for r in e)
    of = lambda kind: [r for r in n if r["kind"] == kind]
    assert len(of("message")) == 3 and len(of("package")) == 1 and [r["label"] for r in of("path")] == ["src/a/b.py"]
    assert [raw[r["start"] : r["end"]].decode() for r in sorted(of("sentence"), key=lambda r: r["start"])] == ["Please use @acme/lib now!", "See src/a/b.py.", "We must not use @acme/lib here.", "..."]
    assert len(of("proposition")) == 3 and len(of("request")) == 1 and {r["layer"] for r in of("constraint")} == {"work"}
    assert sum(r["kind"] == "reference:mentions" for r in e) == 3
    wn, we = text_graph.project(text_graph.nodes(d, "id", "text"), text_graph.edges(d, "id", "text"), "work")
    assert {r["kind"] for r in wn.collect()} == {"request", "constraint", "proposition", "package"}
    assert {r["kind"] for r in we.collect()} == {"work:qualifies", "semantic:about"}


def test_git_history(spark, tmp_path):
    def run(*a):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    (tmp_path / "ä b.txt").write_text("one\ntwo\nthree\n" * 9)
    run("add", "-A"), run("commit", "-qm", "first\n\nbody é")
    run("mv", "ä b.txt", "c.txt"), run("commit", "-qm", "move")
    run("checkout", "-qb", "side", "HEAD~1"), (tmp_path / "d.txt").write_text("x"), run("add", "-A"), run("commit", "-qm", "side")
    run("checkout", "-q", "main"), run("commit", "-q", "--allow-empty", "-m", "nothing"), run("merge", "-q", "--no-ff", "-m", "merge", "side")
    c = git.commits(spark.createDataFrame([(str(tmp_path),)], "repository string"))
    rows = {r["message"]: r for r in c.collect()}
    assert set(rows) == {"first\n\nbody é", "move", "side", "nothing", "merge"} and len(rows["merge"]["parents"]) == 2
    assert all(rows[m]["seq"] > min(r["seq"] for r in rows.values()) for m in ("move", "side", "merge")) and rows["merge"]["seq"] == 4
    ch = {(r["oid"], r["parent"], r["status"], r["path"], r["new_path"]) for r in git.changes(c).collect()}
    o = {m: r["oid"] for m, r in rows.items()}
    first = o["first\n\nbody é"]
    assert ch == {(first, None, "A", "ä b.txt", None), (o["move"], first, "R", "ä b.txt", "c.txt"), (o["side"], first, "A", "d.txt", None), (o["merge"], o["nothing"], "A", "d.txt", None), (o["merge"], o["side"], "R", "ä b.txt", "c.txt")}
    blob = run("rev-parse", "side:d.txt")
    want = spark.createDataFrame([(str(tmp_path), blob), (str(tmp_path), blob), (str(tmp_path), "0" * 40)], "repository string, oid string")
    assert {(r["oid"], r["type"], r["size"], r["bytes"] and bytes(r["bytes"])) for r in git.objects(want).collect()} == {(blob, "blob", 1, b"x"), ("0" * 40, "missing", None, None)}
