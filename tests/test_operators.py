"""Operators on hand-made rows."""

import json

from pyspark.sql import functions as F

from annalist.operators import chat, context, graph, history, lineage
from annalist.sources import analyzers, tables
from annalist.streaming import incremental


def test_trace_terminals(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "d")], "src string, dst string")
    got = {tuple(r["path"]): r["terminal"] for r in graph.trace(spark.createDataFrame([("a",)], "node string"), e, 5, F.col("node") == "d").collect()}
    assert got == {("a", "b", "c", "d"): "sink", ("a", "b", "a"): "cycle"}
    assert {r["terminal"] for r in graph.trace(spark.createDataFrame([("a",)], "node string"), e, 1).collect()} == {"max-depth"}


def test_transitions_compare_with_the_inserted_revision(spark):
    rows = [(1, 0, "A", "p", False), (1, 1, "B", "p", False), (1, 2, "A", "p", False), (1, 3, "B", "q", False), (1, 4, None, "q", True), (1, 5, "B", "q", False)]
    log = spark.createDataFrame(rows, "entity long, seq long, digest string, path string, gone boolean")
    got = [r["kind"] for r in history.transitions(log, ["entity"], ["seq"], "digest", "path", "gone").orderBy("seq").collect()]
    assert got == ["introduced", "modified", "modified", "moved", "deleted", "resurrected"]


def symbols(spark, rows):
    cols = "grp long, key string, name string, kind string, signature string, structural_hash string, shape_hash string, features array<string>, node_count long, depth long, arity long, tokens array<string>, references array<string>, paths array<string>"
    return spark.createDataFrame([(1, n, n, "function", f"({n})", h, s, f, 10, 4, 2, t, [], ["a.py"]) for n, h, s, f, t in rows], cols)


def test_lineage_kinds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    a = symbols(spark, [("load", "h1", "s1", ["Call", "If"], ["load", "file"]), ("save", "h2", "s2", ["With"], ["save", "disk"])])
    b = symbols(spark, [("load", "h9", "s1", ["Call", "If"], ["load", "file"]), ("store", "h2", "s2", ["With"], ["save", "disk"])])
    c = lineage.candidates(a, b, ["grp"], "key")
    got = {(r["from"], r["to"]): r["kind"] for r in lineage.match(c, ["grp"]).collect()}
    assert got["load", "load"] == "modified" and got["save", "store"] == "moved"
    twin = symbols(spark, [("saveA", "h2", "s2", ["With"], ["save", "disk"]), ("saveB", "h3", "s2", ["With"], ["save"])])
    one = a.where("key = 'save'")
    near = lineage.candidates(one, symbols(spark, [("x", "h2", "s2", ["With"], ["save", "disk"]), ("y", "h2", "s2", ["With"], ["save", "disk"])]), ["grp"], "key")
    assert {r["resolution"] for r in near.collect()} == {"candidate"} and lineage.match(near, ["grp"]).count() == 0
    assert {r["kind"] for r in lineage.match(lineage.candidates(one, twin, ["grp"], "key", delta=0.001), ["grp"]).collect()} == {"split"}
    assert {r["kind"] for r in lineage.match(lineage.candidates(twin, one, ["grp"], "key", delta=0.001), ["grp"]).collect()} == {"merge"}


def test_pack_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 4), (2, 0, 99)], "g long, pos long, cost long")
    assert sorted((r["g"], r["pos"], r["used"]) for r in context.pack(d, "g", ["pos"], "cost", 10, ["pos"]).collect()) == [(1, 0, 5), (1, 2, 9)]


def test_current_and_historical_search(spark):
    rev = spark.createDataFrame([("r1", "alpha beta"), ("r2", "gamma"), ("r3", "delta epsilon"), ("r4", "zeta")], "revision string, text string")
    obs = spark.createDataFrame([("m", "r1", "c", "s", "user", None, "2020", 1), ("m", "r2", "c", "s", "user", None, "2021", 2), ("n", "r3", "c", "s", "user", None, "2020", 1)], "message string, revision string, conversation string, source string, role string, created string, observed string, seq long")
    assert chat.search_messages(rev, obs, ["alpha"]).count() == 0
    assert chat.search_messages(rev, obs, ["alpha"], historical=True).count() == 1
    assert chat.search_messages(rev, obs, ["gamma"]).first()["message"] == "m"


def test_checkpoint_status(spark):
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9"), ("d", None)], "ref string, oid string")
    known = spark.createDataFrame([("1",), ("2",)], "oid string")
    reach = spark.createDataFrame([("a", "1"), ("b", "1")], "ref string, oid string")
    assert {r["ref"]: r["status"] for r in chat.checkpoint_status(c, known, reach).collect()} == {"a": "ready", "b": "ref-rewritten", "c": "checkpoint-missing", "d": "empty"}


def test_analysers(spark):
    py = "X = 1\nclass Größe:\n    def m(self):\n        return f(1, 2)\n\ndef test_it():\n    pass\n"
    lisp = '(ns my.app)\n; note\n(defn greet [who] (str "hi (" who))\n(def pi 3)\n(deftest t (is (= 1 1)))'
    files = spark.createDataFrame([("a.py", "python", py), ("b.clj", "clojure", lisp), ("c.py", "python", "def ("), ("d", "cobol", "x"), ("e.py", "python", None)], "path string, language string, text string")
    rows = analyzers.analyse(files).collect()
    got = {(r["path"], r["qualified_name"]): r for r in rows}
    assert {k[1] for k in got if k[0] == "a.py"} == {"X", "Größe", "Größe.m", "test_it"} and got["a.py", "Größe.m"]["references"] == ["f"]
    r = got["a.py", "Größe"]
    assert py.encode()[r["start_byte"] : r["end_byte"]].decode().startswith("class Größe")
    assert {k[1] for k in got if k[0] == "b.clj"} == {"my.app/greet", "my.app/pi", "my.app/t"} and "str" in got["b.clj", "my.app/greet"]["references"]
    assert got["c.py", None]["error"] == "SyntaxError"


def test_chat_export(spark, tmp_path):
    node = lambda i, parent, text: {"id": i, "parent": parent, "message": {"id": i, "author": {"role": "user"}, "create_time": 1600000000.5, "content": {"content_type": "text", "parts": [text]}} if text else None}
    conv = lambda up, text: {"conversation_id": "c", "title": "t", "update_time": up, "current_node": "b", "mapping": {"r": node("r", None, None), "b": node("b", "r", text)}}
    (tmp_path / "conversations.json").write_text(json.dumps([conv(1.0, "old"), conv(2.0, "new")]))
    m = tables.chat_messages(tables.chat_export(spark, str(tmp_path / "conversations.json"))).collect()
    assert [(r["node"], r["parent"], r["text"]) for r in m] == [("b", "r", "new")]
    (tmp_path / "a.jsonl").write_text('{"result":{"n":1}}\n\n{"error":"x"}\nnot json\n')
    assert sorted(r["failed"] for r in tables.analyses(spark, str(tmp_path / "a.jsonl"), "struct<n:long>").collect()) == [False, True, True]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    for k in range(2):
        incremental.ingest(spark, spark.readStream.schema("id long, v string").parquet(src), target, str(tmp_path / f"cp{k}"), ["id"]).awaitTermination()
        assert spark.read.parquet(target).count() == 2
