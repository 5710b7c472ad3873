"""Snippets, known names, captured conversations, vectors, rendered context on hand-made rows."""

import hashlib
import json
import math
import re

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import chat, graph, search, text_graph, topics
from annalist.sources import observations
from annalist.streaming import incremental

HOSTS = ("chat.example.com",)


def test_snippet(spark):
    far = "x " * 30 + "alpha y beta " + "z " * 30
    d = spark.createDataFrame([("",), (None,), ("one two",), (far,), ("a alpha b. " + "q " * 40 + "Alpha, beta",)], "t string")
    got = [r[0] for r in d.select(T.snippet(F.col("t"), ["alpha", "beta"], 4)).collect()]
    assert got == ["", "", "one two", "… [alpha] y [beta] z …", "… q q [Alpha,] [beta]"]


def test_known_names_prefer_the_longest_and_do_not_overlap(spark):
    names = {"p:graph": ("project", "Graph", ("graph", "Graph Store")), "p:store": ("project", "Store", ("store", "graph store")), "p:c": ("project", "C++", ("c++",))}
    texts = ["A GRAPH STORE, a store; graphs", "c++ c+++ graph-store", "graph graph store", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(T.known_names(F.col("t"), names).alias("n"))
    assert [[x["key"] for x in r["n"]] for r in d.collect()] == [["p:graph", "p:store"], ["p:c", "p:c"], ["p:graph", "p:graph"], [], []]
    assert spark.range(1).select(T.known_names(F.lit("a"), {})).first()[0] == []
    m = spark.createDataFrame([("m", "Use the graph store. The store.")], "id string, text string")
    n, e = text_graph.nodes(m, "id", "text", names).collect(), text_graph.edges(m, "id", "text", names).collect()
    assert {r["label"] for r in n if r["layer"] == "reference"} == {"Graph", "Store"}
    assert {r["src"] for r in e} | {r["dst"] for r in e} <= {r["node"] for r in n}


def test_speech_acts_need_whole_words(spark):
    said = {"please": ["request"], "xplease": [], "pleased": [], "a_please": [], "(please)": ["request"], "we should go": ["proposal"], "it works only.": ["constraint"], "é only": ["constraint"], "not a but": ["correction"], "who?": ["question"], "whoever": []}
    d = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.transform(T.speech_acts(F.col("t")), lambda a: a["kind"]).alias("k"))
    assert {r["t"]: r["k"] for r in d.collect()} == said


def capture(**change):
    m = [{"id": "a", "role": "user", "blocks": [{"type": "text", "text": "A"}, {"type": "code", "text": "x"}], "parents": []}, {"id": "b", "blocks": [], "parents": ["a"]}, {"id": "s", "blocks": [{"type": "text", "text": " "}], "parents": ["a"]}]
    return {"source_key": "k", "conversation": {"id": "c", "url": "https://chat.example.com/c/1?x"}, "messages": m, "active_path": ["a", "b"]} | change


def test_faults_of_captures(spark):
    m = capture()["messages"]
    cases = {
        "[]": [], "none": ["not-json"],
        "dup": ["duplicate-id"], "unknown": ["unknown-parent"], "cycle": ["cycle"], "self": ["cycle"], "path": ["active-path-not-connected"], "gone": ["bad-active-path"],
        "key": ["credential-key"], "url": ["url-not-allowed"], "block": ["bad-blocks"], "empty": ["no-messages"], "list": ["not-an-object"], "deep": ["metadata-too-deep"],
    }
    nested = 1
    for _ in range(12):
        nested = [nested]
    raw = {
        "[]": capture(), "dup": capture(messages=[*m, m[1]]), "unknown": capture(messages=[*m, {"id": "z", "blocks": [], "parents": ["?"]}]),
        "cycle": capture(messages=[m[0], {"id": "b", "blocks": [], "parents": ["s", "a"]}, {"id": "s", "blocks": [], "parents": ["b"]}]), "self": capture(messages=[*m, {"id": "z", "blocks": [], "parents": ["z"]}]),
        "path": capture(active_path=["b", "s"]), "gone": capture(active_path=["a", "?"]), "key": capture(messages=[m[0] | {"state": {"x": [{"Access-Token": 1}]}}, *m[1:]]),
        "url": capture(conversation={"id": "c", "url": "https://chat.example.com.evil/c"}), "block": capture(messages=[m[0] | {"blocks": [{"type": "video"}]}, *m[1:]]), "empty": capture(messages=[]), "list": [1], "deep": capture(messages=[m[0] | {"state": {"x": nested}}, *m[1:]]),
    }
    d = spark.createDataFrame([(k, json.dumps(raw[k]) if k in raw else None) for k in cases], "name string, raw string")
    got = observations.checked(d, "raw", HOSTS)
    assert {r["name"]: r["faults"] for r in got.collect()} == cases
    rows = observations.messages(got.where("size(faults) = 0"), "raw").collect()
    assert [(r["message"], r["role"], r["text"], r["parents"], r["active_position"]) for r in rows] == [("a", "user", "A\n\nx", [], 0), ("b", "unknown", "", ["a"], 1), ("s", "unknown", "", ["a"], None)]
    assert observations.checked(d.limit(0), "raw", HOSTS).count() == 0


def test_hashed_vector(spark):
    text = "é" * 70 + "b"
    d = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", search.hashed_vector(40)("t").alias("v"))
    want = [0.0] * 40
    for at in (0, 64):
        for i, b in enumerate(hashlib.sha256(f"{at}:{text[at:at + 64]}".encode()).digest()):
            want[(at + i) % 40] += (b - 127.5) / 127.5
    n = math.sqrt(sum(x * x for x in want))
    got = {r["t"]: r["v"] for r in d.collect()}
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(got[text], want)) and got[""] == got[None] == [0.0] * 40


def test_markdown_of_nothing_and_of_null_texts(spark):
    ddl = "conversation int, title string, rank int, position int, role string, text string, message string, revision string, tokens long"
    rows = [(1, None, 2, 0, "user", None, "m1", "r1", 1), (2, "T", 1, 0, "assistant", "hi", "m2", "r2", 2)]
    got = chat.markdown(spark.createDataFrame(rows, ddl), "q", 9).first()[0]
    assert got.startswith("# Context bundle\n\n- Query: q\n- Messages: 2\n- Conversations: 2\n- Estimated tokens: 3 / 9\n\n## T\n\n### [H1] Assistant\n\nhi\n\n## Untitled conversation\n\n### [H2] User\n\n\n\n## Provenance")
    assert "No matching" in chat.markdown(spark.createDataFrame([], ddl), "q", 9).first()[0]


def test_blocked_checkpoints(spark):
    c = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "ref string, oid int")
    known = spark.createDataFrame([(1,)], "oid int")
    got = {r["ref"]: r["status"] for r in chat.checkpoint_status(c, known, known.withColumn("ref", F.lit("a")), shallow=True).collect()}
    assert got == {"a": "blocked-shallow", "b": "empty", "c": "checkpoint-missing"}


def test_trace_order_of_terminals(spark):
    rows = [("a", "b", "none"), ("b", "a", "inferred"), ("b", "c", None), ("c", "a", "none"), ("b", None, "unresolved"), ("c", "s", "dynamic"), ("c", "e", "none")]
    e = spark.createDataFrame(rows, "src string, dst string, doubt string")
    a = spark.createDataFrame([("a",)], "node string")
    got = {(tuple(r["path"]), r["terminal"]) for r in graph.trace(a, e, 3, F.col("node") == "s").collect()}
    assert got == {(("a", "b", "a"), "inferred"), (("a", "b", None), "unresolved"), (("a", "b", "c", "a"), "cycle"), (("a", "b", "c", "s"), "sink"), (("a", "b", "c", "e"), "max-depth")}
    assert graph.trace(a.limit(0), e, 3).count() == 0


def test_evidence_counts_places(spark):
    rows = [("m", 0, "x", 4.0), ("m", 0, "y", 1.0), ("m", 1, "x", 1.0), ("n", 0, "x", 1.0), ("n", 0, "y", 1.0)]
    m = spark.createDataFrame(rows, "message string, context int, topic string, weight double")
    r = spark.createDataFrame([("m", "n"), ("m", "n"), ("n", "gone")], "src string, dst string")
    got = {(x["a"], x["b"], x["relation"], x["place"]): x["weight"] for x in topics.evidence(m, r).collect()}
    assert got == {("x", "y", "same-context", '["m","0"]'): 8.0, ("x", "y", "same-context", '["n","0"]'): 4.0, ("x", "y", "same-message", '["m"]'): 1.5, ("x", "y", "same-message", '["n"]'): 0.75, ("x", "y", "reply", '["m","n"]'): 4.5}
    assert [tuple(x) for x in topics.evidence_associations(m, r, 5).collect()] == [("x", "y", 5, round(1 - math.exp(-18.75 / 2 / 3), 6))]


def test_evidence_of_hits(spark):
    h = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, 3, None), (1, 1, "a"), (1, 2, "b"), (9, 1, "z")], "k int, o int, v string")
    got = {r["k"]: [tuple(x) for x in r["rows"]] for r in search.with_evidence(h, "k", {"rows": (rows, ["o"], 2)}).collect()}
    assert got == {1: [(1, "a"), (2, "b")], 2: []}


def test_a_receipt_is_taken_once(spark, tmp_path):
    t, r = str(tmp_path / "facts"), str(tmp_path / "receipts")
    f = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert [incremental.archive(spark, f, t, r, "one", ["k"]), incremental.archive(spark, f, t, r, "one", ["k"]), incremental.archive(spark, f.union(f.selectExpr("k + 1", "v")), t, r, "two", ["k"])] == [2, 0, 1]
    assert sorted(x["k"] for x in spark.read.parquet(t).collect()) == [1, 2, 3]
    assert {tuple(x) for x in spark.read.parquet(r).collect()} == {("one", 2), ("two", 1)}


def test_context_document_chooses_from_the_whole_table(spark):
    """Brute force over all conversations: the registered query takes what fits of the best ones, whatever their ids."""
    from annalist.plans import QUERIES
    from annalist.plans.queries import TERMS

    data = "/root/testdata/sf0.01"
    rows = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    words = {k: re.findall("[a-z0-9]+", (r["text"] or "").lower()) for k, r in rows.items()}
    n, mean = len(rows), sum(map(len, words.values())) / len(rows)
    idf = {q: math.log((n - d + 0.5) / (d + 0.5)) for q in TERMS for d in [sum(q in w for w in words.values())]}
    score = {k: round(sum(max(idf[q], 0) * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean)) if idf[q] > 0 else 1e-6 * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for q in TERMS), 6) for k, w in words.items() if any(q in w for q in TERMS)}
    hits = sorted(score, key=lambda k: (-score[k], k))[:96]
    top = {c: max(score[h] for h in hits if h[0] == c) for c in {h[0] for h in hits}}
    want, n_tokens = [], 0
    chosen = sorted(top, key=lambda c: (-top[c], c))[:8]
    for c in chosen:
        far = {k[1]: min(abs(k[1] - h[1]) for h in hits if h[0] == c) for k in rows if k[0] == c}
        used, taken = 0, []
        for _, turn in sorted((p, t) for t, p in far.items() if p <= 2):
            cost = max(1, -(-len((rows[c, turn]["text"] or "").encode()) // 4)) + 18
            if used + cost <= 1500:
                used, taken = used + cost, [*taken, turn]
        want += [(c, t) for t in sorted(taken)]
        n_tokens += used
    got = QUERIES["context_document"](spark, data).first()["markdown"]
    cited = [(int(a), int(b)) for a, b in re.findall(r"message `([0-9]+):([0-9]+)`", got.split("## Provenance")[1])]
    assert cited == want and max(chosen) >= 3 and n_tokens <= 12000
    assert got.startswith(f"# Context bundle\n\n- Query: that with heat\n- Messages: {len(want)}\n- Conversations: {len({c for c, _ in want})}\n- Estimated tokens: {n_tokens} / 12000\n\n## Conversation {want[0][0]}\n")
    assert all(f"### [H{i + 1}] {rows[k]['role'].capitalize()}\n\n{rows[k]['text']}\n" in got for i, k in enumerate(want))
