"""Code histories where deletions, names or copies are many: whole results, without the rows of pairs on the way."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from annalist.operators import code_history, history, lineage
from annalist.plans import SQL, code, queries

COLS = "repository long, commit string, seq long, analysis long, path string, language string, kind string, name string, qualified_name string, structural_hash string, source_hash string"


def a_history(spark, n, seed=1):
    r = random.Random(seed)
    rows, gone = [], []
    for k in range(n):
        path = r.choice(["a.py", "b.py", None])
        if r.random() < 0.3:
            gone.append((1, f"c{k // 5}", path, k))
        else:
            rows.append((1, f"c{k // 5}", k, k, path, "python", r.choice(["function", None]), "f", r.choice(["m.f", "m.g", None]), r.choice(["h1", "h2", None]), "s"))
    return code_history.identified(spark.createDataFrame(rows, COLS)), spark.createDataFrame(gone, "repository long, commit string, path string, seq long")


def above(df, node):
    """The operators above the first one whose line holds node, in the plan before it runs."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    planned = df._jdf.queryExecution().executedPlan().toString().split("\n")
    lines = planned if any(node in x for x in planned) else lines
    depth = lambda x: len(re.match(r"[\s:|+\-*()\d]*", x).group())
    at = next(k for k, x in enumerate(lines) if node in x)
    out, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            out.append(x)
            d = depth(x)
    return out


def test_changes_make_the_rows_of_deletions_last(spark, monkeypatch):
    monkeypatch.setattr(code_history, "BLOCK", 3)
    for seed in range(2):
        seen, gone = a_history(spark, 90, seed)
        t = code_history.changes(seen, gone)
        log = seen.select("repository", "commit", "seq", "path", "logical_id", "revision_id", F.lit(False).alias("gone"))
        dead = gone.join(seen.select("repository", "path", "logical_id").distinct(), ["repository", "path"])
        log = log.unionByName(dead.withColumn("revision_id", F.lit(None).cast("string")).withColumn("gone", F.lit(True)))
        want = history.transitions(log, ["logical_id"], ["seq"], "revision_id", "path", "gone").where("kind is not null")
        want = want.select(F.col("seq").alias("id"), "repository", "commit", "logical_id", F.col("prior").alias("from_revision"), F.when(~F.col("gone"), F.col("revision_id")).alias("to_revision"), "kind")
        key = lambda r: tuple(map(str, r))
        got = sorted(map(tuple, t.collect()), key=key)
        assert got == sorted(map(tuple, want.collect()), key=key) and {"deleted", "resurrected", "moved"} <= {r[-1] for r in got}
    assert not [x for x in above(t, "Generate explode") if re.search("Exchange|Sort|Window", x)]


def test_documents_get_the_names_of_a_deletion_in_one_row(spark):
    seen, gone = a_history(spark, 90)
    names = {}
    symbols = {r["logical_id"]: r["qualified_name"] for r in code_history.logical_symbols(seen).collect()}
    for r in code_history.changes(seen, gone).collect():
        names.setdefault((r["commit"], r["id"]), []).append(symbols[r["logical_id"]])
    got = code_history.changed_names(seen, gone).collect()
    assert {(r["commit"], r["id"]): r["names"] for r in got} == {k: sorted(v) for k, v in names.items()} and len(got) == len(names)
    commits = spark.createDataFrame([("c0", "m")], "commit string, message string")
    changes = spark.createDataFrame([("c0", 1, "M", None, "a.py")], "commit string, id long, change_kind string, old_path string, new_path string")
    words = [n for k in sorted(names) if k[0] == "c0" for n in sorted(names[k])]
    assert code_history.commit_documents(commits, changes, code_history.changed_names(seen, gone)).first()["content"] == " ".join(["m", "M  a.py", *words])


def test_a_symbols_history_looks_at_its_own_observations(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    some = code_history.logical_symbols(code._seen(t)).orderBy("logical_id").limit(3)
    own = code._moved(t, some).orderBy("id", "logical_id").collect()
    assert own and own == code._moved(t).join(some.select("logical_id"), "logical_id", "left_semi").select(code._moved(t).columns).orderBy("id", "logical_id").collect()


def test_references_meet_one_revision_of_a_name(spark):
    r = random.Random(5)
    found = [(f"r{k}", f"l{k % 4}", r.choice(["c1", "c2", None])) for k in range(12)]
    symbols = [(f"l{k}", "m.f" if k < 3 else "m.g") for k in range(4)]
    places = sorted({(f"r{r.randrange(12)}", r.choice(["c1", "c2", "c3"])) for _ in range(14)})
    refs = [(k, f"r{k % 3}", r.choice(["c1", "c2", "c3", "c4", None]), r.choice(["m.f", "m.g", "r5", "none", "", None]), None, r.choice(["resolved", "dynamic", "guessed"])) for k in range(60)]
    names = dict(symbols)

    def target(commit, t):
        all_ = [(commit is None or (i, commit) not in places, t != i, i, last) for i, lid, last in found if t in (i, names[lid])]
        order = lambda x: (x[0], x[1], (x[3] is None, [-ord(c) for c in x[3] or ""]) if x[0] else (), x[2])
        return min(all_, key=order)[2] if all_ else None

    frames = (spark.createDataFrame(found, "revision_id string, logical_id string, last_commit string"), spark.createDataFrame(symbols, "logical_id string, qualified_name string"), spark.createDataFrame(places, "revision_id string, commit string"))
    d = spark.createDataFrame(refs, "id long, revision string, commit string, target_text string, target_qualified_name string, resolution string")
    got = {x["id"]: x["target"] for x in code_history.resolved(d, *frames).collect()}
    assert got == {k: None if how == "dynamic" else target(commit, t) for k, _, commit, t, _, how in refs}
    edges = code_history.resolved(d, *frames).select(F.col("id").alias("seq"), F.col("revision").alias("src"), F.col("target").alias("dst"), "doubt")
    start, asked = spark.createDataFrame([("r0", 1), ("r1", 2)], "node string, rank long"), []

    def some(nodes):
        asked.append(nodes.count())
        return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")

    assert code_history.traced(start, some, 2, 400).collect() == code_history.traced(start, edges, 2, 400).collect() and asked[0] == 2


def test_alike_symbols_are_scored_once_and_give_all_pairs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    cols = "grp long, key string, name string, kind string, signature string, structural_hash string, shape_hash string, features array<string>, node_count long, depth long, arity long, tokens array<string>, references array<string>, paths array<string>"
    side = lambda keys: spark.createDataFrame([(1, k, n, "function", f"({n})", h, "s", ["Call"], 10, 4, 2, [n], [], []) for k, n, h in keys], cols)
    a = side([("a1", "load", "h1"), ("a2", "load", "h1"), ("a3", "save", "h2")])
    b = side([("b1", "load", "h1"), ("b2", "save", "h2"), ("b3", "save", "h9")])
    got = {(r["from"], r["to"]): (r["confidence"], r["resolution"]) for r in lineage.candidates(a, b, ["grp"], "key").collect()}
    one = {}
    for x in a.collect():
        for y in b.collect():  # each pair by itself
            p = lineage.candidates(a.where(F.col("key") == x["key"]), b.where(F.col("key") == y["key"]), ["grp"], "key").collect()
            one |= {(r["from"], r["to"]): r["confidence"] for r in p}
    near = lambda p: any(q != p and (q[0] == p[0] or q[1] == p[1]) and round(abs(one[p] - one[q]), 9) < 0.05 for q in one)
    assert got == {p: (v, "candidate" if near(p) else "resolved") for p, v in one.items()} and {x[1] for x in got.values()} == {"candidate", "resolved"}
    plan = lineage.candidates(a, b, ["grp"], "key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # pairs of copies are made after the windows
    resolved = {(r["from"], r["to"]) for r in lineage.match(lineage.candidates(a, b, ["grp"], "key"), ["grp"]).collect()}
    assert resolved and resolved <= {p for p, v in got.items() if v[1] == "resolved"}


def some_symbols(spark, n, seed, side):
    r = random.Random(seed)
    some = lambda: r.sample(["a", "b", "c", "d"], r.randrange(4)) + r.choice([[], ["a"]])
    cols = "grp long, key string, name string, kind string, signature string, structural_hash string, shape_hash string, features array<string>, node_count long, depth long, arity long, tokens array<string>, references array<string>, paths array<string>"
    rows = []
    for k in range(n):
        texts = r.choice(rows)[:1] + (f"{side}{k}",) + r.choice(rows)[2:] if rows and r.random() < 0.1 else None
        rows.append(texts or (r.choice([1, 2]), f"{side}{k}", r.choice(["load a", "a.load", "save it", "load", None]), r.choice(["f", "c", None]), r.choice(["(a)", "(a, b)", "", None]), r.choice(["h1", "h2", "h3", f"{side}{k}", None]), r.choice(["s1", "s2", None]), some(), r.choice([1, 5, 9, None]), r.choice([0, 3]), r.choice([2, None]), some(), some(), r.choice([[], ["x"]])))
    return spark.createDataFrame(rows, cols)


def score(x, y, w):
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    of = lambda v: {u.lower() for u in re.split("[^A-Za-z0-9_!?*-]+", v or "") if u}
    num = lambda a, b: 0.0 if a is None or b is None else max(0.0, 1 - abs(a - b) / max(1, a, b))
    same = lambda c: x[c] is not None and x[c] == y[c]
    text = lambda c: 1.0 if same(c) else share(of(x[c]), of(y[c]))
    parts = 0.45 * same("shape_hash") + 0.3 * share(x["features"], y["features"]) + 0.1 * num(x["node_count"], y["node_count"]) + 0.1 * num(x["depth"], y["depth"]) + 0.05 * num(x["arity"], y["arity"])
    e = {"name": text("name"), "kind": float(same("kind")), "structure": 1.0 if same("structural_hash") else round(parts, 6), "token": share(x["tokens"], y["tokens"])}
    e |= {"signature": 0.0 if x["signature"] is None and y["signature"] is None else text("signature"), "references": share(x["references"], y["references"]), "diff": share(x["paths"], y["paths"])}
    return sum(e[k] * w[k] for k in e) / sum(w.values())


def test_words_are_compared_before_symbols_and_no_pair_is_lost(spark):
    for seed, weights, threshold in ((1, {}, 0.45), (2, {"structure": 0.9, "name": 0.0}, 0.6), (3, {"kind": -0.1}, 0.2)):
        a, b = some_symbols(spark, 40, seed, "a"), some_symbols(spark, 40, seed + 9, "b")
        d = lineage.candidates(a, b, ["grp"], "key", weights, threshold)
        rows = d.collect()
        got = {(r["from"], r["to"]): r["confidence"] for r in rows}
        want = {(x["key"], y["key"]): score(x, y, lineage.WEIGHTS | weights) for x in a.collect() for y in b.collect() if x["grp"] == y["grp"]}
        sure = {p for p, v in want.items() if v >= threshold + 2e-6}
        assert sure <= set(got) <= {p for p, v in want.items() if v >= threshold - 2e-6} and len(rows) == len(got) and sure
        assert all(abs(want[p] - v) < 2e-6 for p, v in got.items())
        near = lambda p: any(q != p and (q[0] == p[0] or q[1] == p[1]) and round(abs(got[p] - got[q]), 9) < 0.05 for q in got)
        assert {(r["from"], r["to"]): r["resolution"] for r in rows} == {p: "candidate" if near(p) else "resolved" for p in got}
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("explode(c_parts") < plan.index("explode(p_parts") < plan.index("array_intersect")  # words are compared below
        assert plan.count("array_intersect") == 1


def test_matches_score_pairs_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = lineage.match(lineage.candidates(some_symbols(spark, 20, 1, "a"), some_symbols(spark, 20, 2, "b"), ["grp"], "key", delta=0.001), ["grp"])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert d.count() and "Join" not in plan and "Generate" not in plan  # what is done and what is left come from pairs that are kept


def test_matches_of_parts_follow_from_the_sql_of_their_scores(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r, made = random.Random(3), []
    rows = [(k, " ".join(r.sample(["red", "old", "hot", "big", "bolt", "nut", "ring"], r.choice([1, 2, 2, 3]))), f"B{r.randrange(5)}", r.choice(["S", "L"]), r.randrange(8)) for k in range(200)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    con = duckdb.connect()
    con.register("part", part.toPandas())
    pairs = [x[:3] for x in con.sql(SQL["code_lineage_scores"]).fetchall() if x[3] == "resolved"]
    names, ends = {k: n for k, n, *_ in rows}, [Counter(x[k] for x in pairs) for k in (0, 1)]
    kinds = {(True, True): "split-merge", (True, False): "split", (False, True): "merge"}
    known = {p: kinds.get((ends[0][p[0]] > 1, ends[1][p[1]] > 1)) for p in pairs}
    used = [{p[k] for p in pairs if known[p]} for k in (0, 1)]
    want = {(*p, known[p] or ("modified" if names[p[0]] == names[p[1]] else "moved")) for p in pairs if known[p] or not (p[0] in used[0] or p[1] in used[1])}
    monkeypatch.setattr(lineage, "cut", lambda df, cut=lineage.cut: made.append("Join" in df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    d = code.code_lineage_matches(lambda name: part)
    got = [(x["from"], x["to"], x["confidence"], x["kind"]) for x in d.collect()]
    key = lambda x: (x[0], x[1], round(x[2], 5), x[3])
    assert sorted(map(key, got)) == sorted(map(key, want)) and {"modified", "moved", "split"} <= {x[3] for x in want}
    assert made.count(True) + ("Join" in d._jdf.queryExecution().optimizedPlan().toString()) == 1  # the pairs are scored once


def test_parts_of_the_same_words_are_scored_once(spark):
    rows = [(1, "red bolt", "B", 1), (2, "Red bolt", "B", 1), (3, "bolt red", "B", 1), (4, "blue bolt nut", "B", 1), (5, "red bolt", "B", 2), (6, "bolt nut", "B", 1), (7, "red bolt", "B", 1)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    d = queries.lineage_candidates(lambda name: part)
    words = {k: (set(n.lower().split()), (b, s)) for k, n, b, s in rows}
    pairs = [(x, y, len(words[x][0] & words[y][0]) / len(words[x][0] | words[y][0])) for x in words for y in words if x < y and words[x][1] == words[y][1]]
    assert sorted(map(tuple, d.collect())) == sorted((x, y, round(s, 6)) for x, y, s in pairs if s >= 0.5)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # pairs of copies are made after the join


def test_first_transitions_are_those_of_all(spark):
    seen, gone = a_history(spark, 90)
    seen = seen.where("path is not null")
    commits = spark.createDataFrame([(1, f"c{k}", None if k == 3 else k * 7 % 5) for k in range(16)], "repository long, commit string, committed_at long").withColumn("message", F.lit("m"))
    for limit in (1, 4, 50):
        all_ = code_history.symbol_transitions(code_history.changes(seen, gone), commits, code_history.logical_symbols(seen), limit).select("logical_id", "place", "id")
        first = code_history.first_transitions(seen, gone, commits, limit)
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, all_.collect()))


def test_a_search_of_commits_makes_no_transitions(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert "Window" not in code._commit_text(t)._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_cut_to_the_resolved_before_pairs_of_copies(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    plan = code._pairs(t).where("resolution = 'resolved'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[: plan.index("Generate explode")]


def test_context_makes_its_hits_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(code, "cut", lambda df: made.append(1) or df)
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert {r["type"] for r in code.code_context(t).collect()} == {"symbol_revision", "commit_change"} and len(made) == 2
