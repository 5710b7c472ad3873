"""Facts of a code history as tables, derived from observations of symbols, and the queries over them.

Observations have one row per symbol that an analyser found: repository, commit, seq (a total order of indexing), analysis
(the analysis it comes from), path, language, kind, name, qualified_name, structural_hash, source_hash and, for structures,
shape_hash, node_count, depth, arity, features. References: id, revision, commit, kind, target_text,
target_qualified_name, resolution, confidence. Commits: repository, commit, committed_at, message.

Every table is a function of the observations, so it can be built again at any time; what a store would upsert is the first
or the last row of a key here. Nulls in names and kinds count as empty, and ties go by seq.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.history import latest, transitions
from annalist.operators.stable import cut

ZERO_BLOB = "0" * 40
# Deletions of a path that are kept in one array.
BLOCK = 1024


def digest_of(*values: Column) -> Column:
    """sha256 of a JSON array of the values; numbers bare, texts quoted, null as null."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(v, F.lit("null")) for v in values)), F.lit("]")), 256)


def quoted(text: Column) -> Column:
    """A text as JSON."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def identified(symbols: DataFrame) -> DataFrame:
    """symbols with logical_id (repository, kind, qualified name or name) and revision_id (logical id, structural hash)."""
    d = symbols.withColumn("logical_id", digest_of(F.col("repository").cast("string"), quoted(F.col("kind")), quoted(F.coalesce("qualified_name", "name"))))
    return d.withColumn("revision_id", digest_of(quoted(F.col("logical_id")), quoted(F.col("structural_hash"))))


def once(observations: DataFrame) -> DataFrame:
    """The observations without replays: of several analyses of a path at a commit the first counts."""
    first = F.min("analysis").over(W.partitionBy("repository", "commit", "path"))
    return observations.withColumn("__first", first).where("analysis <=> __first").drop("__first")


def logical_symbols(seen: DataFrame) -> DataFrame:
    """logical_id, repository, language, qualified_name, kind as first seen. seen: identified observations."""
    one = F.struct("repository", "language", F.coalesce("qualified_name", "name").alias("qualified_name"), "kind")
    return seen.groupBy("logical_id").agg(F.min_by(one, "seq").alias("x")).select("logical_id", "x.*")


def revisions(seen: DataFrame) -> DataFrame:
    """revision_id, logical_id, structural_hash, source_hash (as first seen), first_commit, last_commit, first_seq."""
    one = F.struct("logical_id", "structural_hash", "source_hash", F.col("commit").alias("first_commit"))
    g = seen.groupBy("revision_id").agg(F.min_by(one, "seq").alias("x"), F.max_by("commit", "seq").alias("last_commit"), F.min("seq").alias("first_seq"))
    return g.select("revision_id", "x.*", "last_commit", "first_seq")


def structures(seen: DataFrame) -> DataFrame:
    """revision_id and its structure as last seen, where there is one."""
    one = F.struct("shape_hash", "node_count", "depth", "arity", "features")
    return seen.where("shape_hash is not null").groupBy("revision_id").agg(F.max_by(one, "seq").alias("x")).select("revision_id", "x.*")


def structure_of_symbols(found: DataFrame, structured: DataFrame) -> DataFrame:
    """logical_id and the structure of its newest revision that has one. found: revisions."""
    d = structured.join(found.select("revision_id", "logical_id", "first_seq"), "revision_id")
    return latest(d, ["logical_id"], [F.desc("first_seq")]).drop("first_seq", "revision_id")


def locations(seen: DataFrame) -> DataFrame:
    """revision_id, commit, path, seq (the last): where a revision was seen, each place once."""
    return seen.groupBy("revision_id", "commit", "path").agg(F.max("seq").alias("seq"))


def _identity(seen: DataFrame) -> DataFrame:
    """seen by what its ids are made of, a fraction of their size: repository, commit, seq, path, sort (the symbol's kind), name, digest."""
    name = F.coalesce("qualified_name", "name") if "name" in seen.columns else F.col("qualified_name")
    return seen.select("repository", "commit", "seq", "path", F.col("kind").alias("sort"), name.alias("name"), F.coalesce(quoted(F.col("structural_hash")), F.lit("null")).alias("digest"))


def _logical() -> Column:
    return digest_of(F.col("repository").cast("string"), quoted(F.col("sort")), quoted(F.col("name")))


def _revision(digest: Column) -> Column:
    return F.when(digest.isNotNull(), digest_of(quoted(F.col("logical_id")), digest))


def changes(seen: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """Transitions: id (the row's seq), repository, commit, logical_id, from_revision, to_revision, kind.

    seen: identified observations. deletions: repository, commit, path, seq. A deleted path ends every symbol that was ever located there,
    each at the revision seen there last.

    That makes as many rows as deletions times symbols of their paths, so these rows are made last, and neither shuffled nor sorted: an
    observation stands at its path until its symbol is seen there again, and meets the deletions between, which are numbered along the path.
    """
    own = _identity(seen)
    entity, place = ["repository", "sort", "name"], ["repository", "path"]
    own = own.withColumn("end", F.lit(None).cast("long")) if deletions is None else own
    if deletions is not None:
        dead = deletions.select("repository", "commit", "seq", "path").where("repository is not null and path is not null")
        along = W.partitionBy(*place).orderBy("seq")
        marks = own.withColumn("gone", F.lit(False)).unionByName(dead.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        marks = marks.withColumn("before", F.sum(F.col("gone").cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
        next_ = F.last(F.when(F.col("gone"), F.col("seq")), ignorenulls=True).over(W.partitionBy(*place).orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0))
        upto = F.lead("before").over(W.partitionBy(*place, "sort", "name").orderBy("seq"))
        here = marks.withColumn("next", next_).where("not gone").withColumn("upto", upto)
        own = here.select(*own.columns, F.when(F.col("upto").isNull() | (F.col("upto") > F.col("before")), F.col("next")).alias("end"))
    t = transitions(own.repartition(*entity), entity, ["seq"], "digest", "path")
    # the prior revision counts as deleted from the first end of any of its observations on
    w, alike = W.partitionBy(*entity).orderBy("seq"), W.partitionBy(*entity, "digest").orderBy("seq")
    t = t.withColumn("first", F.row_number().over(alike) == 1).withColumn("least", F.min("end").over(alike.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("inserted", F.last(F.when(F.col("first"), F.col("digest")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ended = F.last(F.when(F.col("digest") == F.col("inserted"), F.struct("least")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))["least"]
    t = t.withColumn("ended", F.coalesce(ended < F.col("seq"), F.lit(False))).withColumn("logical_id", _logical())
    kind = F.when(F.col("prior").isNotNull() & F.col("ended"), "resurrected").otherwise(F.col("kind"))
    out = t.select(F.col("seq").alias("id"), "repository", "commit", "logical_id", _revision(F.col("prior")).alias("from_revision"), _revision(F.col("digest")).alias("to_revision"), kind.alias("kind"))
    if deletions is None:
        return out
    numbered = dead.withColumn("n", F.row_number().over(along))
    blocks = numbered.groupBy(*place, F.expr(f"(n - 1) div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "seq", "commit"))).alias("gone"))
    start = F.greatest(F.col("before") - F.col("block") * BLOCK, F.lit(0))
    stop = F.least(F.coalesce(F.col("upto") - F.col("block") * BLOCK, F.lit(BLOCK)), F.size("gone").cast("long"))
    stands = here.where("upto is null or upto > before").withColumn("logical_id", _logical()).select(*place, "before", "upto", "logical_id", _revision(F.col("digest")).alias("from_revision"))
    met = stands.join(blocks, place).where(F.expr(f"block >= before div {BLOCK} and (upto is null or block <= (upto - 1) div {BLOCK})")).where(stop > start)
    met = met.select("repository", "logical_id", "from_revision", F.explode(F.slice("gone", (start + 1).cast("int"), (stop - start).cast("int"))).alias("d"))
    return out.unionByName(met.select(F.col("d.seq").alias("id"), "repository", "d.commit", "logical_id", "from_revision", F.lit(None).cast("string").alias("to_revision"), F.lit("deleted").alias("kind")))


def latest_analyses(runs: DataFrame, keys: tuple[str, ...] = ("repository", "blob")) -> DataFrame:
    """Of the completed runs of a blob the one with the greatest id, with its files: runs have id, status and keys."""
    return latest(runs.where("status = 'complete'"), list(keys), [F.desc("id")])


def analysis_gaps(path_changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct repository, commit, path, blob of changes whose blob no run has analysed. path_changes: repository, commit, new_path, new_blob."""
    c = path_changes.where(F.col("new_blob").isNotNull() & (F.col("new_blob") != ZERO_BLOB)).select("repository", "commit", F.col("new_path").alias("path"), F.col("new_blob").alias("blob")).distinct()
    return c.join(runs.select("repository", "blob"), ["repository", "blob"], "left_anti").select("repository", "commit", "path", "blob")


def revision_summaries(found: DataFrame, symbols: DataFrame, places: DataFrame, commits: DataFrame, commit: str | None = None) -> DataFrame:
    """One row per revision: its symbol, its newest place (at the commit given, if any), and the commit of that place or else its last one."""
    at = places.select("revision_id", F.col("commit").alias("location_commit"), "path")
    at = at.where(F.col("location_commit") == commit) if commit else at
    d = found.join(symbols.select("logical_id", "qualified_name", "kind", "language"), "logical_id").join(at, "revision_id", "left")
    d = d.withColumn("commit", F.coalesce("location_commit", "last_commit")).join(commits.select("commit", "committed_at", "message"), "commit", "left")
    d = latest(d, ["revision_id"], [F.col("location_commit").isNull(), F.desc_nulls_last("committed_at"), F.asc_nulls_last("path"), F.asc("commit")])
    return d.select("revision_id", "logical_id", "qualified_name", "kind", "language", "path", F.when(F.col("committed_at").isNotNull() | F.col("message").isNotNull(), F.col("commit")).alias("commit"), "committed_at", "message", "first_commit", "last_commit")


def matching_symbols(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols whose qualified name is the query or begins with it, by name."""
    name, q = F.col("qualified_name"), (query or "").lower()
    return symbols.where((name == query) | F.lower(name).startswith(q)).orderBy("qualified_name", "logical_id").limit(limit)


def starts(found: DataFrame, symbols: DataFrame, places: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """node (revision), rank: where a trace may begin. The id, the name, a name that begins so, then names and paths that hold the query.

    Case does not count in the last three. A blank query finds nothing.
    """
    q = (query or "").strip()
    low, name = q.lower(), F.lower("qualified_name")
    on_path = places.where(F.lower("path").contains(low)).select("revision_id").distinct().withColumn("__path", F.lit(True))
    d = found.join(symbols.select("logical_id", "qualified_name"), "logical_id").join(on_path, "revision_id", "left")
    order = F.when(F.col("revision_id") == q, 0).when(F.col("qualified_name") == q, 1).when(name.startswith(low), 2).otherwise(3)
    d = d.where(F.lit(bool(q)) & ((F.col("revision_id") == q) | (F.col("qualified_name") == q) | name.contains(low) | F.col("__path"))).withColumn("__o", order)
    keys = [F.asc("__o"), F.desc_nulls_last("last_commit"), F.asc("revision_id")]
    d = d.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*keys)).cast("long"))
    return d.select(F.col("revision_id").alias("node"), "rank")


def few(rows: DataFrame, bound: int = 100_000) -> DataFrame:
    """rows, counted, and marked to be broadcast if they are at most bound."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= bound else rows


def references_of(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """The references that start at nodes (column node: revisions)."""
    return references.join(nodes.select(F.col("node").alias("revision")), "revision", "left_semi")


def resolved(references: DataFrame, found: DataFrame, symbols: DataFrame, places: DataFrame) -> DataFrame:
    """references with target (a revision or null) and doubt (none, dynamic, unresolved, inferred).

    A target is the revision of that id, or one of the symbol of that name: seen at the reference's commit, the
    smallest id first; else by the latest last commit. A dynamic reference has none.

    Of the revisions of a name one is chosen for each commit and one for all others, before references meet them, so no reference
    is paired with every revision of its name.
    """
    r = references.withColumn("__t", F.when(F.coalesce(F.col("resolution"), F.lit("")) != "dynamic", F.coalesce("target_qualified_name", "target_text")))
    wanted = few(r.where("__t is not null and __t <> ''").select("__t", "commit").distinct())
    named = found.select("revision_id", "logical_id", "last_commit").join(symbols.select("logical_id", "qualified_name"), "logical_id")
    keys = named.select(F.col("revision_id").alias("__t"), F.lit(0).alias("__by"), "revision_id", "last_commit").unionByName(named.select(F.col("qualified_name").alias("__t"), F.lit(1).alias("__by"), "revision_id", "last_commit"))
    keys = keys.join(few(wanted.select("__t").distinct()), "__t", "left_semi")
    at = places.join(few(wanted.select("commit").distinct()), "commit", "left_semi").select("revision_id", "commit")
    here = at.join(keys, "revision_id").groupBy("__t", "commit").agg(F.min(F.struct("__by", "revision_id")).alias("__here"))
    newest = latest(keys, ["__t"], [F.asc("__by"), F.desc_nulls_last("last_commit"), F.asc("revision_id")]).select("__t", F.col("revision_id").alias("__newest"))
    d = r.join(here, ["__t", "commit"], "left").join(newest, "__t", "left").withColumn("target", F.coalesce("__here.revision_id", "__newest"))
    doubt = F.when(F.col("resolution") == "dynamic", "dynamic").when(F.col("target").isNull(), "unresolved").when(~F.coalesce(F.col("resolution"), F.lit("")).isin("resolved", "exact"), "inferred").otherwise("none")
    return d.select(*references.columns, "target", doubt.alias("doubt"))


def symbol_transitions(moved: DataFrame, commits: DataFrame, symbols: DataFrame, limit: int = 100) -> DataFrame:
    """logical_id, place, id, commit, kind, from_revision, to_revision, committed_at, message: the first transitions of each symbol given.

    moved: changes; a transition belongs to a symbol if either of its revisions does, which changes() tells by logical_id.
    """
    d = moved.join(symbols.select("logical_id"), "logical_id", "left_semi").join(commits.select("repository", "commit", "committed_at", "message"), ["repository", "commit"], "left")
    place = F.row_number().over(W.partitionBy("logical_id").orderBy(F.asc_nulls_first("committed_at"), "id"))
    d = d.withColumn("place", place.cast("long")).where(F.col("place") <= limit)
    return d.select("logical_id", "place", "id", "commit", "kind", "from_revision", "to_revision", "committed_at", "message")


def first_transitions(seen: DataFrame, deletions: DataFrame, commits: DataFrame, limit: int = 20) -> DataFrame:
    """logical_id, place, id: the first transitions of each symbol as symbol_transitions orders those of changes(seen, deletions).

    Every observation is one, and every deletion of a path after the symbol was first seen there. Of the deletions of a path a symbol takes
    the first `limit`, so the others are not made.
    """
    place, entity = ["repository", "path"], ["repository", "sort", "name"]
    when = commits.select("repository", "commit", "committed_at")
    own = _identity(seen)
    dead = deletions.select(*place, "commit", "seq").join(when, ["repository", "commit"], "left")
    gone = dead.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("committed_at", "seq"))).alias("gone"))
    # nulls come last in array_sort, but first among transitions
    gone = gone.withColumn("gone", F.concat(F.filter("gone", lambda d: d["committed_at"].isNull()), F.filter("gone", lambda d: d["committed_at"].isNotNull())))
    since = own.where("path is not null").groupBy(*entity, "path").agg(F.min("seq").alias("since")).join(gone, place)
    met = since.select(*entity, F.explode(F.slice(F.filter("gone", lambda d: d["seq"] > F.col("since")), 1, limit)).alias("d"))
    rows = own.join(when, ["repository", "commit"], "left").select(*entity, "committed_at", F.col("seq").alias("id"))
    rows = rows.unionByName(met.select(*entity, "d.committed_at", F.col("d.seq").alias("id")))
    n = F.row_number().over(W.partitionBy(*entity).orderBy(F.asc_nulls_first("committed_at"), "id"))
    return rows.withColumn("n", n).where(F.col("n") <= limit).select(_logical().alias("logical_id"), F.col("n").cast("long").alias("place"), "id")


def lineage_of_revisions(hits: DataFrame, found: DataFrame, first: DataFrame, limit: int = 20) -> DataFrame:
    """hits (revision_id) with transitions and related: the first transitions (first_transitions) and revisions of its symbol, as ids joined by commas."""
    h = hits.select("revision_id").join(found.select("revision_id", "logical_id"), "revision_id")
    wanted = h.select("logical_id").distinct()
    t = first.join(wanted, "logical_id", "left_semi").groupBy("logical_id").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x"))
    own = found.join(wanted, "logical_id", "left_semi").withColumn("place", F.row_number().over(W.partitionBy("logical_id").orderBy("first_commit", "revision_id"))).where(F.col("place") <= limit)
    r = own.groupBy("logical_id").agg(F.array_sort(F.collect_list(F.struct("place", "revision_id"))).alias("y"))
    d = h.join(t, "logical_id", "left").join(r, "logical_id", "left")
    return d.select("revision_id", "logical_id", F.array_join(F.transform("x", lambda p: p["id"].cast("string")), ",").alias("transitions"), F.array_join(F.transform("y", lambda p: p["revision_id"]), ",").alias("related"))


def changed_names(seen: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """commit, id, names: the sorted names of the symbols that each row of changes(seen, deletions) is about, one row per observation or deletion.

    A deletion changes every symbol that was seen at its path before it. The symbols of a path are one array, which its deletions
    filter, so a row per deletion is made, not one per symbol.
    """
    own = _identity(seen)
    out = own.where("name is not null").select("commit", F.col("seq").alias("id"), F.array("name").alias("names"))
    if deletions is None:
        return out
    place = ["repository", "path"]
    since = own.where("name is not null and path is not null").groupBy(*place, "sort", "name").agg(F.min("seq").alias("since"))
    known = since.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("name", "since"))).alias("known"))
    dead = deletions.select(*place, "commit", F.col("seq").alias("id")).join(known, place)
    names = F.transform(F.filter("known", lambda x: x["since"] < F.col("id")), lambda x: x["name"])
    return out.unionByName(dead.select("commit", "id", names.alias("names")).where(F.size("names") > 0))


def commit_documents(commits: DataFrame, path_changes: DataFrame, names: DataFrame) -> DataFrame:
    """commit, content: the message, each path change (in order of id), and the names of the symbols that changed (changed_names, in order of id)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    paths = path_changes.select("commit", "id", F.concat_ws(" ", text("change_kind"), text("old_path"), text("new_path")).alias("part"), F.lit(0).alias("k"))
    named = names.select("commit", "id", F.array_join("names", " ").alias("part"), F.lit(1).alias("k"))
    parts = paths.unionByName(named).groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("k", "id", "part"))).alias("x"))
    words = F.concat(F.array(text("message")), F.coalesce(F.transform("x", lambda p: p["part"]), F.array().cast("array<string>")))
    return commits.join(parts, "commit", "left").select("commit", F.array_join(words, " ").alias("content"))


def traced(starts: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], depth: int = 8, most: int = 50, sinks: Column | None = None) -> DataFrame:
    """The first paths of a walk in breadth: place, path (nodes), depth, terminal, truncated. At most `most` of them.

    starts: node, rank. edges: seq (order of a node's edges, unique), src, dst, doubt. Paths come in the order in which a queue
    would give them: by steps walked, then by start and edges. Each step joins the frontier with the edges; the walk ends with
    the step that fills the limit, so no step is made for paths that are not asked for. truncated: something was left to walk.
    edges may be a function of the frontier's nodes (column node), which makes the edges of each step when it is walked.
    """
    front = starts.select("node", F.array("node").alias("path"), F.array("rank").alias("key"))
    at = (lambda nodes: cut(edges(nodes))) if callable(edges) else (lambda nodes: edges)
    ends = F.when(sinks, "sink") if sinks is not None else F.lit(None).cast("string")
    done, n, left = None, 0, False
    for d in range(depth + 1):
        front = cut(front)
        if front.isEmpty():
            break
        here, stands = front, F.lit("max-depth")
        if d < depth:
            e = at(few(front.select("node").where("node is not null").distinct()))
            step = e.select("src", "dst", "seq", F.when(F.col("doubt") != "none", F.col("doubt")).alias("doubt"))
            here = front.join(e.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True)), "node", "left")
            stands = F.when(F.col("out").isNull(), "leaf")
        part = here.withColumn("terminal", stands).where("terminal is not null").select("path", "key", F.lit(d).cast("long").alias("depth"), "terminal")
        if d < depth:
            walked = here.where("out").join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "path", F.concat("key", F.array("seq")).alias("key"), "doubt")
            back = F.when(F.array_contains("path", F.col("node")), "cycle")
            walked = cut(walked.select("node", F.concat("path", F.array("node")).alias("path"), "key", F.coalesce(ends, F.col("doubt"), back).alias("terminal")))
            part = part.unionByName(walked.where("terminal is not null").select("path", "key", F.lit(d).cast("long").alias("depth"), "terminal"))
            next_front = walked.where("terminal is null").drop("terminal")
        part = cut(part.orderBy("key").limit(most - n))
        done = part if done is None else done.unionByName(part)
        n += part.count()
        if n >= most:
            last = part.agg(F.max("key").alias("k")).first()["k"]
            stop = F.lit([int(x) for x in last])
            later = front.where(F.col("key") > F.slice(stop, 1, d + 1))
            pushed = d < depth and not next_front.where(F.col("key") < stop).isEmpty()
            left = pushed or not later.isEmpty()
            break
        if d < depth:
            front = next_front
    if done is None:
        done = front.select("path", "key", F.lit(0).cast("long").alias("depth"), F.lit("").alias("terminal"))
    place = F.row_number().over(W.orderBy("depth", "key")).cast("long")
    return done.select(place.alias("place"), "path", "depth", "terminal", F.lit(left).alias("truncated"))


def persisted_matches(matched: DataFrame, stored: DataFrame) -> DataFrame:
    """What fuzzy matches add to the stored transitions: repository, commit, from_revision, to_revision, kind, confidence.

    matched: those columns. Matches of a revision with itself and what is stored (null being equal to null) are left out; of equal ones one stays.
    """
    keys = ["repository", "commit", "kind", "from_revision", "to_revision"]
    m = matched.where(~F.col("from_revision").eqNullSafe(F.col("to_revision"))).groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    known = stored.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        c = m[k].eqNullSafe(known[f"__{k}"])
        same = c if same is None else same & c
    return m.join(known, same, "left_anti").select("repository", "commit", "from_revision", "to_revision", "kind", "confidence")
