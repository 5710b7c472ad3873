"""Near-duplicate documents by BagMinHash over the multiset of word shingles.

Weights. A shingle (five words of the lower-cased text, split at white space; the whole text if it has
fewer) that occurs w times has weight w. Two documents are linked if the weighted Jaccard
similarity, sum of minima over sum of maxima, is 0.8 or more; a class is a connected component of
links, named by its smallest id.

Signature. The weight axis is cut into [0,1), [1,2), [2,4), [4,8) ... Each (shingle, section) owns a
Poisson process of points (time, weight, register) whose rate is the section's length; it is a function
of the shingle's hash alone. A document sees the points below its weight: all of the lower sections,
and in the top one those that a uniform coordinate puts below w. Register r keeps the earliest point
that falls to it. The earliest point of a union of processes belongs to the intersection with
probability weighted Jaccard, so equal registers estimate it without bias. Points come in order of
time, and a process stops when its next point is later than every register of the document.

Search. Texts that are equal after normalisation are one representative. Signatures are cut into
bands of ROWS registers; representatives that share a band are candidates. The degree of a
representative is the number of times it meets others in bands, which is highest for the text that a
family of edited copies goes back to. Then

 1. within each band value, every member is compared with the member of the highest degree;
 2. verified links are closed to components;
 3. band values that still hold several components are finished exactly: members are dealt into chunks,
    and every pair of chunks is compared in a task of its own, which skips pairs that are already
    connected, pairs met in an earlier band and pairs whose signatures rule out the similarity, and
    returns links that connect components, not pairs.

So a large group costs one comparison per member and band before step 3, and step 3 never holds more
than two chunks in a task nor returns more rows than it has members.

Every comparison that makes a link computes the multiset overlap of the shingles themselves. A link can be missed
in two ways: pairs of similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS < 4e-6, and signatures of
such a pair agree in less than DOUBT of their registers with probability < 1e-9. A lead's pairs are salted by the
size of their band value, so no lead is one join key.

Defined results: null text = empty; texts without words are one class (all equal); repeated rows
and ids: each row gets the class of its text, and rows that share an id get one class each by their text;
null ids are never a class's name unless all ids of the class are null; an empty table gives no rows;
extra columns are ignored by `classes` and kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship, stable, unused, whole

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 24, 4, 0.8
REGISTERS = BANDS * ROWS
CHUNK, SLICE = 512, 96
BROADCAST_ROWS = 1_000_000  # ids, 8 to 16 bytes each
DOUBT = 0.5  # a pair whose signatures agree less is below 0.8 but for a chance under 1e-9
SALT = 4096  # pairs with one lead that a task compares
STEP = np.uint64(0x9E3779B97F4A7C15)


def _nth(k: int) -> np.uint64:
    return np.uint64(k * int(STEP) & 0xFFFFFFFFFFFFFFFF)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, sorted, and how often each occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids: dict[str, int] = {}
    for w in words:
        if w not in ids:
            ids[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out + STEP) + h[k : len(h) - n + k + 1]
    return np.unique(mix64(out), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures of non-empty bags, a row each; the processes of all bags advance together."""
    m = REGISTERS
    doc, seed, rate, top = [], [], [], []
    for d, (h, w) in enumerate(bags):
        section = 0
        left = np.ones(len(h), bool)
        while left.any():
            low = 0 if section == 0 else 1 << (section - 1)
            length = 1 if section == 0 else low
            left = w > low
            if not left.any():
                break
            k = int(left.sum())
            doc.append(np.full(k, d, np.int64))
            seed.append(mix64(h[left] + _nth(section + 1)))
            rate.append(np.full(k, float(length)))
            top.append(np.minimum(1.0, (w[left] - low) / length))
            section += 1
    doc, seed, rate, top = map(np.concatenate, (doc, seed, rate, top))
    time = np.full(len(bags) * m, np.inf)
    name = np.zeros(len(bags) * m, np.uint64)
    t = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        z = mix64(seed + _nth(step))
        t = t - np.log(((z >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        z2 = mix64(z)
        seen = (z2 >> np.uint64(40)).astype(np.float64) * 2.0**-24 < top
        at = doc * m + (z2 % np.uint64(m)).astype(np.int64)
        ok = np.flatnonzero(seen & (t < time[at]))
        # of several new points for one register the earliest counts
        order = ok[np.lexsort((t[ok], at[ok]))]
        first = np.ones(len(order), bool)
        first[1:] = at[order][1:] != at[order][:-1]
        order = order[first]
        time[at[order]], name[at[order]] = t[order], z2[order]
        latest = time.reshape(-1, m).max(axis=1)
        alive = t < latest[doc]
        doc, seed, rate, top, t = doc[alive], seed[alive], rate[alive], top[alive], t[alive]
    return (mix64(name) >> np.uint64(32)).astype(np.uint32).reshape(-1, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    x = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]) * STEP
    for k in range(ROWS):
        h = mix64(h ^ x[:, :, k]) + STEP
    return h.view(np.int64)


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def _name(text: str) -> bytes:
    return xxhash.xxh3_128_digest(_normal(text).encode())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rep and sig (empty for a text without words) to rows of id, k1, k2, text; equal texts of a slice are signed once."""
    for whole_batch in batches:
        for at in range(0, len(whole_batch), SLICE):  # bags that are held and advance together; bounds memory
            b = whole_batch.slice(at, SLICE)
            texts = b["text"].to_pylist()
            names = [_name(t) for t in texts]
            own = {n: k for k, n in enumerate(names)}
            bags = {n: shingles(texts[k]) for n, k in own.items()}
            full = [n for n, bag in bags.items() if len(bag[0])]
            made = dict(zip(full, (s.tobytes() for s in signatures([bags[n] for n in full])), strict=True)) if full else {}
            yield pa.RecordBatch.from_arrays([b["id"], b["k1"], b["k2"], pa.array(names, pa.binary()), pa.array([made.get(n, b"") for n in names], pa.binary())], names=["id", "k1", "k2", "rep", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = _matrix(b["sig"].to_pylist())
        yield pa.RecordBatch.from_arrays([b["rep"], pa.array(list(bands(sig)), pa.list_(pa.int64()))], names=["rep", "keys"])


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, REGISTERS)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_normal(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_name(t) for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["rep", "text"])


def _verify(batches):
    """pairs with both texts -> the pairs that are linked."""
    for whole_batch in batches:
        for at in range(0, len(whole_batch), 4 * SLICE):
            b = whole_batch.slice(at, 4 * SLICE)
            held: dict[str, tuple] = {}

            def bag(t: str, held=held) -> tuple:
                if t not in held:
                    held[t] = shingles(t)
                return held[t]

            keep = [overlap(bag(x), bag(y)) >= SIMILARITY for x, y in zip(b["text_a"].to_pylist(), b["text_b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs of a lead and a member whose texts overlap enough. pairs: lead, rep, n (the size of a band value that they share)."""
    parts = lambda n: F.ceil(n / SALT).cast("int")
    x = pairs.join(texts.select("rep", F.col("text").alias("text_b")), "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), parts(F.col("n"))).cast("int"))
    leads = pairs.groupBy("lead").agg(F.max("n").alias("n")).select("lead", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("salt"))
    leads = leads.join(texts.select(F.col("rep").alias("lead"), F.col("text").alias("text_a")), "lead")
    x = x.join(leads, ["lead", "salt"])
    return x.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"), "text_a", "text_b").mapInArrow(_verify, "a binary, b binary")


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """rep, comp (the smallest rep of its component) for all of names, by label passing with pointer jumps."""
    both = stable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    comp = stable(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(comp.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        moved = comp.join(near, "rep").select("rep", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = comp.select(F.col("rep").alias("comp"), F.col("comp").alias("far"))
        nxt = stable(moved.join(jump, "comp", "left").select("rep", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        comp = nxt.select("rep", "comp")
        if nxt.where("comp < old").isEmpty():
            break
    return names.join(comp, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def _elements(text: str) -> frozenset:
    """The multiset of shingles as a set: the k-th occurrence of a shingle is an element of its own."""
    h, w = shingles(text)
    out = h.tolist()
    for k in np.flatnonzero(w > 1):
        out += [(int(h[k]), i) for i in range(1, int(w[k]))]
    return frozenset(out)


def _chunk_links(group: pa.Table) -> pa.Table:
    """Links that connect components of two chunks of a band value, or of one (side 1 only)."""
    side, key = np.array(group["side"].to_pylist()), group["key"][0].as_py()
    rep, comp, text = (group[c].to_pylist() for c in ("rep", "comp", "text"))
    number = {c: k for k, c in enumerate(dict.fromkeys(comp))}
    comp_no = np.array([number[c] for c in comp])
    sig = _matrix(group["sig"].to_pylist())
    keys = bands(sig)
    within = not (side == 0).any()
    a, b = (np.flatnonzero(side == 1),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    held: dict[int, frozenset] = {}

    def bag(k: int) -> frozenset:
        if k not in held:
            held[k] = _elements(text[k])
        return held[k]

    out = []
    for i in a:
        other = b[(comp_no[b] != comp_no[i]) & ((b > i) if within else True)]
        if not len(other):
            continue
        first = (keys[other] == keys[i]).argmax(axis=1)
        alike = (sig[other] == sig[i]).mean(axis=1)
        fit = (keys[i][first] == key) & (alike >= DOUBT)
        for j in other[fit][np.argsort(-alike[fit], kind="stable")]:
            if comp_no[i] == comp_no[j]:
                continue
            x, y = bag(i), bag(j)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                continue
            both = len(x & y)
            if both >= SIMILARITY * (len(x) + len(y) - both):
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                comp_no[comp_no == comp_no[j]] = comp_no[i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def signed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1, k2 (two hashes of id and text), rep (a 128-bit hash of the normalised text), sig: one row per row of docs, stored."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(1)).alias("k2"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return stable(rows.mapInArrow(_sign, f"id {kind}, k1 long, k2 long, rep binary, sig binary"))


def components_of(docs: DataFrame, id_col: str, text_col: str, signed: DataFrame) -> DataFrame:
    """rep, comp for the representatives that share a band with another; all others are alone."""
    reps = signed.where("octet_length(sig) > 0").groupBy("rep").agg(F.first("sig").alias("sig"))
    rows = reps.mapInArrow(_keys, "rep binary, keys array<long>").select("rep", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stable(rows.join(shared, "key").select("key", "rep", "n"))
    degree = members.groupBy("rep").agg(F.sum("n").alias("deg"))
    members = stable(members.join(degree, "rep"))
    needed = stable(degree.select("rep"))
    # the texts that are compared: found by the hash of id and text of one row of each representative
    wanted = signed.groupBy("rep").agg(F.min("k1").alias("k1")).join(needed, "rep", "left_semi").select("k1")
    wanted = F.broadcast(wanted) if needed.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64(F.col(id_col), whole(F.col(text_col))).alias("k1"), whole(F.col(text_col)).alias("text")).join(wanted, "k1", "left_semi")
    texts = stable(texts.select("text").mapInArrow(_named, "rep binary, text string").groupBy("rep").agg(F.first("text").alias("text")))

    high = F.struct("deg", F.xxhash64("rep").alias("h"))
    leads = members.groupBy("key").agg(F.max_by("rep", high).alias("lead"))
    pairs = members.join(leads, "key").where("rep <> lead").groupBy("lead", "rep").agg(F.max("n").alias("n"))
    links = stable(_linked(pairs, texts))
    comp = components(links, needed)

    placed = stable(members.where("n > 2").select("key", "rep", "n").join(comp, "rep"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    left = placed.join(open_keys, "key", "left_semi").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(texts.join(reps, "rep"), "rep")
    places = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"), F.when(F.col("chunk") < o, 0).otherwise(1).alias("side")))
    dealt = left.select("key", "rep", "comp", "sig", "text", F.explode(places).alias("p")).select("key", "p.i", "p.j", "p.side", "rep", "comp", "sig", "text")
    extra = stable(dealt.groupBy("key", "i", "j").applyInArrow(_chunk_links, "a binary, b binary"))
    return comp if extra.isEmpty() else components(links.unionByName(extra), needed)


def _placed(signed: DataFrame, comp: DataFrame) -> DataFrame:
    """rep, first (its smallest row: id, k1, k2) and comp of every representative."""
    low = F.min_by(F.struct("id", "k1", "k2"), F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("first")
    return signed.groupBy("rep").agg(low).join(comp, "rep", "left").select("rep", "first", F.coalesce("comp", "rep").alias("comp"))


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, class_id (the smallest id of the class), n_texts (distinct texts in the class) for every row."""
    signed = signed_rows(docs, id_col, text_col)
    placed = stable(_placed(signed, components_of(docs, id_col, text_col, signed)))
    names = placed.groupBy("comp").agg(F.min("first.id").alias("class_id"), F.count("*").alias("n_texts"))
    by_rep = placed.join(names, "comp").select("rep", "class_id", "n_texts")
    return signed.select("id", "rep").join(by_rep, "rep").select(F.col("id").alias(id_col), "class_id", "n_texts")


def keep_first(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, with one row of each class: the one with the smallest id (of rows with equal id and text, one)."""
    signed = signed_rows(docs, id_col, text_col)
    placed = _placed(signed, components_of(docs, id_col, text_col, signed))
    best = stable(placed.groupBy("comp").agg(F.min_by("first", F.struct(F.col("first.id").isNull(), "first")).alias("f")).select("f.k1", "f.k2"))
    gone = stable(signed.select("k1", "k2").join(best, ["k1", "k2"], "left_anti").distinct())
    few = gone.count() <= BROADCAST_ROWS
    keys = unused(docs, 2)
    d = docs.withColumns(dict(zip(keys, (F.xxhash64(F.col(id_col), whole(F.col(text_col))), F.xxhash64(whole(F.col(text_col)), F.col(id_col), F.lit(1))), strict=True)))
    out = gone.toDF(*keys)
    d = d.join(F.broadcast(out) if few else out, keys, "left_anti")
    if not signed.join(best, ["k1", "k2"], "left_semi").groupBy("k1", "k2").count().where("count > 1").isEmpty():
        d = d.dropDuplicates(keys)
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
