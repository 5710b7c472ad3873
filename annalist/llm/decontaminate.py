"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become token sequences in which numbers, names and units are typed placeholders (#num, #name,
#num#unit for a number with its unit); a run of numbers or of capitalised words within a sentence is
one placeholder. Every window of eight template tokens (four for items shorter than that) is hashed,
and documents meet benchmark items in a hash join on windows. So a question with other numbers or
names still matches. Matches of a document and an item are lined up by their offset. A value of
another length moves the offset, so offsets less than half an item apart are one line-up, in which
each item window counts once, at the offset nearest to the commonest. In a line-up the slot values
must agree: one value of the item always stands for one value of the document. It counts if its
consistent part covers enough of the item's windows. A single offset is a line-up, too. Items of one
to three tokens have too few windows for that: they match verbatim, value for value, as a run of
tokens anywhere in a text.

Only windows of the benchmark are ever gathered by item; documents send window hashes that the join
drops unless the benchmark has them. The benchmark is broadcast if its number of windows is below a
fixed bound, and shuffled otherwise.

Defined results: null texts = empty; empty texts and items match nothing; an id may be null or occur
any number of times, since rows are told apart by id and text: each distinct (id, text) is
searched, and `keep_clean` judges every row; items that share an id are all searched, and the best
of them is reported; rows equal in id and text count as one in `match`; an empty table gives no rows;
extra columns are ignored by `match` and kept by `keep_clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stable, unused, whole

WINDOW, SHORT = 8, 4
BROADCAST_WINDOWS = 500_000

# Units of measure.
UNITS = ("km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "yard", "yards", "kg", "g", "mg", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "meter", "meters", "metre", "metres", "kmh", "mph")

# Quantifiers of groups are possessive: they step through runs of any length without recursion.
_NUM, _NAME, _GAP = r"[0-9](?:[0-9.,]*[0-9])?+", r"\p{Lu}\p{Ll}[\p{L}\p{N}]*+", r"[^\p{L}\p{N}.!?]"
TOKEN = "|".join((
    rf"{_NUM}(?:{_GAP}++{_NUM})*+(?:{_GAP}{{0,3}}(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}]))?+",
    rf"[.!?][^\p{{L}}\p{{N}}]*+(?:{_NAME})?+",  # the first word of a sentence is no name
    rf"{_NAME}(?:{_GAP}++{_NAME})*+",
    r"[\p{L}\p{N}]++",
))


def template(x: Column) -> Column:
    """The template token of a raw one; empty for the end of a sentence. Raw tokens are told apart by their first character."""
    number = F.when(F.substring(x, -1, 1).between("0", "9"), "#num").otherwise("#num#unit")
    name = ((x < "[") | (x > "\x7f")) & x.rlike(r"^\p{Lu}\p{Ll}")
    return F.when(x >= "A", F.when(name, "#name").otherwise(F.lower(x))).when((x >= "0") & (x < ":"), number).otherwise(F.lower(F.regexp_extract(x, r"[\p{L}\p{N}]+$", 0)))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(". "), text), F.lit(TOKEN), F.lit(0))


def typed_tokens(text: Column) -> Column:
    """Tokens as array<struct<t,v>>: template token and value (lower case; the whole run of a placeholder)."""
    pair = lambda x: F.struct(template(x).alias("t"), F.lower(x).alias("v"))
    tokens = F.filter(F.transform(raw_tokens(text), pair), lambda p: p["t"] != "")
    return F.transform(tokens, lambda p: F.struct(p["t"].alias("t"), F.when(p["t"].startswith("#"), p["v"]).otherwise(p["t"]).alias("v")))


def _grown(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """df with window hashes made from its array h, doubling the width, each level in a projection of its own; size is a power of two."""
    width = 1
    while width < size:
        n = F.greatest(F.size("h") - width, F.lit(0))
        df = df.select(*keys, F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b)).alias("h"))
        width *= 2
    return df


def _windows(df: DataFrame, keys: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """keys, size, pos, w: the windows of df's array h of token hashes, of both sizes at once."""
    low = _grown(df.select(*keys, "h"), keys, SHORT)
    if WINDOW not in sizes:
        d = low.select(*keys, F.lit(0).alias("n"), "h")
    else:
        n = F.greatest(F.size("h") - SHORT, F.lit(0))
        high = F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(SHORT + 1), n), lambda a, b: F.xxhash64(a, b))
        d = low.select(*keys, n.alias("n"), (F.concat(high, "h") if SHORT in sizes else high).alias("h"))
    # the outer form, since the optimiser would push the inner form's size(h) > 0 below the projections and compute them twice
    d = d.select(*keys, "n", F.posexplode_outer("h").alias("at", "w")).where("w is not null")
    wide = F.col("at") < F.col("n")
    return d.select(*keys, F.when(wide, WINDOW).otherwise(SHORT).alias("size"), F.when(wide, F.col("at")).otherwise(F.col("at") - F.col("n")).alias("pos"), "w")


def _line_ups(lines: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, at (ipos and shift of the matched windows, one per item window): line-ups with enough windows.

    lines: keys, shift, at (ipos of the windows matched at that shift).
    """
    near = F.greatest(F.lit(SHORT), F.col("n") / 2)
    w = W.partitionBy(*keys).orderBy("shift")
    d = lines.withColumn("apart", F.when(F.col("shift") - F.lag("shift").over(w) >= near, 1).otherwise(0)).withColumn("group", F.sum("apart").over(w))
    groups = d.groupBy(*keys, "group").agg(F.max(F.struct(F.size("at").alias("n"), (-F.col("shift")).alias("s"))).alias("most"), F.collect_list(F.struct("shift", "at")).alias("lines")).where(F.size("lines") > 1)
    places = F.flatten(F.transform("lines", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("ipos"), F.abs(x["shift"] + F.col("most.s")).alias("far"), x["shift"].alias("shift")))))
    groups = groups.select(*keys, F.array_sort(places).alias("places"))
    nearest = F.filter("places", lambda x, k: (k == 0) | (x["ipos"] != F.get(F.col("places"), k - 1)["ipos"]))
    many = groups.select(*keys, F.transform(nearest, lambda x: F.struct(x["ipos"], x["shift"])).alias("at"))
    one = lines.select(*keys, F.transform("at", lambda p: F.struct(p.alias("ipos"), F.col("shift").alias("shift"))).alias("at"))
    return one.unionByName(many).where(F.size("at") >= F.col("of") * least)


def _verbatim(rows: DataFrame, items: DataFrame, sizes: list[int], hint) -> DataFrame:
    """id, h, item, slots of texts that hold an item of so few tokens as a run of equal values."""
    values = lambda d: F.transform(d, lambda p: F.xxhash64(p["v"]))
    doc = rows.select("id", "h", values(typed_tokens(F.col("text"))).alias("v"))
    item = items.select("item", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda p: p["t"].startswith("#"))).cast("long").alias("slots"), F.concat_ws(",", values(F.col("tokens")).cast("array<string>")).alias("w")).distinct()

    def held(n: int) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("v") - n + 1, F.lit(1))), lambda k: F.concat_ws(",", F.slice("v", k, n).cast("array<string>")))
        d = doc.select("id", "h", F.explode(F.array_distinct(runs)).alias("w"))
        return d.join(hint(item.where(F.col("n") == n)), "w").select("id", "h", "item", "slots")

    return reduce(DataFrame.unionByName, map(held, sizes))


def _same(a: DataFrame, b: DataFrame, how: str, keys: tuple[str, ...] = ("id", "h")) -> DataFrame:
    """a joined with b on keys, nulls being equal; a's columns, and for an inner join also the rest of b's."""
    right = b.select(*(F.col(k).alias(f"{k}__") if k in keys else F.col(k) for k in b.columns))
    out = a.join(right, reduce(Column.__and__, (a[k].eqNullSafe(right[f"{k}__"]) for k in keys)), how)
    return out.drop(*(f"{k}__" for k in keys))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, least: float) -> DataFrame:
    """id, h (hash of the text), item, windows, coverage, slots, changed: the best line-up of each document and item."""
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    item = items.select(F.col(item_id).alias("item"), whole(F.col(item_text)).alias("text")).select("item", F.xxhash64("text").alias("i"), typed_tokens(F.col("text")).alias("tokens")).dropDuplicates(["item", "i"])
    item = stable(item.withColumn("n", F.size("tokens")).where("n > 0"))
    shape = item.agg(F.sum("n").alias("all"), *(F.count(F.when(F.col("n").between(a, b), 1)).alias(k) for k, a, b in (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("short", SHORT, WINDOW - 1), ("long", WINDOW, 1 << 30)))).first()
    hint = F.broadcast if (shape["all"] or 0) <= BROADCAST_WINDOWS else (lambda x: x)
    sizes = tuple(s for s, k in ((WINDOW, "long"), (SHORT, "short")) if shape[k])
    kind = f"id {rows.schema['id'].dataType.simpleString()}, h long, item {item.schema['item'].dataType.simpleString()}"
    out = docs.sparkSession.createDataFrame([], f"{kind}, windows long, coverage double, slots long, changed long")
    if tiny := [n for n in (1, 2, 3) if shape[str(n)]]:
        v = _verbatim(rows, item.where(F.col("n") < SHORT), tiny, hint)
        out = out.unionByName(v.select("id", "h", "item", F.lit(1).cast("long").alias("windows"), F.lit(1.0).alias("coverage"), "slots", F.lit(0).cast("long").alias("changed")))
    if sizes:
        out = out.unionByName(_lined_up(rows, item.where(F.col("n") >= SHORT), sizes, hint, least))
    best = out.groupBy("id", "h", "item").agg(F.max(F.struct("coverage", "windows", "slots", (-F.col("changed")).alias("c"))).alias("best"))
    return best.select("id", "h", "item", "best.windows", "best.coverage", "best.slots", (-F.col("best.c")).alias("changed"))


def _lined_up(rows: DataFrame, item: DataFrame, sizes: tuple[int, ...], hint, least: float) -> DataFrame:
    keys = ["id", "h", "item", "i", "size", "of", "n"]
    own = item.withColumn("size", F.when(F.col("n") >= WINDOW, WINDOW).otherwise(SHORT)).withColumn("of", F.col("n") - F.col("size") + 1)
    hashed = lambda c: F.transform(c, lambda p: F.xxhash64(p["t"]))
    bench = _windows(own.select("item", "i", F.col("size").alias("own"), "of", F.col("n").alias("m"), hashed(F.col("tokens")).alias("h")), ["item", "i", "own", "of", "m"], sizes)
    bench = bench.where("size = own").select("item", "i", "of", F.col("m").alias("n"), F.col("pos").alias("ipos"), F.col("size").alias("own"), "w")
    words = F.transform(F.filter(F.transform(raw_tokens(F.col("text")), template), lambda t: t != ""), lambda t: F.xxhash64(t))
    here = _windows(rows.select("id", F.col("h").alias("k"), words.alias("h")), ["id", "k"], sizes).withColumnRenamed("k", "h")
    met = here.join(hint(bench), "w").where("size = own")
    lines = met.groupBy(*keys, (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    enough = F.sum(F.size("at")).over(W.partitionBy(*keys)) >= F.col("of") * least
    lines = stable(lines.withColumn("enough", enough).where("enough").drop("enough"))
    # the documents that hold an item are read again for their slot values; all others are kept from a shuffle
    # by a broadcast of the hits' keys while those are fewer than a fixed bound, and by a semi join beyond it
    ids = lines.select("id", "h").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_WINDOWS else ids
    again = _same(rows, ids, "left_semi").dropDuplicates(["id", "h"]).select("id", "h", typed_tokens(F.col("text")).alias("dtoks"))
    runs = _same(_line_ups(lines, keys, least), hint(item.select("item", "i", F.col("tokens").alias("itoks"))), "inner", ("item", "i"))
    runs = _same(runs, again, "inner")
    slot = lambda k, s: F.struct(k.alias("k"), s.alias("shift"), F.get("itoks", k)["t"].alias("t"), F.get("itoks", k)["v"].alias("a"), F.get("dtoks", k + s)["v"].alias("b"), F.get("dtoks", k + s)["t"].alias("u"))
    places = F.transform("at", lambda m: F.transform(F.sequence(m["ipos"], m["ipos"] + F.col("size") - 1), lambda k: slot(k, m["shift"])))
    placed = F.flatten(F.transform(places, lambda ps: F.filter(ps, lambda p: p["t"].startswith("#") & p["t"].eqNullSafe(p["u"]))))
    runs = runs.withColumn("slots", F.array_distinct(placed))
    # values of the item that stand for several values of the document: neighbours when sorted
    runs = runs.withColumn("values", F.array_sort(F.array_distinct(F.transform("slots", lambda p: F.struct(p["t"], p["a"], p["b"])))))
    before = lambda k: F.get(F.col("values"), k - 1)
    twice = F.filter("values", lambda x, k: before(k)["t"].eqNullSafe(x["t"]) & before(k)["a"].eqNullSafe(x["a"]))
    runs = runs.withColumn("twice", F.transform(twice, lambda x: F.struct(x["t"], x["a"])))
    runs = runs.withColumn("clash", F.filter("slots", lambda p: F.array_contains("twice", F.struct(p["t"].alias("t"), p["a"].alias("a")))))
    # the windows without a contradicting slot are the consistent part
    good = F.filter("at", lambda m: ~F.exists("clash", lambda p: (p["shift"] == m["shift"]) & (p["k"] >= m["ipos"]) & (p["k"] < m["ipos"] + F.col("size"))))
    runs = runs.withColumn("windows", F.size(good).cast("long")).withColumn("coverage", F.col("windows") / F.col("of").cast("double")).where(F.col("coverage") >= least)
    n = lambda ps: F.size(F.array_distinct(F.transform(ps, lambda p: p["k"]))).cast("long")
    return runs.select("id", "h", "item", "windows", "coverage", n(F.col("slots")).alias("slots"), n(F.filter("slots", lambda p: p["a"] != p["b"])).alias("changed"))


def match(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, least: float = 0.5) -> DataFrame:
    """Documents that hold (a re-parameterised copy of) an item.

    Returns id_col, item_id, windows (matched and consistent), coverage (of the item's windows), slots
    (placeholders in matched windows), changed (how many of their values differ): one row per pair of a
    distinct (id, text) and an item id, the best line-up. least: the share of the item's windows that must match.
    """
    hits = _hits(docs, items, id_col, text_col, item_id, item_text, least)
    return hits.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "windows", "coverage", "slots", "changed")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that hold no item. The hits' keys are broadcast below a fixed number, so texts are not shuffled."""
    hits = stable(_hits(docs, items, id_col, text_col, item_id, item_text, least).select("id", "h").distinct())
    a, b = unused(docs, 2)
    gone = hits.select(F.col("id").alias(a), F.col("h").alias(b))
    gone = F.broadcast(gone) if hits.count() <= BROADCAST_WINDOWS else gone
    return docs.join(gone, docs[id_col].eqNullSafe(gone[a]) & (F.xxhash64(whole(docs[text_col])) == gone[b]), "left_anti")
