"""Captured conversations: what is wrong with each, and the messages of those that are sound."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.stable import ship

# Keys that hold credentials, kinds of blocks, bounds.
CREDENTIAL_KEYS = frozenset("authorization cookie cookies accesstoken refreshtoken idtoken sessiontoken localstorage sessionstorage".split())
BLOCKS = frozenset("text code image audio file citation tool-call tool-result provider".split())
MESSAGES, BLOCKS_EACH, PARENTS_EACH, DEPTH, ENTRIES, BYTES = 5000, 128, 16, 8, 10_000, 32 << 20

SCHEMA = "source_key string, observed_at string, conversation struct<id:string,title:string,url:string>, messages array<struct<id:string,role:string,created_at:string,blocks:array<struct<type:string,text:string>>,parents:array<string>>>, active_path array<string>"


def _metadata(value: object) -> set[str]:
    """Faults of free-form metadata, walked without recursion so that depth cannot hurt."""
    faults, todo, entries = set(), [(value, 0)], 0
    while todo:
        x, depth = todo.pop()
        inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        entries += len(inner)
        if depth > DEPTH or entries > ENTRIES:
            return faults | {"metadata-too-deep" if depth > DEPTH else "metadata-too-large"}
        if isinstance(x, dict) and any(re.sub("[^a-z0-9]", "", k.lower()) in CREDENTIAL_KEYS for k in x):
            faults.add("credential-key")
        todo += [(v, depth + 1) for v in inner]
    return faults


def _cyclic(parents: dict[str, list[str]]) -> bool:
    """Take away messages without parents until none is left; if some stay, they are on or below a cycle."""
    waits = {m: len(p) for m, p in parents.items()}
    children: dict[str, list[str]] = {}
    for m, ps in parents.items():
        for p in ps:
            children.setdefault(p, []).append(m)
    free, gone = [m for m, n in waits.items() if n == 0], 0
    while free:
        gone += 1
        for c in children.get(free.pop(), []):
            waits[c] -= 1
            if waits[c] == 0:
                free.append(c)
    return gone < len(parents)


def faults(raw: str | None, hosts: tuple[str, ...]) -> list[str]:
    """The names of everything that is wrong with one observation, sorted; none for a sound one."""
    if len((raw or "").encode()) > BYTES:
        return ["too-large"]
    try:
        o = json.loads(raw or "")
    except (ValueError, RecursionError):
        return ["not-json"]
    if not isinstance(o, dict):
        return ["not-an-object"]
    c, ms, out = o.get("conversation"), o.get("messages"), set()
    c = c if isinstance(c, dict) else {}
    text = lambda x: isinstance(x, str) and x != ""
    if not text(o.get("source_key")):
        out.add("no-source-key")
    if not text(c.get("id")):
        out.add("no-conversation")
    if c.get("url") and not re.match(rf"(?i)https://({'|'.join(map(re.escape, hosts))})(:\d+)?([/?#]|$)", str(c["url"])):
        out.add("url-not-allowed")
    if not isinstance(ms, list) or not ms or not all(isinstance(m, dict) and text(m.get("id")) for m in ms):
        return sorted(out | {"no-messages"})
    if len(ms) > MESSAGES:
        out.add("too-many-messages")
    if max(Counter(m["id"] for m in ms).values()) > 1:
        out.add("duplicate-id")
    parents: dict[str, list[str]] = {}
    for m in ms:
        ps, bs = m.get("parents", []), m.get("blocks")
        if not isinstance(ps, list) or len(ps) > PARENTS_EACH or not all(map(text, ps)):
            out.add("bad-parents")
            ps = []
        if not isinstance(bs, list) or len(bs) > BLOCKS_EACH or not all(isinstance(b, dict) and isinstance(b.get("type", ""), str) and b.get("type", "provider") in BLOCKS for b in bs):
            out.add("bad-blocks")
            bs = []
        out |= _metadata([m.get("author"), m.get("attachments"), m.get("state"), *(v for b in bs if isinstance(b, dict) for v in (b.get("data"), b.get("metadata")))])
        parents[m["id"]] = list(dict.fromkeys(ps))
    if any(p not in parents for ps in parents.values() for p in ps):
        out.add("unknown-parent")
    elif _cyclic(parents):
        out.add("cycle")
    path = o.get("active_path", [m["id"] for m in ms])
    if not isinstance(path, list) or not all(map(text, path)) or len(set(path)) < len(path) or any(i not in parents for i in path):
        out.add("bad-active-path")
    elif any(a not in parents[b] for a, b in zip(path, path[1:])):
        out.add("active-path-not-connected")
    return sorted(out)


def checked(observations: DataFrame, raw: str, hosts: tuple[str, ...]) -> DataFrame:
    """observations with a column faults; one Arrow pass, an observation never leaves its row."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: faults(r, hosts))

    return ship(observations).withColumn("faults", run(F.col(raw)))


def messages(sound: DataFrame, raw: str) -> DataFrame:
    """conversation, message, role, text, parents, active_position of sound observations; a missing active path is the order of the messages."""
    o = sound.select(F.from_json(raw, SCHEMA).alias("o")).select("o.*")
    path = F.coalesce("active_path", F.transform("messages", lambda m: m["id"]))
    m = o.select(F.col("conversation.id").alias("conversation"), path.alias("path"), F.explode("messages").alias("m"))
    shown = F.array_join(F.transform(F.filter("m.blocks", lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != ""), lambda b: b["text"]), "\n\n")
    at = F.array_position("path", F.col("m.id"))
    return m.select("conversation", F.col("m.id").alias("message"), F.coalesce("m.role", F.lit("unknown")).alias("role"), shown.alias("text"), F.coalesce("m.parents", F.array().cast("array<string>")).alias("parents"), F.when(at > 0, at - 1).alias("active_position"))


def unknown_keys(payload: dict, allowed: Sequence[str]) -> list[str]:
    """The keys of a payload that its vocabulary does not hold; a payload with any is to be rejected."""
    return sorted(set(payload) - set(allowed))


# What makes two captures the same, whenever and by whatever they were taken.
CAPTURED = ("$schema", "provider", "source_key", "conversation", "messages", "active_path")


def capture_digest(raw: Column) -> Column:
    """sha256 of what a capture holds, as JSON with sorted keys; the time and the collector do not count. Null for what is no JSON object."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(r: str) -> str | None:
            try:
                o = json.loads(r)
            except ValueError:
                return None
            return hashlib.sha256(json.dumps({k: o[k] for k in CAPTURED if k in o}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() if isinstance(o, dict) else None

        return rows.map(one, na_action="ignore")

    return run(raw)
