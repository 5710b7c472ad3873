"""Histories of git repositories as tables. Repositories lie in a folder that all executors reach; git must be installed there."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.stable import ship

COMMITS = "repository string, seq long, oid string, parents array<string>, author string, author_email string, authored string, committer string, committer_email string, committed string, message string"
CHANGES = "repository string, oid string, parent string, status string, old_mode string, new_mode string, old_blob string, new_blob string, path string, new_path string"
OBJECTS = "repository string, oid string, type string, size long, bytes binary"
BATCH = 1000


def _git(repository: str, *args: str) -> subprocess.Popen:
    return subprocess.Popen(["git", "-C", repository, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE)


def _records(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """NUL-ended records of a stream, without holding more than one and a block."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\0")
        yield from whole
    if rest:
        yield rest


def _text(b: bytes) -> str:
    return b.decode(errors="replace")


def _end(p: subprocess.Popen, what: str) -> None:
    if p.wait():
        raise RuntimeError(f"git failed: {what}")


def _walk(repository: str, refs: list[str]) -> Iterator[dict]:
    if subprocess.run(["git", "-C", repository, "rev-parse", "--is-shallow-repository"], capture_output=True, text=True, check=True).stdout.strip() != "false":
        raise ValueError(f"{repository} is shallow: its history is not whole")
    p = _git(repository, "log", "-z", "--topo-order", "--reverse", "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%cn%x1f%ce%x1f%cI%x1f%B", *refs, "--")
    for seq, r in enumerate(_records(p.stdout)):
        oid, parents, *who, message = map(_text, r.split(b"\x1f", 8))
        yield dict(zip(("author", "author_email", "authored", "committer", "committer_email", "committed"), who, strict=True)) | {"repository": repository, "seq": seq, "oid": oid, "parents": parents.split(), "message": message.strip()}
    _end(p, f"log of {repository}")


def _tables(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _packed(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows with bytes: of BATCH rows or, if they are large, of about most bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += r.get("size") or 0
        if len(held) == BATCH or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def commits(repositories: DataFrame, refs: tuple[str, ...] = ("HEAD",)) -> DataFrame:
    """All commits that refs reach in each repository (column repository), parents before children by seq. A shallow repository is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                yield from _tables(_walk(r, list(refs)), _schema(COMMITS))

    return ship(repositories).select("repository").mapInArrow(run, COMMITS)


def _changes(repository: str, oids: list[tuple[str, str | None]]) -> Iterator[dict]:
    p = subprocess.Popen(["git", "-C", repository, "diff-tree", "--stdin", "--always", "--root", "--raw", "-r", "-z", "-M", "-C"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    for oid, parent in oids:
        p.stdin.write(f"{oid} {parent}\n".encode() if parent else f"{oid}\n".encode())
    p.stdin.close()
    asked, records = iter(oids), _records(p.stdout)
    oid = parent = None
    for r in records:
        if not r.startswith(b":"):
            oid, parent = next(asked)
            continue
        old_mode, new_mode, old_blob, new_blob, status = _text(r[1:]).split()
        path = _text(next(records))
        new_path = _text(next(records)) if status[0] in "RC" else None
        yield {"repository": repository, "oid": oid, "parent": parent, "status": status[0], "old_mode": old_mode, "new_mode": new_mode, "old_blob": old_blob, "new_blob": new_blob, "path": path, "new_path": new_path}
    _end(p, f"changes of {repository}")


def changes(found: DataFrame) -> DataFrame:
    """Changed paths of each commit against each parent (a root against nothing), with renames and copies. found: repository, oid, parents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked: dict[str, list[tuple[str, str | None]]] = {}
            for r in b.to_pylist():
                asked.setdefault(r["repository"], []).extend((r["oid"], x) for x in r["parents"] or [None])
            for repository, oids in asked.items():
                for i in range(0, len(oids), 400):  # 400 lines stay below the size of a pipe
                    yield from _tables(_changes(repository, oids[i : i + 400]), _schema(CHANGES))

    return ship(found).select("repository", "oid", "parents").mapInArrow(run, CHANGES)


def objects(wanted: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Objects by (repository, oid), each once; type is missing where there is none. One process per repository and batch; an object above most bytes is an error."""

    def read(repository: str, oids: list[str]) -> Iterator[dict]:
        p = _git(repository, "cat-file", "--batch")
        for oid in oids:
            p.stdin.write(f"{oid}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().decode().split()
            if head[-1] == "missing":
                yield {"repository": repository, "oid": oid, "type": "missing"}
                continue
            if int(head[2]) > most:
                p.kill()
                raise ValueError(f"{oid} has {head[2]} bytes")
            data = p.stdout.read(int(head[2]))
            p.stdout.read(1)
            yield {"repository": repository, "oid": oid, "type": head[1], "size": int(head[2]), "bytes": data}
        p.stdin.close()
        _end(p, f"objects of {repository}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(OBJECTS)
        for b in batches:
            asked: dict[str, list[str]] = {}
            for r in b.to_pylist():
                asked.setdefault(r["repository"], []).append(r["oid"])
            for repository, oids in asked.items():
                yield from _packed(read(repository, oids), schema)

    return ship(wanted).select("repository", "oid").distinct().mapInArrow(run, OBJECTS)


def json_objects(found: DataFrame, schema: str) -> DataFrame:
    """repository, oid, value (parsed by schema) and fault (missing, not a blob, or no JSON; else null) of objects()."""
    text = F.col("bytes").cast("string")
    value = F.from_json(text, schema)
    fault = F.when(F.col("type") == "missing", "missing").when(F.col("type") != "blob", "not-a-blob").when(F.schema_of_variant(F.try_parse_json(text)).isNull(), "no-json")
    return found.select("repository", "oid", F.when(fault.isNull(), value).alias("value"), fault.alias("fault"))


def refs(repositories: DataFrame, prefix: str) -> DataFrame:
    """repository, ref, oid of all refs below a prefix, in order. A prefix that is no path of refs is an error."""
    if not re.fullmatch(r"refs/[A-Za-z0-9._/-]+", prefix) or ".." in prefix or "//" in prefix:
        raise ValueError(f"invalid prefix of refs: {prefix}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                out = subprocess.run(["git", "-C", r, "for-each-ref", "--format=%(refname)%00%(objectname)", prefix], capture_output=True, check=True).stdout
                rows = sorted(_text(line).split("\0") for line in out.splitlines())
                yield from _tables(iter([{"repository": r, "ref": ref, "oid": oid} for ref, oid in rows]), _schema("repository string, ref string, oid string"))

    return ship(repositories).select("repository").mapInArrow(run, "repository string, ref string, oid string")
