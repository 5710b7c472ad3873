"""Helpers that the operators share: reading tables, shipping code, stable storage, per-row Arrow maps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context; it may not be installed there.

    Documents are long rows: Spark's usual number of rows and of bytes in an Arrow batch, where nobody has chosen
    others, are lowered so that a batch stays at some megabytes on both sides.
    """
    sc = spark.sparkContext
    for key, usual, ours in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    if getattr(sc, "_annalist_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "annalist_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._annalist_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_stable_storage(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder that spark.checkpoint.dir names. A folder of our own is for one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors are not on this machine")
        sc.setCheckpointDir(shared or f"file://{tempfile.gettempdir()}/annalist-{uuid.uuid4().hex}")


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage through files that outlive executors."""
    use_stable_storage(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have."""
    taken = {c.lower() for c in df.columns}
    return list(islice((c for c in (f"__{k}" for k in range(len(taken) + n)) if c not in taken), n))


def id_text(col: Column) -> Column:
    """An id as text; a null id counts as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def remainder(col: Column, mod: int) -> Column:
    return F.crc32(id_text(col)) % mod


def whole(col: Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def map_rows(df: DataFrame, fn: Callable[[list], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """df's first column is passed on; fn turns the list of the second column's texts into tuples of the rest.

    names: the output columns after the first. One slice of an Arrow batch at a time, so memory is bounded.
    """
    key = df.columns[0]
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 512):
                b = whole_batch.slice(at, 512)
                rows = fn(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows]) for i in range(len(names)))], names=[key, *names])

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply-xorshift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
