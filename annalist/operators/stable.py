"""What clusters need: lineage cut where lost executors cannot hurt, in the shared folder; this package on the executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df by checkpoint(), in the shared folder that spark.checkpoint.dir names. A folder of our own is for one machine only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors are not on this machine")
        sc.setCheckpointDir(shared or tempfile.mkdtemp())
    return df.checkpoint()


def ship(df: DataFrame) -> DataFrame:
    """df, after its executors have been given this package, once per context; it may not be installed there."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_annalist_shipped", False):
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / "annalist_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        sc.addPyFile(str(path))
        sc._annalist_shipped = True
    return df
