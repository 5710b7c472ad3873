"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Callable[[Column], Column], max_rows: int) -> list[tuple[str, int]]:
    """At most max_rows (text, label) pairs, the same for the same rows: those with the smallest hash of the id, then of the text.

    usable: from the id's column, a condition. Null labels and null ids are left out. The ids are chosen before
    any text is read. Of rows that repeat a chosen id, executors keep the first max_rows too, so
    what is broadcast and what comes to the driver is bounded by max_rows.
    """
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__label").isNotNull() & F.col("__id").isNotNull())
    chosen = chosen.withColumn("__h", F.xxhash64(F.col("__id"), F.lit(7))).where(usable(F.col("__id"))).orderBy("__h", "__id", "__label").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), whole(F.col(text_col)).alias("__text")).join(F.broadcast(chosen), "__id")
    order = ("__h", "__label", F.xxhash64("__text"), "__text")
    # coalesced, so that the cut is made by a task: as the root of a plan it would be made by the driver, from max_rows of each partition
    return [(r["__text"], r["__label"]) for r in rows.orderBy(*order).limit(max_rows).select("__text", "__label").coalesce(1).collect()]


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores x and labels y (Newton's method)."""
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (p - y) + ridge * a
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])
