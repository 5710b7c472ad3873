"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of n-grams (3 to 6 characters of the lower-cased text, white space runs as one
blank), hashed to 2**20 places. Per feature r = log of the smoothed ratio of its share among toxic
and clean training texts; the input of the logistic regression is r where the n-gram is present. The
regression is fitted with L2 regularisation; its weights times r are one sparse table of floats that
scores a text in one pass.

Bounds, all parameters: training uses max_rows labelled rows (those with the smallest hash of the id) and fits weights for the
max_features features that tell most (by r over its standard error) among those that least_rows texts or more have. Whole texts
are hashed, in training and in scoring, whatever their length. Defined results: null text = empty; a text without a telling n-gram gets the score of the
intercept; repeated rows are scored row by row; an empty table gives no rows; without any labelled
row, or with one class only, every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ship, whole
from .labelled import sample

BITS = 20
SIZES = (3, 4, 5, 6)
_blank = re.compile(r"[\x00-\x20]+")


def hashes(text: str) -> np.ndarray:
    """The places of all n-grams of a text; a surrogate alone counts as a question mark."""
    b = np.frombuffer(f" {_blank.sub(' ', text.lower())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h, out = b.copy(), []
    for n in range(2, max(SIZES) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + b[n - 1 :]
        if n in SIZES:
            out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit(pairs: list[tuple[str, int]], max_features: int = 6000, least_rows: int = 4, ridge: float = 0.02, steps: int = 150) -> tuple[np.ndarray, float]:
    """The weight of each place, and the intercept."""
    y = np.array([int(label == 1) for _, label in pairs], np.float64)
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return weights, float(np.log(p / (1 - p)))
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for t, label in pairs:
        (pos if label == 1 else neg)[np.unique(hashes(t))] += 1
    rp, rn = (pos + 0.5) / (y.sum() + 1), (neg + 0.5) / ((1 - y).sum() + 1)
    ratio = np.log(rp / rn)
    telling = ratio / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    telling[pos + neg < least_rows] = 0
    chosen = np.argsort(-np.abs(telling), kind="stable")[:max_features]
    chosen = np.sort(chosen[telling[chosen] != 0])
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    kept = []
    for t, _ in pairs:  # hashed a second time, so that only the chosen places are ever held
        c = column[hashes(t)]
        kept.append(np.unique(c[c >= 0]))
    rows, cols = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept]), np.concatenate(kept)
    x = ratio[chosen][cols]
    w, b = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean())))
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):  # Adam on the full batch: deterministic, and the features differ much in how often they occur
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[cols], len(y)) + b, -30, 30)))
        d = (p - y) / len(y)
        g, g_b = np.bincount(cols, x * d[rows], len(w)) + ridge * w / len(w), d.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b * g_b
        rate = 0.05 / (1 + k / 50)
        w -= rate * (m_w / (1 - 0.9**k)) / (np.sqrt(v_w / (1 - 0.99**k)) + 1e-6)
        b -= rate * (m_b / (1 - 0.9**k)) / (np.sqrt(v_b / (1 - 0.99**k)) + 1e-6)
    weights[chosen] = w * ratio[chosen]
    weights[np.abs(weights) < 1e-4] = 0
    return weights, float(b)


def score(text: str, weights: np.ndarray, intercept: float) -> float:
    h = hashes(text)
    h = h[weights[h] != 0]
    return float(1 / (1 + np.exp(-np.clip(weights[np.unique(h)].sum(dtype=np.float64) + intercept, -30, 30))))


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable, max_rows: int = 8000, max_features: int = 6000, least_rows: int = 4) -> DataFrame:
    """id_col and score (0 to 1) of every row of docs.

    usable: a function of the id column that says which labels may be learnt from.
    """
    weights, intercept = fit(sample(docs, labels, id_col, text_col, label_col, usable, max_rows), max_features, least_rows)
    at = np.flatnonzero(weights)
    values = weights[at]
    held: dict[str, np.ndarray] = {}

    def run(texts: list[str]) -> list[tuple]:
        if "w" not in held:
            held["w"] = np.zeros(1 << BITS, np.float32)
            held["w"][at] = values
        return [(score(t, held["w"], intercept),) for t in texts]

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return map_rows(src, run, f"id {kind}, score double", ["score"]).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable, threshold: float = 0.3, max_rows: int = 8000, max_features: int = 6000, least_rows: int = 4) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    weights, intercept = fit(sample(docs, labels, id_col, text_col, label_col, usable, max_rows), max_features, least_rows)
    at = np.flatnonzero(weights)
    values = weights[at]
    held: dict[str, np.ndarray] = {}
    place = docs.columns.index(text_col)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "w" not in held:
            held["w"] = np.zeros(1 << BITS, np.float32)
            held["w"][at] = values
        for b in batches:
            yield b.filter(pa.array([score(t or "", held["w"], intercept) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
