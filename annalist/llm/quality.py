"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, shortens a text more.

The dictionaries are trained on all bytes of the labelled good and bad texts (those of the fitting half): zstandard's cover
algorithm keeps the segments whose parts recur most. They are used as raw content. A text is cut into pieces (so
that it cannot become its own dictionary) and every piece is compressed once with each; the difference of the summed
sizes over their sum is the text's feature. A logistic curve, fitted on labelled texts that did not go into
the dictionaries, turns it into a score.

Bounds, all parameters: max_rows labelled rows are used for training (those with the smallest hash of the id), and a
dictionary has dictionary_bytes. Whole texts are read, in training and in scoring. Defined results: null text = empty; an empty
text has feature 0; repeated rows are scored row by row; an empty table gives no rows; without both classes every
score is the smoothed share of good labels.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole
from .labelled import platt, sample

PIECE = 256
SEGMENT, PART = 512, 8  # of the cover algorithm
LEVEL = 6


def content(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes from all of the texts: all bytes if they are few, else what training keeps; deterministic.

    Texts too much alike for training (it refuses them) give even shares of their bytes, at places dealt over their lengths.
    """
    if sum(map(len, texts)) + len(texts) <= size:
        return b"\n".join(texts)
    samples = [p for t in texts for at in range(0, len(t), SEGMENT) if len(p := t[at : at + SEGMENT]) >= PART]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART, f=20, accel=1, steps=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        share = max(PART, size // len(texts))
        starts = [int(k * 0.6180339887498949 % 1 * max(0, len(t) - share)) for k, t in enumerate(texts)]
        return b"\n".join(t[a : a + share] for t, a in zip(texts, starts, strict=True))[:size]


class CompressionClassifier:
    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.parts = good, bad
        self.slope, self.offset = slope, offset
        self._make()

    def _make(self) -> None:
        self.tools = []
        for d in self.parts:
            if len(d) < 8:
                self.tools.append(zstandard.ZstdCompressor(level=LEVEL))
                continue
            zd = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            zd.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=zd))

    def __getstate__(self):
        return self.parts, self.slope, self.offset

    def __setstate__(self, state):
        self.parts, self.slope, self.offset = state
        self._make()

    def feature(self, text: str) -> float:
        data = text.encode()
        if not data:
            return 0.0
        good, bad = (t.compress for t in self.tools)
        g = b = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            g += len(good(piece))
            b += len(bad(piece))
        return (b - g) / (b + g)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.feature(text) + self.offset, -30, 30))))


def fit(pairs: list[tuple[str, int]], size: int = 192 << 10) -> CompressionClassifier:
    y = np.array([int(label == 1) for _, label in pairs], np.float64)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return CompressionClassifier(b"", b"", 0.0, float(np.log(p / (1 - p))))
    rank = {0: 0, 1: 0}
    groups: dict[tuple[int, int], list[str]] = {(k, part): [] for k in (0, 1) for part in (0, 1)}
    for text, label in pairs:
        k = int(label == 1)
        groups[k, rank[k] % 2].append(text)
        rank[k] += 1
    c = CompressionClassifier(*(content([t.encode() for t in groups[k, 0]], size) for k in (1, 0)))
    rest = [(c.feature(t), k) for k in (0, 1) for t in groups[k, 1] or groups[k, 0]]
    c.slope, c.offset = platt(np.array([x for x, _ in rest]), np.array([k for _, k in rest], np.float64))
    return c


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable, max_rows: int = 8000, dictionary_bytes: int = 192 << 10) -> DataFrame:
    """id_col, score (0 to 1) and the compression feature of every row of docs."""
    c = fit(sample(docs, labels, id_col, text_col, label_col, usable, max_rows), dictionary_bytes)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(texts: list[str]) -> list[tuple]:
        return [(1 / (1 + np.exp(-np.clip(c.slope * (x := c.feature(t)) + c.offset, -30, 30))), x) for t in texts]

    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return map_rows(src, run, f"id {kind}, score double, size_difference double", ["score", "size_difference"]).withColumnRenamed("id", id_col)
