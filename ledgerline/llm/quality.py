"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are indicators of its words (hashed) and of one to three word shapes in
a row: letter case, trailing marks, and whether a word repeats the one before. Each
indicator is scaled by the log of its smoothed count ratio between the classes; a linear
model with hinge loss is then fitted on the scaled, length-normalised vectors by dual
coordinate descent, and a logistic curve turns its margin into a score.

Training reads a bounded sample of about ``SAMPLE`` labelled rows, chosen by a hash of the
id; the bound is a parameter. The model has a fixed size and is broadcast. Scoring reads
whole texts. Defined cases: null texts count as empty; an empty text has the score of the
bias alone; without rows of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_runs

SAMPLE = 4000
#: Hashed features of words; shape features follow them.
WORD_FEATURES = 1 << 17
_SHAPES = 64
_SHAPE_FEATURES = _SHAPES**3
N_FEATURES = WORD_FEATURES + _SHAPE_FEATURES
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
_REMEMBERED = 200_000
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _Shapes(dict):
    """Word -> shape from 1 to 31, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        core = word.rstrip(_MARKS)
        tail = word[len(core) :]
        if not tail:
            end = 0
        elif tail == b".":
            end = 1
        elif len(tail) == 1:
            end = 2
        elif len(set(tail)) == 1:
            end = 3
        else:
            end = 4
        if not core:
            case = 5
        elif core.isdigit():
            case = 4
        elif core.islower():
            case = 1
        elif core.isupper() and len(core) > 1:
            case = 2
        else:
            case = 3
        shape = 5 * case + end + 1
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = shape
        return shape


_shapes = _Shapes()


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of a text's indicators."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, dtype=np.int32)
    hashed = np.fromiter(map(crc32, set(found)), dtype=np.int64) % WORD_FEATURES
    shapes = np.fromiter(map(_shapes.__getitem__, found), dtype=np.int64, count=len(found))
    shapes[1:] += 32 * np.fromiter(map(operator.eq, found, found[1:]), dtype=np.int64, count=len(found) - 1)
    runs = [shapes]
    for k in (1, 2):
        if len(shapes) > k:
            runs.append(runs[-1][:-1] * _SHAPES + shapes[k:])
    return np.unique(np.concatenate([hashed, *(WORD_FEATURES + r for r in runs)])).astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        norm = float(np.sqrt((self.scale[found] ** 2).sum()))
        return float(self.weights[found].sum()) / norm + self.bias if norm else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def fit(vectors: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """NB-scaled linear hinge model from indicator lists and labels 0 or 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        odds = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        zero = np.zeros(N_FEATURES, dtype=np.float32)
        return QualityModel(zero, zero, 0.0, 0.0, odds)
    counts = [np.full(N_FEATURES, SMOOTHING) for _ in range(2)]
    for v, y in zip(vectors, labels, strict=True):
        counts[int(y)][v] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(labels == 1, 1.0, -1.0)
    scaled = []
    for v in vectors:
        x = ratio[v]
        norm = np.sqrt((x**2).sum())
        scaled.append(x / norm if norm else x)
    # Dual coordinate descent; classes weigh alike. The last coordinate is the bias.
    cost = COST * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = np.zeros(N_FEATURES), 0.0
    alpha = np.zeros(len(y))
    square = np.array([(x**2).sum() + 1.0 for x in scaled])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            v, x = vectors[i], scaled[i]
            gradient = y[i] * (x @ w[v] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[v] += step * x
                bias += step
                alpha[i] = new
    margins = np.array([x @ w[v] + bias for v, x in zip(vectors, scaled, strict=True)])
    slope, offset = _logistic(margins, labels)
    return QualityModel((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, slope, offset)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets drawn in from 0 and 1."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def bounded_sample(rows: DataFrame, key: str, salt: str, sample: int) -> DataFrame:
    """About ``sample`` rows, chosen by a hash of the id, however many there are."""
    share = min(1.0, sample / max(1, rows.count()))
    place = F.crc32(F.concat(F.lit(salt + " "), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")) / F.lit(float(1 << 32))
    return rows.filter(place < share)


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> QualityModel:
    """Model from about ``sample`` rows of ``labelled`` (id, text, label)."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "t"):
            packed = [features(t.as_py()).tobytes() for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(packed, type=pa.binary()), batch.column("y")], names=["k", "v", "y"])

    kind = rows.schema["k"].dataType.simpleString()
    found = bounded_sample(rows, "k", "quality", sample).mapInArrow(run, f"k {kind}, v binary, y int").toPandas().sort_values(["k", "y"])
    return fit([np.frombuffer(v, dtype=np.int32) for v in found["v"]], found["y"].to_numpy(np.int64))


def score(df: DataFrame, model: QualityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` plus ``score``."""
    if "score" in {c.lower() for c in df.columns}:
        raise ValueError("column score would be overwritten")
    ship(df.sparkSession)
    frozen = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if keep_text or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for batch in text_runs(batches, text):
            scores = [m.score(features(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, type=pa.float64())], names=[*keep, "score"])

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return df.mapInArrow(run, ", ".join([*fields, "score double"]))
