"""Quality classifier: naive Bayes support vectors.

Indicators of character n-grams (2 to 4 bytes, hashed) and of how much a text repeats its own words and lines are scaled by the
log ratio of their counts in the two classes, each text is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. Margins become probabilities by a logistic curve fitted on a fifth of the sample that the model has
not seen. Fitting sees at most learning.SAMPLE labelled documents; scoring sees everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.common import in_parts
from lintlake.llm.learning import scored

BITS = 18
ORDERS = (2, 3, 4)
SPARE = 512


class Grams:
    """Hashed indicators of a text, each once. A table of flags is kept, so nothing is sorted."""

    def __init__(self):
        self.seen = np.zeros((1 << BITS) + SPARE, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        code = b
        for n in range(2, max(ORDERS) + 1):
            code = (code[:-1] << np.uint32(8)) | b[n - 1:] if len(code) > 1 else code[:0]
            if n in ORDERS:
                self.seen[((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
        for i in repetition(text):
            self.seen[(1 << BITS) + i] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def repetition(text: bytes) -> list[int]:
    """Indicators below SPARE: share of different words, by length; share of different lines; most frequent repeats in a row."""
    words, lines = text.split(), text.split(b"\n")
    size = min(15, len(words).bit_length())
    share = int(15 * len(set(words)) / len(words)) if words else 0
    line_share = int(15 * len(set(lines)) / len(lines))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [16 * size + share, 256 + min(15, line_share), 272 + (int(15 * same / len(words)) if words else 0), 288 + size]


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratios of the indicators, smoothed by one."""
    up, down = (np.ones((1 << BITS) + SPARE) for _ in range(2))
    for at, positive in zip(rows, (y == 1).tolist()):
        (up if positive else down)[at] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def dual_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Weights of min |w|^2 / 2 + cost * sum of hinge losses, over x = r at the row's indicators, of unit length. The rarer class has
    the costs of its losses raised to equal weight."""
    w, alpha = np.zeros(len(r)), np.zeros(len(rows))
    scales = [1 / max(1e-12, math.sqrt(float(r[at] @ r[at]))) for at in rows]
    share = np.where(y == 1, (y == 1).mean(), (y != 1).mean())
    most = cost * 0.5 / share
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            sign = 1.0 if y[i] == 1 else -1.0
            at = rows[i]
            x = r[at] * scales[i]
            gradient = sign * float(w[at] @ x) - 1
            new = min(max(alpha[i] - gradient, 0.0), most[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * sign * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def margin(at: np.ndarray, weighted: np.ndarray, squares: np.ndarray) -> float:
    return float(weighted[at].sum() / math.sqrt(max(1e-12, float(squares[at].sum()))))


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin), by Newton's method with smoothed targets."""
    n1 = int((y == 1).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(y))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    """Weights times ratios, squares of the ratios, slope and shift."""

    weighted: np.ndarray
    squares: np.ndarray
    slope: float
    shift: float


def train(sample: DataFrame) -> Model:
    """From (doc_id, text, y), a bounded sample: indicators are made on the executors, numbers alone come to the driver."""
    def run(batches):
        grams = Grams()
        for whole in batches:
            for b in in_parts(whole):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([grams(t).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()], pa.binary())],
                                                 ["doc_id", "y", "grams"])

    got = sorted(sample.mapInArrow(run, "doc_id long, y int, grams binary").collect(), key=lambda r: (r["doc_id"], bytes(r["grams"])))
    size = (1 << BITS) + SPARE
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2 or min((y == 1).sum(), (y != 1).sum()) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, math.log(share / (1 - share)))
    rows = [np.frombuffer(r["grams"], np.uint32) for r in got]
    aside = np.random.default_rng(11).random(len(rows)) < 0.2
    for c in (0, 1):
        aside[np.flatnonzero((y == 1) == c)[:2]] = [True, False]
    fit, rest = np.flatnonzero(~aside).tolist(), np.flatnonzero(aside).tolist()
    r = log_ratios([rows[i] for i in fit], y[fit])
    weighted, squares = dual_descent([rows[i] for i in fit], r, y[fit]) * r, r * r
    slope, shift = logistic(np.array([margin(rows[i], weighted, squares) for i in rest]), y[rest])
    return Model(weighted.astype(np.float32), squares.astype(np.float32), slope, shift)


def score(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null texts are empty and get a score like any; a null id counts as
    empty text in the held-out rule; repeated rows repeat; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, grams = shared.value, Grams()
        for whole in batches:
            for b in in_parts(whole):
                z = np.array([m.slope * margin(grams(t), m.weighted, m.squares) + m.shift for t in b.column("text").to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return scored(docs, modulus, held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
