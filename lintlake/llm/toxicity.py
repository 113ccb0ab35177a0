"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (does it hold this term?) and pattern voters (insults aimed at someone, shouted
insults, ...). A generative label model, fitted by expectation maximisation over a bounded sample of documents, estimates how
often each voter fires in either class, and from the correlations that remain inside the classes how much of each vote is its own;
known labels are one more voter, which is right most of the time but not always. A linear classifier on hashed terms is then
trained on the posterior labels, and scores every document.

Fitting sees at most learning.SAMPLE labelled documents (a documented bound, chosen by the hash of the id); scoring sees everything.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lintlake.llm.common import in_parts, words_of
from lintlake.llm.learning import scored

VOTERS = 400
BITS = 20
STEMS = (5, 7)
#: Terms that stand for abuse in themselves; more are found from the labels.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "dumb", "freak", "vermin", "filth")
PATTERNS = {
    "you_are": re.compile(rb"\byou(?:'re| are)? (?:an? |such an? )?(?:" + "|".join(LEXICON).encode() + rb")\b"),
    "aimed": re.compile(rb"\b(?:this|that|these|those|such|the|an?|and) (?:" + "|".join(LEXICON).encode() + rb")\b"),
    "inflected": re.compile(rb"\b(?:" + "|".join(LEXICON).encode() + rb")(?:s|ic|ly|ness)?\b"),
    "twice": re.compile(rb"\b(?:" + "|".join(LEXICON).encode() + rb")\b.*\b(?:" + "|".join(LEXICON).encode() + rb")\b", re.S),
}
_RAW = [t.encode() for t in LEXICON]
EDGES = b".,!?;:#$%&*|\"'()[]<>-"


class Terms:
    """Hashed terms of texts: words without punctuation at their edges, beginnings of 5 and of 7 characters of longer words, and
    beginnings of 5 that two, and that three, or more different words share. What a word gives is kept, up to KEPT words."""

    KEPT = 200_000

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, int]] = {}

    def of_word(self, word: bytes) -> tuple[int, int, int]:
        if word in self.known:
            return self.known[word]
        bare = word.strip(EDGES)
        chars = bare.decode("utf-8", "replace")
        out = (slot(b"w" + bare), *(slot(b"p" + chars[:k].encode()) if len(chars) > k else 0 for k in STEMS))
        if len(self.known) >= self.KEPT:
            self.known.clear()
        self.known[word] = out
        return out

    def __call__(self, text: bytes) -> np.ndarray:
        rows = np.array(list(set(map(self.of_word, set(words_of(text))))), np.uint32).reshape(-1, 3)
        stems, n = np.unique(rows[:, 1], return_counts=True)
        shared = [(stems[n > k] * np.uint32(2654435761) + np.uint32(k << 12)) >> np.uint32(32 - BITS) for k in (1, 2)]
        out = np.unique(np.concatenate([rows.ravel(), *shared]))
        return out[out > 0]


def slot(term: bytes) -> int:
    """1 .. 2^BITS - 1"""
    return xxhash.xxh3_64_intdigest(term) % ((1 << BITS) - 1) + 1


def pattern_votes(text: bytes) -> list[bool]:
    low = text.lower()
    some = any(t in low for t in _RAW)
    return [some and bool(p.search(low)) for p in PATTERNS.values()]


@dataclass
class LabelModel:
    """Per voter the log odds of a vote and of none, and the share of it that is its own; the prior."""

    prior: float
    fired: np.ndarray
    silent: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = self.prior + np.where(votes, self.fired, self.silent) @ self.share
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 15, trust: float = 0.999) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over votes (documents, voters). known: labels 0/1, a voter right with probability `trust`."""
    n = len(votes)
    q = np.where(known == 1, trust, 1 - trust)
    x = votes.astype(np.float64)
    share = np.ones(votes.shape[1])
    gold = np.where(known == 1, 1, -1) * math.log(trust / (1 - trust))
    model = None
    for step in range(rounds):
        p1 = (q @ x + 0.5) / (q.sum() + 1)
        p0 = ((1 - q) @ x + 0.5) / (n - q.sum() + 1)
        prior = math.log((q.sum() + 1) / (n - q.sum() + 1))
        if step == 1:
            share = own_share(x, q, p1, p0)
        model = LabelModel(prior, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)), share)
        logit = model.prior + gold + np.where(votes, model.fired, model.silent) @ share
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return model, q


def own_share(x: np.ndarray, q: np.ndarray, p1: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """1 over the sum of a voter's correlations with all voters inside the classes: copies of one voter count once together."""
    out = np.zeros((x.shape[1], x.shape[1]))
    for weight, p in ((q, p1), (1 - q, p0)):
        away = (x - p) * np.sqrt(weight / max(weight.sum(), 1e-9))[:, None]
        cov = away.T @ away
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = np.maximum(out, np.abs(cov / np.outer(scale, scale)))
    out[out < 0.2] = 0
    np.fill_diagonal(out, 1)
    return 1 / out.sum(axis=1)


def fit_linear(bags: list[np.ndarray], q: np.ndarray, epochs: int = 15, rate: float = 0.5, least: float = 5.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by AdaGrad over single documents; terms of little gain stay at 0."""
    useful = gains(bags, q) > least
    rows = [bag[useful[bag]] for bag in bags]
    w, g, bias, bias_g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-1), 0.0, 1e-1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[at].sum() + bias))))
            err = p - q[i]
            g[at] += err * err
            w[at] -= rate * err / np.sqrt(g[at])
            bias_g += err * err
            bias -= rate * err / math.sqrt(bias_g)
    return w, bias


@dataclass
class Model:
    """Weights of hashed terms; the voters and the label model that the training labels came from."""

    weights: np.ndarray
    bias: float
    voters: np.ndarray
    label_model: LabelModel | None


def gains(bags: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each hashed term for the class of weights q; 0 where it speaks against it or has under 3 documents."""
    n1 = max(1.0, float(q.sum()))
    n0 = max(1.0, len(q) - n1)
    a, b = (np.zeros(1 << BITS) for _ in range(2))
    for bag, y in zip(bags, q.tolist()):
        a[bag] += y
        b[bag] += 1 - y
    both = np.maximum(a + b, 1e-9)
    out = sum(np.where(x > 1e-9, x * np.log(np.maximum(x, 1e-9) * (n0 + n1) / (n * both)), 0) for x, n in ((a, n1), (b, n0)))
    out[(a < 2.5) | (a / n1 <= 2 * b / n0)] = 0
    return out


def find_voters(bags: list[np.ndarray], known: np.ndarray, most: int = VOTERS) -> np.ndarray:
    """Hashed terms whose presence speaks for the label in the learning part, best first, after those of LEXICON."""
    gain = gains(bags, known.astype(np.float64))
    best = np.argsort(-gain, kind="stable")[:most]
    fixed = np.array([slot(b"w" + t.encode()) for t in LEXICON])
    return np.concatenate([fixed, np.setdiff1d(best[gain[best] > 3], fixed)]).astype(np.int64)


def train(sample: DataFrame) -> Model:
    """From (doc_id, text, y), a bounded sample: terms are hashed on the executors, numbers alone come to the driver."""
    def run(batches):
        terms = Terms()
        for whole in batches:
            for b in in_parts(whole):
                texts = b.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([terms(t).tobytes() for t in texts], pa.binary()),
                                                  pa.array([bytes(pattern_votes(t)) for t in texts], pa.binary())], ["doc_id", "y", "terms", "votes"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, terms binary, votes binary").collect(), key=lambda r: (r["doc_id"], bytes(r["terms"])))
    if len({r["y"] for r in rows}) < 2:
        share = (sum(r["y"] for r in rows) + 1) / (len(rows) + 2)
        return Model(np.zeros(1 << BITS, np.float32), math.log(share / (1 - share)), np.zeros(0, np.int64), None)
    bags = [np.frombuffer(r["terms"], np.uint32).astype(np.int64) for r in rows]
    known = np.array([r["y"] for r in rows])
    voters = find_voters(bags, known)
    votes = np.array([np.concatenate([np.isin(voters, bag), np.frombuffer(r["votes"], np.bool_)]) for bag, r in zip(bags, rows)])
    label_model, q = fit_label_model(votes, known)
    weights, bias = fit_linear(bags, q)
    return Model(weights.astype(np.float32), bias, voters, label_model)


def score(docs: DataFrame, model: Model, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null texts are empty and get a score like any; a null id counts as
    empty text in the held-out rule; repeated rows repeat; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        (weights, bias), terms = shared.value, Terms()
        for whole in batches:
            for b in in_parts(whole):
                z = np.array([weights[terms(t)].sum(dtype=np.float64) + bias for t in b.column("text").to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return scored(docs, modulus, held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def not_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows of docs that score below the threshold, with all their columns, decided where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        (weights, bias), terms = shared.value, Terms()
        most = math.log(threshold / (1 - threshold))
        for whole in batches:
            for b in in_parts(whole):
                texts = b.column("text").cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([bool(weights[terms(t or b"")].sum(dtype=np.float64) + bias < most) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
