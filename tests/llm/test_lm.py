import collections
import math
import random
import zlib

import numpy as np
import pytest

from lintlake.llm import lm
from lintlake.llm.trie import EliasFano, Trie


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (1, 2**50), (500, 300), (3000, 2**20), (2000, 2**45)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    ef = EliasFano.of(values, universe)
    assert (ef.at(np.arange(n)) == values).all()
    x = np.unique(np.concatenate([values, rng.integers(0, universe, 500).astype(np.uint64)]))
    at, same = ef.successor(x)
    assert (at == np.searchsorted(values, x)).all() and (same == np.isin(x, values)).all()
    if n > 1000:
        assert (ef.low.nbytes + ef.high.nbytes) * 8 / n < math.log2(universe / n) + 3.2


def test_trie():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 400, (3000, 2)) ** np.array([1, 2]), axis=0)
    codes = rng.integers(0, 65536, len(pairs)).astype(np.uint16)
    trie = Trie(pairs[:, 0], pairs[:, 1], codes)
    want = {tuple(p): c for p, c in zip(pairs.tolist(), codes.tolist())}
    ask = np.concatenate([pairs, rng.integers(0, 500, (4000, 2)) ** np.array([1, 2])])
    got, found = trie.find(ask[:, 0], ask[:, 1])
    assert [(c if f else None) for c, f in zip(got.tolist(), found.tolist())] == [want.get(tuple(p)) for p in ask.tolist()]
    empty = Trie(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
    assert not empty.find(np.array([0, 5]), np.array([0, 5]))[1].any()


def brute(rows):
    docs = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        docs.append((i, held, low.split() + [None]))
    c, pairs = collections.Counter(), collections.Counter()
    for _, held, t in docs:
        if not held:
            c.update(t)
            pairs.update(zip([None] + t, t))
    n, v = sum(c.values()), len(c)
    bins = collections.Counter(round(math.log2(x) * lm.BINS) for x in c.values())
    kinds = lm.expected_kinds(bins, n) if bins else (np.zeros(1), np.ones(1))
    out = []
    for i, held, t in docs:
        base = score = 0.0
        for h, w in zip([None] + t, t):
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            m = float(np.interp(math.log2(max(1, c[h])), *kinds)) if c[h] else 1.0
            base += math.log10(p)
            score += math.log10(((pairs[h, w] if c[h] and c[w] else 0) + m * p) / (c[h] + m))
        out.append((i, held, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "SHARD_PAIRS", 300)
    rng = random.Random(9)
    vocabulary = [f"w{k}É" for k in range(40)] + ["the"] * 60
    rows = [(i, " \t".join(rng.choices(vocabulary, k=rng.randrange(60))) + (f" Only{i}" if i % 3 == 0 else "")) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "the the"), (7, rows[7][1]), (7, rows[7][1]), (502, "x " * 20_000), (503, "a b\x1cc\x0bd")]
    df = spark.createDataFrame([(a, b, 1.0, "s") for a, b in rows], "doc_id long, text string, score double, kind string")
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    for g, x in zip(got, want):
        assert abs(g[5] - x[5]) <= 1e-9 * max(1, abs(x[5])) and abs(g[6] - x[6]) <= 1e-3 * x[2]


def test_probabilities_sum_to_one_and_model_beats_base(spark):
    rng = random.Random(4)
    follow = {k: rng.sample(range(200), 4) for k in range(200)}

    def text():
        k, out = rng.randrange(200), []
        for _ in range(50):
            out.append(f"v{k}")
            k = rng.choice(follow[k])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    held = [r for r in lm.score(df).collect() if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_pair_is_one_entry_a_block(spark, monkeypatch):
    seen = []

    def watched(pairs, shards, real=lm.looked_up):
        seen.extend(lm.unsqueezed(r["payload"]) for r in pairs.where("kind = 1").collect())
        return real(pairs, shards)

    monkeypatch.setattr(lm, "looked_up", watched)
    rows = [(i, "a b " * 500 + f"only{i} a a") for i in range(60)] + [(100, "b a"), (101, None)]
    got = sorted((tuple(r) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    for part in seen:
        assert len(set(zip(np.cumsum(part["h"]).tolist(), part["w"].tolist()))) == len(part["w"])
    assert sum(len(p["w"]) for p in seen) < 1000
    for g, x in zip(got, sorted(brute(rows), key=str), strict=True):
        assert g[:5] == x[:5] and abs(g[6] - x[6]) <= 1e-3 * x[2]
    nothing = [(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert lm.score(spark.createDataFrame(nothing, "doc_id long, text string")).where("score = score").count() == len(nothing)
