import math

import numpy as np
import pytest

from lintlake.llm import topk
from lintlake.llm.topk import BallTree, top_k, top_k_sql

KIND = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k=5):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q, qv in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0")).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 1000)] + [(i, [0.5, 0.25]) for i in range(1000, 1004)] + [(1100, [1.0, -1.0]), (1150, [9.0])]
    rows += [(50, rows[50][1]), (1200, None), (1250, [None] * 8), (1300, [float("nan")] * 8), (1350, [float("inf")] * 8), (None, rows[0][1]), (1400, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)
    assert run(df) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e5 + i / 7, -3e4 * i]) for i in range(120)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)
    assert run(df) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], KIND)) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.integers(-900, 900, (8, 16))
    vectors = (centres[rng.integers(0, 8, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(np.int64)
    tree = BallTree(vectors, np.arange(3000))
    queries = rng.integers(-900, 900, (20, 16)).astype(np.float64)
    bounds = tree.bounds(queries)
    for n, (_, _, least, first, last) in enumerate(tree.nodes):
        assert (tree.floats[first:last] @ queries.T <= bounds[:, n]).all() and least == tree.ids[first:last].min()
    leaves = [n for n, (a, _) in enumerate(tree.children) if a < 0]
    fifth = np.sort(tree.floats @ queries.T, axis=0)[-5]
    assert (bounds[:, leaves] < fifth[:, None]).mean() > 0.3


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_says_the_same(spark, sf):
    from checks.compare import connect, rows_of_spark, rows_of_sql

    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    assert rows_of_spark(top_k(df, df.where("vec_id % 50 = 0"))) == rows_of_sql(connect(f"/root/testdata/{sf}"), top_k_sql())
