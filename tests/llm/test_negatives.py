import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import negatives
from lintlake.llm.blocks import squeezed
from lintlake.llm.negatives import ANCHOR, LABEL, Columns, hard_negatives, hard_negatives_sql

KIND = "vec_id long, embedding array<float>, label int, score int, n string"


def brute(rows, k=5):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, label, av in {(i, l, tuple(v)) for i, l, v in good if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for i, l, v in good if i != a and len(v) == len(av))
        for ps, p, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:k]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], KIND)
    return sorted(tuple(r) for r in hard_negatives(df, F.expr(ANCHOR), F.expr(LABEL)).collect())


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("PACK", 60), ("ANCHORS", 3), ("ZONE", 16), ("STEP", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 11))
    vectors = (centres[rng.integers(0, 6, 900)] + 0.4 * rng.normal(size=(900, 11))).astype(np.float32).tolist()
    rows = [(n, v, int(label)) for n, (v, label) in enumerate(zip(vectors, rng.integers(0, 4, 900)))]
    rows += [(n, vectors[300], n % 3) for n in range(900, 1300)]  # one vector holds a third of all rows: ties
    rows += [(100, vectors[100], rows[100][2]), (2000, None, 1), (2100, vectors[0], None), (2200, [float("nan")] * 11, 1), (2300, [None] * 11, 1), (None, vectors[0], 1)]
    rows += [(2400, [1.0, 2.0], 1), (2401, [1.0, 2.0], 1), (2402, [1.0, 1.9], 2), (2500, [], 3), (2501, [], 3), (2502, [], 4), (2600, [3.0, float("inf")], 1)]
    rows += [(2700, [-1.0] * 3, 5), (2701, [1.0] * 3, 5), (2702, [1.0] * 3, 6)]  # a negative positive score
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 2), (2, [1.0], 3)]) == []


def test_large_components(spark):
    rows = [(n, [3e5 * (n % 9), -2e5 + n, 1e5], n % 3) for n in range(240)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        run(spark, [(n, [1e15, 1.0], 1) for n in range(100, 104)])


def test_scan_prunes_and_is_exact():
    rng = np.random.default_rng(9)
    v = rng.integers(-60, 60, (2000, 32)) + np.repeat(rng.integers(-200, 200, (20, 32)), 100, axis=0)
    pack = Columns(squeezed(ids=np.arange(2000), labels=np.zeros(2000, np.int64), columns=np.ascontiguousarray(v.T).astype(np.int16).reshape(-1)))
    q = v[7]
    scores = v @ q
    for low, high in ((np.sort(scores)[-5], np.inf), (np.sort(scores)[500], np.sort(scores)[520]), (10**9, np.inf)):
        rows, found = pack.scan(q, np.ones(2000, bool), low, high)
        assert rows.tolist() == np.flatnonzero((scores >= low) & (scores <= high)).tolist() and (found == scores[rows]).all()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_says_the_same(spark, sf):
    from checks.compare import connect, rows_of_spark, rows_of_sql

    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    mine = rows_of_spark(hard_negatives(df, F.expr(ANCHOR), F.expr(LABEL)))
    assert len(mine[1]) > 5 and mine == rows_of_sql(connect(f"/root/testdata/{sf}"), hard_negatives_sql())
