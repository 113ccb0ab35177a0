import random

import pytest

from lintlake.llm import mixing
from lintlake.llm.mixing import flight, land, mix, taken_rows, taken_words


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        per = left / sum(weight[s] for s in free)
        above = {s for s in free if per * weight[s] > 2 * sizes[s]}
        if not above:
            out |= {s: per * weight[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return out


def test_flight_keeps_both_totals_and_probabilities():
    rng = random.Random(1)
    sizes = [rng.choice([0, 5, 5, 9, 100, 10_000]) for _ in range(500)]
    p = [0.3] * 500
    hits = [0.0] * 500
    for k in range(200):
        q = flight(sizes, p, random.Random(k))
        assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, sizes)) - 0.3 * sum(sizes)) < 1e-3
        assert sum(0 < x < 1 for x in q) <= 2
        hits = [a + b for a, b in zip(hits, q)]
        assert all(x in (0, 1) for x in land(sizes, q))
    assert all(0.15 < h / 200 < 0.46 for h in hits)


@pytest.mark.parametrize("block", [40, 4096])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 30, 80, 300]), rng.choice(["b", "b", "b", "b", "a", "é", "Z", None, "z"]), "x") for i in range(1500)]
    rows += [(2000, None, "empty", "x"), (None, "a b c", "a", "x"), (2002, "q r", "a", "x"), (2002, "q r", "a", "x"), (2001, "v " * 20_000, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = taken_words(mix(df)).collect()
    again = taken_words(mix(df.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    source_of = {r[0]: r[2] for r in rows}
    total = {}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        total[s] = total.get(s, 0) + r["taken"]
    longest = {s: max(len((r[1] or "").split()) for r in rows if r[2] == s) for s in want}
    assert all(abs(total[s] - want[s]) <= longest[s] / 2 + 1 for s in want)
    kept = taken_rows(df, mix(df)).collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in kept if r["text"]) == sorted((str(r["doc_id"]), r["taken"] // r["size"]) for r in got if r["taken"])


@pytest.mark.parametrize("run", [7, 1 << 16])
def test_many_equal_rows_meet_the_target(spark, monkeypatch, run):
    """A source of one text many times over, with rows that differ in another column only, some under a null id."""
    monkeypatch.setattr(mixing, "RUN", run)
    ten = "w " * 10
    rows = [(i, ten, "a", str(i)) for i in range(2000)] + [(5000, ten, "b", str(i % 3)) for i in range(900)] + [(6000 + i, ten, "b", "") for i in range(100)]
    rows += [(None, ten, None, "n")] * 301 + [(7000, ten, "c", "c")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    sizes = {s: 10 * sum(r[2] == s for r in rows) for s in ("a", "b", "c", None)}
    want = brute_targets(sizes)
    source_of = {r[0]: r[2] for r in rows}
    got = taken_words(mix(df)).collect()
    assert len(got) == len(rows) and all(r["taken"] in (0, 10, 20) for r in got)
    kept = taken_rows(df, mix(df)).collect()
    for s in want:
        assert abs(sum(r["taken"] for r in got if source_of[r["doc_id"]] == s) - want[s]) <= 5.001
        assert sum(10 * r["copies"] for r in kept if r["source"] == s) == sum(r["taken"] for r in got if source_of[r["doc_id"]] == s)
    again = taken_rows(df.repartition(5), mix(df.repartition(3))).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))
    assert all(1 <= r["copies"] <= 2 for r in kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken_words(mix(df)).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in taken_words(mix(df)).collect()] == [0, 0]
