import random

import pytest

from lintlake.llm import decontaminate
from lintlake.llm.decontaminate import Items, clean, contaminated, overlaps, seeds_of, short_stretches, tokens

DOCS = "doc_id long, text string, item_id string, matches string"


def stretches(same, least, share):
    """Most matches of any stretch that meets the criterion; 0 if none does."""
    best = 0
    for x in range(len(same)):
        m = 0
        for y in range(x, len(same)):
            m += same[y]
            if m >= least and m >= share * (y + 1 - x):
                best = max(best, m)
    return best


def brute(docs, items, least=8, share=0.75):
    """The criterion alone: every diagonal, every stretch, no seeds and none of the operator's own parts."""
    out = set()
    for d, text in docs:
        t = tokens((text or "").encode())
        for i, item in items:
            own = tokens((item or "").encode())
            best = 0
            for shift in range(-len(own) + 1, len(t)) if set(t) & set(own) else []:
                same = [t[j + shift] == own[j] for j in range(len(own)) if 0 <= j + shift < len(t)]
                if sum(same) >= min(least, len(own)):
                    best = max(best, stretches(same, min(least, len(own)), share))
            if best:
                out.add((d, i, best))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (block,))
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["Größe", "É"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 12, 20, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (53, "W1, w2"), (53, "W1, w2")]
    docs = []
    for k in range(40):
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 30]))
        part = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "zzz"
        at = rng.randrange(len(words) + 1)
        docs.append((k, ", ".join(words[:at] + part + words[at:]).upper() if k % 2 else " ".join(words[:at] + part + words[at:])))
    docs += [(100, None), (101, ""), (102, "x " * 50_000)]
    df = spark.createDataFrame([(a, b, "c", "d") for a, b in docs], DOCS)
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in contaminated(df, bench).collect()}
    want = brute(docs, dict(items).items())
    assert got == want
    assert sorted(r["doc_id"] for r in clean(df, bench).collect()) == sorted({d for d, _ in docs} - {x[0] for x in want})


def test_substitutions_are_tolerated_and_empties_are_fine(spark):
    item = " ".join(f"t{i}" for i in range(40))
    words = item.split()
    for i in (6, 13, 25, 33):
        words[i] = "other"
    df = spark.createDataFrame([(1, "a b " + " ".join(words) + " c", "", ""), (1, "a b " + " ".join(words) + " c", "", ""), (2, "t1 t2 t3", "", "")], DOCS)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    rows = contaminated(df, bench).collect()
    assert [(r["doc_id"], r["matches"], r["first_token"], r["end_token"]) for r in rows] == [(1, 36, 2, 42)] * 2
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0
    assert clean(df, bench.limit(0)).count() == 3


@pytest.mark.parametrize("least", [8, 5, 11])
def test_every_overlap_that_meets_the_criterion_is_found(spark, least):
    rng = random.Random(11)
    items = [(n * 100 + k, " ".join(f"t{n}x{k}y{j % 40}" for j in range(n))) for n in (3, 5, 7, 8, 9, 11, 12, 15, 16, 20, 25, 60) for k in range(2)]
    docs = []
    for k in range(120):
        part = rng.choice(items)[1].split()
        for i in rng.sample(range(len(part)), min(len(part) - 1, rng.randrange(1 + len(part) // 3))):
            part[i] = rng.choice(["zzz", "t12x0y3"])
        docs.append((k, " ".join(["a b"] * (k % 2) + part[rng.randrange(3) * (k % 3 == 0):] + ["t9x0y0"] * (k % 5))))
    fourth = items[-1][1].split()
    docs += [(1000, " ".join("zzz" if i % 4 == 3 else w for i, w in enumerate(fourth))), (1001, " ".join(["zzz"] + items[12][1].split()[1:])), (1002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string"), least).collect()}
    assert got == brute(docs, items, least)
    assert (1000, items[-1][0]) in {x[:2] for x in got} and (1001, items[12][0]) in {x[:2] for x in got}


@pytest.mark.parametrize("least,share", [(8, 0.75), (8, 0.8), (5, 0.75), (11, 0.75), (3, 0.75), (1, 0.75)])
def test_random_diagonals(least, share):
    """Items against copies of themselves with random substitutions: seeds, stretches around them and the best one against the criterion alone."""
    rng = random.Random(least)
    found = missed = 0
    for _ in range(1500):
        n = rng.choice([1, 3, 6, 8, 9, 10, 12, 16, 24, 60])
        words = [f"t{i}" for i in range(n)]
        rate = rng.choice([0.1, 0.2, 0.25, 0.3, 0.4])
        text = ["x"] * rng.randrange(3) + [w if rng.random() > rate else "x" for w in words] + ["x"] * rng.randrange(3)
        block = Items([(1, b"other words"), (7, " ".join(words).encode())], least, share)
        _, got, _ = overlaps([b"", " ".join(text).encode(), b"x y"], block)
        want = stretches([w != "x" for w in text], min(least, n), share)
        assert (got[1][0] if 1 in got else 0) == want, (text, got, want)
        found, missed = found + bool(want), missed + (not want)
    assert found > 100 and (missed > 100 or least < 8)


def test_every_short_stretch_holds_a_seed():
    lead, others = seeds_of(5, 8, 0.75)
    masks = [{*range(lead), *r} for r in others]
    for kind in short_stretches(8, 0.75):
        ones = {i for i, c in enumerate(kind) if c == "1"}
        assert any({i + s for i in m} <= ones for m in masks for s in range(len(kind)))


def test_further_matches_never_take_a_report_away(spark):
    """An item of 130 tokens: 12 of them exact, then pieces of 10 with 7 matches each, which lower the share of the whole."""
    words = [f"t{i}" for i in range(130)]
    exact = words[:12] + ["x"] * 118
    more = words[:12] + [w if i % 10 < 7 else "x" for i, w in enumerate(words[12:])]
    df = spark.createDataFrame([(1, " ".join(exact)), (2, " ".join(more)), (3, " ".join(words))], "doc_id long, text string")
    rows = {r["doc_id"]: r["matches"] for r in contaminated(df, spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")).collect()}
    assert rows[1] == 12 and rows[2] >= rows[1] and rows[3] == 130


def test_short_items_are_reported_but_take_no_document_away(spark):
    docs = spark.createDataFrame([(1, "yes we can"), (2, "no 42"), (3, "a b c d e f g h i")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes."), (2, "42"), (3, "a b c d e f g"), (4, "b c d e f g h i")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == {(1, 1), (2, 2), (3, 3), (3, 4)}
    assert sorted(r["doc_id"] for r in clean(docs, bench).collect()) == [1, 2]
