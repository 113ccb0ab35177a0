import random
import re

import numpy as np
import pytest
import xxhash

from lintlake.llm.graph import components
from lintlake.llm.simhash import Forest, Sets, compare, compare_sets, fingerprint, near_duplicates, order_key, shingles

ODD = "doc_id long, text string, fp string, component_id string, u string"


def roots(n, links):
    forest = Forest(n)
    forest.grow(*np.array(links, np.int64).reshape(-1, 2).T)
    return [forest.root(x) for x in range(n)]


def brute(rows, size=3, radius=3):
    out = []
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        out.append((doc_id, fp))
    near = [(i, j) for i in range(len(out)) for j in range(i) if (out[i][1] ^ out[j][1]).bit_count() <= radius]
    root = roots(len(out), near)
    least = {}
    for (doc_id, _), r in zip(out, root):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, f"{fp:016x}", least.get(r)) for (d, fp), r in zip(out, root)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_brute_force_and_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 40, 200]))
        rows.append((i * 3 + 1, " ".join(words)))
        for k in range(rng.randrange(3)):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i * 3 + 2 + k, "\t".join(words)))
    rows += [(900, None), (901, ""), (902, "  \n"), (5, rows[0][1]), (None, rows[0][1]), (None, "alone here now"), (903, "x " * 200_000), (900, None)]
    df = spark.createDataFrame([(a, b, "x", "y", None) for a, b in rows], ODD)
    assert rows_of(near_duplicates(df)) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], ODD)).count() == 0


@pytest.mark.parametrize("radius,words", [(3, 1), (16, 1), (32, 2)])
def test_compare_is_exact(radius, words):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (900, words), dtype=np.uint64)
    near = base[:500].copy()
    for _ in range(radius):
        near ^= (np.uint64(1) << rng.integers(0, 64, near.shape).astype(np.uint64)) * (rng.random(near.shape) < 0.7)
    fps = sorted({r.tobytes() for r in np.concatenate([base, near])}, key=lambda b: (order_key(b), b))
    fps = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, words)
    bits = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = roots(len(fps), np.argwhere(np.triu(bits <= radius, 1)))
    assert roots(len(fps), compare(fps, fps, radius, True)) == want
    half = len(fps) // 2
    parts = compare(fps[:half], fps[:half], radius, True) + [(i, j + half) for i, j in compare(fps[:half], fps[half:], radius, False)]
    parts += [(i + half, j + half) for i, j in compare(fps[half:], fps[half:], radius, True)]
    assert roots(len(fps), parts) == want


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(1000 + i, 2000) for i in range(300)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[1000 + i] == 1000 for i in range(300))
    assert got[2000] == 1000 and got[6] == got[5] == 5 and 7 not in got and 3 not in got


def test_similarity_is_checked(spark):
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(400)]
    close, far = list(base), list(base)
    for i in range(5, 400, 100):
        close[i] = f"n{i}"
    for i in range(5, 400, 12):
        far[i] = f"m{i}"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(far)), (4, "a b c d e f g")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 5, 64, 2, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_repeated_line_makes_no_copies(spark):
    """Texts of one line, a thousand times, and of prose of their own are not alike; texts of one set of shingles are, however often it repeats."""
    rng = random.Random(2)

    def prose():
        return " ".join(f"t{rng.randrange(10**6)}" for _ in range(200))

    texts = ["la " * 1000 + prose(), "la " * 1000 + prose(), "la " * 1000 + prose()]
    texts += [texts[0].replace("la ", "", 900), " ".join(["one two three four five six seven eight"] * 3), " ".join(["one two three four five six seven eight"] * 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 5, 32, 2, 0.8).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 4}


def family(rng, n):
    """Edited copies of edited copies: many pairs just below and just above the similarity."""
    texts = [[f"t{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120]))]]
    while len(texts) < n:
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


def sets_of(texts, size=5):
    words = [t.encode().split() for t in texts]
    grams = [{xxhash.xxh3_64_intdigest(g) >> 1 for g in shingles(w, size)} for w in words]
    return [fingerprint(w, size, 2, True) for w in words], grams


def test_no_candidate_is_left_unchecked(spark, monkeypatch):
    rng = random.Random(3)
    texts = [t for _ in range(12) for t in family(rng, 50)] + ["", "one two"]
    fps, grams = sets_of(texts)

    def linked(i, j):
        near = sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j])) <= 32
        return fps[i] == fps[j] or near and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) > 0

    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if linked(i, j)])
    assert 20 < len(set(want)) < 500
    whole = Sets(np.frombuffer(b"".join(fps), np.uint64).reshape(-1, 2), np.array([len(g) for g in grams]), np.concatenate([np.array(sorted(g), np.int64) for g in grams]))
    assert roots(len(texts), compare_sets(whole, whole, 32, 0.8, True)) == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (4096, 24):  # all in one tile; groups over many tiles
        monkeypatch.setattr("lintlake.llm.simhash.SET_TILE", most)
        monkeypatch.setattr("lintlake.llm.simhash.CHECKS", most)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 5, 32, 2, 0.8).collect()}
        assert [got[i] for i in range(len(texts))] == want


def stays(rows):
    """One row of each group: groups by Jaccard similarity of sets of five-word runs, ids and fingerprints ascending."""
    from lintlake.llm.simhash import fingerprint, shingles, words_of

    named = sorted({(i, fingerprint(words_of((t or "").encode()), 5, 2, True).hex(), t) for i, t, _ in rows if i is not None}, key=str)
    sets = [set(shingles(words_of((t or "").encode()), 5)) for _, _, t in named]
    parent = list(range(len(named)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if named[a][1] == named[b][1] or both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best = {}
    for n, (i, fp, _) in enumerate(named):
        best[root(n)] = min(best.get(root(n), (i, fp)), (i, fp))
    kept = set(best.values())
    out = {}
    for i, t, lang in rows:
        key = (i, fingerprint(words_of((t or "").encode()), 5, 2, True).hex())
        if i is not None and key in kept:
            out.setdefault(key, []).append((i, t, lang))
    return out, sorted(((t, lang) for i, t, lang in rows if i is None), key=str)


def test_one_of_each_is_decided_by_row(spark):
    import random

    from lintlake.llm.simhash import one_of_each

    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(80)) for _ in range(14)]
    a, b, c, d = texts[:4]
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, c, "x"), (9, d, "x")]
    rows += [(rnd.randint(20, 60), t + rnd.choice(["", "", " tail", "  "]), rnd.choice("xyz")) for t in texts[4:] for _ in range(8)]
    rows += [(70, None, "x"), (70, "", "y"), (71, "", "x"), (None, a, "x"), (None, a, "x"), (None, None, None), (80, "one", "x"), (80, "two", "x"), (80, "one", "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = [tuple(r) for r in one_of_each(df, 5, 32, 2, 0.8).collect()]
    groups, unnamed = stays(rows)
    named = [r for r in got if r[0] is not None]
    assert sorted(((t, lang) for i, t, lang in got if i is None), key=str) == unnamed
    assert len(named) == len(groups) and all(sum(r in some for r in named) == 1 for some in groups.values())
    assert {(3, a, "x"), (7, b, "x"), (9, c, "x"), (9, d, "x"), (80, "one", "w"), (80, "two", "x")} <= set(named) and (7, a, "x") not in named
    again = [tuple(r) for r in one_of_each(df.repartition(3), 5, 32, 2, 0.8).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    assert one_of_each(df.limit(0), 5, 32, 2, 0.8).count() == 0
