import collections
import hashlib
import random

import pytest

from lintlake.llm import substrings
from lintlake.llm.substrings import without_repeats


def brute(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[p:p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3000, 8 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    rng = random.Random(block)

    def prose(n):
        return "".join(rng.choices("abcdé  etaoin\n", k=n))

    passages = [prose(k) for k in (150, 199, 200, 201, 260, 500, 900)] + ["é" * 100, "ab" * 150, "x" * 199, "word " * 60]
    rows = []
    for i in range(150):
        parts = [prose(rng.randrange(300)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) // 3))
            parts.insert(rng.randrange(len(parts) + 1), p[a:] if rng.random() < 0.5 else p[:len(p) - a])
        rows.append((i, "".join(parts)))
    variants = prose(1500)
    for i in range(25):
        v = list(variants)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = "#"
        rows.append((200 + i, "".join(v)))
    rows += [(300, None), (301, ""), (302, "y" * 150), (303, "z" * 200), (304, "q" * 201), (305, "q" * 5000), (306, "ab" * 3000), (None, rows[0][1] * 2), (307, "Orre " * 2000)]
    rows += [rows[3], rows[3], (308, prose(199)), (309, rows[-1][1] if rows[-1][1] else "")]
    df = spark.createDataFrame([(a, b, 1, "m") for a, b in rows], "doc_id long, text string, block int, mark string")
    got = sorted((tuple(r) for r in without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 60 and sum(0 < r[2] < r[1] for r in got) > 40


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert without_repeats(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")).count() == 2
