import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import turntree
from lintlake.llm.running import running
from lintlake.llm.turntree import conversation_trie, rebuilt_trie, rebuilt_trie_sql

KIND = "conv_id long, turn long, role string, text string, key string, depth int"


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest(), (role, text)))
    return {c: [x[-1] for x in sorted(ts)] for c, ts in convs.items()}


def remade(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(np.fmod(c, 20))
        out[c] = convs.get(donor, [])[:h] + ts[h:]
    return out


def brute(convs):
    members, kids = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0) + sum(saved[x] for x in kids[k])
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def mixed_rows():
    rng = np.random.default_rng(4)
    rows = [(int(c), t, "user", f"w{rng.integers(0, 2)} w{rng.integers(0, 2)}\n x") for c in range(120) for t in range(rng.integers(1, 9))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(90) for t in range(11)]  # a third of all conversations are alike, some longer
    rows += [(200 + c, 11 + t, None, "tail") for c in range(0, 90, 7) for t in range(c % 3)]
    rows += [(400, t, "a", f"long {t % 50}") for t in range(900)]  # one conversation holds most turns
    rows += [(420, t, "a", f"long {t % 50}") for t in range(950)]
    rows += [(441, 0, "u", None), (441, None, None, "first of all"), (441, 0, "u", ""), (442, 5, "u", "x"), (-7, 0, "u", "negative"), (-20, 3, "u", "donor"), (None, 0, "u", "nobody")]
    rows += [(500, 1, "ab", "c"), (520, 1, "a", "bc"), (540, 1, "a", "b c d e")]
    return rows


def test_against_brute_force(spark, mixed_rows, monkeypatch):
    monkeypatch.setattr(turntree, "RUN", 5)
    assert result(rebuilt_trie(table(spark, mixed_rows))) == brute(remade(turns_of(mixed_rows)))


@pytest.mark.parametrize("block", [1, 3])
def test_as_they_are(spark, mixed_rows, monkeypatch, block):
    monkeypatch.setattr(turntree, "BLOCK", block)
    rows = [r for r in mixed_rows if r[1] is None or r[1] < 40]
    assert result(conversation_trie(table(spark, rows))) == brute(turns_of(rows))


def test_empty_table(spark):
    assert result(rebuilt_trie(table(spark, []))) == []


def test_turnless_only(spark):
    """Conversation 5 gives its one turn away (crc32('5') mod 4 is 1 or more) and has no donor."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert result(rebuilt_trie(table(spark, [(c, 0, "u", "x")]))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_running_sums_of_a_key_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(0 if n < 400 else int(n) // 7, n, int(x)) for n, x in enumerate(rng.integers(-(2**63), 2**63 - 1, 1000))]
    got = running(spark.createDataFrame(rows, "k long, n long, x long").repartition(7), "k", [F.col("k"), F.col("n")], ["x"]).collect()
    sums, want = defaultdict(int), {}
    for k, n, x in rows:
        want[n] = (sums[k] + 2**63) % 2**64 - 2**63
        sums[k] += x
    assert {r["n"]: r["before_x"] for r in got} == want


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_says_the_same(spark, sf):
    from checks.compare import connect, rows_of_spark, rows_of_sql

    mine = rows_of_spark(rebuilt_trie(spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")))
    assert mine == rows_of_sql(connect(f"/root/testdata/{sf}"), rebuilt_trie_sql())
