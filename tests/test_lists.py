"""Long lists of words against plain loops."""

import random

from lintlake.operators.lists import filter_whitelist_table, texts_with_any


def test_texts_with_any_word(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdé. ") for _ in range(rnd.randint(0, 14))) for _ in range(600)] + ["", "a", "ab", "aaaaaaaa"] + [None]
    for sizes in ((1, 2, 3, 4, 5, 7), (3, 5)):
        words = {"".join(rnd.choice("abcdé. ") for _ in range(rnd.choice(sizes))) for _ in range(25)}
        # one letter stands in nearly every text: rare enough here
        words = {w for w in words if len(w) > 1 or w == "é"} | {"zzzz"}
        rows = spark.createDataFrame([(t,) for t in texts * 2], "text string")
        table = spark.createDataFrame([(w,) for w in words] * 2 + [("",), (None,)], "word string")
        got = sorted(r.text for r in texts_with_any(rows, table).collect())
        assert got == sorted({t for t in texts if t is not None and any(w in t for w in words)}) and got


def test_findings_and_empty_lists(spark):
    found = spark.createDataFrame([("a.js", 1, "render(x)"), ("a.js", 2, "go(x)"), ("b.js", 3, "render(y)")], "path string, line_no int, text string")
    words = spark.createDataFrame([("render",), ("y)",)], "word string")
    assert [tuple(r) for r in filter_whitelist_table(found, words).collect()] == [("a.js", 2, "go(x)")]
    assert filter_whitelist_table(found, words.limit(0)).count() == 3
    assert filter_whitelist_table(found.limit(0), words).count() == 0


def test_many_names_make_no_longer_plan(spark):
    found = spark.range(2000).selectExpr("concat('call', id, '(', id % 7, ')') AS text", "id")
    names = spark.range(100_000).selectExpr("concat('all', id * 3) AS word")
    left = {r.id for r in filter_whitelist_table(found, names).collect()}
    want = {n for n in range(2000) if not any(int(str(n)[:k]) % 3 == 0 and str(int(str(n)[:k])) == str(n)[:k] for k in range(1, len(str(n)) + 1))}
    assert left == want and want
