"""Words a pattern needs, and many rules chosen by one expression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.catalog import rules as R
from lintlake.functions.literals import beginnings, required_literals, word_tree
from lintlake.operators import scan


@pytest.mark.parametrize("pattern, words", [
    (r"licen[sc]e\s*=", ("licence", "license")), (r"(?i)\bEval\s*\(", ("eval",)), (r"(?:foo|ba[rz])+x?", ("bar", "baz", "foo")), (r"x+y*ab", None), (r"(?:long|\w+)", None),
    (r"a(?=b)bcd", ("abcd",)), (r"(ab)?cde", ("cde",)), (r"café au lait", (" au lait",)), (r"\p{L}foo", None), (r"(unclosed", None), (r"", None),
    (r"one\s+(two|three)\s+four", ("four",))])
def test_needed_words(pattern, words):
    assert required_literals(pattern) == words


def test_every_match_holds_a_needed_word():
    rnd = random.Random(3)
    bits = ["eval", "(", ")", " ", "new ", "Function", "md5", "a", "b", "x.y", "==", "'", "SELECT * FROM t", "os.system(", "${x};", "pickle.load(", "0", "../", "for (", "password = 'abcd1'", "console.log(", "+ 'q'"]
    lines = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 8))) for _ in range(4000)]
    rules, seen = [r for r in R.BY_UID.values() if r.pattern], 0
    for r in rules:
        words = required_literals(r.pattern)
        for line in lines if words else ():
            if re.search(r.pattern.replace("[^[\\]]", r"[^\[\]]"), line, re.I if r.ignore_case else 0):
                seen += 1
                assert any(w in line.lower() for w in words), (r.uid, line)
    assert seen > 500 and sum(required_literals(r.pattern) is not None for r in rules) > 30


def test_tree_finds_the_longest_word_at_every_place(spark):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc.$[") for _ in range(rnd.randint(3, 6))) for _ in range(150)} | {"abc", "abcabc", "a^-]b"}
    texts = ["".join(rnd.choice("abc.$[^-]") for _ in range(60)) for _ in range(300)]
    pattern = f"(?=({word_tree(words)}))"
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(pattern), 1).alias("w")).collect()}
    for t in texts:
        longest = [max((w for w in words if t.startswith(w, i)), key=len, default=None) for i in range(len(t))]
        assert got[t] == [w for w in longest if w]
        assert {b for w in got[t] for b in beginnings(w, words)} == {w for w in words if w in t}


def test_many_rules_chosen_or_tried_one_by_one(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["alpha", "alphabet", "beta", "Gamma", "delta.", "eps", "zeta("]
    patterns = [rnd.choice([r"\b{0}\b", r"{0}\s*{1}", r"(?:{0}|{1})x", r"{0}.*{1}", r"[{0}]+\d", r"^{0}"]).format(*[re.escape(w) for w in rnd.sample(words, 2)]) for _ in range(400)]
    rules = [R.Rule(f"Z{n}", 6, n, f"rule/{n}", "BadPractice", "Low", 0.8, None, p, "m", "e", "f", ignore_case=n % 3 == 0) for n, p in enumerate(patterns)]
    lines = [("a.js", "javascript", "c-style", n, " ".join(rnd.choice([*words, "ALPHA", "x", "betax", "7"]) for _ in range(rnd.randint(0, 5)))) for n in range(300)]
    df = spark.createDataFrame(lines, "path string, lang_id string, family string, line_no int, text string")

    def found(many):
        monkeypatch.setattr(scan, "MANY_WORDS", many)
        return sorted(tuple(r) for r in scan.scan_rules(df, rules, exact_edges=True).select("uid", "line_no", "ord").collect())

    chosen = found(1)
    assert chosen == found(10**9) and len(chosen) > 3000
