import random
import re

from lintlake.llm.urls import LIST_RULES, Automaton, Rule, judge, judge_sql, rules_of


def as_regex(glob):
    return re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {"\\*\\*": ".*", "\\*": "[^/]*", "\\?": "."}[m[0]], re.escape(glob))


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choices(["a", "b", "/", ".", "*", "**", "?"], k=rng.randint(0, 12))) for _ in range(120)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["x" * 200 + "*"]
    automaton = Automaton([Rule(g, "block") for g in globs])
    urls = ["".join(rng.choices("ab/.", k=rng.randint(0, 14))) for _ in range(400)] + ["x" * 300, ""]
    got = automaton.matches([u.encode() for u in urls])
    assert automaton.words > 5
    for i, u in enumerate(urls):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(re.fullmatch(as_regex(g), u, re.S)), (u, g)


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in LIST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1?x", "http://a.example.org/en/1", "http://a.example.org/en/2", "http://notexample.org/es/",
            "http://x.com/fr/a", "http://x.com/de/#x", "http://x.com/dex", "http://xcom/fr/", "http://org/", "http://org", "http://org?x/", "http://x.net/a.org/b",
            "http://spam.net/a", "http://a.net/spam", "http://cheap-pills.org/x", "a://b://c/d", "http://É.com/fr/é", "http://x.net/" + "y" * 100_000, "http://a.net/f.exe", "http://a.net/x\ny"] * 2
    df = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls)] + [(None, "http://x.org/", 1, "r")], "page_id long, url string, host int, rule string")
    rows = judge(df).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        url = "http://x.org/" if r["page_id"] is None else urls[r["page_id"]]
        host, path, rule = brute(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        if rule:
            assert r["verdict"] == dict(LIST_RULES)[rule]
    by = {u: r["verdict"] for r in rows if r["page_id"] is not None for u in [urls[r["page_id"]]]}
    assert by["http://spam.net/a"] == by["http://a.net/f.exe"] == "block" and by["http://a.net/spam"] == by["no scheme"] == "allow"
    assert judge(df.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    from checks.compare import connect, rows_of_spark, rows_of_sql

    sf = "/root/testdata/sf0.001"
    assert rows_of_spark(judge(spark.read.parquet(f"{sf}/pages.parquet"))) == rows_of_sql(connect(sf), judge_sql())


def test_rule_order():
    assert [r.listed for r in rules_of()][:3] == ["example.org/en/1", "example.org/es/", "com/de/"]
