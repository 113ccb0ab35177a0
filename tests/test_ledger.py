"""The log of reviews, the stream's state, the pruned listing."""

from collections import Counter

from pyspark.sql import functions as F

from lintlake import ReviewConfig, review_files
from lintlake.operators.ledger import Ledger
from lintlake.sources import corpus
from lintlake.streaming.continuous import continuous_review

BAD = "eval(x);\nvar y = 1;\nif (a == b) {\n}\n"


def bag(df):
    return Counter(tuple(r) for r in df.select("path", "line_no", "rule_id", "message", "severity").collect())


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_log_follows_the_corpus(spark, files_of, tmp_path):
    config = ReviewConfig()
    log = Ledger(spark, f"{tmp_path}/log", config)
    assert log.findings().count() == 0 and log.frameworks() == []
    texts = {"a.js": BAD, "b.js": BAD + "useEffect(() => {});\n", "c.ts": "exec(y);", "vendor/x.js": BAD, "/r/vendor/y.js": BAD, "n.txt": BAD}
    log.update(files_of(texts))
    assert bag(log.findings()) == bag(review_files(files_of(texts), config))
    texts |= {"a.js": "exec(z);", "d.js": "import React from 'react';\n" + BAD}
    second = log.update(files_of(texts))
    assert bag(log.findings()) == bag(review_files(files_of(texts), config)) and log.frameworks() == ["react"]
    batches = {r.path: r.reviewed for r in log.current().collect()}
    assert batches["a.js"] == batches["c.ts"] == second  # a new framework: findings of every file may differ
    # a deletion takes the framework with it
    del texts["d.js"]
    log.update(files_of(texts))
    third = log.update(files_of({**texts, "e.js": "eval(x);"}))
    assert {r.path for r in spark.read.parquet(f"{tmp_path}/log/findings/batch={third}").select("path").distinct().collect()} == {"e.js"}  # only what is new
    log.remove(paths(spark, "e.js"))
    assert bag(log.findings()) == bag(review_files(files_of(texts), config)) and log.frameworks() == [] and log.out_of_date().count() == 0
    small = log.compact(f"{tmp_path}/small")
    assert bag(small.findings()) == bag(log.findings()) and small.log().count() == log.current().count()
    assert small.update(files_of(texts)) == 2 and spark.read.parquet(f"{tmp_path}/small/findings/batch=2").count() == 0


def test_change_lists_invalidation_and_removal(spark, files_of, tmp_path):
    config = ReviewConfig()
    log = Ledger(spark, f"{tmp_path}/log", config)
    texts = {"a.js": BAD, "b.js": BAD, "c.js": "import React from 'react';\n" + BAD}
    log.update(files_of(texts))
    texts["a.js"] = "exec(q);\nuseState(1);"
    batch = log.change(files_of({"a.js": texts["a.js"]}))  # no other file is at hand
    assert bag(log.findings()) == bag(review_files(files_of(texts), config))
    assert {r.path for r in spark.read.parquet(f"{tmp_path}/log/findings/batch={batch}").select("path").distinct().collect()} == {"a.js"}
    log.invalidate(paths(spark, "b.js", "nowhere.js"))
    assert [r.path for r in log.out_of_date().collect()] == ["b.js"]
    again = log.update(files_of(texts))
    assert {r.path: r.reviewed for r in log.current().collect()}["b.js"] == again
    log.remove(paths(spark, "c.js"))
    del texts["c.js"]
    assert {r.path for r in log.out_of_date().collect()} == {"a.js", "b.js"}  # the framework went with it
    log.update(files_of(texts))
    assert bag(log.findings()) == bag(review_files(files_of(texts), config)) and log.out_of_date().count() == 0
    log.invalidate()
    assert log.out_of_date().count() == 2
    # a batch that died after its findings is written again under its number
    n = log.next_batch()
    log.findings().limit(1).write.parquet(f"{tmp_path}/log/findings/batch={n}")
    assert log.update(files_of(texts)) == n and bag(log.findings()) == bag(review_files(files_of(texts), config))


def test_stream_state_is_keyed(spark, files_of, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(texts, config=None, horizon=None):
        files_of(texts).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = continuous_review(stream, out, config, horizon)
        query.awaitTermination()
        state = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
        return sum(r[0] for r in spark.read.parquet(f"{out}/findings").groupBy("batch").count().select("count").collect()), state[-1][0] if state else None

    first, before = arrive({"a.js": BAD, "b.js": BAD})
    same, after = arrive({"b.js": BAD})
    assert same == first > 0 and after["numRowsTotal"] == before["numRowsTotal"]
    more, after = arrive({"b.js": BAD + "eval(z);"})
    assert more > first and after["numRowsTotal"] > before["numRowsTotal"]
    # keys, not earlier batches, are what is kept
    assert not (tmp_path / "out" / "state").exists()


def test_files_that_are_left_out_are_not_opened(spark, tmp_path):
    root = tmp_path / "my tree+x"
    for path in ("a.js", "src/b.py", "src/my file+1.js", "node_modules/big.js", "vendor/big.js", "x.min.js", "notes.txt", "big.ts"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("eval(x);" * (5000 if "big" in path else 1))
    (root / "broken.js").write_bytes(b"ev\xffal(x);")
    found = corpus.read_tree(spark, str(root), ignore_patterns=("*.min.js",), max_bytes=1000)
    texts = {r.path.split("x/", 1)[1]: r.content for r in found.collect()}
    assert set(texts) == {"a.js", "src/b.py", "src/my file+1.js", "broken.js"} and texts["broken.js"] == "ev�al(x);"
    plan = found._jdf.queryExecution().executedPlan()
    scans = [p for p in _nodes(plan) if "FileScan" in p.nodeName() or "Scan binaryFile" in p.nodeName()]
    scans[0].execute().count()
    assert scans[0].metrics().apply("numFiles").value() == 4
    whole = corpus.scan_corpus(corpus.read_folder(spark, str(root)), ignore_patterns=("*.min.js",))
    assert {r.path for r in corpus.read_tree(spark, str(root), ignore_patterns=("*.min.js",)).collect()} == {r.path for r in whole.collect()}
    assert found.where(F.col("path").contains("big")).count() == 0


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        children = p.children()
        todo += [children.apply(i) for i in range(children.length())]
    return out
