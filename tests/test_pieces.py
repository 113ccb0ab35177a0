"""Long files in pieces give the findings of whole files."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake import ReviewConfig, review_files
from lintlake.operators import pieces
from lintlake.plans.review import review_long_files, review_pieces
from lintlake.sources.derived import BLOCKS
from lintlake.sources.lines import read_lines

COLUMNS = ["path", "line_no", "end_line", "rule_id", "message", "severity", "seq"]


def bag(found):
    return Counter(tuple(r) for r in found.select(*COLUMNS).collect())


def texts(seed, count, blocks):
    rnd = random.Random(seed)
    out = {}
    for n in range(count):
        parts = [rnd.choice(BLOCKS).replace("@", str(rnd.randint(0, 9))) for _ in range(rnd.randint(1, blocks))]
        parts += rnd.choices(["{", "}", "}}", "", "\n\n", "for (;;) {", "function open() {", "def f(x):", "  if y:", "    def g(z):", "wide()"], k=rnd.randint(0, 2 * blocks))
        rnd.shuffle(parts)
        out[f"src/f{n}.{rnd.choice(['js', 'ts', 'py', 'java', 'go', 'rb', 'c', 'rs', 'php'])}"] = "\n".join(parts)
    return out


@pytest.fixture(scope="module")
def corpus():
    made = texts(11, 60, 9)
    # blocks over many pieces, closed, never closed, opened late; loops and levels that are carried
    made["src/deep.js"] = "function outer() {\n" + "for (a) {\n" * 4 + "  step(1);\n" * 300 + "for (b) {\n" + "}\n" * 7 + "function late(x)\n" + "y;\n" * 270 + "}\n{\nif (q) {}\n}\n}\n}"
    made["src/deep.py"] = "class K:\n    def one(self):\n" + "        if a: b\n" * 260 + "\n" * 30 + "    def two(self):\n        pass\n" + "def three():\n" + "  x\n" * 240
    made["src/same.ts"] = "\n".join("  const value = combine(alpha, 'one');" for _ in range(120)) + "\nel.addEventListener('click', f);\n" + "go();\n" * 50 + "x.addEventListener('dblclick', f);\nsetInterval(a, 1);"
    made["src/none.js"], made["src/end.js"] = "", "eval(x);\n"
    return made


def test_pieces_of_seven_lines(files_of, corpus):
    config = ReviewConfig(confidence_threshold=0.0, max_function_length=3, max_complexity=2, min_duplicate_lines=3)
    files = files_of(corpus)
    whole = bag(review_files(files, config))
    assert len({k[3] for k in whole}) >= 40
    assert bag(review_long_files(files, config, lines=7)) == whole


def test_frameworks_of_the_file(files_of, corpus):
    config = ReviewConfig(framework_scope="file", ignore_paths=("skip",), whitelisted_functions=("combine",))
    files = files_of({**corpus, "/r/skip/a.js": "eval(x);", "src/build/b.js": "eval(x);"})
    assert bag(review_long_files(files, config, lines=50)) == bag(review_files(files, config))


def test_lines_of_files_that_no_row_holds(spark, tmp_path, corpus):
    """The reader cuts the files, too: blocks of some bytes."""
    for path, text in corpus.items():
        target = tmp_path / "tree" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode())
    files = spark.createDataFrame([(f"{tmp_path}/tree/{p}", t) for p, t in corpus.items()], "path string, content string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_lines(spark, f"{tmp_path}/tree")
        got = {(r.path, r.line_no): (r.text, r.n_lines) for r in lines.collect()}
        config = ReviewConfig()
        found = bag(review_pieces(pieces.cut_lines(lines, 60), config))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(f"{tmp_path}/tree/{p}", n + 1): (x, len(t.split("\n"))) for p, t in corpus.items() if t for n, x in enumerate(t.split("\n"))}
    assert got == want
    assert found == bag(review_files(files, config))


def test_margins(files_of):
    rows = pieces.cut(files_of({"a.js": "\n".join(map(str, range(1, 101)))}), 30, 5).orderBy("own_first").collect()
    assert [(r.first, r.own_first, r.own_last, r.content.split("\n")[0], r.content.split("\n")[-1]) for r in rows] == [
        (1, 1, 30, "1", "35"), (11, 31, 60, "11", "65"), (41, 61, 90, "41", "95"), (71, 91, 100, "71", "100")]
    assert pieces.cut(files_of({}), 30).where(F.col("path").isNotNull()).count() == 0
