"""Long files, framework scope, settings that leave files out."""

import time

from pyspark.sql import functions as F

from lintlake import ReviewConfig, review_files
from lintlake.operators import blocks, changes, duplicates, files as fo, sequence

BAD = "eval(x);\nvar y = 1;\nif (a == b) {\n}\n"


def rows(df):
    return sorted((r.path, r.line_no, r.rule_id) for r in df.collect())


def seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_long_file_is_reviewed(files_of):
    files = files_of({"big.js": "eval(x);\n" + "a\n" * 300_000})
    config = ReviewConfig(max_file_chars=500_000)
    assert any(r.line_no == 1 for r in review_files(files).select("path", "line_no").collect())
    assert review_files(files, config).count() == 0
    assert fo.result_status(fo.detect_language(files), 500_000).first()["language"] == "too_large"


def test_block_extents_are_linear(files_of):
    def run(n):
        files = fo.reviewable(files_of({"a.ts": "switch (x) {\n}\n" * n}))
        return blocks.switch_no_default(files).count()

    assert run(20) == 20
    short, long = seconds(lambda: run(5_000)), seconds(lambda: run(30_000))
    assert run(30_000) == 30_000 and long < 6 * short + 20


def test_nested_loops_are_linear(files_of):
    def run(n):
        return sequence.win_nested_loops(fo.reviewable(files_of({"a.js": "for (a) {\nfor (b) {\nfor (c) {\n}\n}\n}\n" * n}))).count()

    assert run(100) == 100
    assert run(3_000) == 3_000


def test_repeated_blocks_are_linear(files_of):
    def run(n):
        text = "\n".join(f"  const value = compute(alpha, {'+ ' * (i % 7)}beta);" for i in range(n))
        files = fo.reviewable(files_of({"a.js": text})).withColumn("frameworks", F.array().cast("array<string>"))
        return duplicates.duplicate_blocks(files, ReviewConfig()).count()

    assert run(100) == 89
    short, long = seconds(lambda: run(20_000)), seconds(lambda: run(100_000))
    assert long < 6 * short + 5


def test_change_sets_use_the_frameworks_of_the_corpus(files_of):
    files = files_of({"src/a.js": BAD + "useEffect(() => {});\nconsole.log(1);\n", "src/b.js": "import React from 'react';\n", "lib/c.js": BAD})
    for config in (ReviewConfig(), ReviewConfig(framework_scope="file")):
        full = rows(review_files(files, config))
        only = files.where("path = 'src/a.js'").select("path")
        assert rows(changes.review_changed(files, only, config)) == [r for r in full if r[0] == "src/a.js"]
        assert rows(changes.review_path_prefix(files, "src", config)) == [r for r in full if r[0].startswith("src/")]


def test_increment_equals_full_when_frameworks_change(files_of, spark):
    before = files_of({"a.js": BAD})
    now = files_of({"a.js": BAD, "b.js": "import React from 'react';\nimport { x } from '@angular/core';\n"})
    for config in (ReviewConfig(), ReviewConfig(framework_scope="file")):
        state, old = changes.next_state(before, config), review_files(before, config)
        assert rows(changes.incremental_review(now, state, old, config)) == rows(review_files(now, config))


def test_ignore_settings_apply_to_folders_not_to_changes(files_of):
    files = files_of({"/r/skip/x.js": BAD, "/r/a.min.js": BAD, "/r/a.js": BAD})
    config = ReviewConfig(ignore_paths=("skip",), ignore_patterns=("*.min.js",))
    assert {r.path for r in review_files(files, config).collect()} == {"/r/a.js"}
    assert {r.path for r in changes.review_changed(files, files.select("path"), config).collect()} == {"/r/skip/x.js", "/r/a.min.js", "/r/a.js"}
    assert files.where(F.col("path") == "/r/a.js").count() == 1
