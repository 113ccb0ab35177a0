"""Review state as an append-only log, so that a run touches what changed and nothing else.

A batch adds rows (path, content_hash, config_fp, flags, reviewed, live); the latest row of a path holds. ``flags`` are the frameworks
the file shows traces of, so the frameworks of the corpus are a fold over slim rows, deletions included, and no run reads the corpus for them.
Findings lie in batches of their own: those of a path count if their batch is the one its row names as ``reviewed``. A batch writes its findings,
then its rows; the rows are what makes it count. A batch that died between the two is written again under the same number.

Deleted paths leave a row that is not live, invalidated ones a row without a hash: the next update reviews them whatever they hold.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.config import ReviewConfig
from lintlake.operators.changes import content_hash, only_listed
from lintlake.operators.files import filter_ignore_paths, filter_ignore_patterns, reviewable
from lintlake.operators.tokens import forced_frameworks, framework_flags
from lintlake.plans.review import review_files
from lintlake.sources.local import kept

ROW = "path string, content_hash bigint, config_fp string, flags array<string>, reviewed bigint, live boolean"


class Ledger:
    """The log in ``folder`` (state/batch=N, findings/batch=N), read and written by Spark jobs alone.

    ``config`` are the settings findings are wanted for. Rows made with other settings count as not reviewed. Paths are unique in what is handed
    over; null paths are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, config: ReviewConfig | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or ReviewConfig()

    # reading -------------------------------------------------------------------------------------------

    def _read(self, part: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema + ", batch long").option("basePath", f"{self.folder}/{part}").parquet(f"{self.folder}/{part}")
        except Exception as err:
            if "PATH_NOT_FOUND" in str(err):
                return None
            raise

    def log(self) -> DataFrame:
        rows = self._read("state", ROW)
        return rows if rows is not None else self.spark.createDataFrame([], ROW + ", batch long")

    def current(self, log: DataFrame | None = None) -> DataFrame:
        """The latest row of each path that is live. Sums up before it shuffles: a path that changes often is one row per task."""
        rows = self.log() if log is None else log
        latest = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "batch").alias("r"))
        return latest.select("path", "r.*").where("live")

    def next_batch(self) -> int:
        return (self.log().agg(F.max("batch")).first()[0] or 0) + 1

    def frameworks(self, rows: DataFrame | None = None) -> list[str]:
        """Frameworks in use: traces in any live file, or forced by the settings (known names, a handful)."""
        found = (self.current() if rows is None else rows).select(F.explode_outer("flags").alias("f")).where("f IS NOT NULL").distinct()
        return sorted({r["f"] for r in found.collect()} | set(forced_frameworks(self.config)))

    def _fingerprint(self, active: list[str]) -> str:
        own = self.config.fingerprint()
        return own if self.config.framework_scope == "file" else "-".join([own, *active])

    def findings(self) -> DataFrame:
        """Findings of all live files, each from the batch that reviewed it last."""
        found = self._read("findings", self._finding_schema())
        now = self.current().select("path", F.col("reviewed").alias("batch"))
        return found.join(now, ["path", "batch"]).drop("batch") if found is not None else self.spark.createDataFrame([], self._finding_schema())

    def _finding_schema(self) -> str:
        empty = review_files(self.spark.createDataFrame([], "path string, content string"), replace(self.config, framework_scope="file"))
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)

    # writing -------------------------------------------------------------------------------------------

    def _add(self, rows: DataFrame, batch: int) -> None:
        rows.select("path", "content_hash", "config_fp", "flags", F.col("reviewed").cast("long").alias("reviewed"), "live").where("path IS NOT NULL").write.mode(
            "overwrite").parquet(f"{self.folder}/state/batch={batch}")

    def _marked(self, files: DataFrame) -> DataFrame:
        ready = reviewable(files, self.config.max_file_chars)
        ready = filter_ignore_patterns(filter_ignore_paths(ready, self.config.ignore_paths), self.config.ignore_patterns)
        return ready.select("path", content_hash(F.col("content")).alias("content_hash"), framework_flags(F.col("content")).alias("flags"))

    def _review(self, files: DataFrame, paths: DataFrame, active: list[str], batch: int) -> None:
        """Findings of the named files with the frameworks that the log knows: no other file is read."""
        review_files(only_listed(files, paths), self.config, frameworks=active).write.mode("overwrite").parquet(f"{self.folder}/findings/batch={batch}")

    def update(self, files: DataFrame) -> int:
        """``files`` is the whole corpus: new and changed files are reviewed, missing ones leave the log. Returns the number of the batch."""
        return self._run(files, everything=True)

    def change(self, files: DataFrame) -> int:
        """``files`` are those of a change list alone; the others are as the log has them, and only these files are read. When the change turns a framework of the
        whole corpus on or off, other files' findings are out of date: they are marked, and the next update reviews them."""
        return self._run(files, everything=False)

    def _run(self, files: DataFrame, everything: bool) -> int:
        batch, log = self.next_batch(), self.log()
        now = kept(self.current(log), "current")
        marks = kept(self._marked(files), "marks")
        others = now.join(marks.select("path"), "path", "left_anti")
        after = marks.select("path", "flags") if everything else marks.select("path", "flags").unionByName(others.select("path", "flags"))
        active = self.frameworks(after)
        mark = self._fingerprint(active)
        known = now.where((F.col("config_fp") == mark) & F.col("content_hash").isNotNull()).select("path", "content_hash", "reviewed")
        judged = kept(marks.join(known, ["path", "content_hash"], "left").withColumn("fresh", F.col("reviewed").isNull()), "judged")
        self._review(files, judged.where("fresh").select("path"), active, batch)
        rows = judged.where("fresh").select("path", "content_hash", F.lit(mark).alias("config_fp"), "flags", F.lit(batch).alias("reviewed"), F.lit(True).alias("live"))
        if everything:
            rows = rows.unionByName(others.select("path", "content_hash", "config_fp", "flags", "reviewed", F.lit(False).alias("live")))
        self._add(rows, batch)
        return batch

    def invalidate(self, paths: DataFrame | None = None) -> int:
        """The next update reviews these files (all, without a list) even if they are as they were."""
        batch, now = self.next_batch(), self.current()
        if paths is not None:
            now = only_listed(now, paths)
        self._add(now.withColumn("content_hash", F.lit(None).cast("long")), batch)
        return batch

    def remove(self, paths: DataFrame) -> int:
        """Files that are gone, by a list instead of the corpus."""
        batch = self.next_batch()
        self._add(only_listed(self.current(), paths).withColumn("live", F.lit(False)), batch)
        return batch

    def out_of_date(self) -> DataFrame:
        """Paths whose findings were made with other settings or frameworks than now hold, or were invalidated."""
        now = self.current()
        mark = self._fingerprint(self.frameworks(now))
        return now.where((F.col("config_fp") != mark) | F.col("content_hash").isNull()).select("path")

    def compact(self, folder: str) -> Ledger:
        """The same state and findings as one batch of a new log."""
        out = Ledger(self.spark, folder, self.config)
        self.findings().write.mode("overwrite").parquet(f"{out.folder}/findings/batch=1")
        out._add(self.current().withColumn("reviewed", F.lit(1)), 1)
        return out
