"""Review of arriving files: each micro-batch goes through the batch plan.

What was seen is keyed state of the stream itself (path, content hash, settings): a batch looks up and adds its own keys, whatever
the number of batches before it, and the state is part of the checkpoint. Row-frame windows are not allowed on streams, so the review runs in
foreachBatch; a batch writes its findings under its own number, overwriting what an interrupted attempt left, so replays give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.config import ReviewConfig
from lintlake.operators.changes import content_hash
from lintlake.plans.review import review_files


def unseen(stream: DataFrame, config: ReviewConfig, horizon: str | None = None) -> DataFrame:
    """(path, content) that did not arrive before with this content and these settings.

    horizon: how long a file is remembered (for instance ``30 days``), which bounds the state; without it, for ever.
    """
    keyed = stream.select("path", "content", content_hash(F.col("content")).alias("content_hash"), F.lit(config.fingerprint()).alias("config_fp"))
    key = ["path", "content_hash", "config_fp"]
    if horizon is None:
        return keyed.dropDuplicates(key).select("path", "content")
    return keyed.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(key).select("path", "content")


def continuous_review(stream: DataFrame, out: str, config: ReviewConfig | None = None, horizon: str | None = None) -> StreamingQuery:
    """``stream``: streaming (path, content). Findings go to ``out``/findings/batch=N.

    A file that was seen before with the same content and settings is not reviewed again. A batch sees only
    its own files, so frameworks are those of the file (scope ``file``). The state has as many parts as spark.sql.shuffle.partitions says at the first
    start; for many millions of files choose the RocksDB provider (spark.sql.streaming.stateStore.providerClass), which keeps it on disk.
    """
    config = config or ReviewConfig(framework_scope="file")

    def review_batch(files: DataFrame, batch: int) -> None:
        files = files.persist()  # read several times below, and the state behind it looked up once
        review_files(files, config).write.mode("overwrite").parquet(f"{out}/findings/batch={batch}")
        files.unpersist()

    return (unseen(stream, config, horizon).writeStream.foreachBatch(review_batch).option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True).start())
