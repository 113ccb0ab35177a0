"""Text files of any size as lines with their numbers: a file is split over tasks, no row holds a whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, n_lines, line_no, text of all files below ``root``; a final newline opens one more (empty) line.

    The reader cuts files into blocks and gives each line the place of its block. Lines of a block are counted first (one row per block
    leaves the executors), so a line's number is its place in the block plus the lines of earlier blocks.
    """
    raw = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(root)
           .select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                   F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("seq"), "value"))
    blocks = raw.groupBy("path", "block", "size").agg(F.min("seq").alias("first"), F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path")
    # every line but an unfinished last one takes its bytes and a newline
    ends = (F.sum("bytes").over(whole) == F.col("size")).cast("int")
    known = blocks.select("path", "block", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"), (F.sum("lines").over(whole) + ends).alias("n_lines"),
                          ends.alias("open"))
    lines = raw.select("path", "block", "seq", "value").join(known, ["path", "block"]).select(
        "path", "n_lines", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("line_no"), F.make_valid_utf8("value").alias("text"))
    last = known.where("open = 1").select("path", "n_lines", F.col("n_lines").alias("line_no"), F.lit("").alias("text")).distinct()
    return lines.unionByName(last)
