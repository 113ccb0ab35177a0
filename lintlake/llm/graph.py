"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import Written


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge; root is the least node of its component.

    edges: u, v of one ordered type, either direction, repeats and loops allowed (loops and nulls are dropped). Each round is
    two joins on nodes with least neighbours aggregated before the shuffle; a node with very many edges is a skewed
    join key, which adaptive execution splits. Rounds are logarithmic in the longest path; each is written to the shared folder.
    """
    w = Written(edges.sparkSession)
    now = w.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = w.put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = w.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        w.drop(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
