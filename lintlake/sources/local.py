"""Small driver-side tables, and places to write."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_table(spark: SparkSession, rows: list[tuple], names: list[str], types: dict | None = None) -> DataFrame:
    """A catalog as a local relation (no Python rows at run time)."""
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    fields = [pa.field(n, (types or {}).get(n, pa.string())) for n in names]
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(fields)))


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the folder all executors share (spark.checkpoint.dir). Only a local session,
    where executors and driver are one process, may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lintlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of one task that reads rows standing for much work each
ROWS_OF_TASK = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows that stand for much work each: over all cores, and in tasks that do not grow with the table (it is counted, from the
    files' footers alone). A table of that many splits is left as it is."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_OF_TASK))
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: computed once, and no lost executor takes them along."""
    folder = run_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
