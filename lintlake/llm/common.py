"""What the operators share: tables, shared folders, tokens, order numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder all executors see: below spark.checkpoint.dir. Only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Written:
    """Tables written to cut lineage; drop() removes those that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(self.spark, name)
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = folder
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop(id(t)))
            path.getFileSystem(conf).delete(path, True)


def doc_bytes(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Texts as UTF-8 bytes (null: empty), with the columns asked for and no others."""
    return docs.select(*columns, F.coalesce(F.col(TEXT), F.lit("")).cast("binary").alias(TEXT))


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def in_parts(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about so many bytes: long texts are not all turned into objects at once."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: bytes split on the blank and 09-0D, A-Z lower-cased, other bytes kept."""
    return text.lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their number from 0 in the given order, without bringing them to one task: ranges, then
    counts of the ranges (as many as partitions), then numbers inside each."""
    w = Written(rows.sparkSession)
    parts = w.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
                  .withColumn("_seq", F.monotonically_increasing_id()), "ranges")
    firsts, total = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_seq").alias("first")).orderBy("_part").collect():
        firsts.append((r["_part"], total - r["first"]))
        total += r["n"]
    offsets = F.create_map(*[F.lit(x) for pair in firsts for x in pair]) if firsts else F.create_map(F.lit(0), F.lit(0)).cast("map<int,bigint>")
    return parts.withColumn(name, (F.col("_seq") + offsets[F.col("_part")]).cast("long")).drop("_part", "_seq")
