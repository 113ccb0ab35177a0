"""Running sums inside keys of any size, without bringing a key to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import Written


def running(rows: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """Rows with before_<value>: the sum of the value (long, modulo 2 ** 64) over earlier rows of the same key.

    order sorts by the key first and has no ties inside a key. Range partitions sum for themselves; only a partition's first key can have begun
    earlier, so the driver needs one row per partition to know what it had before: first and last key and the last key's sum. No nulls in keys or values.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen, held = TaskContext.get().partitionId(), None, 0, np.zeros(len(values), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            if keys[0] != last:
                held = np.zeros(len(values), np.int64)
            for n, v in enumerate(values):
                x = b.column(v).to_numpy()
                before = np.concatenate([[0], np.cumsum(x)])
                out = before[:-1] - before[starts][segment]
                out[segment == 0] += held[n]
                held[n] = out[-1] + x[-1]
                b = b.append_column("before_" + v, pa.array(out, pa.int64()))
            last, seen = keys[-1], seen + len(keys)
            yield b.append_column("_part", pa.array(np.full(len(keys), part), pa.int32())).append_column("_seq", pa.array(np.arange(seen - len(keys), seen)))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", before_{v} long" for v in values)
    names = rows.columns
    w = Written(rows.sparkSession)
    sums = w.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, own + ", _part int, _seq long"), "sums")
    last = F.max_by(F.struct(F.col(key).alias("key"), *[F.col(c) for v in values for c in (v, "before_" + v)]), "_seq")
    held, open_, carried = {}, None, [0] * len(values)
    for r in sums.groupBy("_part").agg(F.min_by(key, "_seq").alias("first"), last.alias("last")).orderBy("_part").collect():
        if r["first"] == open_:
            held[r["_part"]] = (open_, carried)
        sums_here = [r["last"][v] + r["last"]["before_" + v] for v in values]
        carried = [a + b for a, b in zip(carried, sums_here)] if r["last"]["key"] == open_ else sums_here
        open_ = r["last"]["key"]
    # as wide as the sums are: modulo 2 ** 64
    held = {part: (k, np.array([(c + 2**63) % 2**64 - 2**63 for c in cs], np.int64)) for part, (k, cs) in held.items()}

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, keys = b.column("_part").to_numpy(), b.column(key).to_numpy()
            out = b.select(names)
            mine = [(np.flatnonzero((parts == p) & (keys == held[p][0])), held[p][1]) for p in np.unique(parts).tolist() if p in held]
            for n, v in enumerate(values):
                x = b.column("before_" + v).to_numpy().copy()
                for at, more in mine:
                    x[at] += more[n]
                out = out.append_column("before_" + v, pa.array(x, pa.int64()))
            yield out

    return sums.drop("_seq").mapInArrow(carry, own)
