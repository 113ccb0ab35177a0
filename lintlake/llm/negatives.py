"""Hard negatives by a vertical scan of columns with branch and bound.

Rows are cut into packs, sorted by label and kept by column: a dimension of all rows of a pack is one run of numbers, and zones of
some rows know the least and greatest value of each dimension. An anchor reads the dimensions of a pack by descending magnitude of its own
components, a few at a time. After each the scores so far plus the least and greatest that the unread dimensions can still give
are held against the window asked for, and rows outside leave the candidates; what is left at the end has exact scores.

The scan runs twice: over rows of the anchor's label for its positives (the window is all that beats the current k-th score), then over the
other rows for the windows of its positives. Anchors go in blocks, packs in strips; a task takes one block through the packs of one strip one
after the other and keeps each window's best, so later packs meet narrower windows and a strip gives a few rows per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.blocks import squeezed, unsqueezed
from lintlake.llm.common import Written

PACK = 4096
ANCHORS = 4096
ZONE = 256
#: Dimensions read between two tests
STEP = 8


class Columns:
    """A pack by column: ids and labels (sorted by label, then id), columns (dimensions, rows), zone minima and maxima."""

    def __init__(self, payload: bytes):
        a = unsqueezed(payload)
        self.ids, self.labels = a["ids"], a["labels"]
        self.columns = a["columns"].reshape(-1, len(self.ids))
        starts = np.arange(0, len(self.ids), ZONE)
        self.low, self.high = (f.reduceat(self.columns, starts, axis=1).T.astype(np.int64) for f in (np.minimum, np.maximum))
        self.most = int(max(self.high.max(initial=0), -self.low.min(initial=0)))
        if self.most * self.most * max(1, len(self.columns)) < 2**53:
            self.columns = self.columns.astype(np.float64)
        elif self.columns.dtype != np.int64:
            self.columns = self.columns.astype(np.int64)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def scan(self, q: np.ndarray, alive: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of those alive) whose score with q is from low to high, and the scores."""
        largest = int(np.abs(q).max(initial=0))
        if largest * self.most * max(1, len(q)) >= 2**63:
            raise OverflowError("inner products of vectors this large do not fit 64 bits")
        exact = largest * max(largest, self.most) * max(1, len(q)) < 2**53
        columns = self.columns if exact or self.columns.dtype == np.int64 else self.columns.astype(np.int64)
        q = q.astype(columns.dtype)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.low, q * self.high])[:, :, order]
        # what the dimensions from each place on can give at least and at most, by zone
        least, most = (np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1), x.dtype)], axis=1) for x in (ends.min(axis=0), ends.max(axis=0)))
        rows = np.flatnonzero(alive)
        score = np.zeros(len(rows), columns.dtype)
        for start in range(0, len(q) + STEP, STEP):
            at = min(start, len(q))
            zone = rows // ZONE
            keep = (score + most[zone, at] >= low) & (score + least[zone, at] <= high)
            rows, score = rows[keep], score[keep]
            if at == len(q) or not len(rows):
                break
            dims = order[at:at + STEP]
            score = score + q[dims] @ columns[np.ix_(dims, rows)]
        return rows, score.astype(np.int64)


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v (floor(256 x)), dim: the rows that take part."""
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                                       F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v")).withColumn("dim", F.size("v"))


def packed(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """Rows by (dim, label, vec_id) in packs of one length: name, dim, labels (distinct), payload (ids, labels, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def pack():
            nonlocal made
            made += 1
            ids, labels, v = (np.array(x, np.int64) for x in zip(*(r[1:] for r in held)))
            kind = next(k for k in (np.int16, np.int32, np.int64) if k == np.int64 or np.abs(v).max(initial=0) <= np.iinfo(k).max)
            payload = squeezed(ids=ids, labels=labels, columns=np.ascontiguousarray(v.reshape(len(ids), -1).T).astype(kind).reshape(-1))
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + made], pa.int64()), pa.array([held[0][0]], pa.int32()), pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
                                               pa.array([payload], pa.binary())], [name, "dim", "labels", "payload"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("dim", "vec_id", "label", "v"))):
                if held and (len(held) >= size or r[0] != held[0][0]):
                    yield pack()
                    held = []
                held.append(r)
        if held:
            yield pack()

    order = ("dim", "label", "vec_id", "v")
    return (rows.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order).coalesce(max(1, n // size))
            .mapInArrow(run, f"{name} long, dim int, labels array<long>, payload binary"))


def better(best: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of a list of (-score, id) and of more of them; equal pairs (repeated rows) stay."""
    if len(score) > k:
        at = np.argpartition(-score, k - 1)[:k]
        tied = np.flatnonzero(score >= score[at].min())
        score, ids = score[tied], ids[tied]
    return sorted(best + list(zip((-score).tolist(), ids.tolist())))[:k]


def scanned(needs: DataFrame, packs: DataFrame, blocks: DataFrame, k: int, windows: bool) -> DataFrame:
    """Blocks taken through the packs of a strip. needs: block, strip, pack. Gives block, n (the anchor's place), p (the positive's rank, 0
    without windows), vec_id, score: the k best of each in that strip. blocks: block, payload and, for windows, positives."""
    w = Written(packs.sparkSession)
    needs = w.put(needs, "needs")
    own = needs.select("block", "strip").distinct()
    tasks = own.count()
    # the block's row comes first, its packs follow; one pack is held at a time
    left = own.join(blocks.select("block", "payload", *(["positives"] if windows else [])), "block").withColumn("pack", F.lit(None).cast("long"))
    right = needs.join(packs.select("pack", "payload"), "pack")
    if windows:
        right = right.withColumn("positives", F.lit(None).cast(dict(blocks.dtypes)["positives"]))
    columns = ["strip", "block", "pack", "payload", *(["positives"] if windows else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, block, state = None, None, {}

        def result():
            rows = [(block, n, p, i, -s) for (n, p), best in state.items() for s, i in best]
            block_, n, p, i, s = zip(*rows) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block_, n, p, i, s)], ["block", "n", "p", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["pack"] is None:
                    if block is not None:
                        yield result()
                    anchors, block, state, asked = unsqueezed(row["payload"]), row["block"], {}, {}
                    anchors["v"] = anchors["columns"].reshape(-1, len(anchors["ids"])).T.astype(np.int64)
                    for x in (row["positives"] or []) if windows else []:
                        if x["score"] >= 0:  # no score is from 0.8 s to s if s is negative
                            asked.setdefault(x["n"], []).append((x["p"], -(-80 * x["score"] // 100), x["score"]))
                    continue
                pack = Columns(row["payload"])
                for n, (i, label) in enumerate(zip(anchors["ids"].tolist(), anchors["labels"].tolist())):
                    first, last = pack.of_label(label)
                    q = anchors["v"][n]
                    if not windows:
                        alive = np.zeros(len(pack.ids), bool)
                        alive[first:last] = pack.ids[first:last] != i
                        best = state.get((n, 0), [])
                        rows, score = pack.scan(q, alive, -best[-1][0] if len(best) == k else -np.inf, np.inf)
                        state[n, 0] = better(best, score, pack.ids[rows], k)
                    elif n in asked:
                        alive = np.ones(len(pack.ids), bool)
                        alive[first:last] = False
                        alive &= pack.ids != i
                        lows = [max(low, -best[-1][0]) if len(best := state.get((n, p), [])) == k else low for p, low, _ in asked[n]]
                        rows, score = pack.scan(q, alive, min(lows), max(high for _, _, high in asked[n]))
                        for (p, _, high), low in zip(asked[n], lows):
                            fits = (score >= low) & (score <= high)
                            if fits.any():
                                state[n, p] = better(state.get((n, p), []), score[fits], pack.ids[rows[fits]], k)
        if block is not None:
            yield result()

    return (left.select(columns).unionByName(right.select(columns)).repartitionByRange(max(1, tasks), "block", "strip").sortWithinPartitions("block", "strip", F.asc_nulls_first("pack"))
            .select(columns[1:]).mapInArrow(run, "block long, n long, p long, vec_id long, score long"))


def first_of(found: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("block", "n", "p").orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, k: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its k best rows of the same label
    (positives) the k best rows of other labels whose score is from 80 % to 100 % of the positive's.

    vectors: vec_id, embedding, label; anchors: the condition for anchors; label: the label in use, the column itself by default. Other columns are
    ignored. Components count as floor(256 x), scores are integer inner products, ties go to the smaller vec_id. Rows with a
    null id, label or vector, or a null or non-finite component take no part. Rows with the anchor's own id are neither positive nor negative; repeated
    rows of others count each; equal anchor rows (id, label, vector) are one anchor. Only vectors of one length are
    compared. A negative positive score has no window and gives no rows, nor does an empty table. Scores beyond 64 bits raise an error.
    """
    w = Written(vectors.sparkSession)
    rows = w.put(quantised(vectors, F.col("label") if label is None else label), "rows")
    asked = w.put(rows.where(anchors).distinct(), "anchors")
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    packs = w.put(packed(rows, n, PACK, "pack").withColumn("strip", F.shiftright("pack", 24)), "packs")
    blocks = w.put(packed(asked, asked.count(), ANCHORS, "block"), "blocks")
    w.drop(rows, asked)
    strips = max(1, min(-(-n // PACK), 4 * cores + n // (64 * PACK)))  # a strip is one pack in small tables, at most 64 in large ones
    packs = packs.withColumn("strip", F.col("strip") % strips)
    # same label: by label, so that no pack without it is sent
    same = (blocks.select("block", "dim", F.explode("labels").alias("label")).join(packs.select("pack", "strip", "dim", F.explode("labels").alias("label")), ["dim", "label"])
            .select("block", "strip", "pack").distinct())
    positives = w.put(first_of(scanned(same, packs, blocks, k, False), k, "rank"), "positives")
    named = positives.groupBy("block").agg(F.collect_list(F.struct("n", F.col("rank").cast("long").alias("p"), "score")).alias("positives"))
    # the anchors against all packs, in blocks: a block names its strips, a strip its packs
    every = (blocks.select("block", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("strip"))
             .join(packs.select("pack", "dim", F.col("strip").cast("long").alias("strip")), ["dim", "strip"]).select("block", "strip", "pack"))
    ready = w.put(blocks.join(named, "block"), "asked")
    best = first_of(scanned(every.join(ready.select("block"), "block", "left_semi"), packs, ready, k, True), k, "rank")
    ids = blocks.select("block", "payload").mapInArrow(places, "block long, n long, anchor_id long")
    known = positives.select("block", "n", F.col("rank").cast("long").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, ["block", "n"])
    return (best.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(known, ["block", "n", "p"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a block's anchors by place."""
    for b in batches:
        for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
            ids = unsqueezed(payload)["ids"]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids)], ["block", "n", "anchor_id"])


#: Anchors and labels of the registered query
ANCHOR = "vec_id % 100 = 0"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def hard_negatives_sql(k: int = 5) -> str:
    """The same in DuckDB SQL, anchors against all rows: for small tables."""
    return f"""
WITH v AS (SELECT vec_id, {LABEL} AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum([a.v[i] * c.v[i] for i in range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.{ANCHOR} AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= {k}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {k}"""
