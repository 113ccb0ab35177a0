"""Exact top-k by inner product: ball trees with branch and bound, one tree per shard.

Vectors are cut into packs (shards) of bounded size, each searched through its ball tree. Nodes are visited by their
upper bound q.c + |q| r (centre c, radius r) and left out once the bound cannot beat the current k-th score; at equal scores the
smaller id wins, so each node also knows its least id. Every query is first searched in one pilot pack; its k-th score
goes with the query to all other packs, and inside a task it is passed on from pack to pack. Queries go in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import Written

PACK = 4096
QUERY_BLOCK = 1024
LEAF = 64
MOST = 2**63 - 1


class BallTree:
    """Nodes as arrays: centre, radius, least id, rows [first, last) of the reordered vectors, children (-1: a leaf)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.floats = vectors.astype(np.float64)
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.children: list[tuple[int, int]] = []
        todo = [(0, len(ids), None)]
        while todo:
            first, last, parent = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                a, b = self.children[parent]
                self.children[parent] = (me, b) if a < 0 else (a, me)
            rows = self.order[first:last]
            x = self.floats[rows]
            centre = x.mean(axis=0)
            away = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.nodes.append((centre, float(away.max()), int(ids[rows].min()), first, last))
            self.children.append((-1, -1))
            if last - first > LEAF and away.max() > 0:
                far = x[away.argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                along = x @ (other - far)
                half = (last - first) // 2
                self.order[first:last] = rows[np.argpartition(along, half)]
                todo += [(first + half, last, me), (first, first + half, me)]
        self.centres = np.array([n[0] for n in self.nodes]).reshape(len(self.nodes), -1)
        self.radii = np.array([n[1] for n in self.nodes])
        self.ids = ids[self.order]
        self.vectors = vectors[self.order]
        self.floats = self.floats[self.order]
        self.most = int(np.abs(vectors).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no score in the node is higher."""
        norms = np.sqrt((queries**2).sum(axis=1))[:, None]
        slack = 1e-9 * norms * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii) + 1e-6
        return np.floor(queries @ self.centres.T + norms * self.radii + slack)

    def search(self, query: np.ndarray, query_id: int, bounds: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """best: a heap of (score, -id), at most k, from earlier packs; changed in place. Returns what came in here."""
        exact = self.most * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53
        data, q = (self.floats, query.astype(np.float64)) if exact else (self.vectors.astype(object), query.astype(object))
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                break
            _, _, least, first, last = self.nodes[node]
            if len(best) == k and (-bound, -least) < best[0]:
                continue
            a, b = self.children[node]
            if a >= 0:
                for child in (a, b):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = data[first:last] @ q
            ids = self.ids[first:last]
            fine = ids != query_id
            if len(best) == k:
                fine &= (scores >= best[0][0]).astype(bool)
            for s, i in zip(scores[fine].tolist(), ids[fine].tolist()):
                item = (int(s), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of each component, and its length; rows that take part only."""
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"),
                                       F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v")).withColumn("dim", F.size("v"))


def packed(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """Rows of (vec_id, v, dim) as packs of one length: name, dim, ids, vectors (int64). Dealt by the hash of id and vector."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, vectors, dim = [], [], -1

        def pack():
            nonlocal made, ids, vectors
            made += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(vectors, np.int64).tobytes()], pa.binary())], [name, "dim", "ids", "vectors"])
            ids, vectors = [], []
            return out

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                if ids and (len(v) != dim or len(ids) == size):
                    yield pack()
                dim = len(v)
                ids.append(i)
                vectors.append(v)
        if ids:
            yield pack()

    return (rows.repartition(max(1, -(-n // size)), F.xxhash64("vec_id", "v")).sortWithinPartitions("dim", "vec_id").mapInArrow(run, f"{name} long, dim int, ids binary, vectors binary"))


def search(pairs: DataFrame, packs: DataFrame, blocks: DataFrame, k: int, pilot: bool) -> DataFrame:
    """Each pair's queries searched in its pack. Pilot: block, and the best so far, packed; else rows of what beats the best so far."""
    left = pairs.join(packs.select("pack", "ids", "vectors"), "pack")
    right = pairs.join(blocks.select("block", "dim", *[F.col(c).alias("q_" + c) for c in blocks.columns if c not in ("block", "dim")]), "block")

    def run(batches):
        shared: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                dim = row["dim"]
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                tree = BallTree(np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim), ids)
                queries = np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), dim)
                if not pilot and row["block"] not in shared:
                    old = np.frombuffer(row["q_best"], np.int64).reshape(-1, 3)
                    shared[row["block"]] = [[] for _ in q_ids]
                    for q, s, i in old.tolist():
                        shared[row["block"]][q].append((s, i))
                best = [[] for _ in q_ids] if pilot else shared[row["block"]]
                bounds = tree.bounds(queries.astype(np.float64))
                out = []
                for n, q_id in enumerate(q_ids.tolist()):
                    heapq.heapify(best[n])
                    before = set() if pilot else set(best[n])
                    tree.search(queries[n], q_id, bounds[n], best[n], k)
                    out += [(n, q_id, s, -i) for s, i in best[n] if (s, i) not in before]
                table = np.array([(n, max(-MOST, min(MOST, s)), -i) for n, _, s, i in out], np.int64).reshape(-1, 3)
                if pilot:
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["block", "best"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[table[:, 0]], pa.int64()), pa.array(-table[:, 2], pa.int64()), pa.array(table[:, 1], pa.int64())], ["query_id", "vec_id", "score"])

    return left.join(right, ["pack", "block"]).mapInArrow(run, "block long, best binary" if pilot else "query_id long, vec_id long, score long")


def found_by_pilot(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for ids, best in zip(batch.column("ids").to_pylist(), batch.column("best").to_pylist()):
                q_ids, table = np.frombuffer(ids, np.int64), np.frombuffer(best, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[table[:, 0]], pa.int64()), pa.array(-table[:, 2], pa.int64()), pa.array(table[:, 1], pa.int64())], ["query_id", "vec_id", "score"])

    return blocks.select("ids", "best").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all other rows, ties to the smaller vec_id.

    Both inputs have vec_id and embedding; other columns are ignored. Vectors that are null, or hold null or non-finite
    components, and rows without an id take no part, as vectors and as queries. Rows with the query's own id are no candidates
    for it; repeated rows of others are candidates each, a repeated query (id and vector) is answered once. Only vectors of
    the same length are compared. Scores beyond 64 bits are clipped.
    """
    w = Written(vectors.sparkSession)
    rows, asked = w.put(quantised(vectors), "vectors"), w.put(quantised(queries).distinct(), "queries")
    packs, blocks = w.put(packed(rows, rows.count(), PACK, "pack"), "packs"), w.put(packed(asked, asked.count(), QUERY_BLOCK, "block"), "blocks")
    w.drop(rows, asked)
    # blocks of the stated query set against all packs: names only, then joined by name
    pairs = w.put(packs.select("pack", "dim").join(blocks.select("block", "dim"), "dim").drop("dim"), "pairs")
    first = packs.groupBy("dim").agg(F.min("pack").alias("pack"))
    pilot = w.put(search(pairs.join(first.select("pack"), "pack", "left_semi"), packs, blocks, k, True), "pilot")
    blocks = w.put(blocks.join(pilot, "block"), "blocks")
    rest = search(pairs.join(first.select("pack"), "pack", "left_anti"), packs, blocks, k, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found_by_pilot(blocks).unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top_k_sql(k: int = 5) -> str:
    """The same in DuckDB SQL, all pairs: for small tables."""
    return f"""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
