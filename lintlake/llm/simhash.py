"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared all against all, in tiles: numpy exclusive-or and bit counts over blocks that fit the processor's
cache. Fingerprints are sorted by their population count and by the counts of their single bytes, so a tile covers
a small box of counts; two fingerprints that differ in d bits have byte counts that differ by at most d in sum, so
tile pairs whose boxes are further apart than the radius are skipped unseen. Nothing else is: the comparison is exact.

Spark sorts and cuts the fingerprints into tiles, pairs the tiles by overlapping ranges of counts (an equality join on the
count), and spreads the pairs over all tasks. A tile pair yields a spanning forest of its links, not the links, so a
group of thousands of near copies gives no more rows than it has members per pair of tiles.

Where links must also be alike in their shingle sets, the forests only say which fingerprints can belong together. Those groups are cut
into tiles again, now with the shingle sets, and in each pair of tiles every close pair is checked unless links that
passed already join its ends: no candidate is left out, and a group of true copies costs few checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import Written, doc_bytes, in_parts, words_of
from lintlake.llm.graph import components

TILE = 16384
INNER = 256
PIECE = 1 << 15
#: Tiles that carry shingle sets: fingerprints, and shingles of all of them (a text of more is a tile of its own)
SET_TILE, SET_GRAMS = 4096, 1 << 20
CHECKS = 4096


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by a blank, repeats included; fewer words: the whole sequence; none: nothing."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts = ends - lengths
    return [joined[s:e] for s, e in zip(starts[:1 - size or None].tolist(), ends[size - 1:].tolist())]


def fingerprint(words: list[bytes], size: int, n64: int, once: bool = False) -> bytes:
    """8 * n64 bytes, highest bit first: a bit is 1 if set in over half of the shingles' hashes. One 64-bit word: XXH64, seed 42;
    two: the 128-bit XXH3 hash, seed 42. once: equal shingles count once, so a repeated line has no more say than any other. No words: zeros."""
    digest = xxhash.xxh64_digest if n64 == 1 else xxhash.xxh3_128_digest
    grams = shingles(words, size)
    if once:
        grams = list(set(grams))
    ones = np.zeros(64 * n64, np.int64)
    for start in range(0, len(grams), PIECE):
        raw = np.frombuffer(b"".join([digest(g, 42) for g in grams[start:start + PIECE]]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8 * n64), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams)).tobytes()


def order_key(fp: bytes) -> bytes:
    """Sorts fingerprints by population count, then by the counts of their bytes."""
    counts = [b.bit_count() for b in fp]
    return bytes([sum(counts), *counts])


def fingerprints(docs: DataFrame, size: int, n64: int, once: bool = False) -> DataFrame:
    """doc_id and fingerprint (binary) of every document, repeated rows kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole):
                fps = [fingerprint(words_of(t), size, n64, once) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, fp binary")


def tiles(fps: DataFrame, n: int) -> DataFrame:
    """Distinct fingerprints, cut into tiles: tile id, range of population counts, box of byte counts, the fingerprints.

    However finely ranges are dealt, tiles are full: the fewer tile pairs, the fewer forests of one group.
    """

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([order_key(x) for x in b.column("fp").to_pylist()], pa.binary())], ["fp", "key"])

    def pack(batches):
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def tile(rows: list[bytes]):
            nonlocal made
            counts = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
            counts = np.bitwise_count(counts)
            totals = counts.sum(axis=1, dtype=np.int64)
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made], pa.int64()), pa.array([int(totals.min())], pa.int32()), pa.array([int(totals.max())], pa.int32()),
                 pa.array([counts.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32())),
                 pa.array([b"".join(rows)], pa.binary())], ["tile", "lo", "hi", "mins", "maxs", "fps"])

        for b in batches:
            held += b.column("fp").to_pylist()
            while len(held) >= TILE:
                yield tile(held[:TILE])
                held = held[TILE:]
        if held:
            yield tile(held)

    return (fps.mapInArrow(keyed, "fp binary, key binary").repartitionByRange(max(1, -(-n // TILE)), "key", "fp")
            .sortWithinPartitions("key", "fp").coalesce(max(1, n // TILE)).mapInArrow(pack, "tile long, lo int, hi int, mins array<int>, maxs array<int>, fps binary"))


def tile_pairs(cut: DataFrame, radius: int) -> DataFrame:
    """a <= b: tiles that may hold fingerprints within the radius. Joined on the population count, then boxes compared."""
    meta = cut.select("tile", "lo", "hi", "mins", "maxs")
    left = meta.select(*[F.col(c).alias("a_" + c) for c in meta.columns], F.explode(F.sequence("lo", "hi")).alias("count"))
    right = meta.select(*[F.col(c).alias("b_" + c) for c in meta.columns],
                        F.explode(F.sequence(F.col("lo") - radius, F.col("hi") + radius)).alias("count"))
    gap = F.expr("aggregate(arrays_zip(a_mins, a_maxs, b_mins, b_maxs), 0, (s, x) -> s + greatest(0, x.a_mins - x.b_maxs, x.b_mins - x.a_maxs))")
    return (left.join(right, "count").where("a_tile <= b_tile").dropDuplicates(["a_tile", "b_tile"]).where(gap <= radius)
            .select(F.col("a_tile").alias("a"), F.col("b_tile").alias("b")))


class Forest:
    """Which of so many nodes are joined already."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self, x: np.ndarray) -> np.ndarray:
        ends, back = np.unique(x, return_inverse=True)
        return np.array([self.root(e) for e in ends.tolist()], np.int64)[back]

    def grow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of those of the given links that join two trees."""
        ri, rj = self.roots(i), self.roots(j)
        first = np.unique(ri * len(self.parent) + rj, return_index=True)[1]
        used = []
        for n in first[ri[first] != rj[first]].tolist():
            a, b = self.root(int(i[n])), self.root(int(j[n]))
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                used.append(n)
        return np.array(used, np.int64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every row of x and every row of y."""
    bits = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for k in range(1, x.shape[1]):
        bits += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return bits


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius, as row numbers of a and b.

    a, b: (n, words) of 64 bits, sorted by order_key. same: a is b, pairs are taken once.
    """
    def boxes(x):
        counts = np.bitwise_count(x.view(np.uint8)).astype(np.int16)
        at = np.arange(0, len(x), INNER)
        return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)

    (alo, ahi), (blo, bhi) = boxes(a), boxes(b)
    shift = 0 if same else len(a)
    forest, found = Forest(len(b) + shift), []
    for p in range(len(alo)):
        gaps = np.maximum(0, np.maximum(alo[p] - bhi, blo - ahi[p])).sum(axis=1)
        for q in np.flatnonzero(gaps <= radius).tolist():
            if same and q < p:
                continue
            i, j = np.nonzero(distances(a[p * INNER:(p + 1) * INNER], b[q * INNER:(q + 1) * INNER]) <= radius)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            if len(i):
                i, j = i + p * INNER, j + q * INNER
                used = forest.grow(i, j + shift)
                found += zip(i[used].tolist(), j[used].tolist())
    return found


@dataclass
class Sets:
    """Fingerprints (n, words) with their sets of shingle hashes, one after the other."""

    fps: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray


def compare_sets(a: Sets, b: Sets, radius: int, least: float, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius whose sets have a Jaccard similarity of at least `least`.

    Every close pair is checked, near ones first, but for those whose ends are joined already by links that passed.
    """
    ids = np.unique(np.concatenate([a.grams, b.grams]), return_inverse=True)[1]
    a_sets = np.split(ids[:len(a.grams)], np.cumsum(a.sizes)[:-1])
    b_sets = np.split(ids[len(a.grams):], np.cumsum(b.sizes)[:-1])
    seen = np.zeros(len(ids), bool)

    def passed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for x in np.unique(i).tolist():
            at = np.flatnonzero(i == x)
            others = [b_sets[y] for y in j[at].tolist()]
            sizes = b.sizes[j[at]]
            seen[a_sets[x]] = True
            common = np.add.reduceat(seen[np.concatenate(others)], np.cumsum(sizes) - sizes, dtype=np.int64)
            seen[a_sets[x]] = False
            out[at] = common >= least * (a.sizes[x] + sizes - common)
        return out

    shift = 0 if same else len(a.fps)
    forest, found = Forest(len(b.fps) + shift), []
    for p in range(0, len(a.fps), INNER):
        bits = distances(a.fps[p:p + INNER], b.fps)
        small, large = (f(a.sizes[p:p + INNER, None], b.sizes[None, :]) for f in (np.minimum, np.maximum))
        i, j = np.nonzero((bits <= radius) & (small > 0) & (small >= least * large - 1e-6))
        order = np.argsort(bits[i, j], kind="stable")
        i, j = i[order] + p, j[order]
        if same:
            i, j = i[i < j], j[i < j]
        for start in range(0, len(i), CHECKS):
            ci, cj = i[start:start + CHECKS], j[start:start + CHECKS]
            apart = forest.roots(ci) != forest.roots(cj + shift)
            ci, cj = ci[apart], cj[apart]
            good = passed(ci, cj)
            ci, cj = ci[good], cj[good]
            used = forest.grow(ci, cj + shift)
            found += zip(ci[used].tolist(), cj[used].tolist())
    return found


def links(cut: DataFrame, radius: int) -> DataFrame:
    """u, v: fingerprints (binary) within the radius of each other; per tile pair a spanning forest of them."""
    width = F.size("mins")
    pairs = tile_pairs(cut, radius)
    w = Written(cut.sparkSession)
    pairs = w.put(pairs, "pairs")
    left = pairs.join(cut.select(F.col("tile").alias("a"), F.col("fps").alias("a_fps"), width.alias("width")), "a")
    right = pairs.join(cut.select(F.col("tile").alias("b"), F.col("fps").alias("b_fps")), "b")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in ("a", "b", "a_fps", "b_fps", "width")}
                x, y = (np.frombuffer(one[c], np.uint64).reshape(-1, one["width"] // 8) for c in ("a_fps", "b_fps"))
                found = np.array(compare(x, y, radius, one["a"] == one["b"]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x[found[:, 0]]], pa.binary()),
                                                  pa.array([v.tobytes() for v in y[found[:, 1]]], pa.binary())], ["u", "v"])

    return left.join(right, ["a", "b"]).mapInArrow(run, "u binary, v binary")


def set_tiles(docs: DataFrame, reps: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Fingerprints that have candidate links, with their shingle sets, cut into tiles by group: tile, first and last group, payloads.

    reps: fp and the document that stands for it; nodes: fp and root, the group. Sets are made for linked documents alone.
    """
    wanted = nodes.join(reps.where("doc IS NOT NULL"), "fp").select("fp", "root", F.col("doc").alias("doc_id"))

    def run(batches):
        for whole in batches:
            for batch in in_parts(whole):
                kept, sets, sizes = [], [], []
                for n, (fp, text) in enumerate(zip(batch.column("fp").to_pylist(), batch.column("text").to_pylist())):
                    words = words_of(text)
                    if fingerprint(words, size, len(fp) // 8, True) == fp:
                        grams = np.unique(np.array([xxhash.xxh3_64_intdigest(g) >> 1 for g in shingles(words, size)], np.int64))
                        kept.append(n)
                        sets.append(grams.tobytes())
                        sizes.append(len(grams))
                rows = batch.select(["root", "fp"]).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["root", "fp", "size", "grams"])

    def pack(batches):
        from pyspark import TaskContext

        part, made, held, total = TaskContext.get().partitionId(), 0, [], 0

        def tile():
            nonlocal made
            made += 1
            roots, fps, sizes, grams = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + made], pa.int64()), pa.array([roots[0]], pa.binary()), pa.array([roots[-1]], pa.binary()), pa.array([b"".join(fps)], pa.binary()),
                 pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), pa.array([b"".join(grams)], pa.binary())], ["tile", "first", "last", "fps", "sizes", "grams"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("root", "fp", "size", "grams"))):
                if held and (len(held) >= SET_TILE or total + r[2] > SET_GRAMS):
                    yield tile()
                    held, total = [], 0
                held.append(r)
                total += r[2]
        if held:
            yield tile()

    texts = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).join(wanted, "doc_id")
    w = Written(docs.sparkSession)
    sets = w.put(texts.select("root", "fp", "text").mapInArrow(run, "root binary, fp binary, size long, grams binary").dropDuplicates(["fp"]), "sets")
    n, grams = sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return (sets.repartitionByRange(1 + max(n // SET_TILE, grams // SET_GRAMS), "root", "fp").sortWithinPartitions("root", "fp")
            .mapInArrow(pack, "tile long, first binary, last binary, fps binary, sizes binary, grams binary"))


def alike(cut: DataFrame, radius: int, least: float) -> DataFrame:
    """u, v: fingerprints within the radius whose shingle sets have a Jaccard similarity of at least `least`; a spanning forest of
    them per pair of tiles. Tiles are sorted by group, so groups that two tiles share are the first or last of both."""
    ends = cut.select("tile", F.explode(F.array_distinct(F.array("first", "last"))).alias("root"))
    w = Written(cut.sparkSession)
    pairs = w.put(ends.withColumnRenamed("tile", "a").join(ends.withColumnRenamed("tile", "b"), "root").where("a <= b").select("a", "b").distinct(), "pairs")
    left = pairs.join(cut.select(F.col("tile").alias("a"), *[F.col(c).alias("a_" + c) for c in ("fps", "sizes", "grams")]), "a")
    right = pairs.join(cut.select(F.col("tile").alias("b"), *[F.col(c).alias("b_" + c) for c in ("fps", "sizes", "grams")]), "b")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                x, y = (Sets(np.frombuffer(one[t + "_fps"], np.uint64).reshape(len(one[t + "_sizes"]) // 8, -1), np.frombuffer(one[t + "_sizes"], np.int64),
                             np.frombuffer(one[t + "_grams"], np.int64)) for t in "ab")
                found = np.array(compare_sets(x, y, radius, least, one["a"] == one["b"]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x.fps[found[:, 0]]], pa.binary()),
                                                  pa.array([v.tobytes() for v in y.fps[found[:, 1]]], pa.binary())], ["u", "v"])

    return left.join(right, ["a", "b"]).mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, n64: int = 1, least: float | None = None, rooted: bool = False) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least doc_id reachable over links of at most `radius` differing bits. rooted: with
    the fingerprint that stands for the component (root), which tells components apart where unlike texts share an id.

    Documents of one fingerprint are one node (a group of copies is aggregated before anything is compared), and links join nodes.
    least: links must also have this Jaccard similarity of shingle sets, which is checked exactly for every link that could still join
    two components; fingerprints are then those of the sets, equal shingles counted once. Null texts are empty; documents without words
    have fingerprint zero and link like any other. Repeated rows give repeated rows. A null doc_id is no component's least unless all
    are null, and such documents are not checked by `least`, which needs the id. Other columns are ignored.
    """
    w = Written(docs.sparkSession)
    marked = w.put(fingerprints(docs, size, n64, least is not None), "fingerprints")
    reps = w.put(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    cut = w.put(tiles(reps.select("fp"), reps.count()), "tiles")
    found = w.put(links(cut, radius).distinct(), "links")
    w.drop(cut)
    if least is not None:
        groups = w.put(components(found).select(F.col("node").alias("fp"), "root"), "groups")
        cut = w.put(set_tiles(docs, reps, groups, size), "tiles")
        found = w.put(alike(cut, radius, least), "alike")
        w.drop(cut)
    nodes = w.put(components(found).withColumnsRenamed({"node": "fp"}), "nodes")
    best = nodes.join(reps, "fp").groupBy("root").agg(F.min("doc").alias("component_id"))
    linked = nodes.join(best, "root").select("fp", "component_id", "root")
    ids = w.put(reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc").alias("component_id"), *([F.coalesce("root", "fp").alias("root")] if rooted else [])), "ids")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", *(["root"] if rooted else []))


def with_fingerprint(docs: DataFrame, size: int, n64: int, once: bool) -> DataFrame:
    """All columns and the fingerprint (hex, column `_fp`) of each row's own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole):
                fps = [fingerprint(words_of(t), size, n64, once).hex() for t in batch.column("_bytes").to_pylist()]
                yield batch.drop_columns(["_bytes"]).append_column("_fp", pa.array(fps, pa.string()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_bytes", F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(run, f"{kind}, _fp string")


def one_of_each(docs: DataFrame, size: int, radius: int, n64: int = 1, least: float | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each group of near-duplicates does: the one of the least doc_id, at equal ids of the least fingerprint.

    Decided by row, that is by id and text: of unlike texts under one id each stays or goes with its own group. Rows equal in id and
    fingerprint are one document; the least of them (all columns, as JSON) stays, so reruns agree. Rows without an id stay, all of
    them. Null texts are empty. All columns are kept; none may be called _fp, _bytes or _json. An empty table stays empty.
    """
    w = Written(docs.sparkSession)
    found = w.put(near_duplicates(docs, size, radius, n64, least, rooted=True).where("doc_id IS NOT NULL"), "components")
    kinds = found.groupBy("doc_id", "fingerprint").agg(F.first("root").alias("root"), F.count("*").alias("rows"))
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "fingerprint")).alias("best"))
    stays = (F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.fingerprint") == F.col("fingerprint"))
    judged = w.put(kinds.join(best, "root").select("doc_id", "fingerprint", "rows", stays.alias("stays")), "judged")
    ids = judged.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.sum("rows").alias("rows"))
    # most ids have one row, or go as a whole: they need no look at their texts
    apart = w.put(ids.where("NOT some OR rows > 1").select(F.col("doc_id").alias("_id"), "some"), "apart")
    same_id = docs["doc_id"].cast("long") == apart["_id"]
    easy = docs.join(apart, same_id, "left_anti")
    hard = docs.join(apart.where("some"), same_id, "left_semi")
    if not apart.where("some").limit(1).count():
        return easy
    wanted = judged.where("stays").select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_kept"))
    rows = with_fingerprint(hard, size, n64, least is not None)
    rows = rows.join(wanted, (rows["doc_id"].cast("long") == wanted["_id"]) & (rows["_fp"] == wanted["_kept"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = rows.withColumn("_json", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    first = rows.groupBy("_id", "_fp").agg(F.min_by(F.struct(*columns), "_json").alias("row"))
    return easy.unionByName(first.select("row.*"))
