"""Duplicate substrings of at least 200 bytes anywhere in the corpus, removed exactly.

Like induced sorting, only a sample of suffixes is compared directly and the rest is induced from it. Sampling is recursive: a
position is kept when its name is less than both neighbours' (the local minima of the order of names, as LMS positions are of the
order of suffixes), names of what is kept form the next level, three levels deep, about one byte in 27. Every
sampled place (an anchor) is decided by the bytes of its context alone, so equal strings hold equal anchors. Tuples of
context and of the segment that leads to it are brought together by sorted shuffles; neighbours with an equal segment have a
common prefix over it, and all windows inside are induced to be repeated. A window with a context that occurs once cannot be repeated.
What neither rule decides (windows at the ends of a match, windows without an anchor) is compared by itself.

The README tells how this differs from external induced sorting with queues of all suffixes, and why. Strings are compared by
64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.blocks import ROW, groups, row, squeezed, unsqueezed
from lintlake.llm.common import Written, doc_bytes, in_parts, mixed

LENGTH = 200
GRAM = 16
LEVELS = 3
BLOCK_BYTES = 4 << 20
SHARD_TUPLES = 2_500_000
BYTES_PER_ANCHOR = 27
TEXT_LEVEL = 6
ONCE, INSIDE, SHOWN, OPEN = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses, modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Text:
    """Prefix sums of a text: hashes of its substrings; its anchors."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_LETTERS[raw] * up[:self.n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes [start, end), by content and length; never 0."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(raw + (end - start).astype(np.uint64)) | np.uint64(1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts [lo, hi), both increasing."""
        n = self.n - GRAM + 1
        if n < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        name = mixed((self.sums[GRAM:] - self.sums[:n]) * self.down[:n])
        lo = np.arange(n)
        hi = lo + GRAM
        for _ in range(LEVELS):
            if len(name) < 3:
                return lo[:0], hi[:0]
            kept = np.flatnonzero((name[1:-1] < name[:-2]) & (name[1:-1] < name[2:]))
            lo, hi, name = lo[kept], hi[kept + 2], mixed(name[kept + 1] + np.uint64(1))
        return lo, hi

    def tuples(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor the hash of its context, and of the segment from the anchor before to LENGTH bytes after its begin (0: there is none)."""
        context, segment = self.hashes(lo, hi), np.zeros(len(lo), np.uint64)
        full = np.flatnonzero(lo[1:] + LENGTH <= self.n) + 1
        segment[full] = self.hashes(lo[full - 1], lo[full] + LENGTH)
        return context, segment

    def windows(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of all windows: known to be repeated; to be compared by themselves."""
        count = self.n - LENGTH + 1
        marks = np.zeros((2, count + 1), np.int32)
        for k, (which, start, end) in enumerate(((np.flatnonzero(code == ONCE), hi - LENGTH, lo),
                                                 (np.flatnonzero(((code == INSIDE) | (code == SHOWN)) & (segment != 0)), np.roll(lo, 1), lo))):
            a, b = np.maximum(start[which], 0), np.minimum(end[which], count - 1) + 1
            good = a < b
            np.add.at(marks[k], a[good], 1)
            np.add.at(marks[k], b[good], -1)
        once, inside = np.cumsum(marks, axis=1)[:, :count] > 0
        place = np.arange(count)
        first = np.searchsorted(lo, place)
        there = first < len(lo)
        there[there] = hi[first[there]] <= place[there] + LENGTH
        asked = ~there
        asked[there] = code[first[there]] >= SHOWN
        return inside, asked & ~once


def cut(sizes: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    return np.split(raw, np.cumsum(sizes)[:-1])


def block_tuples(texts: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The anchors of each text, and all tuples in order."""
    parts, context, segment = [], [], []
    for raw in texts:
        t = Text(raw)
        lo, hi = t.anchors()
        c, s = t.tuples(lo, hi)
        parts.append((lo, hi))
        context.append(c)
        segment.append(s)
    return parts, np.concatenate(context), np.concatenate(segment)


def dealt(shards: int, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order of shard, then key: numbers of their first rows, whether they repeat, which one each row has, and the
    first of each shard."""
    shard = mixed(keys[0]) % np.uint64(shards)
    order = np.lexsort((*keys[::-1], shard))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.cumsum(new) - 1
    which = np.empty(len(order), np.int64)
    which[order] = number
    first = order[new]
    many = np.bincount(number, minlength=len(first)) > 1
    return first, many, which, np.searchsorted(shard[first], np.arange(shards + 1, dtype=np.uint64))


def stored(texts: DataFrame) -> DataFrame:
    """Blocks of texts of at least LENGTH bytes, each once in its task."""

    def run(batches):
        from pyspark import TaskContext

        part, made, seen = TaskContext.get().partitionId(), 0, set()
        held, size = [], 0

        def block():
            nonlocal made, held, size
            made += 1
            sizes, raw = np.array(list(map(len, held)), np.int64), np.frombuffer(b"".join(held), np.uint8)
            held, size = [], 0
            return row(-1, (part << 24) + made, 0, 0, squeezed(TEXT_LEVEL, sizes=sizes, raw=raw))

        for whole in batches:
            for b in in_parts(whole, BLOCK_BYTES):
                for t in b.column("text").to_pylist():
                    mark = hashlib.md5(t).digest()
                    if len(t) >= LENGTH and mark not in seen:
                        seen.add(mark)
                        held.append(t)
                        size += len(t)
                        if size >= BLOCK_BYTES:
                            yield block()
        if held:
            yield block()

    return texts.mapInArrow(run, ROW)


def sampled(store: DataFrame, shards: int) -> DataFrame:
    """kind 1: a block's distinct tuples for one shard."""

    def run(batches):
        for name, rows in groups(batches, "block"):
            main = unsqueezed(rows[0]["payload"])
            _, context, segment = block_tuples(cut(main["sizes"], main["raw"]))
            first, many, _, cuts = dealt(shards, context, segment)
            context, segment = context[first], segment[first]
            for s in range(shards):
                x = slice(cuts[s], cuts[s + 1])
                if cuts[s] < cuts[s + 1]:
                    yield row(s, name, 1, 0, squeezed(context=np.diff(context[x], prepend=np.uint64(0)), segment=segment[x], many=many[x]))

    return store.mapInArrow(run, ROW)


def codes_of(context: np.ndarray, segment: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What a shard says of each tuple: ONCE, the context occurs once; INSIDE, the segment repeats; SHOWN, it does, and as others
    of the context are open, its windows must be shown to them (first tuple of each segment alone); OPEN."""
    order = np.lexsort((segment, context))
    c, s, m = context[order], segment[order], many[order].astype(np.int64) + 1
    new_c = np.concatenate([[True], c[1:] != c[:-1]])
    new_s = new_c | np.concatenate([[True], s[1:] != s[:-1]])
    group, run = np.cumsum(new_c) - 1, np.cumsum(new_s) - 1
    resolved = (s != 0) & (np.bincount(run, m)[run] >= 2)
    once = np.bincount(group, m)[group] < 2
    some_open = np.bincount(group, ~resolved)[group] > 0
    code = np.where(once, ONCE, np.where(~resolved, OPEN, np.where(some_open & new_s, SHOWN, INSIDE))).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return out


def judged(tuples: DataFrame, shards: int) -> DataFrame:
    """kind 1: a shard's codes for a block's tuples, in their order."""

    def run(batches):
        for shard, rows in groups(batches, "shard"):
            own = [unsqueezed(r["payload"]) for r in rows]
            context = np.concatenate([np.cumsum(o["context"], dtype=np.uint64) for o in own])
            code = codes_of(context, np.concatenate([o["segment"] for o in own]), np.concatenate([o["many"] for o in own]))
            for r, c in zip(rows, np.split(code, np.cumsum([len(o["segment"]) for o in own])[:-1])):
                yield row(shard, r["block"], 1, 0, squeezed(code=c))

    return tuples.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, ROW)


def induced(blocks: DataFrame, shards: int) -> DataFrame:
    """By block: kind 3 what is known of its windows; kind 1 its distinct open windows for one shard."""

    def run(batches):
        for name, rows in groups(batches, "block"):
            main = unsqueezed(rows[0]["payload"])
            parts, context, segment = block_tuples(cut(main["sizes"], main["raw"]))
            _, _, which, _ = dealt(shards, context, segment)
            told = [unsqueezed(r["payload"])["code"] for r in rows[1:]]
            code = np.concatenate(told)[which] if told else np.zeros(0, np.uint8)
            inside, asked, hashes, at = [], [], [], 0
            for raw, (lo, hi) in zip(cut(main["sizes"], main["raw"]), parts):
                t = Text(raw)
                known, ask = t.windows(lo, hi, code[at:at + len(lo)], segment[at:at + len(lo)])
                at += len(lo)
                place = np.flatnonzero(ask)
                inside.append(np.packbits(known))
                asked.append(np.packbits(ask))
                hashes.append(t.hashes(place, place + LENGTH))
            hashes = np.concatenate(hashes)
            first, many, which, cuts = dealt(shards, hashes)
            yield row(-1 - name % shards, name, 3, 0, squeezed(inside=np.concatenate(inside), asked=np.concatenate(asked), which=which.astype(np.uint32)))
            hashes = hashes[first]
            for s in range(shards):
                x = slice(cuts[s], cuts[s + 1])
                if cuts[s] < cuts[s + 1]:
                    yield row(s, name, 1, 0, squeezed(hash=np.diff(hashes[x], prepend=np.uint64(0)), many=many[x]))

    return blocks.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(run, ROW)


def compared(windows: DataFrame, shards: int) -> DataFrame:
    """By window shard: kind 4, which of a block's open windows repeat. Rows of kind 3 pass through."""

    def run(batches):
        for shard, rows in groups(batches, "shard"):
            if shard < 0:
                for r in rows:
                    yield row(shard, r["block"], 3, 0, r["payload"])
                continue
            own = [unsqueezed(r["payload"]) for r in rows]
            _, which = np.unique(np.concatenate([np.cumsum(o["hash"], dtype=np.uint64) for o in own]), return_inverse=True)
            again = np.bincount(which, np.concatenate([o["many"] for o in own]).astype(np.int64) + 1)[which] >= 2
            for r, x in zip(rows, np.split(again, np.cumsum([len(o["many"]) for o in own])[:-1])):
                yield row(shard, r["block"], 4, 0, squeezed(again=x))

    return windows.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, ROW)


def covered(repeated: np.ndarray) -> np.ndarray:
    """Bytes in any repeated window, from marks of windows."""
    step = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + LENGTH - 1
    marks = np.zeros(len(repeated) + LENGTH, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks)[:-1] > 0


def removed(blocks: DataFrame) -> DataFrame:
    """mark (md5 of the text), n_removed, n_spans, kept_sha256 of every text of the blocks."""
    import pyarrow as pa

    def run(batches):
        for _, rows in groups(batches, "block"):
            main, state = unsqueezed(rows[0]["payload"]), unsqueezed(rows[1]["payload"])
            told = [unsqueezed(r["payload"])["again"] for r in rows[2:]]
            again = np.concatenate(told)[state["which"]] if told else np.zeros(0, bool)
            out, byte, at = [], 0, 0
            for raw in cut(main["sizes"], main["raw"]):
                count = len(raw) - LENGTH + 1
                width = -(-count // 8)
                inside = np.unpackbits(state["inside"][byte:byte + width], count=count).astype(bool)
                asked = np.flatnonzero(np.unpackbits(state["asked"][byte:byte + width], count=count))
                byte += width
                inside[asked] |= again[at:at + len(asked)]
                at += len(asked)
                gone = covered(inside)
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                out.append((hashlib.md5(raw).hexdigest(), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             ["mark", "n_removed", "n_spans", "kept_sha256"])

    return blocks.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(run, "mark string, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs: bytes in a string of LENGTH bytes that also starts elsewhere
    in any row, the same one included, are removed; judged on the input; matches never cross rows.

    Null texts are empty; ids may be null or repeat, rows with equal texts are copies of each other. Texts under LENGTH bytes keep
    everything. Other columns are ignored. A text is held whole by one task, with some 60 bytes of work space for each of its bytes.
    """
    spark = docs.sparkSession
    w = Written(spark)
    texts = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    size = F.octet_length("text").cast("long")
    marks = w.put(texts.select("doc_id", F.md5("text").alias("mark"), size.alias("n_bytes"), F.when(size < LENGTH, F.sha2("text", 256)).alias("short")), "marks")
    copies = w.put(marks.where(F.col("n_bytes") >= LENGTH).groupBy("mark").count().where("count > 1").select("mark", F.lit(True).alias("copied")), "copies")
    total = marks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-total // (BYTES_PER_ANCHOR * SHARD_TUPLES)))
    store = w.put(stored(texts.select("text")).select("shard", "block", "kind", "payload"), "texts")
    codes = judged(sampled(store, shards).select("shard", "block", "payload"), shards).select("shard", "block", "kind", "payload")
    windows = compared(induced(store.unionByName(codes), shards).select("shard", "block", "kind", "payload"), shards).select("shard", "block", "kind", "payload")
    found = w.put(removed(store.unionByName(windows)).dropDuplicates(["mark"]), "removed")
    known = marks.join(copies, "mark", "left")
    plain = known.where(F.col("copied").isNotNull() | (F.col("n_bytes") < LENGTH)).select(
        "doc_id", "n_bytes", F.when(F.col("copied"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(F.col("copied"), 1).otherwise(0).cast("long").alias("n_spans"),
        F.coalesce("short", F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"))
    rest = known.where(F.col("copied").isNull() & (F.col("n_bytes") >= LENGTH)).join(found, "mark").select(plain.columns)
    return plain.unionByName(rest)
