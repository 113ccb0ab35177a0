"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few tokens: the tokens at its 1s are hashed, those at its 0s are ignored, so it still hits when
tokens at ignored places were substituted. The seeds follow from the criterion that is verified, a stretch with enough matches that
are a large enough share of it. A stretch of twice the matches asked for can be cut in two, of which one meets the
criterion too, so each holds one of a finite set of short stretches; masks are picked until each of those holds one (`seeds_of`). Hashes
of all benchmark seeds and of all document seeds are joined; hits without a short stretch around them are dropped, and on
the diagonal of each other one document and item are compared token by token, and the stretch of most matches is verified.

The benchmark goes to the tasks in blocks of at most BLOCK_TOKENS tokens (a proven size; more items make more passes over the
documents, not larger broadcasts); documents are read where they lie, nothing of them is shuffled but the overlaps found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import in_parts, mixed

#: Tokens counted in a seed (fewer if fewer matches are asked for)
SEED = 5
BLOCK_TOKENS = 1 << 20
LEAST_TOKENS = 8
LEAST_SHARE = 0.75
BITMAP = 22
#: Hits compared at once
HITS = 1 << 18
#: Document tokens looked at together
TOGETHER = 1 << 18
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits (A-Z lower-cased) and of bytes above 7F; punctuation separates."""
    return TOKEN.findall(text.lower())


def short_stretches(least: int, share: float) -> list[str]:
    """Stretches of `least` to 2 * `least` - 1 matches (1) that are at least `share` of them, from a match to a match. Every longer
    stretch that meets the criterion holds one of these."""
    out = []
    for matches in range(least, 2 * least):
        free = int(matches / share + 1e-9) - matches
        for gaps in combinations_with_replacement(range(1, matches), free) if matches > 1 else [()]:
            # all ways to deal so many substitutions, and with them (their places may fall away) those with fewer
            zeros = Counter(gaps)
            out.append("".join("1" + "0" * zeros[i + 1] for i in range(matches)))
    return out


@lru_cache
def seeds_of(count: int, least: int, share: float) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Leading tokens and, for each seed, the places of its other tokens as seen from the first leading one (also before it).

    All short stretches hold so many successive matches as there are leading tokens. The masks are picked greedily, those first that the
    most stretches hold, until every one of them holds a mask. One of them is `count` matches in succession, which items with fewer tokens
    than the matches asked for need."""
    kinds = short_stretches(max(least, count), share)
    lead = min(min(max(map(len, k.split("0"))) for k in kinds), count)
    pad = 2 * count
    bits = np.array([int(k[::-1], 2) << pad for k in kinds], object)
    width = max(map(len, kinds))
    bits = np.array([[b >> i & 1 for i in range(width + 2 * pad)] for b in bits], bool)
    runs = np.logical_and.reduce([bits[:, pad + i:pad + i + width] for i in range(lead)])

    def held(rest: tuple[int, ...]) -> np.ndarray:
        return np.logical_and.reduce([runs, *[bits[:, pad + i:pad + i + width] for i in rest]]).any(axis=1)

    first = tuple(range(lead, count))
    picked, open_ = [first], ~held(first)
    # near places first: a mask of a small span is the better one of two that as many stretches hold
    near = sorted(combinations([i for i in range(lead - count - 2, count + 3) if not 0 <= i < lead], count - lead), key=lambda r: (max(*r, lead - 1) - min(*r, 0), r)) if lead < count else []
    while open_.any():
        gains = [(held(r) & open_).sum() for r in near]
        best = int(np.argmax(gains))
        if not gains[best]:
            raise ValueError(f"no seed of {count} tokens for {least} matches at a share of {share}")
        picked.append(near[best])
        open_ &= ~held(near[best])
    return lead, tuple(picked)


def stirred(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def lead_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` successive tokens from every place on; 0 if one of them has code 0 (not in the benchmark, or no token)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, whole = np.full(n, 1, np.uint64), np.ones(n, bool)
    for i in range(size):
        whole &= codes[i:i + n] != 0
        out = stirred(out, codes[i:i + n])
    return np.where(whole, out, np.uint64(0))


def seed_hashes(codes: np.ndarray, at: np.ndarray, lead: np.ndarray, rest: np.ndarray, no: int) -> np.ndarray:
    """Hash of a seed's tokens at some places, of which the lead is hashed already; 0 if a counted token has code 0."""
    out, whole = stirred(lead, np.uint64(no + 1)), lead != 0
    for i in rest.tolist():
        part = codes[at + i]
        whole &= part != 0
        out = stirred(out, part)
    return np.where(whole, out, np.uint64(0))


def bitmap_of(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITMAP, bool)
    out[(hashes >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return bitmap[(hashes >> np.uint64(64 - BITMAP)).astype(np.int64)] & (hashes != 0)


class Items:
    """A block of benchmark items: vocabulary, all items' tokens in one array, sorted hashes of all seeds with their place in it."""

    def __init__(self, rows: list[tuple[int, bytes]], least: int = LEAST_TOKENS, share: float = LEAST_SHARE):
        self.ids, self.least, self.share = [i for i, _ in rows], max(least, 1), share
        texts = [tokens(t) for _, t in rows]
        words = sorted(set().union(*texts)) if texts else []
        self.vocabulary = dict(zip(words, mixed(np.arange(1, 1 + len(words), dtype=np.uint64)).tolist()))
        self.codes = [np.array([self.vocabulary[t] for t in ts], np.uint64) for ts in texts]
        count = min(SEED, self.least)
        # what has more matches has those 8 as well
        lead, others = seeds_of(count, min(self.least, LEAST_TOKENS), share)
        # a short stretch is no longer than this; items stand further apart, and away from both ends
        self.reach = max(int((2 * self.least - 1) / share + 1e-9), 3 * SEED)
        gap = np.zeros(self.reach + 1, np.uint64)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.starts = np.cumsum(self.sizes + len(gap)) - self.sizes
        self.all = np.concatenate([gap, *[x for c in self.codes for x in (c, gap)]])
        #: (leading tokens, bitmap of their hashes, [(places of the other tokens, number)]): all seeds, and one for each size of items below a seed's
        self.seeds, hashes, places = [], [], []
        for size, kinds in [(lead, [(np.array(r, np.int64), no) for no, r in enumerate(others)])] + [(int(n), [(np.zeros(0, np.int64), 1000 + int(n))]) for n in np.unique(self.sizes[(self.sizes > 0) & (self.sizes < count)])]:
            leads = lead_hashes(self.all, size)
            at = np.flatnonzero(leads) if kinds[0][1] < 1000 else self.starts[self.sizes == size]
            leads = leads[at]
            self.seeds.append((size, bitmap_of(leads), kinds))
            for rest, no in kinds:
                h = seed_hashes(self.all, at, leads, rest, no)
                hashes.append(h[h != 0])
                places.append(at[h != 0].astype(np.int32))
        self.hashes, self.places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]
        self.bitmap = bitmap_of(self.hashes)

    def diagonals(self, parts: list[np.ndarray]) -> np.ndarray:
        """Distinct (document, item, place in the document minus place in the item) of all seed hits in a stretch that has the matches
        asked for. Documents are looked at together, as one array in which they stand apart as items do."""
        out = []
        edge = np.zeros(self.reach + 1, np.uint64)
        codes = np.concatenate([edge, *[x for p in parts for x in (p, edge)]])
        sizes = np.array([len(p) + len(edge) for p in parts], np.int64)
        origin = np.cumsum(sizes) - sizes + len(edge)
        for size, bitmap, kinds in self.seeds:
            leads = lead_hashes(codes, size)
            begin = np.flatnonzero(marked(bitmap, leads))
            leads = leads[begin]
            for rest, no in kinds if len(begin) else []:
                h = seed_hashes(codes, begin, leads, rest, no)
                hit = np.flatnonzero(marked(self.bitmap, h))
                first, last = np.searchsorted(self.hashes, h[hit], "left"), np.searchsorted(self.hashes, h[hit], "right")
                there = last > first
                hit, first, n = begin[hit[there]], first[there], (last - first)[there]
                # few rows at a time, however often a seed is repeated in the items and in the document
                cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1 if len(n) else []
                for at, low, k in zip(np.split(hit, cuts), np.split(first, cuts), np.split(n, cuts)):
                    rows = np.repeat(low - np.cumsum(k) + k, k) + np.arange(k.sum())
                    where, place = self.lasting(codes, np.repeat(at, k), self.places[rows].astype(np.int64))
                    if len(where):
                        doc, item = np.searchsorted(origin, where, "right") - 1, np.searchsorted(self.starts, place, "right") - 1
                        out.append(np.unique(np.stack([doc, item, where - origin[doc] - place + self.starts[item]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def lasting(self, codes: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the documents, in the items) of hits that lie in a stretch, no longer than short ones are, with the matches asked for and their share."""
        item = np.searchsorted(self.starts, place, "right") - 1
        asked = np.minimum(self.least, self.sizes[item])
        around = range(-self.reach, self.reach + 1)

        def alike(i: int, rows: np.ndarray) -> np.ndarray:
            # items, and the ends, stand more than the reach apart: these places are the item's own or in the gaps beside it
            own = self.all[place[rows] + i]
            return (codes[at[rows] + i] == own) & (own != 0)

        rows = np.arange(len(at))
        rows = rows[sum((alike(i, rows).astype(np.int32) for i in around), np.zeros(len(rows), np.int32)) >= asked]
        sums = np.zeros((len(around) + 1, len(rows)), np.int32)
        for n, i in enumerate(around):
            sums[n + 1] = sums[n] + alike(i, rows)
        kept = np.zeros(len(rows), bool)
        for length in range(1, self.reach + 1):
            # stretches that hold the place of the hit
            first = np.arange(max(0, self.reach + 1 - length), self.reach + 1)
            most = (sums[first + length] - sums[first]).max(axis=0, initial=0)
            kept |= (most >= asked[rows]) & (most >= self.share * length - 1e-9)
        rows = rows[kept]
        return at[rows], place[rows]

    def overlap(self, codes: np.ndarray, item: int, shift: int) -> tuple[int, int, int]:
        """First and last + 1 document token of the stretch of most matches on the diagonal among those in which they are the share asked
        for (the shortest, then the first, of several), and its matches."""
        own = self.codes[item]
        lo, hi = max(0, shift), min(len(codes), shift + len(own))
        same = codes[lo:hi] == own[lo - shift:hi - shift]
        return (lo, lo, 0) if not same.any() else tuple(x + y for x, y in zip((lo, lo, 0), best_stretch(same, self.share)))


def best_stretch(same: np.ndarray, share: float) -> tuple[int, int, int]:
    """Start, end and matches of the stretch of most matches that are at least `share` of it; the shortest, then the first, of several.

    For each end the start with the most matches is the first one at which matches less share * places stand no higher than at the end."""
    count = np.concatenate([[0], np.cumsum(same)])
    over = count - share * np.arange(len(count))
    low = np.minimum.accumulate(over)
    start = np.searchsorted(-low, -over - 1e-9, "left")
    # from a match to a match: what is cut off at the ends raises the share
    hits = np.flatnonzero(same)
    ends = hits + 1
    begin = start[ends]
    begin = hits[np.searchsorted(hits, begin, "left")]
    matches = count[ends] - count[begin]
    best = np.lexsort((begin, ends - begin, -matches))[0]
    return int(begin[best]), int(ends[best]), int(matches[best])


def overlaps(texts: list[bytes], block: Items) -> Iterator[dict[int, tuple[int, int, int, int]]]:
    """For each text the best verified overlap per item: item number -> (matches, first token, last token + 1, tokens of the item).

    Texts are taken together up to TOGETHER tokens (a longer one by itself), so that short ones do not cost a round of array calls each."""
    known, held, total = block.vocabulary, [], 0

    def judged():
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in held]
        for doc, item, shift in block.diagonals(held).tolist():
            start, end, matches = block.overlap(held[doc], item, shift)
            size = len(block.codes[item])
            if matches >= min(block.least, size):
                best[doc][item] = max(best[doc].get(item, (0, 0, 0, 0)), (matches, -start, -end, size))
        return [{i: (m, -s, -e, n) for i, (m, s, e, n) in b.items()} for b in best]

    for text in texts:
        found = tokens(text)
        codes = np.fromiter((known.get(t, 0) for t in found), np.uint64, len(found))
        if held and total + len(codes) > TOGETHER:
            yield from judged()
            held, total = [], 0
        held.append(codes)
        total += len(codes)
    yield from judged()


def blocks_of(benchmark: DataFrame, most: int = BLOCK_TOKENS):
    """Items in blocks of at most `most` tokens (a single longer item is a block of its own), read one partition at a time."""
    rows, size = [], 0
    for r in (benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
              .distinct().orderBy("item_id", F.xxhash64("text")).toLocalIterator()):
        n = len(r["text"]) // 2 + 1
        if rows and size + n > most:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], bytes(r["text"])))
        size += n
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, matches, first_token, end_token, item_tokens: the best verified overlap of each document and item.

    An overlap is a stretch of successive tokens in which at least `least` match (all, for shorter items) and those are at least `share`
    of it. Every document and item that have one are found, also items shorter than the seeds, and further matches never make an overlap
    less; items without a token match nothing. Of several, that of most matches is given, then the first in the document. Null texts are
    empty, ids may be null, repeated rows are found each. Other columns are ignored. Documents without an overlap give no row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    kind = "doc_id long, item_id long, matches int, first_token int, end_token int, item_tokens int"
    out = None
    for rows in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = Items(shared.value, least, share)
            for whole in batches:
                for b in in_parts(whole):
                    found = [(i, block.ids[item], m, s, e, n) for i, best in zip(b.column("doc_id").to_pylist(), overlaps(b.column("text").to_pylist(), block))
                             for item, (m, s, e, n) in sorted(best.items())]
                    names = ["doc_id", "item_id", "matches", "first_token", "end_token", "item_tokens"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64() if k < 2 else pa.int32()) for k in range(6)], names)

        part = texts.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS, share: float = LEAST_SHARE) -> DataFrame:
    """Rows of docs whose text has no such overlap of at least `least` matches, with all their columns; decided row by row, where
    the rows lie. Items of fewer tokens take no document away (a word like 'yes' is no passage); contaminated() reports them."""
    for rows in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = Items(shared.value, least, share)
            for whole in batches:
                for b in in_parts(whole):
                    texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                    yield b.filter(pa.array([all(m < least for m, *_ in best.values()) for best in overlaps(texts, block)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
