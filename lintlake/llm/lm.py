"""Language-model scoring: a bigram model in Elias-Fano tries, one per shard of word pairs.

P(w | h) = (c(h w) + m(h) P(w)) / (c(h) + m(h)), P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); m(h) is the number of different
successors that c(h) words drawn independently would have. All counts are of all learning texts; nothing is pruned.

Neither vocabulary nor model is broadcast; both grow with the corpus. Four passes move packed arrays, not rows of words:
1. texts become blocks: tokens as numbers in the block's own dictionary; dictionaries are dealt by word hash;
2. each word shard adds up the blocks' counts and answers each block with numbers and counts of its words;
3. each block adds up its (context, word) pairs and deals each different one once, with its learned count, by hash: a very frequent
   context is spread over all shards, and a very frequent pair is one entry a block; how often each document has each pair stays with the block;
4. each pair shard counts, builds its trie with quantised smoothed values, looks all pairs up and answers each block with a value per pair,
   which the block sums by document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.blocks import ROW, groups, row, squeezed, unsqueezed
from lintlake.llm.common import Written, in_parts, mixed, words_of
from lintlake.llm.learning import scored
from lintlake.llm.trie import Trie

BLOCK_TOKENS = 1 << 20
SHARD_PAIRS = 1_200_000
END = b" "
ADD = 0.1
#: Quantised log10 of counts and smoothed counts: 2^16 steps over [LOW, HIGH)
LOW, HIGH = -16.0, 16.0
BINS = 16


def quantise(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round((x - LOW) * (65536 / (HIGH - LOW))), 0, 65535).astype(np.uint16)


def value_of(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * ((HIGH - LOW) / 65536) + LOW


def coded(texts: DataFrame, shards: int) -> DataFrame:
    """Pass 1. kind 0: a block (documents, tokens by number); kind 1: part of its dictionary (hashes, learning counts) for a shard.
    A block's dictionary is sorted by shard, then hash; its numbers are places in that order."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, parts, size, known = [], [], [], [], 0, {}

        def block():
            nonlocal made, ids, held, sizes, parts, size, known
            made += 1
            name = (part << 24) + made
            local = np.concatenate(parts)
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in known], np.uint64)
            shard = mixed(hashes) % np.uint64(shards)
            order = np.lexsort((hashes, shard))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            local = place[local]
            learn = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(local[learn], minlength=len(order)).astype(np.uint32)
            null = np.array([i is None for i in ids])
            yield row(-1, name, 0, int(learn.sum()), squeezed(ids=np.array([i or 0 for i in ids], np.int64), null=null, held=np.array(held, bool),
                                                             sizes=np.array(sizes, np.int64), local=local))
            hashes, shard = hashes[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            for s in range(shards):
                if cuts[s] < cuts[s + 1]:
                    yield row(s, name, 1, 0, squeezed(hashes=hashes[cuts[s]:cuts[s + 1]], counts=counts[cuts[s]:cuts[s + 1]]))
            ids, held, sizes, parts, size, known = [], [], [], [], 0, {}

        for whole in batches:
            for b in in_parts(whole):
                for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist()):
                    words = words_of(t)
                    words.append(END)
                    for w in set(words).difference(known):
                        known[w] = len(known)
                    parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                    ids.append(i)
                    held.append(h)
                    sizes.append(len(words))
                    size += len(words)
                    if size >= BLOCK_TOKENS:
                        yield from block()
        if ids:
            yield from block()

    return texts.mapInArrow(run, ROW)


def counted(dictionaries: DataFrame, shards: int) -> DataFrame:
    """Pass 2, by word shard. kind 1: numbers and counts of a block's words (number 0: not learned); kind 2: how many words have a count
    of about 2^(bin / BINS). Numbers run by count inside a shard and are interleaved over shards, so frequent words have small ones."""

    def run(batches):
        for shard, rows in groups(batches, "shard"):
            own = [unsqueezed(r["payload"]) for r in rows]
            words, inverse = np.unique(np.concatenate([o["hashes"] for o in own]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([o["counts"] for o in own]), minlength=len(words)).astype(np.int64)
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
            numbers = np.where(counts > 0, rank * shards + shard + 1, 0).astype(np.uint64)
            at = 0
            for r, o in zip(rows, own):
                mine = inverse[at:at + len(o["hashes"])]
                at += len(mine)
                yield row(shard, r["block"], 1, 0, squeezed(numbers=numbers[mine], counts=counts[mine].astype(np.uint64)))
            bins = np.bincount(np.round(np.log2(counts[counts > 0]) * BINS).astype(np.int64), minlength=1)
            for b in np.flatnonzero(bins).tolist():
                yield row(shard, b, 2, int(bins[b]), b"")

    return dictionaries.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, ROW)


def expected_kinds(histogram: dict[int, int], total: int) -> tuple[np.ndarray, np.ndarray]:
    """log2 of a context's count, and the expected number of different successors: sum over words of 1 - exp(-c p)."""
    n = np.array([2.0 ** (b / BINS) for b in histogram]) / max(1, total)
    k = np.array(list(histogram.values()), np.float64)
    at = np.arange(0, math.log2(max(2, total)) + 0.25, 0.25)
    return at, np.array([(k * -np.expm1(-(2.0**x) * n)).sum() for x in at])


def dealt_pairs(blocks: DataFrame, totals: tuple[int, int], kinds: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """Pass 3, by block. kind 0: what is known of its documents without the pairs; and how often each has each
    pair (by the pair's place among the block's); kind 1: its different pairs for one shard, sorted, with their learned counts."""
    total, vocabulary = totals

    def run(batches):
        for name, rows in groups(batches, "block"):
            main = unsqueezed(rows[0]["payload"])
            told = [unsqueezed(r["payload"]) for r in rows[1:]]
            numbers = np.concatenate([t["numbers"] for t in told])[main["local"]]
            counts = np.concatenate([t["counts"] for t in told]).astype(np.float64)[main["local"]]
            sizes = main["sizes"]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            p = (counts + ADD) / (total + ADD * (vocabulary + 1))
            base = np.bincount(doc, np.log10(p), len(sizes))
            starts = np.cumsum(sizes) - sizes
            # before the first word stands the end of a text: its context is END, whose number and count the last token has
            before, context = np.roll(counts, 1), np.roll(numbers, 1)
            before[starts], context[starts] = counts[-1], numbers[-1]
            m = np.where(before > 0, np.interp(np.log2(np.maximum(before, 1)), *kinds), 1.0)
            m = np.maximum(m, 1e-9)
            local = -np.log10(before + m)
            smooth = quantise(np.log10(m * p))
            unseen = (numbers == 0) | (context == 0)
            local = np.bincount(doc, local + np.where(unseen, value_of(smooth), 0), len(sizes))
            known = np.bincount(doc, counts > 0, len(sizes)).astype(np.int64)
            rest = np.flatnonzero(~unseen)
            h, w = context[rest], numbers[rest]
            shard = mixed(mixed(h) + w) % np.uint64(shards)
            order = np.lexsort((w, h, shard))
            h, w, shard, rest = h[order], w[order], shard[order], rest[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            pair = np.cumsum(new) - 1
            learned = np.bincount(pair, ~main["held"][doc[rest]], int(new.sum())).astype(np.uint32)
            held_by, times = np.unique(doc[rest] << 32 | pair, return_counts=True)
            own = np.bincount(held_by >> 32, minlength=len(sizes)).astype(np.int64)
            # differences of places wrap around where a document begins, and back when they are added up
            place = np.diff(held_by.astype(np.uint32), prepend=np.uint32(0))
            yield row(-1 - name % shards, name, 0, 0, squeezed(ids=main["ids"], null=main["null"], held=main["held"], sizes=sizes, known=known, base=base, local=local,
                                                              own=own, place=place, times=times.astype(np.uint32)))
            h, w, g, shard = h[new], w[new], smooth[rest[new]], shard[new]
            cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            for s in range(shards):
                x = slice(cuts[s], cuts[s + 1])
                if cuts[s] < cuts[s + 1]:
                    yield row(s, name, 1, 0, squeezed(h=np.diff(h[x], prepend=np.uint64(0)), w=w[x], n=learned[x], g=g[x]))

    return blocks.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(run, ROW)


def looked_up(pairs: DataFrame, shards: int) -> DataFrame:
    """Pass 4, by pair shard: counts, trie, a value for each pair of each block, in the block's order. Rows of kind 0 pass through."""

    def run(batches):
        for shard, rows in groups(batches, "shard"):
            if shard < 0:
                for r in rows:
                    yield row(shard, r["block"], 0, 0, r["payload"])
                continue
            own = [unsqueezed(r["payload"]) for r in rows]
            h, w, g = np.concatenate([np.cumsum(o["h"]) for o in own]), np.concatenate([o["w"] for o in own]), np.concatenate([o["g"] for o in own])
            n, ends = np.concatenate([o["n"] for o in own]), np.cumsum([len(o["n"]) for o in own])
            del own
            contexts, h = np.unique(h, return_inverse=True)
            words, w = np.unique(w, return_inverse=True)
            pairs_, first, inverse = np.unique(h * len(words) + w, return_index=True, return_inverse=True)
            learned = np.bincount(inverse, n, len(pairs_))
            smooth = g[first]
            del h, w, g, n
            seen = np.flatnonzero(learned > 0)
            value = quantise(np.log10(learned[seen] + 10 ** value_of(smooth[seen])))
            trie = Trie(pairs_[seen] // len(words), pairs_[seen] % len(words), value)
            codes, found = trie.find(pairs_ // len(words), pairs_ % len(words))
            codes = np.where(found, codes, smooth)[inverse]
            trie.close()
            for r, part in zip(rows, np.split(codes, ends[:-1])):
                yield row(shard, r["block"], 1, 0, squeezed(codes=part))

    return pairs.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, ROW)


def finished(sums: DataFrame, total: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for _, rows in groups(batches, "block"):
            main = unsqueezed(rows[0]["payload"])
            score = main["local"].copy()
            if len(rows) > 1:
                logs = value_of(np.concatenate([unsqueezed(r["payload"])["codes"] for r in rows[1:]]))
                doc = np.repeat(np.arange(len(score)), main["own"])
                score += np.bincount(doc, logs[np.cumsum(main["place"], dtype=np.uint32)] * main["times"], len(score))
            ids = pa.array(main["ids"], mask=main["null"])
            n = len(score)
            yield pa.RecordBatch.from_arrays([ids, pa.array(main["held"]), pa.array(main["sizes"]), pa.array(main["known"]), pa.array(np.full(n, total, np.int64)),
                                              pa.array(main["base"]), pa.array(score)], names)

    return sums.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, modulus: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from rows whose crc32(doc_id) mod `modulus` is not `held` (a null id counts as empty text). Null and empty texts are
    one end token. Repeated rows count and are scored each. Other columns are ignored. Without learning rows, counts are 0.
    """
    spark = docs.sparkSession
    w = Written(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = w.put(coded(scored(docs, modulus, held), shards), "coded")
    total = first.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    second = w.put(counted(first.where("kind = 1").select("shard", "block", "payload"), shards), "counted")
    bins = {r["block"]: r["n"] for r in second.where("kind = 2").groupBy("block").agg(F.sum("tokens").alias("n")).collect()}
    vocabulary = sum(bins.values())
    kinds = expected_kinds(bins, total) if bins else (np.zeros(1), np.ones(1))
    pair_shards = max(shards, -(-total // SHARD_PAIRS))
    blocks = first.where("kind = 0").unionByName(second.where("kind = 1")).select("shard", "block", "kind", "payload")
    pairs = dealt_pairs(blocks, (total, vocabulary), kinds, pair_shards)
    return finished(looked_up(pairs, pair_shards), total)
