"""Prefix trie of conversations by digests of blocks of turns.

A conversation is cut into blocks of BLOCK turns. A block's digest joins its turns (each by its place), a prefix's digest joins its blocks, so
conversations that share their first blocks meet in one group per block, whole blocks at a time. Only where the members of a group go on with
different blocks are turns looked at one by one: inside those blocks every member gives a row per turn, and equal prefixes of turns become nodes.
A block that all of its group goes on with holds a path without branches, which is written down once, from its smallest member.

Sums over subtrees need no walk: each node belongs to its smallest member, whose later turns are below all of its earlier ones. What
a node adds to the nodes above it is a running sum along that one conversation, and a node's total is the sum over its members.
Texts leave the plan with the first scan: a turn is its 128-bit digest and its number of words. No conversation and no node needs a task of its own,
but for the digest of the ids that end at one node, which SHA-256 defines as one stream; it is fed in runs of many ids each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import Written, numbered
from lintlake.llm.running import running

BLOCK = 4
#: Ids in one run of the stream of a node's ends
RUN = 1 << 15
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """c, turn, digest (of role and text), words. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.md5(F.concat_ws(":", F.char_length(role), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def placed(conversations: DataFrame) -> DataFrame:
    """c, pos (from 1), digest, words: turns in order (null first; equal turns by their digest), whatever the length of a conversation."""
    rows = numbered(turns(conversations), [F.col("c"), F.asc_nulls_first("turn"), F.col("digest")], "n")
    w = Written(conversations.sparkSession)
    rows = w.put(rows.select("c", "n", "digest", "words"), "numbered")
    first = rows.groupBy("c").agg(F.min("n").alias("first"))
    return rows.join(first, "c").select("c", (F.col("n") - F.col("first") + 1).alias("pos"), "digest", "words")


def rebuilt(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads: c, donor, own (turns of its own that go), most (turns of the donor that come first, if there are). Returns the turns of the
    conversations made from both, with their number (total), and the conversations without a turn."""
    lengths = rows.groupBy("c").agg(F.max("pos").alias("length"))
    plan = (heads.join(lengths, "c", "left").join(lengths.withColumnsRenamed({"c": "donor", "length": "given"}), "donor", "left")
            .select("c", "donor", "own", F.least("most", F.coalesce("given", F.lit(0))).alias("m"), F.coalesce("length", F.lit(0)).alias("length"))
            .withColumn("total", F.col("m") + F.greatest(F.col("length") - F.col("own"), F.lit(0))))
    w = Written(rows.sparkSession)
    plan = w.put(plan, "plan")
    mine = (rows.join(plan.select("c", "own", "m", "total"), "c").where("pos > own")
            .select("c", (F.col("pos") - F.col("own") + F.col("m")).alias("pos"), "digest", "words", "total"))
    longest = plan.agg(F.max("m")).first()[0] or 0
    lent = rows.where(F.col("pos") <= longest).withColumnRenamed("c", "donor")
    theirs = plan.where("m > 0").select("c", "donor", "m", "total").join(lent, "donor").where("pos <= m").select("c", "pos", "digest", "words", "total")
    return mine.unionByName(theirs), plan.where("total = 0").select("c")


def blocked(rows: DataFrame) -> DataFrame:
    """c, k (block), total, words, keys (digest of the prefix that ends with each turn), pre and post (those before and after the block)."""

    def laned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two 64-bit lanes per turn, from digest and place; sums of them inside the block."""
        for b in batches:
            inner, lo, hi, words = [], [], [], []
            for ts in b.column("ts").to_pylist():
                raw = b"".join(xxhash.xxh3_128_digest(t["digest"] + t["pos"].to_bytes(8, "little")) for t in ts)
                sums = np.cumsum(np.frombuffer(raw, np.uint64).reshape(-1, 2), axis=0)
                inner.append(sums.tobytes())
                lo.append(int(sums[-1, 0].view(np.int64)))
                hi.append(int(sums[-1, 1].view(np.int64)))
                words.append([t["words"] for t in ts])
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("k"), b.column("total"), pa.array(words, pa.list_(pa.int64())), pa.array(inner, pa.binary()),
                                              pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["c", "k", "total", "words", "inner", "lo", "hi"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, pre = [], []
            for inner, lo, hi in zip(b.column("inner").to_pylist(), b.column("before_lo").to_pylist(), b.column("before_hi").to_pylist()):
                before = np.array([lo, hi], np.int64).view(np.uint64)
                keys.append([x.tobytes() for x in np.frombuffer(inner, np.uint64).reshape(-1, 2) + before])
                pre.append(before.tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("c", "k", "total", "words")], pa.array(keys, pa.list_(pa.binary())), pa.array(pre, pa.binary()),
                                              pa.array([k[-1] for k in keys], pa.binary())], ["c", "k", "total", "words", "keys", "pre", "post"])

    cut = (rows.groupBy("c", F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("k"))
           .agg(F.first("total").cast("long").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("ts"))
           .mapInArrow(laned, "c long, k long, total long, words array<long>, inner binary, lo long, hi long"))
    return running(cut, "c", [F.col("c"), F.col("k")], ["lo", "hi"]).mapInArrow(
        keyed, "c long, k long, total long, words array<long>, keys array<binary>, pre binary, post binary")


def grouped(blocks: DataFrame) -> DataFrame:
    """Blocks with their group: m (members that share the prefix to its end), owner (the least), ends (members that end there), and
    path: all members of the group before it that go on go on with this block."""
    last = F.col("k") * BLOCK + F.size("words")
    nodes = blocks.groupBy("k", "post").agg(F.count("*").alias("m"), F.min("c").alias("owner"), F.first("pre").alias("pre"), F.count_if(F.col("total") == last).alias("ends"))
    w = Written(blocks.sparkSession)
    nodes = w.put(nodes, "groups")
    # all first blocks follow the root: one number, no join
    firsts = nodes.where("k = 0").count()
    later = nodes.where("k > 0")
    ways = later.groupBy("k", "pre").agg(F.count("*").alias("ways"))
    known = (nodes.where("k = 0").withColumn("ways", F.lit(firsts).cast("long")).drop("pre")
             .unionByName(later.join(ways, ["k", "pre"]).drop("pre")))
    return blocks.join(known.select("k", "post", "m", "owner", "ends", (F.col("ways") == 1).alias("path")), ["k", "post"])


def by_turn(blocks: DataFrame, *more: Column | str) -> DataFrame:
    """A row per turn of a block: depth, key, parent (key), words, place (from 0), and the columns asked for."""
    zipped = blocks.withColumn("parents", F.expr("concat(array(pre), slice(keys, 1, size(keys) - 1))"))
    rows = zipped.select("k", *more, F.posexplode(F.arrays_zip("words", "keys", "parents")).alias("place", "t"))
    return rows.select("*", (F.col("k") * BLOCK + F.col("place") + 1).alias("depth"), F.col("t.keys").alias("key"), F.col("t.parents").alias("parent"), F.col("t.words").alias("words")).drop("t")


def nodes_of(known: DataFrame, turnless: DataFrame) -> DataFrame:
    """depth, key, parent, words, conv_id, n_convs, ends, inner (the parent is the same conversation's): one row per node below the root, and the root."""
    apart = by_turn(known.where("NOT path"), "c", "total").groupBy("depth", "key").agg(
        F.first("parent").alias("parent"), F.first("words").alias("words"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"),
        F.count_if(F.col("total") == F.col("depth")).alias("ends"), F.lit(False).alias("inner"))
    along = by_turn(known.where("path AND c = owner"), "c", "m", "ends", F.size("words").alias("size")).select(
        "depth", "key", "parent", "words", F.col("c").alias("conv_id"), F.col("m").alias("n_convs"),
        F.when(F.col("place") + 1 == F.col("size"), F.col("ends")).otherwise(F.lit(0)).cast("long").alias("ends"), (F.col("place") > 0).alias("inner"))
    everyone = known.where("k = 0").select("c", F.lit(0).alias("none")).unionByName(turnless.select("c", F.lit(1).alias("none")))
    root = everyone.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.coalesce(F.sum("none"), F.lit(0)).alias("ends")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs", "ends",
        F.lit(False).alias("inner"))
    return apart.unionByName(along).unionByName(root)


def below(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, key, saved (tokens) and leaves of the subtree, for nodes of two members or more or beside a branch."""
    weights = (nodes.where("n_convs > 1 AND depth > 0").select(F.col("conv_id").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("w"))
               .groupBy("c", F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("k")).agg(F.collect_list(F.struct("depth", "w")).alias("own"), F.sum("w").alias("sum")))
    ended = nodes.where("n_convs = ends AND depth > 0").select(F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("leaf"))
    shared = (known.where("m > 1 OR NOT path").select("c", "k", "keys", "pre", "post", "words", "path").join(weights, ["c", "k"], "left").join(ended, "c", "left")
              .withColumns({"leaf": F.coalesce("leaf", F.lit(0).cast("long")), "sum": F.coalesce("sum", F.lit(0).cast("long")), "up": -F.col("k")}))
    after = running(shared, "c", [F.col("c"), F.col("up")], ["sum"])  # from the last block up: what a conversation's later blocks save
    within = F.aggregate(F.filter(F.coalesce("own", F.array().cast("array<struct<depth:bigint,w:bigint>>")), lambda x: x["depth"] >= F.col("depth")), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    w = Written(known.sparkSession)
    after = w.put(after, "after")
    apart = (by_turn(after.where("NOT path"), "own", "before_sum", "leaf").select("depth", "key", (F.col("before_sum") + within).alias("saved"), "leaf")
             .groupBy("depth", "key").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")))
    paths = after.where("path").groupBy("k", "post").agg(F.first("keys").alias("keys"), F.first("pre").alias("pre"), F.first("words").alias("words"), F.sum("before_sum").alias("later"),
                                                         F.sum("leaf").alias("leaf"), F.first("own", ignorenulls=True).alias("own"))
    along = by_turn(paths, "own", "later", "leaf").select("depth", "key", (F.col("later") + within).alias("saved"), F.col("leaf").alias("leaves"))
    return apart.unionByName(along)


def ends_of(blocks: DataFrame, turnless: DataFrame) -> DataFrame:
    """depth, key, sha (of the ids of the conversations that end there, ascending)."""
    ends = blocks.where(F.col("total") == F.col("k") * BLOCK + F.size("words")).select(F.col("total").alias("depth"), F.col("post").alias("key"), "c").unionByName(
        turnless.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), "c"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def out():
            depth, key, first, text = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["depth", "key", "first", "ids"])

        for b in batches:
            for depth, key, c in zip(*(b.column(n).to_pylist() for n in ("depth", "key", "c"))):
                if held and (held[:2] != (depth, key) or len(held[2]) == RUN):
                    rows.append((*held[:2], held[2][0], ",".join(map(str, held[2]))))
                    held = None
                    if len(rows) >= 1000 or len(rows[-1][3]) > 1 << 16:
                        yield out()
                        rows = []
                if not held:
                    held = (depth, key, [])
                held[2].append(c)
        if held:
            rows.append((*held[:2], held[2][0], ",".join(map(str, held[2]))))
        if rows:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        for b in batches:
            done = []
            for depth, key, ids in zip(*(b.column(n).to_pylist() for n in ("depth", "key", "ids"))):
                if held != (depth, key):
                    if held:
                        done.append((*held, sha.hexdigest()))
                    held, sha = (depth, key), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            depth, key, text = zip(*done) if done else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(text, pa.string())], ["depth", "key", "sha"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["depth", "key", "sha"])

    return (ends.repartitionByRange("key", "depth", "c").sortWithinPartitions("key", "depth", "c").mapInArrow(runs, "depth long, key binary, first long, ids string")
            .repartition("key", "depth").sortWithinPartitions("key", "depth", "first").mapInArrow(hashed, "depth long, key binary, sha string"))


def prefix_tree(rows: DataFrame, turnless: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, from their turns (c, pos, digest, words, total) and those without any (c)."""
    w = Written(rows.sparkSession)
    blocks = w.put(blocked(rows), "blocks")
    known = w.put(grouped(blocks), "known")
    nodes = w.put(nodes_of(known, turnless), "nodes")
    root = nodes.where("depth = 0").first()
    if root is None:
        first = F.lit(None).cast("long")
    else:
        first = F.lit(root["conv_id"]).cast("long")
    total_leaves = nodes.where("n_convs = ends").count()
    # the sum over all nodes is the root's
    saved = nodes.agg(F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0))).first()[0]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parts = {"conv_id": "long", "n_convs": "long", "parent_conv_id": "long", "n_children": "long", "leaves": "long", "saved": "long", "sha": "string"}
    far = nodes.where("depth > 1 AND NOT inner").select("depth", "key", "parent", (F.col("depth") - 1).alias("above"))
    owners = nodes.select(F.col("depth").alias("above"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = (far.join(owners, ["above", "parent"]).select("depth", "key", "parent_conv_id")
               .unionByName(nodes.where("inner").select("depth", "key", F.col("conv_id").alias("parent_conv_id")))
               .unionByName(nodes.where("depth = 1 AND NOT inner").select("depth", "key", first.alias("parent_conv_id"))))
    sums = below(known, nodes).unionByName(nodes.where("depth = 0").select("depth", "key", F.lit(saved).cast("long").alias("saved"), F.lit(total_leaves).cast("long").alias("leaves")))
    pieces = [nodes.select("depth", "key", "conv_id", "n_convs"), children, parents, sums, ends_of(blocks, turnless)]
    full = [p.select("depth", "key", *[(F.col(c) if c in p.columns else F.lit(None)).cast(kind).alias(c) for c, kind in parts.items()]) for p in pieces]
    together = full[0]
    for p in full[1:]:
        together = together.unionByName(p)
    # each piece knows other columns of a node
    one = together.groupBy("depth", "key").agg(*[F.max(c).alias(c) for c in parts])
    alone = F.col("n_convs") == 1  # a node of one member outside a branching block: a path to one leaf
    return one.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      F.coalesce("leaves", F.when(alone, F.lit(1))).cast("long").alias("n_leaves"), F.coalesce("saved", F.when(alone, F.lit(0))).cast("long").alias("saved_tokens"),
                      F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations as they are: see rebuilt_trie for the columns."""
    w = Written(conversations.sparkSession)
    rows = w.put(placed(conversations), "turns")
    return prefix_tree(rows.join(rows.groupBy("c").agg(F.max("pos").alias("total")), "c"), rows.select("c").limit(0))


def rebuilt_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations that begin with the first crc32(conv_id) mod `most` turns of the first of their family of `family` ids, instead of their own.

    One row per node, a distinct sequence of first turns (role, text): conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over its subtree), ends_sha256. The root (depth 0) has all conversations, also those that come out without a turn.
    Turns go by turn, null first; equal ones by the digest of role and text, so reruns agree and repeated rows are turns each. Null or empty role
    and text are the same. Rows without a conv_id belong to no conversation. Other columns are ignored. An empty table has no root.
    """
    w = Written(conversations.sparkSession)
    rows = w.put(placed(conversations), "turns")
    own = F.crc32(F.col("c").cast("string").cast("binary")) % most
    heads = rows.select("c").distinct().select("c", (F.col("c") - F.col("c") % family).alias("donor"), own.alias("own"), own.alias("most"))
    made, turnless = rebuilt(rows, heads)
    return prefix_tree(made, w.put(turnless, "turnless"))


def rebuilt_trie_sql(family: int = 20, most: int = 4) -> str:
    """The same in DuckDB SQL: prefixes as joined digests of turns, sums over every node's ancestors. For small tables."""
    crc = ("list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda crc, b: "
           "list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))")
    return f"""
WITH u AS (SELECT conv_id AS c, turn, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM u),
l AS (SELECT c, count(*) AS length, c - c % {family} AS donor, CAST(xor({crc}, 4294967295::UBIGINT) % {most} AS BIGINT) AS h FROM t GROUP BY c),
p AS (SELECT l.c, l.h, l.donor, least(l.h, coalesce(d.length, 0)) AS m FROM l LEFT JOIN l d ON l.donor = d.c),
r AS (SELECT c, pos - h + m AS pos, digest, words FROM t JOIN p USING (c) WHERE pos > h
  UNION ALL SELECT p.c, t.pos, t.digest, t.words FROM p JOIN t ON t.c = p.donor AND t.pos <= p.m),
k AS (SELECT c, pos AS depth, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM l),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM k),
n AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM e GROUP BY depth, key),
f AS (SELECT depth - 1 AS depth, left(key, -32) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (SELECT k.depth, k.key, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (f.key IS NULL) AS n_leaves
  FROM n LEFT JOIN f USING (depth, key) JOIN k ON k.c = n.conv_id AND k.depth <= n.depth GROUP BY k.depth, k.key)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, key) LEFT JOIN f USING (depth, key) LEFT JOIN n q ON q.depth = n.depth - 1 AND q.key = left(n.key, -32) AND n.depth > 0"""
