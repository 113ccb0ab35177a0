"""Mixing sources to target weights by balanced sampling: the cube method.

A source with target t and size s is taken t / s times: each document wholly floor(t / s) times, and once more with the
remaining fraction as inclusion probability. The flight moves the probabilities inside the null space of two balancing
constraints (words and documents of the source) until all but two are 0 or 1: three units at a time, whose null direction
has a closed form. Sources are cut into blocks that fly in parallel, a large source like many small ones; what is left, at most two units
a block, flies again, until a source is one block; its last two units are landed where the word total is nearest. Long documents
fly first, so that what is left to land is short.

Equal rows are one unit whatever their number: r of them take floor(r * fraction) further copies for sure, and what remains of
r * fraction, less than one copy, flies as one row. So a source that is one text many times meets its target like any other.

All random moves come from seeds made of the source, the block and the round, and blocks from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import Written, doc_bytes, in_parts, numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK = 4096
#: Rows of one unit written out by a task at a time
RUN = 1 << 16
NEAR = 1e-9


def flight(sizes: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Probabilities moved to 0 or 1 with sums of p and of p * size kept; at most two stay between."""
    p = list(p)
    active: list[int] = []
    todo = iter(range(len(p)))
    while True:
        while len(active) < 3:
            nxt = next(todo, None)
            if nxt is None:
                break
            if NEAR < p[nxt] < 1 - NEAR:
                active.append(nxt)
            else:
                p[nxt] = float(round(p[nxt]))
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            u = (1, -1)
        else:
            return p
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] < NEAR or p[i] > 1 - NEAR:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0 < p[i] < 1]


def land(sizes: list[int], p: list[float]) -> list[float]:
    """The open units (few) set to 0 or 1 such that the word total, then the document total, moves least."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    best = min(range(2 ** len(left)), key=lambda m: (round(abs(sum(sizes[i] * ((m >> n & 1) - p[i]) for n, i in enumerate(left))), 6),
                                                     abs(sum((m >> n & 1) - p[i] for n, i in enumerate(left))), m))
    out = list(p)
    for n, i in enumerate(left):
        out[i] = float(best >> n & 1)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (hash of the text), size (words) of every row."""
    def run(batches):
        for whole in batches:
            for b in in_parts(whole):
                sizes = pa.array([len(t.split()) for t in b.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("mark"), sizes], ["doc_id", "source", "mark", "size"])

    texts = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mark().alias("mark"))
    return texts.mapInArrow(run, "doc_id long, source string, mark long, size long")


def mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target` to (source, source_size): weights repeat over sources by code point, null last; targets above cap times
    the size stop there and the excess is shared again. One number, the share per weight, is found by a few aggregations."""
    w = Written(sources.sparkSession)
    rows = numbered(sources, [F.col("source").asc_nulls_last()], "n")
    rows = w.put(rows.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights)).cast("int"))).drop("n"), "weights")
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    per, capped = (share * (total or 0) / all_weights if all_weights else 0.0), -1
    while True:
        above = F.col("weight") * per > cap * F.col("source_size")
        n, held, free = rows.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        per, capped = (share * total - held) / free, n
    return rows.withColumn("target", F.least(F.col("weight") * per, cap * F.col("source_size"))).drop("weight")


def one_round(units: DataFrame, no: int, seed: int) -> DataFrame:
    """A flight of every block; sources of one block are landed."""
    counts = units.groupBy("skey").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = units.join(counts, "skey").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("spot", F.lit(no)), "blocks"))

    def run(batches):
        rows: list[dict] = []

        def fly():
            sizes = [r["size"] for r in rows]
            first = rows[0]
            p = flight(sizes, [r["p"] for r in rows], random.Random(f"{seed}|{first['skey']}|{first['block']}|{no}"))
            if first["blocks"] == 1:
                p = land(sizes, p)
            names = [n for n in rows[0] if n not in ("blocks", "block", "n")]
            return pa.RecordBatch.from_pylist([{n: r[n] for n in names} | {"p": x} for r, x in zip(rows, p)], schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(n) for n in batch.schema.names if n not in ("blocks", "block", "n")])
            for row in batch.to_pylist():
                if rows and (row["skey"], row["block"]) != (rows[0]["skey"], rows[0]["block"]):
                    yield fly()
                    rows = []
                rows.append(row)
        if rows:
            yield fly()

    return (dealt.repartition("skey", "block").sortWithinPartitions("skey", "block", F.col("size").desc(), "spot", "doc_id", "mark")
            .mapInArrow(run, units.schema))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Units of equal rows (doc_id, source, mark, size, rows) with source_size, target, whole and extra: each of the rows is taken
    `whole` times, and `extra` of them once more.

    Null text has size 0, a null source is a source (the last one), a null doc_id an id like any other. Rows equal in id, source and
    text are one unit, of which any number of rows may be taken. No row is taken more than `cap` times. Ties in landing go to the
    word total, then the document total, then the earlier unit. Other columns are ignored. An empty table gives no units.
    """
    w = Written(docs.sparkSession)
    units = w.put(sized(docs).groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("rows")), "units")
    sources = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size")), weights, share, cap)
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    sources = w.put(sources.withColumn("skey", skey).drop("source"), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    now = w.put(units.withColumn("skey", skey).join(sources, "skey").withColumn("whole", F.floor(ratio + NEAR).cast("long"))
                .withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)) * F.col("rows")).withColumn("sure", F.floor(F.col("p") + NEAR).cast("long"))
                .withColumn("p", F.greatest(F.col("p") - F.col("sure"), F.lit(0.0))).withColumn("spot", F.xxhash64("doc_id", "mark", F.lit(seed))), "start")
    w.drop(units)
    done, no = [], 0
    open_ = F.col("p").between(NEAR, 1 - NEAR)
    while True:
        done.append(now.where(~open_))
        rest = now.where(open_)
        if not rest.limit(1).count():
            break
        now = w.put(one_round(rest, no, seed), "flight")
        no += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "mark", "size", "rows", "source_size", "target", "whole", (F.col("sure") + F.round("p").cast("long")).alias("extra"))


def taken_words(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document row. Units of very many rows are spread over tasks by runs of RUN rows."""
    few = mixed.where(F.col("rows") <= RUN).withColumn("from", F.lit(0).cast("long"))
    many = mixed.where(F.col("rows") > RUN).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN).cast("long"))))
    runs = few.unionByName(many.repartition("doc_id", "from"))
    each = runs.withColumn("n", F.explode(F.sequence(F.col("from") + 1, F.least("rows", F.col("from") + RUN))))
    copies = F.col("whole") + (F.col("n") <= F.col("extra")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def taken_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of docs that are taken, with `copies` (a column of that name in docs gives way to it).

    Where only some of a unit's equal rows are taken once more, these are the first by all their columns (as JSON), so reruns agree.
    None of the columns may be called _mark, _row or _n.
    """
    names = [c for c in docs.columns if c != "copies"]
    own = [F.col(f"d.`{c}`") for c in names]
    d = docs.withColumn("_mark", mark()).alias("d")
    same = (F.col("d._mark") == F.col("m.mark")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("m.source"))
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))
    alike = mixed.withColumn("copies", F.col("whole") + (F.col("extra") > 0).cast("long")).where(~some & (F.col("copies") > 0)).alias("m")
    out = d.join(alike, same).select(*own, F.col("m.copies"))
    split = mixed.where(some)
    if not split.limit(1).count():
        return out
    key = ["doc_id", "source", "mark"]
    rows = d.join(split.alias("m"), same).select(*[F.col(f"m.{k}").alias(f"_{k}") for k in key], F.col("m.whole").alias("_whole"), F.col("m.extra").alias("_extra"), F.struct(*own).alias("_row"))
    order = [F.col(f"_{k}") for k in key] + [F.to_json("_row", {"ignoreNullFields": "false"}), F.monotonically_increasing_id()]
    rows = numbered(rows, order, "_n")
    first = rows.groupBy(*[f"_{k}" for k in key]).agg(F.min("_n").alias("_first")).select(*[F.col(f"_{k}").alias(k) for k in key], "_first").alias("f")
    here = (F.col("r._mark") == F.col("f.mark")) & F.col("r._doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("r._source").eqNullSafe(F.col("f.source"))
    more = (F.col("_n") - F.col("_first") < F.col("_extra")).cast("long")
    picked = rows.alias("r").join(first, here).select("_row", (F.col("_whole") + more).alias("copies")).where("copies > 0")
    return out.unionByName(picked.select(*[F.col(f"_row.`{c}`") for c in names], "copies"))
