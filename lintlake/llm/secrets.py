"""Secret scan with patterns and character Markov models, in DataFrame functions only.

Base kinds are fixed patterns. The method adds `random`: two first-order character models, of random strings and of
ordinary identifiers, are trained from labelled samples; a long run of key characters is reported when its log-likelihood ratio
over both models exceeds a threshold. A model is one table of 96 x 96 log ratios (printable ASCII), whatever the input.

Positions come without user code: the gaps between matches are what `split` returns, so ends are running sums of the lengths
of gaps and matches, in code points.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order of kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12

RUN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
SAMPLE = 20_000
THRESHOLD = 10.0
FIRST, SYMBOLS = 32, 96
CHUNK = 512


def _running(lengths: str, upto: str) -> str:
    """SQL: inclusive running sums of an array, starting from a number."""
    return (f"aggregate({lengths}, named_struct('t', cast({upto} as bigint), 'o', cast(array() as array<bigint>)), "
            "(s, v) -> named_struct('t', s.t + v, 'o', array_append(s.o, s.t + v))).o")


def located(rows: DataFrame, pattern: str, name: str, group: int = 0) -> DataFrame:
    """Adds `name`: array of (start, end, value) of all matches, leftmost and non-overlapping; value is the group.

    Sums run inside chunks of 512 matches and over chunks, so a text with very many matches stays near linear.
    """
    re = F.lit(pattern)
    rows = rows.withColumn("_m", F.regexp_extract_all("text", re, F.lit(0)))
    some = F.size("_m") > 0
    rows = rows.withColumn("_g", F.when(some, F.split("text", pattern, -1)))
    if group:
        rows = rows.withColumn("_v", F.when(some, F.regexp_extract_all("text", re, F.lit(group))))
    else:
        rows = rows.withColumn("_v", F.when(some, F.col("_m")))
    rows = rows.withColumn("_len", F.when(some, F.expr("transform(_m, (m, i) -> cast(char_length(m) + char_length(_g[i]) as bigint))")))
    rows = rows.withColumn("_chunks", F.when(some, F.expr(f"transform(sequence(0, (size(_m) - 1) div {CHUNK}), c -> slice(_len, c * {CHUNK} + 1, {CHUNK}))")))
    rows = rows.withColumn("_sums", F.when(some, F.expr(_running("transform(_chunks, x -> aggregate(x, 0L, (s, v) -> s + v))", "0"))))
    rows = rows.withColumn("_ends", F.when(some, F.expr(f"flatten(transform(_chunks, (x, c) -> {_running('x', 'if(c = 0, 0L, _sums[c - 1])')}))")))
    spans = F.when(some, F.expr("transform(_ends, (e, i) -> named_struct('start', e - char_length(_m[i]), 'end', e, 'value', _v[i]))"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    return rows.withColumn(name, F.coalesce(spans, empty)).drop("_m", "_g", "_v", "_len", "_chunks", "_sums", "_ends")


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds arrays assign, access and hex to rows with a non-null `text`."""
    rows = located(rows, ASSIGN, "assign", 2).withColumn("assign", F.expr(f"filter(assign, x -> char_length(x.value) >= {LEAST_VALUE})"))
    return located(located(rows, ACCESS, "access"), HEX, "hex")


def _texts(docs: DataFrame, *kept: str | Column) -> DataFrame:
    return docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def labelled_strings(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """value, random (boolean), from at most `sample` documents, chosen by the hash of their id (so few that the ids may be broadcast). Random: values of base matches,
    and digests of the ids as hex, upper-case hex and base64. Ordinary: words without a base match or a digit-heavy mix."""
    chosen = docs.select(F.col("doc_id").cast("string").alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit("secrets"), "id"), "id").limit(sample)
    texts = _texts(docs, F.col("doc_id").cast("string").alias("id")).join(F.broadcast(chosen), "id", "left_semi")
    found = base_spans(texts)
    base = found.select(F.explode(F.expr("transform(concat(assign, access, hex), x -> x.value)")).alias("value"))
    digest = F.sha2("id", 256)
    made = chosen.select(F.explode(F.array(digest, F.upper(digest), F.base64(F.unhex(digest)))).alias("value"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value")).where(~F.col("value").rlike(HEX) & ~F.col("value").rlike("[0-9].*[0-9].*[0-9]"))
    return base.unionByName(made).withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log ratios of transition probabilities, random over ordinary, at 96 * (a - 32) + b - 32. One count per class and
    pair of characters comes to the driver, at most 2 * 96 * 96. Without samples all ratios are 0: nothing is reported."""
    chars = F.expr("filter(transform(split(value, ''), c -> ascii(c)), c -> c >= 32 AND c < 128)")
    pairs = (samples.where("value IS NOT NULL").withColumn("codes", chars)
             .select("random", F.explode(F.expr("transform(slice(codes, 2, size(codes)), (c, i) -> named_struct('a', codes[i], 'b', c))")).alias("p"))
             .groupBy("random", "p").count().collect())
    counts = {(r["random"], r["p"]["a"] - FIRST, r["p"]["b"] - FIRST): r["count"] for r in pairs}
    if not counts:
        return [0.0] * SYMBOLS**2
    totals: dict[tuple[bool, int], int] = {}
    for (random, a, _), n in counts.items():
        totals[random, a] = totals.get((random, a), 0) + n

    def log_p(random: bool, a: int, b: int) -> float:
        return math.log((counts.get((random, a, b), 0) + 0.5) / (totals.get((random, a), 0) + 0.5 * SYMBOLS))

    return [round(log_p(True, a, b) - log_p(False, a, b), 4) for a in range(SYMBOLS) for b in range(SYMBOLS)]


def find_secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with `secrets`: array of (start, no, end, kind, value), by start, then kind; no numbers the kinds.

    Positions are code points, the end is exclusive. Nulls count as empty text. `random` spans are runs of 20 or
    more key characters; hex and access matches in a run have their own spans and add nothing to its ratio, the rest of the run decides. Spans may overlap. Work on a
    text is near linear. Other columns stay, also one named `secrets`, which is replaced; rows repeat as they do in docs.
    """
    own = [c for c in docs.columns if c not in ("text", "secrets")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own], F.col("text")).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = located(base_spans(rows), RUN, "runs")
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    rows = rows.withColumn("_codes", F.when(F.size("runs") > 0, F.transform("runs", lambda x: F.transform(
        F.split(x["value"], f"{HEX}|{ACCESS}"), lambda part: F.transform(F.split(part, ""), lambda c: F.ascii(c))))))

    def ratio(codes: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b")), F.lit(0.0),
            lambda s, p: s + F.coalesce(F.get(table, (p["a"] - FIRST) * SYMBOLS + p["b"] - FIRST), F.lit(0.0)))

    rows = rows.withColumn("_ratios", F.when(F.size("runs") > 0, F.transform("_codes", lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, x: s + ratio(x)))))
    rows = rows.withColumn("random", F.when(F.size("runs") > 0, F.expr(f"filter(runs, (x, i) -> _ratios[i] > {threshold})")).otherwise(F.expr("slice(runs, 1, 0)")))
    marked = [f"transform({k}, x -> named_struct('start', x.start, 'no', {i}, 'end', x.end, 'kind', '{k}', 'value', x.value))" for i, k in enumerate(KINDS)]
    return rows.select("_row.*", F.expr(f"array_sort(concat({', '.join(marked)}))").alias("secrets"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as text."""
    base = F.filter("secrets", lambda x: x["no"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Rows of find_secrets with the spans (overlapping ones as one) replaced in `text`; `secrets` goes.

    Spans are taken in chunks, each with its own part of the text, so a text with very many secrets stays near linear.
    """
    chunks = f"transform(sequence(0, (size(secrets) - 1) div {CHUNK}), c -> slice(secrets, c * {CHUNK} + 1, {CHUNK}))"
    kept = """aggregate(c, named_struct('at', s.at, 'o', cast(array() as array<string>)), (t, x) -> named_struct('at', greatest(t.at, x.end), 'o',
        if(x.start >= t.at, array_append(t.o, substring(part, cast(t.at - s.at + 1 as int), cast(x.start - t.at as int))), t.o)))"""
    part = "substring(text, cast(s.at + 1 as int), cast(greatest(s.at, array_max(transform(c, x -> x.end))) - s.at as int))"
    pieces = F.expr(f"""aggregate({chunks}, named_struct('at', 0L, 'o', cast(array() as array<array<string>>)),
        (s, c) -> transform(transform(array({part}), part -> {kept}), r -> named_struct('at', r.at, 'o', array_append(s.o, r.o)))[0],
        s -> array_append(flatten(s.o), substring(text, cast(s.at + 1 as int))))""")
    text = F.when(F.size("secrets") > 0, F.array_join(pieces, mark)).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("secrets")
