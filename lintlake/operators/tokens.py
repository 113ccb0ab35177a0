"""Rules over the names of one file. A file is one row, so these stay inside it; for long files see pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import frameworks as FW
from lintlake.catalog.rules import DECLARATIONS, JS_TS
from lintlake.config import ReviewConfig
from lintlake.functions.literals import required_literals
from lintlake.functions.regex import java_regex
from lintlake.functions.text import MARK_OPEN, any_of, contains_any, let, mark_matches, marked_names, split_lines
from lintlake.operators.findings import existing, find, from_arrays
from lintlake.operators.sequence import with_lines

ADDED = r"\.addEventListener\s*\(\s*['\"`](\w+)['\"`]"
#: So many names are looked for by one pattern
FEW = 32
REMOVED = r"\.removeEventListener\s*\(\s*['\"`](\w+)['\"`]"


def declarations(content: Column, lang_id: Column) -> Column:
    """content with each declaration marked by its name, by language (null for other languages)."""
    choice = F
    for lang, pattern in DECLARATIONS.items():
        marked = mark_matches(content, java_regex(pattern), 2 if lang == "go" else 1)
        choice = choice.when(lang_id == lang, marked)
    return choice


def unused_hits() -> Column:
    """Declared names that occur once in their file.

    Tokens are sorted as plain strings; those that occur once and are declared (mostly few) are sorted together with the declarations by
    name: a declaration is unused when such a token stands before it in its run of equal names. Sorting keeps this n log n per file.
    Where FEW names at most are declared, one pattern finds them, and no other token is taken out of the text.
    """
    def declared(marked: Column) -> Column:
        on_lines = existing(F.transform(split_lines(marked), lambda x, i: F.when(
            F.contains(x, F.lit(MARK_OPEN)), F.struct((i + 1).alias("line_no"), marked_names(x).alias("names")))))
        rows = F.flatten(F.transform(on_lines, lambda r: F.transform(
            r["names"], lambda n, k: F.struct(n.alias("name"), r["line_no"].alias("line_no"), k.alias("k")))))
        return F.filter(rows, lambda d: (F.length(d["name"]) > 1) & ~F.startswith(d["name"], F.lit("_")))

    def once(sorted_words: Column) -> Column:
        def differs(word: Column, other: Column) -> Column:
            return other.isNull() | (other != word)

        return F.filter(sorted_words, lambda w, i: differs(w, F.get(sorted_words, i - 1)) & differs(w, F.get(sorted_words, i + 1)))

    def with_words(rows: Column) -> Column:
        few = F.concat(F.lit(r"(?<!\w)(?:"), F.array_join(F.array_distinct(F.transform(rows, lambda d: d["name"])), "|"), F.lit(r")(?!\w)"))
        pattern = F.when(F.size(rows) <= FEW, few).otherwise(F.lit(r"\w+"))
        single = let(F.sort_array(F.regexp_extract_all("content", pattern, F.lit(0))), once)
        words = F.transform(F.array_intersect(F.transform(rows, lambda d: d["name"]), single),
                            lambda t: F.struct(t.alias("name"), F.lit(0).alias("line_no"), F.lit(0).alias("k")))
        return F.when(F.size(rows) > 0, F.sort_array(F.concat(rows, words)))

    def alone(run: Column) -> Column:
        def test(d: Column, i: Column) -> Column:
            one, two = F.get(run, i - 1), F.get(run, i - 2)
            return ((d["line_no"] > 0) & (one["name"] == d["name"]) & (one["line_no"] == 0)
                    & (two.isNull() | (two["name"] != d["name"])))

        return F.transform(F.filter(run, test), lambda d: find(
            "A10", d["line_no"], F.get("lines", d["line_no"] - 1), [d["name"]], ord=d["k"]))

    def runs(marked: Column) -> Column:
        return F.when(F.contains(marked, F.lit(MARK_OPEN)), let(let(declared(marked), with_words), alone))

    return F.when(F.col("lang_id").isin(*DECLARATIONS), let(declarations(F.col("content"), F.col("lang_id")), runs))


def unused_variables(files: DataFrame) -> DataFrame:
    return from_arrays(with_lines(files), unused_hits())


def listener_hits() -> Column:
    """Events added and never removed in the file, at the first line that names both."""
    leaked = F.array_except(F.array_distinct(F.regexp_extract_all("content", F.lit(ADDED), 1)),
                            F.regexp_extract_all("content", F.lit(REMOVED), 1))
    adding = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"))),
                      lambda r: F.contains(r["text"], F.lit("addEventListener")))

    def report(events: Column, lines: Column) -> Column:
        return existing(F.transform(events, lambda e, k: let(
            F.get(F.filter(lines, lambda r: F.contains(r["text"], e)), F.lit(0)),
            lambda r: F.when(r.isNotNull(), find("R20", r["line_no"], r["text"], [e], pos=k)))))

    found = let(leaked, lambda events: F.when(F.size(events) > 0, let(adding, lambda lines: report(events, lines))))
    return F.when(F.col("lang_id").isin(*JS_TS) & F.contains("content", F.lit("addEventListener")), found)


def listener_leaks(files: DataFrame) -> DataFrame:
    return from_arrays(with_lines(files), listener_hits())


def interval_hits() -> Column:
    content = F.col("content")
    line_no = F.size(split_lines(F.substring_index(content, "setInterval(", 1)))
    leak = F.col("lang_id").isin(*JS_TS) & F.contains(content, F.lit("setInterval(")) & ~F.contains(content, F.lit("clearInterval("))
    return F.when(leak, F.array(find("X09", line_no, F.get("lines", line_no - 1))))


def interval_leaks(files: DataFrame) -> DataFrame:
    return from_arrays(with_lines(files), interval_hits())


HITS = {"A10": unused_hits, "R20": listener_hits, "X09": interval_hits}


def first_line(files: DataFrame, word: str) -> DataFrame:
    """First line of each file that holds ``word``."""
    hit = files.where(F.contains("content", F.lit(word)))
    return hit.select("path", F.size(split_lines(F.substring_index("content", word, 1))).alias("line_no"))


def framework_flags(content: Column) -> Column:
    """Names of the frameworks whose traces the text shows. Patterns are tried where the words they need are in the text."""
    def shown(low: Column, pattern: str) -> Column:
        words = required_literals(pattern)
        return contains_any(low, words) & content.rlike(java_regex(pattern)) if words else content.rlike(java_regex(pattern))

    return let(F.lower(content), lambda low: F.array_compact(F.array(*[
        F.when(any_of([shown(low, p) for p in patterns]), F.lit(name)) for name, patterns in FW.DETECT.items()])))


def forced_frameworks(config: ReviewConfig) -> list[str]:
    lower = [n.lower() for n in config.enable_frameworks]
    return [n for n in FW.DETECT if n in lower]


def detect_frameworks(files: DataFrame, config: ReviewConfig) -> DataFrame:
    """The active frameworks of the whole corpus: found in any file, or forced by the settings."""
    found = files.select(F.explode_outer(framework_flags(F.col("content"))).alias("framework")).where(
        F.col("framework").isNotNull()).distinct()
    forced = F.array(*[F.lit(n) for n in forced_frameworks(config)]).cast("array<string>")
    one = files.sparkSession.range(1).select(F.explode(forced).alias("framework"))
    return found.union(one).distinct()


def attach_frameworks(df: DataFrame, config: ReviewConfig, corpus: DataFrame) -> DataFrame:
    """Add the corpus-wide ``frameworks ARRAY<STRING>`` as a scalar subquery: it runs once, and not at all
    when the settings force every framework."""
    forced = forced_frameworks(config)
    if len(forced) == len(FW.DETECT):
        return df.withColumn("frameworks", F.array(*[F.lit(n) for n in sorted(forced)]))
    one = detect_frameworks(corpus, config).agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))
    return df.withColumn("frameworks", one.scalar())


def with_frameworks(files: DataFrame, config: ReviewConfig, corpus: DataFrame | None = None, known: list[str] | None = None) -> DataFrame:
    """Add ``frameworks ARRAY<STRING>``: those of the corpus or those of the file itself.

    ``corpus`` names the files that count for detection when ``files`` is only a part of them. ``known``: those of the corpus, if they have been found before.
    """
    if known is not None and config.framework_scope != "file":
        return files.withColumn("frameworks", F.array(*[F.lit(n) for n in known]).cast("array<string>"))
    if config.framework_scope == "file":
        forced = F.array(*[F.lit(n) for n in forced_frameworks(config)]).cast("array<string>")
        return files.withColumn("frameworks", F.array_union(framework_flags(F.col("content")), forced))
    return attach_frameworks(files, config, corpus if corpus is not None else files)
