"""File-level projections and filters, and the step from files to lines.

A file is one row (path, content), so whatever is computed per file stays inside its row: none of these operators shuffles. A limit
on the length of reviewed files is a setting, off by default; files beyond it carry the status ``too_large``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import dims
from lintlake.functions.regex import escape_literal
from lintlake.functions.text import any_of, contains_any, split_lines, starts_with_any, trim_all
from lintlake.sources.local import small_table

MAX_BROADCAST_RULES = 10_000


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_excluded(path: Column) -> Column:
    names = "|".join(escape_literal(d) for d in dims.EXCLUDED_DIRS)
    return slashed(path).rlike(f"(?:^|/)(?:{names})/|/(?:{names})\\z")


def filter_excluded_dirs(files: DataFrame) -> DataFrame:
    return files.where(~is_excluded(F.col("path")))


def _once(path: Column, test: Callable[[Column], Column]) -> Column:
    """A test on a path that may be an expression: filters are pushed down to where it is one, and it is to be made once and not once per word."""
    return F.exists(F.array(path), test)


def ignored_by_path(path: Column, names: tuple[str, ...]) -> Column:
    return _once(slashed(path), lambda p: contains_any(p, [f"/{n}/" for n in names])) if names else F.lit(False)


def filter_ignore_paths(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return files.where(~ignored_by_path(F.col("path"), names))


def ignored_by_pattern(path: Column, patterns: tuple[str, ...]) -> Column:
    """``*.ext`` is an ending of the path, anything else a part of it."""
    return _once(path, lambda p: any_of([F.endswith(p, F.lit(q[1:])) if q.startswith("*.") else F.contains(slashed(p), F.lit(q)) for q in patterns])) if patterns else F.lit(False)


def filter_ignore_patterns(files: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return files.where(~ignored_by_pattern(F.col("path"), patterns))


def within_size_cap(content: Column, cap: int = dims.MAX_FILE_CHARS) -> Column:
    """Length in UTF-16 units; only texts near the cap are encoded to count them."""
    return F.when(F.length(content) * 2 <= cap, F.lit(True)).when(F.length(content) > cap, F.lit(False)).otherwise(
        F.octet_length(F.encode(content, "UTF-16BE")) <= 2 * cap)


def filter_size_cap(files: DataFrame, cap: int = dims.MAX_FILE_CHARS) -> DataFrame:
    return files.where(within_size_cap(F.col("content"), cap))


def detect_language(files: DataFrame) -> DataFrame:
    """Add lang_id, lang_name, family (null when the extension is not known)."""
    lower = F.lower(F.col("path"))
    docker = F.endswith(lower, F.lit("dockerfile")) | F.contains(lower, F.lit("dockerfile."))
    ext = F.when(docker, F.lit(".dockerfile")).when(
        F.contains(lower, F.lit(".")), F.concat(F.lit("."), F.substring_index(lower, ".", -1)))
    languages = small_table(files.sparkSession, dims.extension_rows(), ["ext", "lang_id", "lang_name", "family"])
    return files.withColumn("ext", ext).join(F.broadcast(languages), "ext", "left").drop("ext")


def result_status(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Every file with the language its result carries: ``excluded``, ``too_large`` (beyond the cap, if one is set), ``unknown`` or the name."""
    status = F.when(is_excluded(F.col("path")), "excluded")
    if cap is not None:
        status = status.when(~within_size_cap(F.col("content"), cap), "too_large")
    return files.select("path", status.otherwise(F.coalesce("lang_name", F.lit("unknown"))).alias("language"))


def reviewable(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Files the analyzers look at, with their language; with a cap, only files up to it."""
    kept = filter_excluded_dirs(files.select("path", "content"))
    if cap is not None:
        kept = filter_size_cap(kept, cap)
    return detect_language(kept).where(F.col("lang_id").isNotNull())


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line; an empty file is one empty line, a final newline opens one more."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode_outer(split_lines(F.col("content"))).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "text")


def comment_flags(lines: DataFrame) -> DataFrame:
    """The four readings of 'this line is a comment' that the analyzers use."""
    trimmed = F.col("trimmed")
    hashed = starts_with_any(trimmed, ("//", "#", "*"))
    return lines.withColumn("trimmed", trim_all(F.col("text"))).withColumns({
        "skip_hash": hashed,
        "skip_html": hashed | F.startswith(trimmed, F.lit("<!--")),
        "skip_hash_blank": hashed | (trimmed == ""),
        "skip_slashes": F.startswith(trimmed, F.lit("//")),
        "lowered": F.lower("text"),
    })


def lang_gate(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of file and rule: a rule without languages applies to every known language.

    ``rules(uid, languages ARRAY<STRING>)`` is sent to all tasks if it has no more than MAX_BROADCAST_RULES rows.
    """
    known = F.array(*[F.lit(x) for x in dims.LANGUAGES])
    per_lang = rules.select("uid", F.explode(F.coalesce("languages", known)).alias("lang_id"))
    small = rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    return files.join(F.broadcast(per_lang) if small else per_lang, "lang_id")
