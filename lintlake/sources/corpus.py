"""Sources: folders, tables, change lists, ignore files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.catalog import dims
from lintlake.functions.regex import escape_literal
from lintlake.functions.text import trim_all
from lintlake.operators.files import filter_excluded_dirs, filter_ignore_paths, filter_ignore_patterns, ignored_by_path, ignored_by_pattern, is_excluded


def scan_table(table: DataFrame, path: Column, content: Column) -> DataFrame:
    return table.select(path.cast("string").alias("path"), content.alias("content"))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as (path, length, content BINARY); the reader lists in parallel."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content"))


def wanted_names(path: Column, ignore_paths=tuple(dims.DEFAULT_IGNORE_PATHS), ignore_patterns=()) -> Column:
    """Whether a file of this name is reviewed: a supported extension, outside the excluded folders, not ignored."""
    exts = "|".join(escape_literal(e) for e in sorted({r[0] for r in dims.extension_rows()}))
    return path.rlike(f"(?:{exts})\\z") & ~is_excluded(path) & ~ignored_by_path(path, tuple(ignore_paths)) & ~ignored_by_pattern(path, tuple(ignore_patterns))


def read_tree(spark: SparkSession, root: str, ignore_paths=tuple(dims.DEFAULT_IGNORE_PATHS), ignore_patterns=(), max_bytes: int | None = None) -> DataFrame:
    """(path, content) of the files below ``root`` that are reviewed; the others are listed, never opened.

    Names and sizes are tests on the reader's file metadata: files that fail them are dropped from the listing, before files are packed into
    tasks by their bytes. Names are compared as the store has them (the metadata's URL escapes undone).
    """
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(wanted_names(name, ignore_paths, ignore_patterns))
    if max_bytes is not None:
        found = found.where(F.col("_metadata.file_size") <= max_bytes)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def scan_corpus(raw: DataFrame, ignore_paths=tuple(dims.DEFAULT_IGNORE_PATHS), ignore_patterns=()) -> DataFrame:
    """(path, length, content BINARY) -> (path, content): files with a supported extension outside
    the excluded folders. Paths are tested before any content is decoded."""
    exts = "|".join(escape_literal(e) for e in sorted({r[0] for r in dims.extension_rows()}))
    named = filter_ignore_paths(filter_excluded_dirs(raw), tuple(ignore_paths)).where(F.col("path").rlike(f"(?:{exts})\\z"))
    kept = filter_ignore_patterns(named, tuple(ignore_patterns))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def listed_paths(raw: DataFrame, root: str) -> DataFrame:
    """Lines of a list command (column ``value``) -> paths below ``root``."""
    value = trim_all(F.col("value"))
    return raw.select(value.alias("value")).where(F.length("value") > 0).select(
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("value")).alias("path"))


def scan_change_list(tracked: DataFrame, untracked: DataFrame, root: str) -> DataFrame:
    return distinct_paths(listed_paths(tracked, root), listed_paths(untracked, root))


def scan_staged_list(staged: DataFrame, root: str) -> DataFrame:
    return listed_paths(staged, root)


def distinct_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("path").union(right.select("path")).distinct()


def scan_ignore_file(raw: DataFrame) -> DataFrame:
    """Lines of an ignore file (column ``value``) -> patterns."""
    pattern = trim_all(F.col("value"))
    return raw.select(pattern.alias("pattern")).where((F.length("pattern") > 0) & ~F.startswith("pattern", F.lit("#")))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
