"""Run settings, read from one JSON document over defaults."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lintlake.catalog import dims
from lintlake.catalog.rules import DEFAULT_USER_FIX, DEFAULT_USER_RULES, USER, Rule
from lintlake.functions.regex import java_regex

_TEXTS = T.ArrayType(T.StringType())
CONFIG_SCHEMA = T.StructType([
    T.StructField("maxFunctionLength", T.DoubleType()),
    T.StructField("maxCyclomaticComplexity", T.DoubleType()),
    T.StructField("forbiddenFunctions", _TEXTS),
    T.StructField("customRules", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("pattern", T.StringType()),
        T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("explanation", T.StringType()), T.StructField("suggestedFix", T.StringType()),
        T.StructField("languages", _TEXTS)]))),
    T.StructField("ignorePaths", _TEXTS),
    T.StructField("severityThreshold", T.StringType()),
    T.StructField("confidenceThreshold", T.DoubleType()),
    T.StructField("minDuplicateLines", T.DoubleType()),
    T.StructField("enableFrameworks", _TEXTS),
    T.StructField("whitelistedFunctions", _TEXTS),
    T.StructField("whitelistedPatterns", _TEXTS),
])


@dataclass(frozen=True)
class ReviewConfig:
    max_function_length: int = 50
    max_complexity: int = 10
    forbidden_functions: tuple[str, ...] = ("eval", "exec")
    custom_rules: tuple[dict, ...] = ()
    ignore_paths: tuple[str, ...] = tuple(dims.DEFAULT_IGNORE_PATHS)
    ignore_patterns: tuple[str, ...] = ()
    severity_threshold: str = "Low"
    confidence_threshold: float = 0.6
    min_duplicate_lines: int = 5
    enable_frameworks: tuple[str, ...] = ()
    whitelisted_functions: tuple[str, ...] = ()
    whitelisted_patterns: tuple[str, ...] = ()
    framework_scope: str = "corpus"      # or "file"
    max_file_chars: int | None = None    # longer files are not reviewed; their status says so

    @cached_property
    def user_rules(self) -> tuple[Rule, ...]:
        return tuple(user_rules(self.custom_rules))

    @property
    def block_lines(self) -> int:
        return max(2, int(self.min_duplicate_lines))

    def fingerprint(self) -> str:
        """Identifies the settings in stored review state: other settings, other findings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=list).encode()).hexdigest()[:16]


def user_rules(custom: tuple[dict, ...] | list[dict], compiles: Callable[[str], bool] | None = None) -> list[Rule]:
    """The default rules plus configured ones; a pattern that does not compile is left out."""
    compiles = compiles or usable_regex
    usable = [r for r in custom if r.get("pattern") is not None and compiles(r["pattern"])]
    out = []
    for n, raw in enumerate([*DEFAULT_USER_RULES, *usable]):
        severity = {"critical": "Critical", "high": "High", "medium": "Medium"}.get((raw.get("severity") or "").lower(), "Low")
        message = raw.get("message") or ""
        langs = raw.get("languages")
        out.append(Rule(f"U{n + 1:02d}", USER, n, f"rule/{raw.get('id')}", "BadPractice", severity, 0.8,
                        tuple(langs) if langs is not None else None, raw["pattern"], message,
                        raw.get("explanation") or message, raw.get("suggestedFix") or DEFAULT_USER_FIX))
    return out


def usable_regex(pattern: str) -> bool:
    """Tried once when the settings are built: tasks must not fail on a broken pattern."""
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        session.sql("SELECT '' RLIKE :p AS ok", args={"p": java_regex(pattern, exact_edges=True)}).collect()
        return True
    except Exception as err:
        if "REGEX" in str(err).upper() or "PATTERN" in str(err).upper():
            return False
        raise


def read_config(spark: SparkSession, path: str, **overrides) -> ReviewConfig:
    """One JSON document. Fields of a wrong type, or a broken file, leave the defaults."""
    row = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path).first()
    doc = row.asDict(recursive=True) if row else {}
    names = {
        "maxFunctionLength": ("max_function_length", int), "maxCyclomaticComplexity": ("max_complexity", int),
        "forbiddenFunctions": ("forbidden_functions", tuple), "customRules": ("custom_rules", tuple),
        "ignorePaths": ("ignore_paths", tuple), "severityThreshold": ("severity_threshold", str),
        "confidenceThreshold": ("confidence_threshold", float), "minDuplicateLines": ("min_duplicate_lines", int),
        "enableFrameworks": ("enable_frameworks", tuple), "whitelistedFunctions": ("whitelisted_functions", tuple),
        "whitelistedPatterns": ("whitelisted_patterns", tuple),
    }
    values = {attr: cast(doc[key]) for key, (attr, cast) in names.items() if doc.get(key) is not None}
    if values.get("severity_threshold", "Low") not in dims.SEVERITY_RANK:
        values.pop("severity_threshold")
    return ReviewConfig(**{**values, **overrides})
