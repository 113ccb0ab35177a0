"""Severity, category and language dimensions.

Fixed values: names, labels, ranks and extensions below must keep these exact
texts, because they appear in results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEVERITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}

# code -> (label shown in results, default severity)
CATEGORIES = {
    "SyntaxError": ("Syntax Error", "High"),
    "LogicalBug": ("Logical Bug", "High"),
    "RuntimeException": ("Possible Runtime Exception", "High"),
    "NullReference": ("Null Reference Issue", "High"),
    "MemoryLeak": ("Memory Leak", "Critical"),
    "ResourceLeak": ("Resource Leak", "High"),
    "PerformanceBottleneck": ("Performance Bottleneck", "Medium"),
    "InefficientLoop": ("Inefficient Loop", "Medium"),
    "UnnecessaryObjectCreation": ("Unnecessary Object Creation", "Low"),
    "HighComplexity": ("High Complexity Function", "Medium"),
    "DeadCode": ("Dead Code", "Low"),
    "UnusedVariable": ("Unused Variable", "Low"),
    "UnreachableCode": ("Unreachable Code", "Medium"),
    "SecurityVulnerability": ("Security Vulnerability", "Critical"),
    "SQLInjection": ("SQL Injection Risk", "Critical"),
    "CommandInjection": ("Command Injection Risk", "Critical"),
    "XSSRisk": ("XSS Risk", "Critical"),
    "ImproperInputValidation": ("Improper Input Validation", "High"),
    "HardcodedSecret": ("Hardcoded Secret", "Critical"),
    "BadPractice": ("Bad Coding Practice", "Low"),
    "InconsistentNaming": ("Inconsistent Naming", "Low"),
    "PoorErrorHandling": ("Poor Error Handling", "Medium"),
    "RaceCondition": ("Race Condition", "High"),
    "ConcurrencyProblem": ("Concurrency Problem", "High"),
    "BlockingIO": ("Blocking I/O", "Medium"),
    "MissingEdgeCase": ("Missing Edge Case Handling", "Medium"),
    "RuntimeRisk": ("Runtime Risk (Predicted)", "High"),
}

# id -> (display name, family, extensions)
LANGUAGES = {
    "javascript": ("JavaScript", "c-style", [".js", ".jsx", ".mjs", ".cjs"]),
    "typescript": ("TypeScript", "c-style", [".ts", ".tsx", ".mts", ".cts"]),
    "python": ("Python", "scripting", [".py", ".pyw"]),
    "java": ("Java", "c-style", [".java"]),
    "c": ("C", "c-style", [".c", ".h"]),
    "cpp": ("C++", "c-style", [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"]),
    "csharp": ("C#", "c-style", [".cs"]),
    "go": ("Go", "c-style", [".go"]),
    "rust": ("Rust", "c-style", [".rs"]),
    "php": ("PHP", "c-style", [".php", ".phtml"]),
    "ruby": ("Ruby", "scripting", [".rb", ".erb"]),
    "swift": ("Swift", "c-style", [".swift"]),
    "kotlin": ("Kotlin", "c-style", [".kt", ".kts"]),
    "dart": ("Dart", "c-style", [".dart"]),
    "html": ("HTML", "markup", [".html", ".htm"]),
    "css": ("CSS", "markup", [".css"]),
    "scss": ("SCSS", "markup", [".scss", ".sass"]),
    "sql": ("SQL", "data", [".sql"]),
    "shellscript": ("Shell/Bash", "shell", [".sh", ".bash"]),
    "powershell": ("PowerShell", "shell", [".ps1", ".psm1", ".psd1"]),
    "json": ("JSON", "data", [".json", ".jsonc"]),
    "yaml": ("YAML", "data", [".yml", ".yaml"]),
    "dockerfile": ("Dockerfile", "infrastructure", [".dockerfile"]),
    "terraform": ("Terraform", "infrastructure", [".tf", ".tfvars"]),
}

EXCLUDED_DIRS = ["node_modules", "dist", "build", ".git"]
DEFAULT_IGNORE_PATHS = ["node_modules", "dist", "build", ".git", "vendor", "__pycache__", ".venv"]
MAX_FILE_CHARS = 500_000


def label(category: str) -> str:
    return CATEGORIES[category][0]


def extension_rows() -> list[tuple[str, str, str, str]]:
    """(ext, lang_id, lang_name, family), one row per extension."""
    return [(ext, lid, name, fam) for lid, (name, fam, exts) in LANGUAGES.items() for ext in exts]


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITY_RANK.items()), "severity string, sev_rank int")


def category_dim(spark: SparkSession) -> DataFrame:
    rows = [(code, lab, sev) for code, (lab, sev) in CATEGORIES.items()]
    return spark.createDataFrame(rows, "code string, category string, default_severity string")


def language_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(extension_rows(), "ext string, lang_id string, lang_name string, family string")
