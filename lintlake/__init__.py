"""Corpus review as Spark jobs: files in, findings, reports and fixed files out."""

from lintlake.config import ReviewConfig
from lintlake.plans.review import review_files

__all__ = ["ReviewConfig", "review_files"]
