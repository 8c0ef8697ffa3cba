"""Source files as rows (file, lang, content), and findings as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.languages import with_language
from tokenloom.sources.store import list_files, read_content


def read_files(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """All regular files under path whose language is known; `file` is relative to it. Unreadable files are left out."""
    return read_content(with_language(list_files(spark, path), "path", compat)).select("file", "lang", "content")


def finding_json(findings: DataFrame) -> Column:
    """A JSON object of a finding: file, start, end, name, captures; empty ones are left out, keys of captures sorted."""
    captures = F.map_from_entries(F.array_sort(F.map_entries("captures")))
    filled = [F.when(F.col("file") != "", F.col("file")).alias("file"), "start", "end", F.when(F.col("name") != "", F.col("name")).alias("name"), F.when(F.size("captures") > 0, captures).alias("captures")]
    return F.to_json(F.struct(*filled))


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write JSON lines; the order of lines is not defined."""
    findings.select(finding_json(findings).alias("value")).write.mode(mode).text(path)
