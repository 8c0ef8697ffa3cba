"""Languages: names in pattern files, and file name endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that pattern files may use, and file name endings.
ALIASES = {
    "c": "c c++ cpp",
    "csharp": "c# csharp cs",
    "go": "go golang",
    "java": "java",
    "js": "js javascript",
    "kotlin": "kt kotlin",
    "py": "py python python2 python3",
    "rust": "rs rust",
    "ts": "ts typescript",
}
ENDINGS = {"c": "c cpp cxx h hpp", "csharp": "cs", "go": "go", "java": "java", "js": "javascript js mjs", "kotlin": "kt kts", "py": "py", "rust": "rs", "ts": "typescript ts"}
BY_ALIAS = {a: lang for lang, names in ALIASES.items() for a in names.split()}


def language_of(path: Column, compat: bool = False) -> Column:
    """The language of a path by its ending, in any case; null if unknown. compat: Kotlin files count as JavaScript."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    names = {e: ("js" if compat and lang == "kotlin" else lang) for lang, ends in ENDINGS.items() for e in ends.split()}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, ending)


def with_language(files: DataFrame, path: str = "file", compat: bool = False) -> DataFrame:
    """files with `lang`, without those of unknown languages."""
    return files.withColumn("lang", language_of(F.col(path), compat)).where(F.col("lang").isNotNull())
