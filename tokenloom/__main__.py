"""python -m tokenloom PATTERNS SCAN: findings of the pattern files under PATTERNS in the files under SCAN, as JSON lines."""

from __future__ import annotations

import argparse
import sys

from tokenloom.functions.tokenize import MAX_LENGTH
from tokenloom.operators.grouping import EXPANSIONS
from tokenloom.plans.pattern import TEMPLATES


def positive(text: str) -> int:
    if (value := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tokenloom", description="Search source code for token patterns.")
    p.add_argument("patterns", help="folder (or file) of pattern files, .yml or .yaml")
    p.add_argument("scan", help="folder of source files")
    p.add_argument("--out", help="folder to write JSON lines to; by default they are printed")
    p.add_argument("--max-token-length", type=positive, default=MAX_LENGTH, help="bytes; longer strings and identifiers match nothing but an ellipsis")
    p.add_argument("--max-group-unique-expansions", type=positive, default=EXPANSIONS, help="results that unique members of a group may make of one")
    p.add_argument("--max-template-expansions", type=positive, default=TEMPLATES, help="patterns that templates may make of one")
    p.add_argument("--compat", action="store_true", help="Kotlin files use the patterns of JavaScript")
    p.add_argument("--explain", action="store_true", help="show the plans instead of running them")
    return p


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from tokenloom.api import find
    from tokenloom.plans.pattern import PatternError, load_files
    from tokenloom.sources.files import finding_json, read_files, write_findings

    a = parser().parse_args(arguments)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        patterns = load_files(spark, a.patterns, a.max_template_expansions, a.max_token_length)
    except PatternError as e:
        print(e, file=sys.stderr)
        return 1
    found = find(read_files(spark, a.scan, a.compat), patterns, "content", a.max_token_length, a.max_group_unique_expansions) if patterns else None
    if found is None:
        return 0
    if a.explain:
        found.explain("formatted")
    elif a.out:
        write_findings(found, a.out)
    else:
        for row in found.select(finding_json(found).alias("line")).toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
