"""The whole way from source text to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tokenize import MAX_LENGTH, spread, token_lists
from tokenloom.operators.grouping import EXPANSIONS, finalize, group_matches
from tokenloom.plans.pattern import Pattern
from tokenloom.plans.program import depths_needed
from tokenloom.plans.scan import scan

#: Patterns up to which their words are looked for one by one, before files leave the JVM; beyond it one automaton looks for all.
FEW = 8


def must_hold(pattern: Pattern) -> list[str]:
    """Identifiers that every match of the pattern has."""
    return sorted({x.text for x in pattern.items if x.kind == "token" and not x.text.startswith('"')})


def needs_of(patterns: list[Pattern]) -> dict[str, list[frozenset[bytes]]]:
    """For each language the sets of words that the files of its patterns have to hold."""
    out: dict[str, set[frozenset[bytes]]] = {}
    for p in patterns:
        words = frozenset(w.encode() for w in must_hold(p))
        for lang in p.languages:
            out.setdefault(lang, set()).add(words)
    return {lang: sorted(sets, key=sorted) for lang, sets in out.items()}


def prefiltered(files: DataFrame, patterns: list[Pattern], content: str = "content") -> DataFrame:
    """The files that hold all fixed identifiers of some pattern of their language; a pattern without any keeps all."""
    text = F.col(content) if dict(files.dtypes)[content] == "string" else F.decode(content, "ISO-8859-1")
    keep = F.lit(False)
    for p in patterns:
        one = F.col("lang").isin(*p.languages)
        for word in must_hold(p):
            one &= F.contains(text, F.lit(word if dict(files.dtypes)[content] == "string" else word.encode().decode("latin-1")))
        keep |= one
    return files.where(keep)


def find(files: DataFrame, patterns: list[Pattern], content: str = "content", max_length: int = MAX_LENGTH, max_unique: int = EXPANSIONS) -> DataFrame:
    """Findings (file, start, end, name, captures) in files(file, lang, content)."""
    languages = tuple(sorted({x for p in patterns for x in p.languages}))
    few = len(patterns) <= FEW
    files = spread(prefiltered(files, patterns, content) if few else files)
    lists = token_lists(files, content, max_length, languages, True, depths_needed(patterns), None if few else needs_of(patterns))
    matches = scan(lists, patterns)
    return finalize(group_matches(matches, max_unique) if any(p.group for p in patterns) else matches)


__all__ = ["find", "must_hold", "needs_of", "prefiltered"]
