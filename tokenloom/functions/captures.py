"""Captures: regular expressions that filter them and make new ones, and fixed values. All of a rule's are data in its row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.regex import java_regex
from tokenloom.functions.tokenize import as_text

#: Of a rule: its expressions (capture, Java's expression, named groups), in the order of its captures, and fixed values.
TRANSFORMS = "array<struct<name:string,rx:string,groups:array<struct<name:string,number:int>>>>"


def transforms_of(transform: tuple[tuple[str, str], ...], order: tuple[str, ...]) -> list[tuple]:
    """TRANSFORMS of a rule whose captures are named in `order`."""
    out = []
    for name, rx in sorted((x for x in transform if x[0] in order), key=lambda x: order.index(x[0])):
        java, groups = java_regex(rx)
        out.append((name, java, sorted(groups.items(), key=lambda g: g[1])))
    return out


def merged(a: Column, b: Column) -> Column:
    """Map a with the entries of b, b's first."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def fits_early(token: Callable[[int], Column], captures: dict[str, int], transforms: list[tuple]) -> Column:
    """Whether captures, by the places of their tokens, match their expressions and the groups that have their names; token(k) is the k-th token as bytes.

    What transformed() leaves out in the end, told before anything is made of it.
    """
    tests = []
    for name, rx, groups in transforms:
        value = as_text(token(captures[name]))
        tests.append(F.rlike(value, F.lit(rx)))
        for group, number in groups:
            if group in captures:
                found = F.regexp_extract(value, rx, number)
                tests.append((found == "") | (found == as_text(token(captures[group]))))
    return reduce(lambda a, b: a & b, tests)


def transformed(rows: DataFrame, transforms: bool = True, out: bool = True) -> DataFrame:
    """rows(captures, transforms, out) whose captures (texts) match their expressions, with the named groups and then `out` added.

    A group whose name is taken must have the same value; a group that took part with an empty text counts as absent.
    transforms, out: whether some row has any.
    """

    def group(state: Column, value: Column, rx: Column, g: Column) -> Column:
        def told(found: Column) -> Column:
            old = F.element_at(state["captures"], g["name"])
            added = F.map_concat(state["captures"], F.create_map(g["name"], found))
            return F.struct((state["ok"] & (old.isNull() | (found == "") | (old == found))).alias("ok"), F.when(old.isNull() & (found != ""), added).otherwise(state["captures"]).alias("captures"))

        return F.get(F.transform(F.array(F.call_function("regexp_extract", value, rx, g["number"])), told), F.lit(0))

    def expression(state: Column, t: Column) -> Column:
        value = F.element_at(state["captures"], t["name"])
        met = state["ok"] & F.coalesce(F.call_function("regexp_instr", value, t["rx"]) > 0, F.lit(False))
        inside = F.aggregate(t["groups"], state, lambda s, g: group(s, value, t["rx"], g))
        return F.when(met, inside).otherwise(F.struct(F.lit(False).alias("ok"), state["captures"].alias("captures")))

    if transforms:  # rows of one element or none: a filter would be worked out twice, below and above
        start = F.struct(F.lit(True).alias("ok"), F.col("captures").alias("captures"))
        done = F.when(F.size("transforms") > 0, F.aggregate("transforms", start, expression)).otherwise(start)
        rows = rows.select(*(c for c in rows.columns if c not in ("captures", "transforms")), F.explode(F.filter(F.array(done), lambda t: t["ok"])).alias("__t")).withColumn("captures", F.col("__t.captures")).drop("__t")
    if out:
        rows = rows.withColumn("captures", merged(F.col("captures"), F.col("out")))
    return rows.drop("transforms", "out")
