"""Merging of the matches of a group: a match takes in those of its file and group that contain it.

Matches of a file and group are ordered by end, then by start from the last. Each one (the anchor) is held against the
later ones that contain it; where both have one of the anchor's `match` captures, the values must be equal. Members are
merged in order, each seen by the next comparison; `unique` members fork the anchor instead, one result for each
combination of the rules' members. Members of an anchor that is not unique are no anchors themselves.

Which matches are anchors is settled in rounds. A match is ready when no earlier one that waits lies inside it, which a
running maximum of starts tells; ready ones are joined with the matches that contain them, and what they take in
waits no longer. So members that are taken in at once never meet each other, however many there are. The join's key is
a bin of places at the scale of a member's length, so that an anchor meets few matches that do not contain it. An anchor's own
members are folded in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.captures import merged
from tokenloom.functions.shared import cut

EXPANSIONS = 64


def _applied(o: Column, m: Column) -> Column:
    """State o with member m's captures, span and cancel."""
    start = F.when(~o["so"] & (m["start"]["offset"] < o["start"]["offset"]), m["start"]).otherwise(o["start"])
    end = F.when(~o["eo"] & (m["end"]["offset"] > o["end"]["offset"]), m["end"]).otherwise(o["end"])
    return F.struct(merged(o["captures"], m["captures"]).alias("captures"), start.alias("start"), end.alias("end"), o["so"].alias("so"), o["eo"].alias("eo"), (o["cancel"] | m["cancel"]).alias("cancel"), o["unique"].alias("unique"), o["axes"].alias("axes"), o["taken"].alias("taken"))


def _absorbed(o: Column, m: Column, keys: Column) -> Column:
    """State o after it has met member m."""
    apart = F.exists(keys, lambda k: F.coalesce(F.element_at(o["captures"], k) != F.element_at(m["captures"], k), F.lit(False)))
    other = {c: o[c] for c in ("captures", "start", "end", "so", "eo", "cancel", "unique")}
    taken = F.concat(o["taken"], F.array(m["rn"]))
    noted = F.struct(*(v.alias(c) for c, v in other.items()), F.when(m["unique"], F.concat(o["axes"], F.array(m))).otherwise(o["axes"]).alias("axes"), taken.alias("taken"))
    merged_ = F.when(m["unique"] | o["unique"], noted).otherwise(_applied(noted, m))
    return F.when(apart, o).otherwise(merged_)


def _combinations(axes: Column, most: int) -> Column:
    """The ways to take one member of each rule, rules by name, at most `most`."""
    names = F.array_sort(F.array_distinct(F.transform(axes, lambda x: x["name"])))
    none = F.array(F.slice(axes, 1, 0))
    return F.aggregate(names, none, lambda acc, n: F.slice(F.flatten(F.transform(acc, lambda c: F.transform(F.filter(axes, lambda x: x["name"] == n), lambda m: F.concat(c, F.array(m))))), 1, most))


def group_matches(matches: DataFrame, most: int = EXPANSIONS) -> DataFrame:
    """matches with those of groups merged. Merged ones have the group's name and an empty group but for cancel."""
    free = matches.where("grp.name = ''")
    order = Window.partitionBy("file", "grp.name").orderBy("actual_end", F.desc("actual_start"), "pattern_id", F.xxhash64(F.array_sort(F.map_entries("captures"))))
    grouped = cut(matches.where("grp.name <> ''").withColumn("rn", F.row_number().over(order)).withColumn("g", F.col("grp.name")))
    member = F.struct("rn", "name", "captures", "start", "end", F.col("grp.cancel").alias("cancel"), F.col("grp.unique").alias("unique"))
    length = F.col("actual_end") - F.col("actual_start")
    spans = grouped.withColumn("scale", F.when(length > 1, F.ceil(F.log2(length)).cast("int")).otherwise(0))
    bins = F.array_distinct(F.array(*(F.call_function("shiftright", F.col(c), F.col("scale")) for c in ("actual_start", "actual_end"))))
    members = spans.select("file", "g", "scale", F.explode(bins).alias("bin"), F.col("rn").alias("mrn"), F.col("actual_start").alias("ms"), F.col("actual_end").alias("me"), member.alias("m"))
    scales = cut(spans.select("file", "g", "scale").distinct())
    empty = F.array_compact(F.array(F.when(F.lit(False), member)))
    state = F.struct("captures", "start", "end", F.col("start_overridden").alias("so"), F.col("end_overridden").alias("eo"), F.col("grp.cancel").alias("cancel"), F.col("grp.unique").alias("unique"), empty.alias("axes"), F.array().cast("array<int>").alias("taken"))
    inside = (F.col("mrn") > F.col("rn")) & (F.col("ms") <= F.col("actual_start")) & (F.col("me") >= F.col("actual_end"))
    before = Window.partitionBy("file", "g").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    waiting, settled = grouped, []
    while True:
        marked = cut(waiting.withColumn("ready", F.coalesce(F.max("actual_start").over(before) < F.col("actual_start"), F.lit(True))))
        ready = marked.where("ready").drop("ready")
        asked = ready.select("file", "g", "rn", "actual_start", "actual_end").join(scales, ["file", "g"]).withColumn("bin", F.call_function("shiftright", F.col("actual_start"), F.col("scale")))
        lists = asked.join(members, ["file", "g", "scale", "bin"]).where(inside).groupBy("file", "g", "rn").agg(F.array_sort(F.collect_list("m"), lambda a, b: a["rn"] - b["rn"]).alias("list"))
        anchors = ready.join(lists, ["file", "g", "rn"], "left").withColumn("list", F.coalesce("list", empty))
        done = cut(anchors.withColumn("s", F.aggregate("list", state, lambda o, m: _absorbed(o, m, F.col("grp.match")))).drop("list"))
        settled.append(done)
        rest = marked.where("not ready").drop("ready")
        if rest.isEmpty():
            break
        taken = done.where("not grp.unique").select("file", "g", F.explode("s.taken").alias("rn")).distinct()
        waiting = cut(rest.join(taken, ["file", "g", "rn"], "left_anti"))
        if waiting.isEmpty():
            break
    kept = reduce(DataFrame.unionByName, settled).withColumn("combo", F.explode(_combinations(F.col("s.axes"), most)))
    kept = kept.withColumn("s", F.when(F.col("grp.unique"), F.col("s")).otherwise(F.aggregate("combo", F.col("s"), _applied)))
    group = F.struct(F.lit("").alias("name"), F.lit(False).alias("unique"), F.col("s.cancel").alias("cancel"), F.array().cast("array<string>").alias("match"))
    done = kept.select("file", "pattern_id", F.col("g").alias("name"), group.alias("grp"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "start_overridden", "end_overridden", "actual_start", "actual_end", F.col("s.captures").alias("captures"))
    return free.unionByName(done)


def finalize(matches: DataFrame) -> DataFrame:
    """(file, start, end, name, captures) of matches that are not cancelled, without captures whose names begin with an underscore."""
    return matches.where("not grp.cancel").select("file", "start", "end", "name", F.map_filter("captures", lambda k, _: ~F.startswith(k, F.lit("_"))).alias("captures"))
