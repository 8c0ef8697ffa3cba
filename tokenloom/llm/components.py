"""Connected components of a table of links, by forests of each task's links and graphs of their roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut

#: Links that a task turns into a forest at a time, and rows up to which a table of roots is broadcast.
LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect the same nodes as the links a-b; for one task's links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def local_forests(links: DataFrame) -> DataFrame:
    """(node, root) for links(node, root): the links of each task, some LINKS at a time, as forests, and their roots as (root, root)."""

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            node, root = forest(*(np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in (0, 1)))
            waiting.clear()
            roots = np.unique(root)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], ["node", "root"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= LINKS:
                yield out()
        if waiting:
            yield out()

    return links.mapInArrow(contracted, "node long, root long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another one.

    Each task turns its links into a forest. A node that tasks have put under different roots links these; the graph of the
    linked roots, far smaller, is treated in the same way until no root is left with another one. Then the roots are
    looked up from the last graph down to the first. A group holds one row for each forest that has the node.
    """
    edges = links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node <> root")
    levels = []
    while True:
        named = cut(local_forests(edges).groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
        levels.append(named.select("node", "root"))
        apart = named.where(F.size("roots") > 1).select(F.explode("roots").alias("node"), "root").where("node <> root")
        n = apart.count()
        if not n:
            break
        edges = apart.coalesce(-(-n // LINKS))
    found = levels.pop().withColumnRenamed("root", "component")
    while levels:
        upper = found.select(F.col("node").alias("root"), "component")
        if upper.limit(LINKS + 1).count() <= LINKS:
            upper = F.broadcast(upper)
        found = levels.pop().join(upper, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return cut(found)
