"""Near-duplicate vectors through hierarchical navigable small-world graphs, one for each shard.

Vectors are compared only within a label. Equal vectors are first joined into one with a count. The distinct vectors
of a label are dealt by hash into shards of about SHARD_ROWS vectors and SHARD_BYTES bytes; each shard builds its own graph:
every vector links to diverse near neighbours, on a random number of layers, and a search walks from the top layer down and then
keeps a beam of the best vectors seen. Every shard's vectors query every shard of the label: two shards meet in one task, where each
queries the other, and a pair counts for both of its ends whichever of them found it. A beam that is full of links is
widened. Before, the links of an audit are known from a scan: those of a sample of the queries with other vectors, and those
of vectors planted just within the threshold of the shard's own, so that an audit always has links; until AUDIT_RECALL of
them are found, all beams are widened. Beams wider than WIDEST give way to a scan of the shard. Found pairs are verified
by the cosine in double precision, counted, and their components united, each task sending only a spanning forest.

Defined cases: null, empty, zero and non-finite vectors, vectors with null components and null labels link with nothing;
vectors of different lengths do not link; a null id makes a row that is kept and has no component; repeated rows link
with each other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut
from tokenloom.llm.components import connected_components, forest

SHARD_ROWS, SHARD_BYTES = 16_384, 32 << 20
LINKS = 16
BEAM = 64
WIDEST = 512
AUDIT_ROWS = 48
AUDIT_RECALL = 0.99
BATCH = 512


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of each row's candidates (ids, -1 for none, best first): those nearer to the row's vector than to one chosen before; then the nearest others."""
    rows, width = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.einsum("rid,rjd->rij", vectors, vectors)
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        hidden = (chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = (ids[:, j] >= 0) & ~hidden & (chosen.sum(axis=1) < most)
    order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return out if width >= most else np.pad(out, ((0, 0), (0, most - width)), constant_values=-1)


class Graph:
    """A graph over the rows of x (unit vectors, float32). layers[k][i] lists the neighbours of row i on layer k; on upper layers most rows have none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, top: int = 0):
        self.x, self.top = x, top
        self.layers = layers if layers is not None else []
        if layers is None and len(x):
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        levels = np.minimum((-np.log(np.random.default_rng(7).random(n)) / np.log(LINKS)).astype(int), 6)
        levels[0] = levels.max()
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(levels[0] + 1)]
        done = 1
        while done < n:
            rows = np.arange(done, min(n, done + min(BATCH, max(32, done))))
            entry = np.zeros((len(rows), 1), np.int32)
            for k in range(levels[0], -1, -1):
                ids, sims = self.walk(k, self.x[rows], entry, BEAM)
                here = levels[rows] >= k
                if here.any():
                    new = rows[here]
                    block = self.x[new] @ self.x[new].T
                    block[np.triu_indices(len(new))] = -np.inf  # only rows before it
                    near = np.argsort(-block, axis=1)[:, :LINKS]
                    near_sims = np.take_along_axis(block, near, axis=1)
                    both = np.concatenate([ids[here], np.where(np.isfinite(near_sims), new[near], -1)], axis=1)
                    both_sims = np.concatenate([sims[here], near_sims], axis=1)
                    order = np.argsort(-both_sims, axis=1)[:, :BEAM]
                    both, both_sims = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_sims, order, axis=1)
                    self._connect(k, new, diverse(self.x, both, both_sims, LINKS))
                entry = ids[:, :4]
            done = rows[-1] + 1

    def _connect(self, k: int, new: np.ndarray, chosen: np.ndarray) -> None:
        table = self.layers[k]
        table[new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        at, begin, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(begin, count)
        width = table.shape[1]
        extra = np.full((len(at), min(width, int(count.max()))), -1, np.int32)
        fits = rank < extra.shape[1]
        extra[np.repeat(np.arange(len(at)), count)[fits], rank[fits]] = source[fits]
        both = np.concatenate([table[at], extra], axis=1)
        sims = np.where(both < 0, -np.inf, np.einsum("rid,rd->ri", self.x[np.maximum(both, 0)], self.x[at]))
        order = np.argsort(-sims, axis=1)
        both, sims = np.take_along_axis(both, order, axis=1), np.take_along_axis(sims, order, axis=1)
        full = (both >= 0).sum(axis=1) > width
        table[at[~full]] = both[~full][:, :width]
        if full.any():
            table[at[full]] = diverse(self.x, both[full], sims[full], width)

    def walk(self, k: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the best `beam` rows met on layer k from the entry rows, best first; all queries step together."""
        table, q = self.layers[k], len(queries)
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        met = np.zeros((q, len(self.x)), bool)
        entry = entry[:, :beam]
        for j in range(entry.shape[1]):
            fresh = (entry[:, j] >= 0) & ~met[np.arange(q), np.maximum(entry[:, j], 0)]
            ids[fresh, j] = entry[fresh, j]
            met[np.flatnonzero(fresh), entry[fresh, j]] = True
        there = ids >= 0
        sims[there] = np.einsum("id,id->i", queries[np.nonzero(there)[0]], self.x[ids[there]])
        open_[there] = True
        live = np.arange(q)
        while len(live):
            waiting = np.where(open_[live], sims[live], -np.inf)
            best = waiting.argmax(axis=1)
            going = np.isfinite(waiting[np.arange(len(live)), best])
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            near = table[ids[live, best]]
            fresh = (near >= 0) & ~met[live[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(fresh)
            met[live[rows], near[rows, cols]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[rows, cols] = np.einsum("id,id->i", queries[live[rows]], self.x[near[rows, cols]])
            all_sims = np.concatenate([sims[live], new], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, keep, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, axis=1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, axis=1)
        ids[~np.isfinite(sims)] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.top, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self.walk(k, queries, entry, 8)[0][:, :4]
        return self.walk(0, queries, entry, beam)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs found with a cosine of at least `least`; beams that are full of such pairs are widened."""
        found = []
        todo = np.arange(len(queries))
        while len(todo) and beam <= min(WIDEST, len(self.x) - 1):
            rest = []
            for part in np.array_split(todo, -(-len(todo) // BATCH)):
                ids, sims = self.search(queries[part], beam)
                near = (sims >= least) & (ids >= 0)
                full = near[:, -1]
                rows, cols = np.nonzero(near & ~full[:, None])
                found.append((part[rows], ids[rows, cols]))
                rest.append(part[full])
            todo, beam = np.concatenate(rest), 2 * beam
        for part in np.array_split(todo, -(-len(todo) // BATCH)) if len(todo) else []:
            rows, cols = np.nonzero(queries[part] @ self.x.T >= least)
            found.append((part[rows], cols))
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def planted(x: np.ndarray, threshold: float, n: int = AUDIT_ROWS) -> np.ndarray:
    """Unit vectors a little nearer than the threshold to n of the rows of x, in random directions."""
    r = np.random.default_rng(11)
    near = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].astype(float)
    off = r.normal(size=near.shape)
    off -= (off * near).sum(axis=1, keepdims=True) * near
    size = np.linalg.norm(off, axis=1, keepdims=True)
    cosine = threshold + (1 - threshold) * 0.05
    return (cosine * near + np.sqrt(1 - cosine**2) * off / np.where(size > 0, size, 1)).astype(np.float32)


def pairs_in(graph: Graph, shard: np.ndarray, block: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row of block, row of shard) of the verified pairs, after audits. same: block and shard are one, and a row is no link of itself."""
    queries, least, beam = unit(block), threshold - 1e-4, BEAM
    sample = np.linspace(0, len(block) - 1, min(AUDIT_ROWS, len(block))).astype(int)
    asked = np.concatenate([queries[sample], planted(graph.x, threshold)])
    truth = asked @ graph.x.T >= least
    if same:
        truth[np.arange(len(sample)), sample] = False
    while True:
        q, r = graph.within(asked, least, beam)
        hit = np.zeros_like(truth)
        hit[q, r] = True
        if beam > min(WIDEST, len(shard)) or (hit & truth).sum() >= AUDIT_RECALL * truth.sum():
            break
        beam *= 2
    q, r = graph.within(queries, least, beam)
    if same:
        q, r = q[q != r], r[q != r]
    if not len(q):
        return q, r
    q, r = np.unique(np.stack([q, r]), axis=1)
    cosine = np.concatenate([np.einsum("id,id->i", block[a], shard[b]) / (np.linalg.norm(block[a], axis=1) * np.linalg.norm(shard[b], axis=1)) for a, b in zip(np.array_split(q, -(-len(q) // 8192)), np.array_split(r, -(-len(q) // 8192)), strict=True)])
    return q[cosine >= threshold], r[cosine >= threshold]


def links_between(one: tuple, other: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of the links of two shards (vectors, graph), each querying the other; of one shard with itself, each link both ways round, if other is None."""
    (x, graph), (y, back) = one, other or one
    q, r = pairs_in(graph, x, y, threshold, other is None)
    a, b = (r, q) if other is None else pairs_in(back, y, x, threshold)[::-1]
    found = np.unique(np.stack([np.concatenate([q, a]), np.concatenate([r, b])]), axis=1)
    return found[1], found[0]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    parts = F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), parts.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    peak = F.array_max(F.transform("x", lambda v: F.abs(v)))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(peak > 0, F.lit(False))
    # by a power of two, which changes no cosine, so that no square is too large or too small
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(peak)).cast("double")))
    rows = rows.withColumn("valid", valid).withColumn("power", F.when(F.col("valid"), F.pow(F.lit(2.0), power))).withColumn("x", F.when(F.col("valid"), F.transform("x", lambda v: v * F.col("power")))).drop("power")
    keyed = rows.withColumns({"k1": F.when(F.col("valid"), F.xxhash64("label", "x")), "k2": F.when(F.col("valid"), F.xxhash64(F.lit("second"), "x", "label"))})
    distinct = cut(keyed.where("valid").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x")).withColumn("dim", F.size("x")))
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.greatest(F.count("*") / shard_rows, F.count("*") * F.col("dim") * 8 / SHARD_BYTES)).cast("int").alias("shards"))
    dealt = distinct.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "k1"), F.col("shards")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = np.stack(group.column("x").to_numpy())
        graph = Graph(unit(x))
        data = [pickle.dumps(v) for v in (x, graph.layers, (group.column("id").to_numpy(), group.column("copies").to_numpy()))]
        return pa.table({"label": group.column("label")[:1], "dim": group.column("dim")[:1], "shard": group.column("shard")[:1], "x": pa.array(data[:1]), "layers": pa.array(data[1:2]), "ids": pa.array(data[2:])})

    graphs = cut(dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard int, x binary, layers binary, ids binary"))
    others = graphs.select("label", "dim", F.col("shard").alias("block"), F.col("x").alias("y"), F.col("layers").alias("back"), F.col("ids").alias("others"))
    tasks = graphs.join(others, ["label", "dim"]).where("shard <= block")
    one = F.col("shard") == F.col("block")
    tasks = tasks.select("label", "dim", "shard", "block", "x", "layers", "ids", *(F.when(~one, F.col(c)).alias(c) for c in ("y", "back", "others")))

    def linked(cell: pa.Table) -> pa.Table:
        """The links of one pair of shards."""
        x, layers, (ids, copies), y, back, others = (pickle.loads(v) if (v := cell.column(c)[0].as_py()) is not None else None for c in ("x", "layers", "ids", "y", "back", "others"))
        same = y is None
        r, q = links_between((x, Graph(unit(x), layers)), None if same else (y, Graph(unit(y), back)), threshold)
        ids_q, copies_q = (ids, copies) if same else others
        counts = [(ids_q, np.bincount(q, copies[r], len(ids_q)))] + ([] if same else [(ids, np.bincount(r, copies_q[q], len(ids)))])
        some, n = (np.concatenate(v) for v in zip(*((i[k > 0], k[k > 0].astype(np.int64)) for i, k in counts), strict=True))
        a, b = forest(ids_q[q], ids[r])
        other = pa.array(np.concatenate([np.full(len(some), -1), b]), mask=np.arange(len(some) + len(a)) < len(some))
        return pa.table({"id": np.concatenate([some, a]), "links": np.concatenate([n, np.zeros(len(a), np.int64)]), "other": other})

    def query(group: pa.Table) -> pa.Table:
        return pa.concat_tables([linked(group.slice(i, 1)) for i in range(group.num_rows)])

    # grouped by a hash of the pair: by its columns, all pairs of a label would stay in the task of the join
    cells = tasks.withColumn("cell", F.xxhash64("label", "dim", "shard", "block")).drop("label", "dim", "shard", "block")
    found = cut(cells.groupBy("cell").applyInArrow(query, "id long, links long, other long"))
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = distinct.select("k1", "k2", "id", "copies").join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    result = keyed.select("id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    return result.select(F.col("id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
