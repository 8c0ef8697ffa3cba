"""Self-join of documents by the Jaccard similarity of their word shingles, through prefixes of their rarest shingles.

A document is the set of its distinct WIDTH-word shingles, each a 64-bit hash; equal sets are joined first and count as
one node, named by a hash of the set. All shingles are put into one order, by the number of sets that have them and then
by hash. Similar sets share so many shingles that the first one they share in this order lies among the first quarter
of each, its prefix, and so far in front that enough shingles follow it in both (the position test). A join of the
prefixes by shingle under that test therefore loses no similar pair, whatever the order; an order by rarity keeps it small,
since a passage that many documents share comes last in each.

- The most frequent shingles are known from a broadcast list and come last; the others are dealt to buckets and counted
  there. Those that one set alone has take places in its prefix and are not sent on.
- Of two sets that pass the position test one has the shingle in its first seventh, so shingles that no set has there are left
  out. For each other one every set is held against the one with the shingle furthest in front (the pivot), so
  that a shingle gives as many pairs as it has sets. If all sets of a shingle pass, they are in one component. Where one fails, all are
  held against a second pivot, the set that shares its shingles with the most others: of near copies, the one they were made of.
- Of shingles whose sets are still in different components, all pairs of different components that pass the position
  test are held against each other.

A pair is verified in two steps: the Hamming distance of two bit sketches (each bit the parity of the shingles that
fall to it) is a lower bound of the symmetric difference and drops nearly all pairs that are not similar; the others
are compared by their whole sets of hashes.

Defined cases: null texts and texts without words have the empty set and link with nothing; texts with fewer than WIDTH
words are one shingle; null ids link with nothing; repeated rows are exact copies; all shingles of very
long texts are compared; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, mix, release, shingle_sets, slices
from tokenloom.llm.components import connected_components

WIDTH = 5
#: Similar: PART * |intersection| >= WHOLE * |union|.
PART, WHOLE = 100, 75
#: Shingles that are put last without counting them in buckets: at most FREQUENT, each in COMMON sets at least. Any choice gives the same links.
FREQUENT, COMMON = 50_000, 50
#: Bits of the sketch that drops pairs, for each shingle, at least.
BITS = 4
#: (shingle, node) pairs in one bucket, and those that a task gathers before it sends them on.
GROUP_PAIRS = 800_000
SEND_PAIRS = 300_000
#: Document ids up to which those of candidates are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty set."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(hashes + np.uint64(77)), bounds[some]))
    return out.view(np.int64)


def bit_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: a power of two of bits, BITS to 2 * BITS for each shingle."""
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        bits = 1 << max(6, (BITS * (b - a) - 1).bit_length())
        at = mix(hashes[a:b] + np.uint64(5)) & np.uint64(bits - 1)
        out.append(np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes())
    return out


def differ(x: bytes, y: bytes) -> int:
    """The Hamming distance of two bit sketches, the longer one folded to the length of the other."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def document_nodes(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, node, sketch) for docs(id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column("text"), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), pa.array(fingerprints(hashes, bounds)), pa.array(bit_sketches(hashes, bounds), pa.binary())], ["id", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(found, "id long, n_shingles long, node long, sketch binary")


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The arrays that the column's cells hold, end to end."""
    found = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, rows, their nodes, hashes, bounds) of the sets of batches that this task has not met yet."""
    seen: set[int] = {0}
    for batch in slices(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"), WIDTH)
        nodes = fingerprints(hashes, bounds)
        new = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes.tolist()):
            new[i] = node not in seen
            seen.add(node)
        sizes = np.diff(bounds)
        yield batch, np.flatnonzero(new), nodes[new], hashes[np.repeat(new, sizes)], np.concatenate([[0], np.cumsum(sizes[new])])


def gathered(parts: Iterator[tuple[np.ndarray, ...]], send) -> Iterator[pa.RecordBatch]:
    """send(columns) for about SEND_PAIRS rows at a time."""
    waiting: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        if len(part[0]):
            waiting.append(part)
        if sum(len(x[0]) for x in waiting) >= SEND_PAIRS:
            yield send(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting.clear()
    if waiting:
        yield send(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def begins(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the sets of docs(text), sorted, and the place of each when they are ordered by rarity. Tasks send those that they meet more than once in about SEND_PAIRS shingles."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(hashes: np.ndarray) -> pa.RecordBatch:
            found, n = np.unique(hashes, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

        yield from gathered(((hashes,) for _, _, _, hashes, _ in new_sets(batches)), send)

    seen = docs.select("text").mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = seen.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()["shingle"]
    hashes = found.to_numpy(np.int64)[::-1].copy().view(np.uint64)
    place = np.argsort(hashes, kind="stable")
    return hashes[place], place


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Shingles of a set of which a similar set has one at least: all but those that any similar set shares, and one more."""
    return size - -(-WHOLE * size // PART) + 1


def prefixes(docs: DataFrame, shingles: int) -> DataFrame:
    """(token, node, n_shingles, pos): the prefix of each set of docs(text), without shingles of one set alone. The sets have `shingles` in total.

    A token names a shingle, or a few that fall together. Rows (node, token, x, y) on the way are of three kinds: n_shingles and the number
    of shingles that are not frequent (y >= 0), the sets that have a token (counted), or the position of a frequent shingle (placed).
    """
    counted, placed = -1, -2
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    buckets = max(24, -(-shingles // GROUP_PAIRS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            common, rank = frequent.value
            for _, _, nodes, hashes, bounds in new_sets(batches):
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
                known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
                of = owner[known]
                n = np.bincount(of, minlength=len(size))
                order = np.lexsort((rank[at[known]], of))
                pos = (size - n)[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
                token = hashes[known][order].view(np.int64)
                first = pos < prefix_length(size)[of]
                sets = np.stack([nodes, np.zeros_like(nodes), size, size - n], axis=1)
                ready = np.stack([nodes[of], token, pos, np.full_like(pos, placed)], axis=1)[first]
                yield hashes[~known], nodes[owner[~known]], np.concatenate([sets, ready])

        # a part without counted shingles still has rows to send
        yield from gathered(((h, n, r) if len(h) else (np.zeros(1, np.uint64), np.zeros(1, np.int64), r) for h, n, r in parts()), send)

    def send(hashes: np.ndarray, nodes: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        hashes, nodes = hashes[nodes != 0], nodes[nodes != 0]
        of, to = (hashes % np.uint64(buckets)).astype(np.int64), (rest[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order, other = np.argsort(of, kind="stable"), np.argsort(to, kind="stable")
        short, nodes, rest = (hashes[order] >> np.uint64(32)).astype(np.uint32), nodes[order], rest[other]
        begin, start = np.searchsorted(of[order], np.arange(buckets + 1)).tolist(), np.searchsorted(to[other], np.arange(buckets + 1)).tolist()
        rows = [(g, short[begin[g] : begin[g + 1]].tobytes(), nodes[begin[g] : begin[g + 1]].tobytes(), rest[start[g] : start[g + 1]].tobytes()) for g in range(buckets) if begin[g] < begin[g + 1] or start[g] < start[g + 1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["bucket", "short", "nodes", "rest"])

    def count(group: pa.Table) -> pa.Table:
        short, nodes = unpacked(group.column("short"), np.uint32), unpacked(group.column("nodes"), np.int64)
        order = np.argsort(short, kind="stable")
        short, nodes = short[order], nodes[order]
        n = np.diff(np.append(begins(short), len(short)))
        n = np.repeat(n, n)
        some = n > 1
        token = (group.column("bucket")[0].as_py() << 32) + short[some].astype(np.int64)
        found = np.stack([nodes[some], token, n[some], np.full(len(token), counted)], axis=1)
        found = np.concatenate([found, unpacked(group.column("rest"), np.int64).reshape(-1, 4)])
        return pa.table(dict(zip(("node", "token", "x", "y"), found.T, strict=True)))

    def place(group: pa.Table) -> pa.Table:
        node, token, x, y = (group.column(c).to_numpy() for c in ("node", "token", "x", "y"))
        sets, first = np.unique(node[y >= 0], return_index=True)
        size, others = x[y >= 0][first], y[y >= 0][first]
        order = np.lexsort((token, x, node))
        order = order[y[order] == counted]
        of = np.searchsorted(sets, node[order])
        n = np.bincount(of, minlength=len(sets))
        # counted from the end, so that a repeated row, whose tokens come more than once, only moves them further in front
        pos = np.maximum((others - n)[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], 0)
        ready = np.flatnonzero(y == placed)
        order, of, pos = np.concatenate([order, ready]), np.concatenate([of, np.searchsorted(sets, node[ready])]), np.concatenate([pos, x[ready]])
        keep = pos < prefix_length(size)[of]
        return pa.table({"token": token[order][keep], "node": node[order][keep], "n_shingles": size[of][keep], "pos": pos[keep]})

    dealt = docs.select("text").mapInArrow(sent, "bucket int, short binary, nodes binary, rest binary")
    seen = dealt.groupBy("bucket").applyInArrow(count, "node long, token long, x long, y long")
    found = seen.withColumn("part", F.pmod("node", F.lit(buckets))).groupBy("part").applyInArrow(place, "token long, node long, n_shingles long, pos long")
    return found.groupBy("token", "node").agg(F.first("n_shingles").alias("n_shingles"), F.min("pos").alias("pos"))


def may_be_similar(m: str, i: str, n: str, j: str) -> Column:
    """The position test: whether sets of m and n shingles can be similar if the first that they share is at i and j."""
    return (PART + WHOLE) * F.least(F.col(m) - F.col(i), F.col(n) - F.col(j)) >= WHOLE * (F.col(m) + F.col(n))


def in_front(size: str, pos: str) -> Column:
    """Whether a shingle lies in the first seventh of a set. One of two sets has the first that they share there, if they pass the position test."""
    return (PART + WHOLE) * F.col(pos) <= (PART - WHOLE) * F.col(size)


def pivot_pairs(prefix: DataFrame) -> DataFrame:
    """(key, a, b, near): for each token that some set has in front, the set that has it furthest in front and each other one, and whether they pass the position test."""
    pivot = prefix.groupBy("token").agg(F.min(F.struct("pos", "n_shingles", "node")).alias("p"), F.count("*").alias("sets"), F.max(in_front("n_shingles", "pos")).alias("front")).where("sets > 1 and front")
    pivot = pivot.select("token", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("m"), F.col("p.pos").alias("i"))
    pairs = prefix.join(pivot, "token").where("node <> pivot")
    return pairs.select(F.col("token").alias("key"), F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), may_be_similar("m", "i", "n_shingles", "pos").alias("near"))


def open_pairs(prefix: DataFrame, keys: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that share one of keys(key) and pass the position test; one of the two has the key in front."""
    members = with_component(prefix.join(keys.select(F.col("key").alias("token")), "token", "left_semi"), parts)
    members = cut(members.withColumn("front", in_front("n_shingles", "pos")))
    left = members.where("front").select("token", F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("pos").alias("i"), F.col("component").alias("of_a"))
    right = members.select("token", F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("pos").alias("j"), F.col("component").alias("of_b"), "front")
    once = ~F.col("front") | (F.col("a") < F.col("b"))
    pairs = left.join(right, (left.token == right.token) & once & (F.col("of_a") != F.col("of_b")) & may_be_similar("m", "i", "n", "j"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def whole_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes): the hashes of each set."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column("text"), WIDTH)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, bounds)), sets], ["node", "hashes"])

    return docs.select("text").mapInArrow(found, "node long, hashes array<long>")


def verify(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """(a, b): the pairs that are similar. nodes: (node, id, n_shingles, sketch), id being that of one row of source(id, text)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("m")) + np.asarray(batch.column("n"))
            # similar: PART * i >= WHOLE * u, where u + i = total and u - i is the symmetric difference
            most = total * (PART - WHOLE) // (PART + WHOLE)
            close = [differ(x.as_buffer(), y.as_buffer()) <= d for x, y, d in zip(batch.column("x"), batch.column("y"), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("sketch").alias("y"))
    sized = pairs.join(left.drop("x"), "a").join(right.drop("y"), "b").where(PART * F.least("m", "n") >= WHOLE * F.greatest("m", "n")).select("a", "b")
    survivors = cut(sized.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(near, "a long, b long"))
    wanted = survivors.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("id")
    sets = cut(whole_sets(only(source, wanted)).dropDuplicates(["node"]))
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    # counted in the JVM row by row: Arrow's batches of pairs of whole sets would be as large as the texts are long
    shared = F.size(F.array_intersect("x", "y"))
    return cut(survivors.join(first, "a").join(second, "b").where(PART * shared >= WHOLE * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def only(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of source whose id is in wanted(id, ...), with wanted's other columns."""
    wanted = cut(wanted)
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return source.join(wanted, "id")


def with_component(nodes: DataFrame, parts: DataFrame, node: str = "node", name: str = "component") -> DataFrame:
    """nodes with the component of `node`; a node without links is its own."""
    return nodes.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def unsettled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node): the sets of the keys with sets of different components."""
    apart = with_component(with_component(rows, parts, "a", "of_a"), parts, "b", "of_b").where("of_a <> of_b").select("key").distinct()
    return rows.join(apart, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()


def central_pairs(members: DataFrame) -> DataFrame:
    """(key, a, b): for each key of members(key, node), the set that shares its keys with the most others, and each other one."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    pivot = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"))
    pairs = members.join(pivot, "key").where("node <> pivot")
    return pairs.select("key", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    nodes = cut(document_nodes(source))
    first = nodes.where("node <> 0 and id is not null").groupBy("node").agg(F.min_by(F.struct("id", "n_shingles", "sketch"), "id").alias("x"))
    first = cut(first.select("node", "x.*"))
    shingles = first.agg(F.sum("n_shingles")).first()[0] or 0
    prefix = cut(prefixes(only(source, first.select("id")), shingles))
    release(docs.sparkSession)
    rows = cut(pivot_pairs(prefix))
    tried = cut(rows.where("near").select("a", "b").distinct())
    links = verify(tried, first, source)
    release(docs.sparkSession)
    members = cut(unsettled(rows, connected_components(links)))
    second = cut(central_pairs(members))
    more = cut(second.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    links, tried = links.union(verify(more, first, source)), tried.union(more)
    parts = connected_components(links)
    release(docs.sparkSession)
    rest = open_pairs(prefix, unsettled(second, parts).select("key").distinct(), parts)
    links = links.union(verify(rest.join(tried, ["a", "b"], "left_anti"), first, source))
    parts = connected_components(links)
    release(docs.sparkSession)
    named = first.join(parts, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named = parts.join(named, "component").select("node", "component_id")
    classes = first.join(named, "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id"))
    joined = nodes.select("id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("node") != 0), F.col("node")).alias("node")).join(classes, "node", "left")
    return joined.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are similar to one kept: of each component the row with its smallest id stays."""
    keep = similar_documents(docs, id_column, text).where(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias("__keep")).distinct()
    kept = docs.where(F.col(id_column).isNotNull()).join(keep, F.col(id_column) == F.col("__keep"), "left_semi").dropDuplicates([id_column])
    return kept.unionByName(docs.where(F.col(id_column).isNull()))
