"""The tree of shared beginnings of conversations.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it. The
member with the smallest id owns it. Whoever owns a node owns the longer ones on its way too, so that each
conversation owns a chain: its nodes from a first owned depth to its last turn.

1. Turns are numbered, and every beginning gets a digest (an exclusive or of 128 bits over turn digests hashed with their
   numbers): running values over rows sorted by ranges (`running`), so that one conversation's turns may lie in many tasks.
2. One aggregation gives each digest's smallest id (the minima), its number of members and bytes.
3. Each conversation's first owned depth by binary search: a round joins the digests at all middle depths with the
   minima and keeps the turns of the half that is left, so all rounds together move little more than the turns twice.
   The last probe that failed names the owner of the parent node.
4. The chains form a tree. Leaves and saved tokens are summed up from below: in round k each chain's sum goes to its
   2^k-th ancestor, so that a tree of height h takes log h rounds; running sums along the chains do the rest.
5. The list of ids that end at a node is sorted by ranges and joined to blocks in parallel; only the SHA-256 over a
   node's blocks, which cannot be split, is one stream, in constant memory.

Defined cases: rows without conv_id are left out; null roles and texts are empty; a null turn comes first, equal turns of
a conversation are ordered by the digest of role and text; repeated turns are turns; conversations without turns (given by `ids`)
are members of the root; very long texts are digested where they are read; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, release

#: Bytes of a block of ids.
BLOCK = 1 << 20
#: Conversations in search up to which their probes are broadcast.
PROBES = 100_000


def running(rows: DataFrame, key: str, order: list[str | Column], sums: dict[str, str], xors: dict[str, str] | None = None) -> DataFrame:
    """rows with running sums and exclusive ors of long columns in `order` within each key; {column: name of the result}.

    Rows are dealt by ranges, so a key may lie in many partitions. Each partition's running values go into the stored
    rows; one small row a partition then carries them over to the following ones.
    """
    both = {**{c: (n, "sum") for c, n in sums.items()}, **{c: (n, "xor") for c, n in (xors or {}).items()}}
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", `{n}` long" for n, _ in both.values()) + ", __part int, __head boolean, __end boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = held = None
        carry = dict.fromkeys(both, np.int64(0))

        def out(batch: pa.RecordBatch, extra: list, end: bool) -> pa.RecordBatch:
            n = batch.num_rows
            ends = np.zeros(n, bool)
            ends[-1] = end
            return pa.RecordBatch.from_arrays([*batch.columns, *extra, pa.array(np.full(n, part, np.int32)), pa.array(batch.column(key).to_numpy() == first), pa.array(ends)], [*names, *(n for n, _ in both.values()), "__part", "__head", "__end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = keys[0] if first is None else first
            begins = np.ones(len(keys), bool)
            begins[1:] = keys[1:] != keys[:-1]
            segment = np.cumsum(begins) - 1
            starts = np.flatnonzero(begins)
            extra = []
            for c, (_, how) in both.items():
                values = batch.column(c).to_numpy()
                add = np.add if how == "sum" else np.bitwise_xor
                total = add.accumulate(values)
                before = np.concatenate([[0], total[starts[1:] - 1]]).astype(np.int64)
                if keys[0] == last:
                    before[0] = -carry[c] if how == "sum" else carry[c]
                result = total - before[segment] if how == "sum" else total ^ before[segment]
                carry[c] = result[-1]
                extra.append(pa.array(result))
            last = keys[-1]
            if held is not None:
                yield out(*held, False)
            held = (batch, extra)
        if held is not None:
            yield out(*held, True)

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    stored = cut(dealt.mapInArrow(local, schema))
    so_far = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.sum if how == "sum" else F.bit_xor)(n).over(so_far).alias(n) for n, how in both.values()]
    parts = stored.where("__end").select("__part", key, *totals)
    lagged = [F.lag(c).over(Window.orderBy("__part")).alias(f"__{c}") for c in (key, *(n for n, _ in both.values()))]
    carried = stored.join(F.broadcast(parts.select("__part", *lagged)), "__part")
    same = F.col("__head") & F.coalesce(F.col(key) == F.col(f"__{key}"), F.lit(False))
    values = [F.when(same, F.col(n) + F.col(f"__{n}") if how == "sum" else F.col(n).bitwiseXOR(F.col(f"__{n}"))).otherwise(F.col(n)).alias(n) for n, how in both.values()]
    return carried.select(*names, *values)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns of conversations(conv_id, turn, role, text), numbered from 1."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"))
    return running(turns, "conv_id", ["turn", "digest"], {"one": "pos"}).select("conv_id", "pos", "digest", "n_bytes")


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, n_bytes): the digest (x, y) of every beginning, from turns(conv_id, pos, digest, n_bytes)."""
    lanes = {f"d{k}": F.xxhash64(F.substring("digest", 1 + 8 * k, 8), F.col("pos")) for k in (0, 1)}
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "n_bytes", *(v.alias(k) for k, v in lanes.items()))
    return running(rows, "conv_id", ["depth"], {}, {"d0": "x", "d1": "y"}).drop("d0", "d1")


def first_owned(starts: DataFrame, minima: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, n, first, above): the first depth that a conversation of n turns owns (n + 1: none), and the owner of the node before it (null: the root)."""
    alive = starts.select("conv_id", "depth", "x", "y").join(lengths.select("conv_id", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high"), F.lit(None).cast("long").alias("above")), "conv_id")
    alive = cut(alive)
    keys = ["depth", "x", "y"]
    done = []
    while n := alive.select("conv_id").where(F.col("depth") == F.floor((F.col("low") + F.col("high")) / 2)).count():
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        probes = alive.where(F.col("depth") == middle)
        met = minima.join(F.broadcast(probes) if n <= PROBES else probes, keys)
        owned = F.col("owner") == F.col("conv_id")
        state = cut(met.select("conv_id", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above")))
        done.append(state.where("low = high").select("conv_id", F.col("low").alias("first"), "above"))
        rest = state.where("low < high")
        alive = cut(alive.select("conv_id", *keys).join(F.broadcast(rest) if n <= PROBES else rest, "conv_id").where("depth >= low and depth < high"))
        release(starts.sparkSession)
    found = lengths.withColumns({"first": F.lit(1).cast("long"), "above": F.lit(None).cast("long")}).where("n = 0").select("conv_id", "first", "above")
    for d in done:
        found = found.unionByName(d)
    return cut(found.join(lengths, "conv_id").select("conv_id", "n", "first", "above"))


def summed_upwards(chains: DataFrame, root: int) -> DataFrame:
    """chains(conv_id, parent, leaves, saved) with the sums over all chains below added; parent is null for the root's."""
    state = cut(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"))
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = state.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = state.join(below, "conv_id", "left").select("conv_id", F.when(F.col("up") != root, F.col("up")).alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        waiting = moved.where("up is not null").join(higher, "up", "left").select("conv_id", F.col("next").alias("up"), "leaves", "saved")
        state = cut(waiting.unionByName(moved.where("up is null")))
    return state.drop("up")


def ends_digest(ends: DataFrame, most: int = BLOCK) -> DataFrame:
    """(conv_id, depth, ends_sha256): of the comma-joined members of each node, from ends(conv_id, depth, member)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, parts, size, rows = None, 0, [], 0, []

        def close() -> None:
            if parts:
                rows.append((*node, first, b",".join(parts)))
                parts.clear()

        for batch in batches:
            for c, d, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (c, d) != node or size > most:
                    close()
                    node, first, size = (c, d), m, 0
                parts.append(b"%d" % m)
                size += len(parts[-1]) + 1
            if len(rows) > 5000 or sum(len(r[3]) for r in rows) > most:
                yield table(rows, pa.binary(), ["conv_id", "depth", "first", "block"])
                rows.clear()
        close()
        if rows:
            yield table(rows, pa.binary(), ["conv_id", "depth", "first", "block"])

    def table(rows: list[tuple], last: pa.DataType, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], last)], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, rows = None, None, []
        for batch in batches:
            for c, d, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (c, d) != node:
                    if node:
                        rows.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(block.as_py())
            if len(rows) > 5000:
                yield table(rows, pa.string(), ["conv_id", "depth", "ends_sha256"])
                rows = []
        if node:
            rows.append((*node, state.hexdigest()))
            yield table(rows, pa.string(), ["conv_id", "depth", "ends_sha256"])

    order = ["conv_id", "depth", "member"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "conv_id long, depth long, first long, block binary")
    return joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_tree(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each node (NODES) of turns(conv_id, pos, digest, n_bytes), pos from 1 without gaps.

    ids(conv_id): all conversations, those without turns too; by default those of turns. A node is named by its owner and depth.
    """
    spark = turns.sparkSession
    starts = cut(beginnings(turns))
    counted = starts.groupBy("conv_id").agg(F.max("depth").alias("n"))
    if ids is not None:
        counted = counted.unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("n"))).groupBy("conv_id").agg(F.max("n").alias("n"))
    lengths = cut(counted)
    top = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if not top.n:
        return spark.createDataFrame([], NODES)
    root = top.root
    minima = cut(starts.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes")))
    search = first_owned(starts, minima, lengths)
    at_root = F.lit(root).cast("long")
    is_root = F.col("conv_id") == at_root
    # where a chain hangs, and where a conversation ends that owns nothing
    hung = search.select("conv_id", "n", "first", F.coalesce("above", at_root).alias("above"), (F.col("first") - 1).alias("depth"))
    chains = hung.where((F.col("first") <= F.col("n")) & ~is_root)
    ends = hung.select(F.when((F.col("first") <= F.col("n")) | is_root, F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "n_bytes").unionByName(
        spark.createDataFrame([(root, 0, top.n, 0)], "conv_id long, depth long, n_convs long, n_bytes long"))
    # own sums of each chain: a leaf where no other chain hangs at its last node
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    own = nodes.groupBy("conv_id").agg(F.sum(saved).alias("saved"), F.max("depth").alias("depth"))
    kids = chains.groupBy(F.col("above").alias("conv_id"), "depth").agg(F.count("*").alias("kids"))
    own = own.join(kids, ["conv_id", "depth"], "left").select("conv_id", "saved", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    linked = own.join(chains.select("conv_id", F.col("above").alias("parent")), "conv_id", "left")
    sums = summed_upwards(linked, root)
    # what hangs at each node, the last nodes and the first nodes of chains, and the digests of those who end there
    zero = lambda c, t="long": F.lit(None).cast(t).alias(c)
    below = chains.join(sums, "conv_id").groupBy(F.col("above").alias("conv_id"), "depth").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = below.select("conv_id", "depth", "kids", "leaves", "saved", zero("parent"), zero("last", "boolean"), zero("ends_sha256", "string"))
    heads = chains.select("conv_id", F.col("first").alias("depth"), zero("kids"), zero("leaves"), zero("saved"), F.col("above").alias("parent"), zero("last", "boolean"), zero("ends_sha256", "string"))
    tails = hung.where((F.col("first") <= F.col("n")) | is_root).select("conv_id", F.col("n").alias("depth"), zero("kids"), zero("leaves"), zero("saved"), zero("parent"), F.lit(True).alias("last"), zero("ends_sha256", "string"))
    listed = ends_digest(ends).select("conv_id", "depth", zero("kids"), zero("leaves"), zero("saved"), zero("parent"), zero("last", "boolean"), "ends_sha256")
    notes = below.unionByName(heads).unionByName(tails).unionByName(listed).groupBy("conv_id", "depth").agg(*(F.max(c).alias(c) for c in ("kids", "leaves", "saved", "parent", "last", "ends_sha256")))
    kids_, last = F.coalesce("kids", F.lit(0)), F.coalesce("last", F.lit(False))
    rows = nodes.join(notes, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", (-F.col("depth")).alias("up"), F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", (kids_ + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + F.when(last & (kids_ == 0), 1).otherwise(0)).cast("long").alias("leaves"), (F.coalesce("saved", F.lit(0)) + saved).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    return running(rows, "conv_id", ["up"], {"leaves": "n_leaves", "saved": "saved_tokens"}).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """prefix_tree() of conversations(conv_id, turn, role, text) as they are."""
    return prefix_tree(cut(numbered(conversations)))


def branched(turns: DataFrame, every: int = 5, depths: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) in which conversation c begins with the first h turns of c - c % every and goes on with its own after the first h; h is the CRC-32 of c, modulo `depths`."""
    size = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % depths
    base = F.col("conv_id") - F.col("conv_id") % every
    found = size.select("conv_id", base.alias("base"), h.alias("h")).join(size.select(F.col("conv_id").alias("base"), F.col("size").alias("there")), "base", "left")
    found = cut(found.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).cast("long").alias("taken")))
    rest = turns.join(found, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes")
    heads = turns.where((F.col("pos") < depths) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    shared = heads.join(found.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", "pos", "digest", "n_bytes")
    return rest.unionByName(shared), found.select("conv_id")


def branched_tree(conversations: DataFrame) -> DataFrame:
    """prefix_tree() of the conversations as branched() makes them."""
    turns, ids = branched(cut(numbered(conversations)))
    return prefix_tree(turns, ids)


#: branched_tree() of conversations, as DuckDB SQL.
ORACLE = r"""
WITH bits AS (SELECT [0::BIGINT, 0, 0, 0, 0, 0, 0, 0] AS eight),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda crc, b: list_reduce([xor(crc, b)] || eight, lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM turns, bits),
built AS (SELECT i.conv_id, 0 AS part, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h UNION ALL SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
rows_ AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, md5(strlen(role) || ':' || role || text) AS d, strlen(text) AS n_bytes FROM built),
starts AS (SELECT conv_id, depth, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, n_bytes, max(depth) OVER (PARTITION BY conv_id) AS n FROM rows_ UNION ALL SELECT conv_id, 0, '', 0, coalesce((SELECT max(depth) FROM rows_ r WHERE r.conv_id = i.conv_id), 0) FROM ids i),
nodes AS (SELECT depth, key, min(conv_id) AS owner, count(*) AS n_convs, min(n_bytes) AS n_bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '') AS ends FROM starts GROUP BY depth, key),
edges AS (SELECT n.depth, n.key, n.owner, p.owner AS parent, p.key AS parent_key FROM nodes n JOIN starts s ON s.conv_id = n.owner AND s.depth = n.depth - 1 JOIN nodes p ON p.depth = s.depth AND p.key = s.key),
kids AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM edges GROUP BY ALL),
sums AS (SELECT a.depth, a.key, sum((k.n_children IS NULL)::INT) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes) AS saved FROM nodes b LEFT JOIN kids k ON k.depth = b.depth AND k.key = b.key JOIN starts a ON a.conv_id = b.owner AND a.depth <= b.depth GROUP BY a.depth, a.key)
SELECT n.owner AS conv_id, n.depth::BIGINT AS depth, e.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN edges e ON e.depth = n.depth AND e.key = n.key LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key JOIN sums s ON s.depth = n.depth AND s.key = n.key
"""
