"""Prefix trie of conversations: double arrays per shard, shared upper nodes merged over all shards.

Conversations become sequences of 128-bit turn keys and are range-partitioned by
(sequence, conversation id), so a shard is a run of neighbours in that order and even
equal sequences part between shards.  A shard is one Arrow batch, cut further at
``SHARD_TURNS`` turns: its keys are numbered densely, its trie is packed level by
level into BASE and CHECK (the child of slot ``s`` under turn ``c`` is slot ``BASE[s] + c``,
where CHECK holds ``s``), and the sequences are walked through it for the nodes.

Only nodes on a shard's first or last sequence can also lie in another shard.  Those carry a chained
hash of their sequence and are merged: sums and minima by hash, child counts over
distinct hashes.  What a merged node adds to its ancestors is added along one
chain that holds it, the rest is summed inside the shards.

Defined cases: a null role or text counts as empty; turns are ordered by turn (null first), then role, then turn key;
rows without a conversation id belong to no conversation; repeated rows are turns of their own; a conversation
without turns ends at the root; an empty table gives no node; other columns are ignored.  A conversation's turns
must fit a row: 16 bytes of key and 8 of length each, the texts themselves do not travel.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.state import small_side
from scorelake.llm.common import col, stage

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_TURNS = 1 << 18  # turns a shard's arrays may hold, unless one conversation has more
WIDE = 8  # a family this many times wider than its children is fitted into free slots
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

NODES = pa.schema(
    [
        ("shard", pa.int64()), ("side", pa.int32()), ("id", pa.binary()), ("parent_id", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("text_bytes", pa.int64()), ("first_end", pa.int64()),
        ("ends", pa.string()), ("ends_sha256", pa.string()),
    ]
)
NODE_DDL = (
    "shard long, side int, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, text_bytes long, first_end long, ends string, ends_sha256 string"
)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` per conversation; a turn is ``(key, text_bytes)``, its key stands for role and text."""
    role = F.coalesce(col("role").cast("string"), F.lit(""))
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 32))
    turn = F.struct(col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("text_bytes"))
    listed = conversations.select(col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).filter("conv_id IS NOT NULL")
    ordered = listed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["text_bytes"].alias("text_bytes"))).alias("turns"))


class DoubleArray:
    """A trie over dense turn ids in two arrays; slot 0 is the root."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.width = int(codes.max(initial=0)) + 1
        size = len(codes) + self.width + 2
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.used = np.zeros(size, bool)
        self.used[0], self.top, self.holes = True, 1, np.zeros(0, np.int64)
        state, rows = np.zeros(len(starts), np.int64), np.arange(len(starts))
        depth = 0
        while len(rows := rows[lengths[rows] > depth]):
            pairs, place = np.unique(state[rows] * self.width + codes[starts[rows] + depth], return_inverse=True)
            state[rows] = self._place(pairs // self.width, pairs % self.width)[place]
            depth += 1

    def _reserve(self, size: int) -> None:
        if size > len(self.used):
            more = max(size, 2 * len(self.used)) - len(self.used)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Slots of the children of one level, given by ascending parent and code."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[first, len(parents)])
        slots = np.zeros(len(parents), np.int64)
        for at, n in zip(first[count > 1], count[count > 1]):
            own = codes[at : at + n]
            slots[at : at + n] = self._family(own - own[0])
        single = first[count == 1]
        self.holes = self.holes[~self.used[self.holes]]
        filled = min(len(single), len(self.holes))
        slots[single[:filled]], self.holes = self.holes[:filled], self.holes[filled:]
        self._reserve(self.top + len(single) - filled)
        slots[single[filled:]] = np.arange(self.top, self.top + len(single) - filled)
        self.top += len(single) - filled
        self.used[slots] = True
        self.check[slots] = parents
        self.base[parents[first]] = slots[first] - codes[first]
        return slots

    def _family(self, steps: np.ndarray) -> np.ndarray:
        """Free slots at these distances: the first that fit where the family is wide, the end otherwise."""
        span = int(steps[-1]) + 1
        self._reserve(self.top + span)
        start = self.top
        if span > WIDE * len(steps):
            fits = ~self.used[: self.top + 1]
            for step in steps[1:]:
                fits &= ~self.used[step : step + self.top + 1]
            start = int(np.argmax(fits))
        slots = start + steps
        self.used[slots] = True
        if start + span > self.top:
            fresh = np.arange(self.top, start + span)
            self.holes, self.top = np.concatenate([self.holes, fresh[~self.used[fresh]]]), start + span
        return slots

    def walk(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Depth by depth: the sequences that reach it and their slots."""
        state, rows, depth = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
        yield 0, rows, state[rows]
        while len(rows := rows[lengths[rows] > depth]):
            below = self.base[state[rows]] + codes[starts[rows] + depth]
            if not np.array_equal(self.check[below], state[rows]):
                raise ValueError("a sequence leaves the packed trie")
            state[rows] = below
            depth += 1
            yield depth, rows, below


def dense_codes(keys: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Numbers from 0 for 16-byte keys, by first appearance from the root down, so siblings get neighbouring numbers."""
    order = np.lexsort((depths, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = order[new]
    rank = np.empty(len(heads), np.int64)
    rank[np.lexsort((heads, depths[heads]))] = np.arange(len(heads))
    return rank[number]


def shard_nodes(shard: int, ids: np.ndarray, keys: np.ndarray, text_bytes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """All nodes of one shard whose sequences are sorted; rows with an ``id`` may lie in other shards too."""
    starts = np.cumsum(lengths) - lengths
    depths = np.arange(len(keys)) - np.repeat(starts, lengths)
    codes = dense_codes(keys, depths)
    trie = DoubleArray(codes, starts, lengths)
    n = trie.top
    depth, convs, size = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    smallest = np.full(n, np.iinfo(np.int64).max)
    end = np.zeros(len(ids), np.int64)
    paths = ([0], [0])  # slots of the first and of the last sequence
    for d, rows, slots in trie.walk(codes, starts, lengths):
        depth[slots], end[rows] = d, slots
        convs += np.bincount(slots, minlength=n)
        np.minimum.at(smallest, slots, ids[rows])
        if d:
            size[slots] = text_bytes[starts[rows] + d - 1]
            for side, row in ((0, 0), (1, len(ids) - 1)):
                if lengths[row] >= d:
                    paths[side].append(int(slots[0 if side == 0 else -1]))
    nodes = np.flatnonzero(depth >= 0)
    edge = np.zeros(n, bool)
    edge[paths[0]], edge[paths[1]] = True, True
    below = nodes[depth[nodes] > 0]
    parent = trie.check[:n].copy()
    children = np.bincount(parent[below], minlength=n)
    inner = np.bincount(parent[below[~edge[below]]], minlength=n)
    leaves = np.where((children == 0) & ~edge, 1, 0)
    saved = np.where(edge, 0, (convs - 1) * size)
    down = below[np.argsort(-depth[below], kind="stable")]
    for level in np.split(down, np.flatnonzero(np.diff(depth[down])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    order = np.lexsort((ids, end))
    cuts = np.flatnonzero(np.r_[True, np.diff(end[order]) != 0])
    texts = {int(end[order[a]]): (int(ids[order[a]]), ",".join(map(str, ids[order[a:b]].tolist()))) for a, b in zip(cuts, np.r_[cuts[1:], len(order)])}
    digest = lambda slot: hashlib.sha256(texts[slot][1].encode()).hexdigest() if slot in texts else EMPTY_SHA256

    names: dict[int, bytes] = {}
    rows = []
    for side, row in ((0, 0), (1, len(ids) - 1)):
        name, above = b"", None
        for d, slot in enumerate(paths[side]):
            name = hashlib.blake2b(name + (keys[starts[row] + d - 1].tobytes() if d else b""), digest_size=16).digest()
            new = slot not in names  # a node on both paths brings its sums once
            first_end, ends = texts.get(slot, (None, None)) if new else (None, None)
            counts = (convs[slot], inner[slot], leaves[slot], saved[slot]) if new else (0, 0, 0, 0)
            rows.append((shard, side, name, above, smallest[slot], d, None, *map(int, counts), size[slot], first_end, ends, None))
            names[slot], above = name, name
    own = nodes[~edge[nodes]]
    hung = edge[parent[own]]
    columns = [
        pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary()),
        pa.array([names[p] if h else None for p, h in zip(parent[own].tolist(), hung.tolist())], pa.binary()),
        pa.array(smallest[own]), pa.array(depth[own]), pa.array(smallest[parent[own]], mask=hung), pa.array(convs[own]),
        pa.array(children[own]), pa.array(leaves[own]), pa.array(saved[own]), pa.array(size[own]), pa.nulls(len(own), pa.int64()),
        pa.nulls(len(own), pa.string()), pa.array([digest(s) for s in own.tolist()], pa.string()),
    ]
    edges = [pa.array([r[i] for r in rows], NODES.types[i]) for i in range(len(NODES))]
    joined = [pa.concat_arrays([a.cast(t), b]) for a, b, t in zip(columns, edges, NODES.types)]
    return pa.RecordBatch.from_arrays(joined, schema=NODES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = np.diff(batch["turns"].offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        stops, start = np.cumsum(lengths), 0
        while start < len(lengths):
            before = stops[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(stops, before + SHARD_TURNS, side="right")))
            cut = batch.slice(start, stop - start)
            turns = cut["turns"].flatten()
            keys = np.frombuffer(b"".join(turns.field("key").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            sizes = turns.field("text_bytes").to_numpy(zero_copy_only=False).astype(np.int64)
            yield shard_nodes(number, cut["conv_id"].to_numpy(zero_copy_only=False), keys, sizes, lengths[start:stop])
            number, start = number + 1, stop


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each id, which follow one another in order."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    for batch in batches:
        for name, piece in zip(batch["id"], batch["ends"]):
            if (name := name.as_py()) != now:
                if state is not None:
                    yield row()
                now, state = name, hashlib.sha256(piece.as_py().encode())
            else:
                state.update(b"," + piece.as_py().encode())
    if state is not None:
        yield row()


def _merged(edges: DataFrame) -> DataFrame:
    """One row per node that several shards may hold, with what all of them know of it."""
    once = stage(
        edges.groupBy("id").agg(
            F.first("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"), F.first("text_bytes").alias("text_bytes"), F.min(F.struct("shard", "side")).alias("owner"),
        )
    )
    outer = once.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("outer"))
    full = once.join(outer, "id", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    own_leaf, own_saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("text_bytes")
    own = full.select("id", "owner", own_leaf.alias("own_leaf"), own_saved.alias("own_saved"))
    chain = edges.select("id", "depth", F.struct("shard", "side").alias("chain")).join(own, "id")
    mine = F.col("chain") == F.col("owner")  # a node is added along one of the chains that hold it
    up = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    shared = chain.select(
        "id", *[F.sum(F.when(mine, F.col(c)).otherwise(0)).over(up).alias(c) for c in ("own_leaf", "own_saved")]
    ).groupBy("id").agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved"))
    pieces = edges.filter("ends IS NOT NULL").select("id", "first_end", "ends")
    digests = pieces.repartition("id").sortWithinPartitions("id", "first_end").select("id", "ends").mapInArrow(_digests, "id binary, ends_sha256 string")
    return full.join(shared, "id").join(digests, "id", "left").select(
        "id", "parent_id", "conv_id", "depth", "n_convs", "n_children", (F.col("leaves") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("own_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of ``(conv_id, turns)`` as of :func:`turn_sequences`, one row per node, the root included.

    ``conv_id`` is the smallest member and with ``depth`` names the node; ``n_convs`` counts members, ``n_leaves``
    childless nodes of the subtree, ``saved_tokens`` sums (members - 1) x bytes of the last text over the subtree, and
    ``ends_sha256`` digests the ids that end at the node.
    """
    order = [F.col("turns"), F.col("conv_id")]
    dealt = sequences.select("conv_id", "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = stage(dealt.mapInArrow(_shards, NODE_DDL))
    merged = stage(_merged(nodes.filter("id IS NOT NULL")))
    names = small_side(merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("above")))
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = merged.join(names, "parent_id", "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *counts)
    inner = nodes.filter("id IS NULL").join(names, "parent_id", "left")
    inner = inner.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *counts)
    return upper.union(inner)
