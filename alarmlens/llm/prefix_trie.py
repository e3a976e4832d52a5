"""Prefix trie of conversations over a minimal-perfect-hash node table.

A node is a distinct sequence of first turns. It is named by a digest that adds up over the turns, so a turn's row knows its
node and its parent without looking at other rows, and a conversation of any length needs no task of its own.

1. Turns get their places; conversations are rebuilt; running sums of the turns' hashes name the prefixes.
2. Equal prefixes collapse to nodes (members, smallest member, rows below). Nodes that differ in their last turn or
   parent though their digests are equal stop the job.
3. Nodes with one member form tails that end in a leaf; their counts are known. Shared nodes are accumulated in shards: a shard
   is the subtree of a node with at most ``shard_rows`` rows below it, under a node with more. In a shard every digest gets its slot by a minimal
   perfect hash, checked against the digest kept there; counts are scattered into flat arrays and added
   along parent slots, deepest nodes first.
4. The crown, nodes with more rows below, takes the totals of the shards hung below it and is added up in the same way.

So a first turn that a third of all conversations share is a crown node that receives sums, not its members.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alarmlens.operators.ranking import global_row_number
from alarmlens.runtime import materialize

GROUP = 5  # conversations that share a first member
HEADS = 9  # so many different numbers of first turns are taken over
SEGMENT = 1024
SHARD_ROWS = 100_000
BLOCK_NODES = 1 << 16
CROWN_NODES = 1_000_000
ENDS_CHUNK = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SUMS = ("s0", "s1", "s2", "s3")
_NODE = "hi long, lo long, p_hi long, p_lo long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def _mixed(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    x = (hi.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31)) ^ lo.view(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class MinimalPerfectHash:
    """Slots 0 .. n-1 for n distinct pairs of longs, by levels: at each level keys that hash to a place of their own
    keep it, the others go on to the next; a key's slot is the rank of its place. The keys stand at their slots, so a
    pair that is no key gets -1."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, spread: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # taken, rank of the places before
        left = np.arange(len(hi))
        ranked = [np.zeros(0, np.int64)]
        base = 0
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("two nodes have the same digest")
            size = int(len(left) * spread) + 1
            place = (_mixed(hi[left], lo[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            self.levels.append((taken, base + np.cumsum(taken) - taken))
            alone = taken[place]
            keys = left[alone]
            ranked.append(keys[np.argsort(place[alone])])
            base += len(keys)
            left = left[~alone]
        at = np.concatenate(ranked)
        self.hi, self.lo = hi[at], lo[at]

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (taken, rank) in enumerate(self.levels):
            place = (_mixed(hi[left], lo[left], level) % np.uint64(len(taken))).astype(np.int64)
            met = taken[place]
            slot[left[met]] = rank[place[met]]
            left = left[~met]
        found = slot >= 0
        found[found] = (self.hi[slot[found]] == hi[found]) & (self.lo[slot[found]] == lo[found])
        return np.where(found, slot, -1)


def accumulate(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved tokens of each node of one or more whole subtrees.

    ``nodes``: hi, lo, p_hi, p_lo, depth, conv_id, n_convs, size, and kids, leaves, saved from below that are already known.
    """
    table = MinimalPerfectHash(nodes["hi"], nodes["lo"])
    slot = table.slots(nodes["hi"], nodes["lo"])
    n = len(slot)
    flat = {}
    for name, values in nodes.items():
        flat[name] = np.empty(n, np.int64)
        flat[name][slot] = values
    parent = table.slots(flat["p_hi"], flat["p_lo"])
    parent[flat["depth"] == 0] = -1
    inner = parent >= 0
    children = flat["kids"]
    np.add.at(children, parent[inner], 1)
    leaves = np.where(children == 0, 1, flat["leaves"])
    saved = flat["saved"] + (flat["n_convs"] - 1) * flat["size"]
    deepest_first = np.argsort(-flat["depth"], kind="stable")
    levels = np.flatnonzero(np.diff(flat["depth"][deepest_first])) + 1
    for own in np.split(deepest_first, levels):
        own = own[inner[own]]
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])
    names = ("hi", "lo", "p_hi", "p_lo", "depth", "conv_id", "n_convs")
    of_parent = np.where(inner, flat["conv_id"][parent], 0)
    return {k: flat[k] for k in names} | {
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "parent_conv_id": of_parent, "inner": inner,
    }


_INPUT = ("hi", "lo", "p_hi", "p_lo", "depth", "conv_id", "n_convs", "size", "kids", "leaves", "saved")


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard; whole shards are solved together up to ``BLOCK_NODES`` nodes and one more shard."""

    def solved(parts: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(parts, axis=1)
        made = accumulate(dict(zip(_INPUT, columns)))
        names = [c.split()[0] for c in _NODE.split(", ")]
        outer = ~made.pop("inner")
        arrays = [pa.array(made[c], pa.int64(), mask=outer if c == "parent_conv_id" else None) for c in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    held, count, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.array([batch.column(i).to_numpy() for i in range(len(_INPUT))])
        shard = np.array([batch.column(len(_INPUT) + i).to_numpy() for i in range(2)])
        starts = np.flatnonzero((shard[:, 1:] != shard[:, :-1]).any(axis=0)) + 1
        if last is not None and (shard[:, 0] != last).any():
            starts = np.concatenate(([0], starts))
        at = 0
        for start in starts.tolist():
            if count + start - at >= BLOCK_NODES:
                held.append(rows[:, at:start])
                yield solved(held)
                held, count, at = [], 0, start
        held.append(rows[:, at:])
        count += rows.shape[1] - at
        last = shard[:, -1]
    if count:
        yield solved(held)


def _prefix_names(prefix: str, sums: list[Column], depth: Column) -> list[Column]:
    """Two longs that name the prefix of ``depth`` turns with these sums."""
    return [F.xxhash64(*sums, depth).alias(f"{prefix}hi"), F.xxhash64(F.lit(7), depth, *reversed(sums)).alias(f"{prefix}lo")]


def rebuilt_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, turn, size)`` of the rebuilt conversations, ``turn`` a digest of role and text, and ``(conv_id, length)``."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("at"), text(role_col).alias("role"), text(text_col).alias("text")
    ).filter("conv_id is not null")
    placed = global_row_number(turns, ["conv_id"], [F.col("at").asc_nulls_first(), "role", "text"], "pos")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    placed = placed.select("conv_id", "pos", digest.alias("turn"), F.octet_length("text").cast("long").alias("size"))
    placed = materialize(placed, "turns")
    counts = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = counts.select("conv_id", "n", heads.alias("h"), base.alias("base"))
    of_base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    length = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")
    convs = materialize(convs.select("conv_id", "base", "h", "taken", length), "conversations")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).cast("long").alias("depth"), "turn", "size")
    first = placed.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("conv_id", "base", "h"), "base").filter("pos <= h")
    first = first.select("conv_id", F.col("pos").cast("long").alias("depth"), "turn", "size")
    return own.unionByName(first), convs.select("conv_id", "length")


def _prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and depth, 0 included: names of the prefix and of its parent, digest and size of its last turn."""
    marks = [F.xxhash64("turn", "depth"), F.xxhash64("depth", "turn")]
    halves = [part for m in marks for part in (m.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(m, 32))]
    marked = rows.select("*", (F.shiftright("depth", SEGMENT.bit_length() - 1)).alias("seg"), *[h.alias(f"x{i}") for i, h in enumerate(halves)])
    # Running sums inside segments of fixed length, on top of the sums of the segments before.
    within = W.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    running = marked.select("*", *[F.sum(f"x{i}").over(within).alias(s) for i, s in enumerate(_SUMS)])
    segments = marked.groupBy("conv_id", "seg").agg(*[F.sum(f"x{i}").alias(f"t{i}") for i in range(4)])
    earlier = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    before = segments.select("conv_id", "seg", *[F.coalesce(F.sum(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in range(4)])
    summed = running.join(before, ["conv_id", "seg"]).join(lengths, "conv_id")
    sums = [F.col(s) + F.col(f"b{i}") for i, s in enumerate(_SUMS)]
    less = [total - F.col(f"x{i}") for i, total in enumerate(sums)]
    inner = summed.select(
        "conv_id", "length", "depth", *_prefix_names("", sums, F.col("depth")), *_prefix_names("p_", less, F.col("depth") - 1), "turn", "size"
    )
    zero = F.lit(0).cast("long")
    top = lengths.select(
        "conv_id", "length", zero.alias("depth"), *_prefix_names("", [zero] * 4, zero), zero.alias("p_hi"), zero.alias("p_lo"),
        F.lit(b"").alias("turn"), zero.alias("size"),
    )
    return inner.unionByName(top)


def _nodes(prefixes: DataFrame) -> DataFrame:
    same = [F.min(c) == F.max(c) for c in ("turn", "p_hi", "p_lo", "size")]
    verified = same[0] & same[1] & same[2] & same[3]
    found = prefixes.groupBy("hi", "lo", "depth").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p_hi").alias("p_hi"), F.min("p_lo").alias("p_lo"),
        F.min("size").alias("size"), F.max("length").alias("length"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
        verified.alias("verified"),
    )
    checked = F.when(F.col("verified"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return found.withColumn("n_convs", checked).drop("verified")


def _crown(crown: DataFrame, crown_nodes: int) -> DataFrame:
    """The crown's rows with its own totals: in one task while it has at most ``crown_nodes`` nodes, else one level at a time."""
    if crown.count() <= crown_nodes:
        whole = crown.select(*_INPUT, F.lit(0).cast("long").alias("shard_hi"), F.lit(0).cast("long").alias("shard_lo"))
        return whole.repartition(1).mapInArrow(_in_shards, _NODE)
    key = ["hi", "lo"]
    deepest = crown.agg(F.max("depth")).first()[0]
    done, up = None, crown.select("hi", "lo", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("s")).limit(0)
    for depth in range(deepest, -1, -1):
        level = crown.filter(F.col("depth") == depth).join(up, key, "left")
        kids = F.col("kids") + F.coalesce("k", F.lit(0))
        leaves = F.when(kids == 0, 1).otherwise(F.col("leaves") + F.coalesce("l", F.lit(0)))
        saved = F.col("saved") + F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")
        level = level.select(*key, "p_hi", "p_lo", "depth", "conv_id", "n_convs", kids.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"))
        level = materialize(level, "crown_level")
        up = level.groupBy(F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(
            F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
        )
        done = level if done is None else done.unionByName(level)
    parents = crown.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    return done.join(parents, ["p_hi", "p_lo"], "left").select(*[c.split()[0] for c in _NODE.split(", ")])


def _ends(prefixes: DataFrame) -> DataFrame:
    """``(hi, lo, ends_sha256)``: digest of the ids of the conversations that end at a node. Ids become text in sorted pieces
    first, so the task that hashes a node's ids reads a row for some thousands of them, one after another."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, conv = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            starts = sorted({0, *edges.tolist(), *range(0, len(hi), ENDS_CHUNK)})
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(hi)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[starts]), pa.array(lo[starts]), pa.array(conv[starts]), pa.array(text, pa.string())], names=["hi", "lo", "first", "ids"]
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (hi, lo) == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (hi, lo), hashlib.sha256()
                digest.update(ids.encode())
            yield named(out)
        if key:
            yield named([(*key, digest.hexdigest())])

    def named(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], [], []]
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["hi", "lo", "ends_sha256"])

    ends = prefixes.filter("depth = length").select("hi", "lo", "conv_id").repartitionByRange("hi", "lo", "conv_id")
    parts = ends.sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(pieces, "hi long, lo long, first long, ids string")
    dealt = parts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first")
    return dealt.mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
    crown_nodes: int = CROWN_NODES,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by role, then text; repeated rows are turns of their own. Null roles and
    texts count as empty. Rows without a conversation id belong to none and are left out. A table without conversations
    has no node.
    """
    rows, lengths = rebuilt_turns(conversations, conv_col, turn_col, role_col, text_col)
    prefixes = materialize(_prefixes(rows, lengths), "prefixes")
    nodes = materialize(_nodes(prefixes), "nodes")
    zero = F.lit(0).cast("long")

    # Tails: nodes with one member. The top of a tail hangs below a shared node, unless it is the root.
    tails = nodes.filter("n_convs = 1")
    tops = tails.groupBy("conv_id").agg(F.min(F.struct("depth", "p_hi", "p_lo")).alias("top")).select("conv_id", "top.*")
    tops = materialize(tops, "tails")
    hung = tops.filter("depth > 0").groupBy(F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(F.count(F.lit(1)).alias("tails"))
    shared = nodes.filter("n_convs > 1").join(hung, ["hi", "lo"], "left").withColumn("tails", F.coalesce("tails", zero))
    shared = materialize(shared, "shared_nodes")

    # A shard's top is the first node of a conversation's path below the crown.
    crowned = F.col("below") > shard_rows
    heavy = materialize(shared.filter(crowned).select("hi", "lo"), "crown_names")
    light = shared.filter(~crowned)
    own_shared = light.select("conv_id").distinct()  # a shared node's smallest member stands for its path
    reached = prefixes.join(heavy, ["hi", "lo"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("crowned"))
    paths = prefixes.join(own_shared, "conv_id", "left_semi").select("conv_id", "depth", F.col("hi").alias("shard_hi"), F.col("lo").alias("shard_lo"))
    of_conv = paths.join(reached, "conv_id", "left").filter(F.col("depth") == F.coalesce("crowned", F.lit(-1)) + 1)
    dealt = light.join(of_conv.select("conv_id", "shard_hi", "shard_lo"), "conv_id")
    dealt = dealt.withColumns({"kids": F.col("tails"), "leaves": F.col("tails"), "saved": zero}).select(*_INPUT, "shard_hi", "shard_lo")
    dealt = dealt.repartition("shard_hi", "shard_lo").sortWithinPartitions("shard_hi", "shard_lo")
    solved = materialize(dealt.mapInArrow(_in_shards, _NODE), "shards")

    # Totals of the shards go up to the crown.
    loose = solved.filter("parent_conv_id is null and depth > 0")
    below = loose.groupBy(F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
    )
    crown = shared.filter(crowned).join(below, ["hi", "lo"], "left").withColumns(
        {
            "kids": F.col("tails") + F.coalesce("k", zero),
            "leaves": F.col("tails") + F.coalesce("l", zero),
            "saved": F.coalesce("s", zero),
        }
    )
    crown = materialize(_crown(materialize(crown.select(*_INPUT), "crown_input"), crown_nodes), "crown")

    # Parents of shards' and tails' tops are known by now.
    names = ["hi", "lo", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parents = shared.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    inside = solved.filter("parent_conv_id is not null or depth = 0").unionByName(crown).select(*names, "parent_conv_id")
    outer = loose.drop("parent_conv_id").join(parents, ["p_hi", "p_lo"]).select(*names, "parent_conv_id")
    single = tails.withColumns(
        {"n_children": (F.col("depth") < F.col("length")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero}
    )
    first = tops.join(parents, ["p_hi", "p_lo"], "left").select("conv_id", F.col("depth").alias("first"), "parent_conv_id")
    single = single.join(first, "conv_id").select(
        *names, F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    )
    every = inside.unionByName(outer).unionByName(single)
    return every.join(_ends(prefixes), ["hi", "lo"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
