"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is four segments of 16 bits on a ring. If two fingerprints differ in at most three bits, there
is a segment from which every chain of 1, 2, 3, 4 consecutive segments holds at most 3/4 of a bit per segment:
0, 1, 2 and 3 differing bits. So only pairs meet that agree in a whole segment and differ in at most one bit of
the next one: the chain's first two segments are the join key, written once as they are and once for each
clear bit of the second segment as if it were set (of two segments that differ in one bit, one has it clear).
Pairs that meet pass the longer chains before the full Hamming check.

Where very many different fingerprints share a key, that key is replaced by the chain of three segments with
all its permitted differences; 16 free bits are left, so no group is larger than 65,536. Inside a group only a spanning
forest of the links is emitted, never all pairs. Equal fingerprints are one node from the start.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.components import components
from alarmlens.llm.tables import id_and_text, in_slices, text_sha256
from alarmlens.runtime import is_empty, materialize

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
DISTANCE = 3
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
GROUP_LIMIT = 4096
_MASK = (1 << WIDTH) - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles; A-Z lower-cased, words split at blanks, tabs and line ends. No words: 0."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    size = min(shingle, len(words))
    spans = zip(starts, ends[size - 1 :])
    total = len(words) - size + 1
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, CHUNK):
        count = min(CHUNK, total - at)
        values = np.fromiter((hashed(joined[a:b], SEED) for (a, b), _ in zip(spans, range(count))), np.uint64, count) if total > CHUNK else np.fromiter(
            (hashed(joined[a:b], SEED) for a, b in spans), np.uint64, count
        )
        bits = np.unpackbits(values.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digests: bool = False) -> DataFrame:
    """``(id, fp)``, with ``digests`` also text_sha256; fp is the unsigned fingerprint in a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *more]
            )

    source = id_and_text(docs, id_col, text_col)
    more = ["text_sha256"] if digests else []
    if digests:
        source = source.select("id", "text", text_sha256("text"))
    return source.mapInArrow(run, "id long, fp long" + "".join(f", {name} string" for name in more))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(WIDTH * (i % SEGMENTS))) & np.uint64(_MASK)


def _two_chain(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint index, probe) of the chains of two segments."""
    keys, rows, probes = [], [], []
    index = np.arange(len(fp))
    for i in range(SEGMENTS):
        first, second = _segment(fp, i), _segment(fp, i + 1)
        base = np.uint64(i) << np.uint64(2 * WIDTH) | first << np.uint64(WIDTH)
        keys.append(base | second)
        rows.append(index)
        probes.append(np.zeros(len(fp), bool))
        for bit in range(WIDTH):
            flag = np.uint64(1 << bit)
            clear = np.flatnonzero(second & flag == 0)
            keys.append(base[clear] | second[clear] | flag)
            rows.append(clear)
            probes.append(np.ones(len(clear), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)


_ONE = [1 << b for b in range(WIDTH)]
_TWO = [1 << a | 1 << b for a in range(WIDTH) for b in range(a)]


def _three_chain(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint index, probe, key of two segments) of the chains of three segments: at most one
    differing bit in the second and two in the second and third together."""
    flips = [(0, x) for x in (0, *_ONE, *_TWO)] + [(a, x) for a in _ONE for x in (0, *_ONE)]
    keys, rows, probes, shorter = [], [], [], []
    index = np.arange(len(fp))
    for i in range(SEGMENTS):
        first, second, third = (_segment(fp, i + k) for k in range(3))
        start = np.uint64(i) << np.uint64(2 * WIDTH) | first << np.uint64(WIDTH)
        for a, b in flips:
            two = start | second ^ np.uint64(a)
            keys.append(two << np.uint64(WIDTH) | third ^ np.uint64(b))
            shorter.append(two)
            rows.append(index)
            probes.append(np.full(len(fp), bool(a or b)))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes), np.concatenate(shorter)


def _near(one: np.uint64, many: np.ndarray, start: int) -> np.ndarray:
    """Which of ``many`` link with ``one``: chains from segment ``start`` within budget, then all bits."""
    differing = one ^ many
    total = np.zeros(len(many), np.uint8)
    ok = np.ones(len(many), bool)
    for length in range(1, SEGMENTS + 1):
        total += np.bitwise_count(_segment(differing, start + length - 1))
        ok &= total * SEGMENTS <= length * DISTANCE
    return ok


def _forest(own: np.ndarray, probes: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of one group: a spanning forest of ``own``, and of each probe one link to every tree it touches."""
    links: list[tuple[int, int]] = []
    own = np.unique(own)
    tree = np.arange(len(own))
    left = np.arange(len(own))
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        if len(left):
            near = _near(own[at], own[left], start)
            for j in left[near].tolist():
                tree[j] = tree[at]
                links.append((own[at], own[j]))
                queue.append(j)
            left = left[~near]
    for probe in np.unique(probes):
        met = np.flatnonzero(_near(probe, own, start))
        if len(met):
            _, firsts = np.unique(tree[met], return_index=True)
            links += [(probe, own[j]) for j in met[firsts].tolist()]
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (key, probe): own fingerprints first. Holds the own fingerprints of one key at most."""
    def links_of(key: int, own: np.ndarray, probes: np.ndarray, shift: int) -> list[tuple[int, int]]:
        return _forest(own, probes, key >> shift)

    out: list[tuple[int, int]] = []
    open_key, open_own = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        fp = batch.column(1).to_numpy().view(np.uint64)
        probe = batch.column(2).to_numpy(zero_copy_only=False)
        shift = int(batch.column(3)[0].as_py())
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        sizes = np.diff(edges)
        last = len(sizes) - 1
        lonely = (sizes == 1) & (np.arange(len(sizes)) != last)
        lonely[0] = lonely[0] and key[0] != open_key
        for g in np.flatnonzero(~lonely).tolist():
            a, b = edges[g], edges[g + 1]
            k = int(key[a])
            flags = probe[a:b]
            own, probes = fp[a:b][~flags], fp[a:b][flags]
            if k == open_key:  # the key began in an earlier batch
                if len(own):
                    fresh = np.setdiff1d(own, open_own)
                    links = links_of(k, np.concatenate([open_own, fresh]), probes, shift) if len(fresh) else []
                    out += links or (_forest(open_own, probes, k >> shift) if len(probes) else [])
                    open_own = np.concatenate([open_own, fresh])
                elif len(probes) and len(open_own):
                    out += links_of(k, open_own, probes, shift)
            else:
                if len(own):
                    out += links_of(k, own, probes, shift)
                if g == last:
                    open_key, open_own = k, np.unique(own)
        if out:
            pairs = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
            out = []


def _keyed(prints: DataFrame, chain: int) -> DataFrame:
    """Key rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = CHUNK // 8 if chain == 2 else 256
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), step):
                fp = every[at : at + step]
                found = _two_chain(fp) if chain == 2 else _three_chain(fp)
                keys, rows, probes = found[:3]
                columns = [pa.array(keys.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(probes)]
                columns.append(pa.array(np.full(len(keys), 2 * WIDTH if chain == 2 else 3 * WIDTH, np.int32)))
                columns.append(pa.array((keys if chain == 2 else found[3]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "probe", "shift", "two"])

    return prints.select("fp").mapInArrow(run, "key long, fp long, probe boolean, shift int, two long")


def _linked(keyed: DataFrame) -> DataFrame:
    rows = keyed.select("key", "fp", "probe", "shift").repartition("key").sortWithinPartitions("key", "probe")
    return rows.mapInArrow(_groups, "u long, v long")


def links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links ``(u, v)`` that connect exactly what Hamming distance 3 connects. ``prints``: distinct ``fp``."""
    shift = 2 * WIDTH
    segment = [F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(_MASK) for i in range(SEGMENTS)]
    own_keys = [
        F.shiftleft(F.lit(i).cast("long"), shift)
        .bitwiseOR(F.shiftleft(segment[i], WIDTH))
        .bitwiseOR(segment[(i + 1) % SEGMENTS])
        for i in range(SEGMENTS)
    ]
    counts = prints.select(F.explode(F.array(*own_keys)).alias("two")).groupBy("two").count()
    heavy = materialize(counts.filter(F.col("count") > group_limit).select("two"), "heavy_keys")
    keyed = _keyed(prints, 2)
    if is_empty(heavy):
        return _linked(keyed)
    light = _linked(keyed.join(heavy, "two", "left_anti"))
    # A fingerprint takes part in a heavy key as itself or as a probe; either way it is met in the chain of three.
    concerned = keyed.join(heavy, "two", "left_semi").select("fp").distinct()
    longer = _keyed(concerned, 3).join(heavy, "two", "left_semi")
    return light.unionByName(_linked(longer))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT, digests: bool = False
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id; with ``digests`` also component (a number
    that only this component has, also if no row of it has an id) and text_sha256.

    Rows whose fingerprints are linked, directly or through others, share the smallest id as component_id. Null
    and empty texts have fingerprint zero and are linked like any other. A row with a null id belongs to its
    component; the component_id is null only where no row of it has an id.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, digests=digests), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct_fingerprints")
    found = components(links(nodes.select("fp"), group_limit))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = placed.join(smallest, "component").select("fp", "component", "component_id")
    more = ["component", "text_sha256"] if digests else []
    return prints.join(of_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more
    )
