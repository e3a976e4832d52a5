"""Removal of repeated byte strings, by suffix arrays over the places where texts can repeat.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier in the corpus. Suffixes are sorted
by linear grouping (``suffix_order``), in bounded blocks that hold everything that can be equal:

1. Equal texts are one text, owned by the smallest id; later copies go whole.
2. Each window of ``LENGTH`` bytes names the smallest hash of the ``GRAM``-byte strings inside it as its anchor. Equal
   windows have equal anchors at equal places, so only windows whose anchor is met again elsewhere can repeat.
3. Neighbouring windows with one anchor form a context. Equal contexts collapse to their first place; all others
   of them are repeats as a whole.
4. Different contexts with one anchor are sorted together. Windows that are neighbours in suffix order and agree in
   ``LENGTH`` bytes are one class; all but its first window are repeats. An anchor with very many different contexts
   is divided: first by the bytes that eight neighbouring windows have in common, then by the whole window.
5. Repeated windows of a text become removed runs.

Rows are places and contexts, never pairs of texts; each step writes to the shared folder.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.suffix_order import suffix_array
from alarmlens.llm.tables import id_and_text, in_slices
from alarmlens.operators.ranking import global_row_number
from alarmlens.runtime import is_empty, materialize, own_table

LENGTH = 100
GRAM = 32
PLACE_BITS = 30  # a text's place in a code; the text's number takes the bits above
BLOCK = 1 << 19
SORTED_BYTES = 1 << 16
GROUP_LIMIT = 256
EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = _mix(np.arange(1001, 1064, dtype=np.uint64)) | np.uint64(1)


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place."""
    h = _BYTE[raw]
    span = 1
    while span < size:
        h = h[:-span] * _STEP[span] + h[span:]
        span *= 2
    return _mix(h)


def contexts(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor's place) of each run of windows with one anchor."""
    found = []
    width = length - gram + 1
    for at in range(0, max(len(raw) - length + 1, 0), BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        hashes = _gram_hashes(part, gram)
        low = hashes & ~np.uint64((1 << 20) - 1) | np.arange(len(hashes), dtype=np.uint64)
        span, least = 1, low
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        edges = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges - 1, [len(place) - 1]))
        anchor = place[first]
        found.append((hashes[anchor].view(np.int64), first + at, last + at, anchor + at))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(column) for column in zip(*found))


def _code(number: np.ndarray | int, place: np.ndarray) -> np.ndarray:
    return (np.int64(number) << PLACE_BITS) + place


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(g, code, rel, width)``: contexts of all texts, code of the first window, anchor's distance, windows less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, first, last, anchor = contexts(np.frombuffer(text.encode("utf-8"), np.uint8), length, gram)
                for column, values in zip(columns, (g, _code(number, first), anchor - first, last - first)):
                    column.append(values)
            g, code, rel, width = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(code), pa.array(rel.astype(np.int32)), pa.array(width.astype(np.int32))],
                names=["g", "code", "rel", "width"],
            )

    return texts.select("number", "text").mapInArrow(run, "g long, code long, rel int, width int")


def _contents(joined: DataFrame, length: int) -> DataFrame:
    """``(g, content, code, rel)`` from texts with their list of suspicious contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            lists = batch.column(2)
            flat = lists.flatten()
            g, code, rel, width = (flat.field(c) for c in ("g", "code", "rel", "width"))
            sizes = np.asarray(lists.value_lengths())
            start = code.to_numpy() - np.repeat(batch.column(0).to_numpy() << PLACE_BITS, sizes)
            stop = start + width.to_numpy() + length
            edges = np.append(0, np.cumsum(sizes)).tolist()
            contents: list[bytes] = []
            for text, first, last in zip(batch.column(1).to_pylist(), edges, edges[1:]):
                raw = text.encode("utf-8")
                contents += [raw[x:y] for x, y in zip(start[first:last].tolist(), stop[first:last].tolist())]
            yield pa.RecordBatch.from_arrays([g, pa.array(contents, pa.binary()), code, rel], names=["g", "content", "code", "rel"])

    return joined.select("number", "text", "places").mapInArrow(run, "g long, content binary, code long, rel int")


def _bytes_of(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of binary cells in a row, and their sizes."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _repeats_in(block: pa.RecordBatch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, windows) of runs of repeated windows among different contexts ``(g, content, code, rel)``.

    Every window holds its context's anchor, which is the same for all contexts of one ``g``, so the anchor
    stands as one symbol of its own in the text that is sorted.
    """
    raw, sizes = _bytes_of(block.column(1))
    raw_starts = np.cumsum(sizes) - sizes
    first_code, rel = block.column(2).to_numpy(), block.column(3).to_numpy().astype(np.int64)
    _, symbol = np.unique(block.column(0).to_numpy(), return_inverse=True)
    owner_of_byte = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(raw)) - (raw_starts + rel)[owner_of_byte]
    wide = raw.astype(np.int64) + 1
    wide[raw_starts + rel] = 257 + symbol
    kept = (inside <= 0) | (inside >= gram)
    short = sizes - (gram - 1)
    starts = np.cumsum(short + 1) - short - 1
    text = np.zeros(int(short.sum()) + len(sizes), np.int64)  # 0 ends a context
    places = np.ones(len(text), bool)
    places[starts + short] = False
    text[places] = wide[kept]
    owner = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    nth = np.arange(len(owner)) - (np.cumsum(sizes - length + 1) - (sizes - length + 1))[owner]
    codes = np.full(len(text), -1, np.int64)
    codes[starts[owner] + nth] = first_code[owner] + nth
    raw_place = np.zeros(len(text), np.int64)
    raw_place[starts[owner] + nth] = raw_starts[owner] + nth
    order = suffix_array(text)
    order = order[codes[order] >= 0]
    same = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    for at in range(1, len(order), 4096):
        here = raw_place[order[at : at + 4096]]
        same[at : at + 4096] = (view[here] == view[raw_place[order[at - 1 : at - 1 + len(here)]]]).all(axis=1)
    heads = np.flatnonzero(~same)
    ranked = codes[order]
    least = np.repeat(np.minimum.reduceat(ranked, heads), np.diff(np.append(heads, len(order))))
    repeated = np.sort(ranked[ranked != least])
    if not len(repeated):
        return repeated, repeated
    edges = np.flatnonzero(np.diff(repeated) != 1) + 1
    first = np.concatenate(([0], edges))
    return repeated[first], np.diff(np.append(first, len(repeated)))


def _sorted_repeats(groups: DataFrame, length: int, gram: int) -> DataFrame:
    """``(code, windows)`` of repeats between different contexts with one ``g``. Groups are whole within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            code, windows = _repeats_in(whole, length, gram)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(windows.astype(np.int64))], names=["code", "windows"])

        block: list[pa.RecordBatch] = []
        held, key = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, (_, sizes) = batch.column(0).to_numpy(), _bytes_of(batch.column(1))
            upto = np.cumsum(sizes)
            starts = (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()
            if key is not None and g[0] != key:
                starts.insert(0, 0)
            at = 0
            for start in starts:  # a block ends where a group does, once it holds enough
                if held + int(upto[start - 1] if start else 0) - int(upto[at - 1] if at else 0) > SORTED_BYTES:
                    if start > at:
                        block.append(batch.slice(at, start - at))
                    yield solved(block)
                    block, held, at = [], 0, start
            block.append(batch.slice(at))
            held += int(upto[-1]) - int(upto[at - 1] if at else 0)
            key = g[-1]
        if block:
            yield solved(block)

    placed = groups.select("g", "content", "code", "rel").repartition("g").sortWithinPartitions("g")
    return placed.mapInArrow(run, "code long, windows long")


def _divided(groups: DataFrame, step: int, length: int) -> DataFrame:
    """Contexts cut at fixed distances from the anchor, ``step`` windows each, keyed by the bytes these have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents, codes, rels = [], [], [], []
            for g, content, code, rel in zip(*(c.to_pylist() for c in batch.columns)):
                windows = len(content) - length + 1
                tail = b"/%d/" % g
                first = 0
                while first < windows:
                    block = (rel - first) // step
                    core = rel - block * step
                    last = min(windows - 1, core)  # windows with rel - w in [block * step, (block + 1) * step)
                    key = content[core : core + length - step + 1] + tail + b"%d" % block
                    keys.append(xxhash.xxh64_intdigest(key) - (1 << 63))
                    contents.append(content[first : last + length])
                    codes.append(code + first)
                    rels.append(rel - first)
                    first = last + 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
            columns = (keys, contents, codes, rels)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "content", "code", "rel"])

    return groups.select("g", "content", "code", "rel").mapInArrow(run, "g long, content binary, code long, rel int")


def _collapsed(rows: DataFrame) -> DataFrame:
    """Different contexts with the code of their first place."""
    return rows.groupBy("g", "content").agg(F.min("code").alias("code"), F.min("rel").alias("rel"))


def _resolve(firsts: DataFrame, length: int, gram: int, limit: int) -> list[DataFrame]:
    """Repeated windows among different contexts, ``(code, windows)``."""
    counts = firsts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = materialize(counts, "shared_anchors")
    found = [_sorted_repeats(firsts.join(counts.filter(F.col("n") <= limit), "g"), length, gram)]
    crowded = counts.filter(F.col("n") > limit).select("g")
    rows = firsts.join(crowded, "g")
    for step in (8, 1):
        if is_empty(crowded):
            break
        parts = materialize(_divided(rows, step, length), "divided")
        firsts = materialize(_collapsed(parts), "divided_firsts")
        later = parts.join(firsts.select("code"), "code", "left_anti")
        found.append(later.select("code", (F.octet_length("content") - length + 1).cast("long").alias("windows")))
        if step == 1:
            break  # a context of one window is a whole window: different contexts are different windows
        counts = materialize(firsts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared_cores")
        found.append(_sorted_repeats(firsts.join(counts.filter(F.col("n") <= limit), "g"), length, gram))
        crowded = counts.filter(F.col("n") > limit).select("g")
        rows = firsts.join(crowded, "g")
    return found


def removed_runs(starts: list[int], windows: list[int], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that begin at ``starts`` and follow one another."""
    runs: list[tuple[int, int]] = []
    for start, count in sorted(zip(starts, windows)):
        stop = min(start + count - 1 + length, size)
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((start, stop))
    return runs


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and stop of removed runs).

    Null texts count as empty. Texts are ordered by id, null ids last, ties by the text's SHA-256; rows with the same id and text are one
    document and get the same result. Texts shorter than ``length`` keep everything. At most 2^33 different texts
    of up to 2^30 bytes each.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    narrow = materialize(source.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    owners = narrow.groupBy("sha").agg(F.min("id").alias("owner"), F.max("n_bytes").alias("n_bytes"))
    long_enough = owners.filter(F.col("n_bytes") >= length).withColumn("all", F.lit(0))
    numbered = global_row_number(long_enough, ["all"], [F.col("owner").asc_nulls_last(), F.col("sha")], "number")
    numbered = materialize(numbered.select("sha", "owner", F.col("number").cast("long").alias("number")), "numbered")

    # One row per different text, in buckets by its digest: later joins on it leave the texts where they are.
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = own_table(spark, "distinct_texts")
    distinct = source.groupBy("sha").agg(F.first("text").alias("text")).join(numbered.select("sha", "number"), "sha")
    distinct.write.bucketBy(buckets, "sha").option("path", path).saveAsTable(name)
    texts = spark.table(name)

    anchors = _anchors(texts, length, gram)
    repeated = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    suspicious = materialize(anchors.join(materialize(repeated, "repeated_anchors"), "g"), "suspicious")
    number = F.shiftright("code", PLACE_BITS).alias("number")
    of_text = (
        suspicious.groupBy(number).agg(F.collect_list(F.struct("g", "code", "rel", "width")).alias("places"))
        .join(numbered.select("sha", "number"), "number").drop("number")
    )
    firsts = materialize(_collapsed(_contents(texts.join(of_text, "sha"), length)), "first_contexts")
    later = suspicious.join(firsts.select("code"), "code", "left_anti")
    found = later.select("code", (F.col("width") + 1).cast("long").alias("windows"))
    for more in _resolve(firsts, length, gram, group_limit):
        found = found.unionByName(more)

    at = (F.col("code") - F.shiftleft(F.shiftright("code", PLACE_BITS), PLACE_BITS)).alias("at")
    runs = (
        found.groupBy(number).agg(F.collect_list(F.struct(at, "windows")).alias("found"))
        .join(numbered.select("sha", "number"), "number").drop("number")
    )
    runs = materialize(runs, "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            removed, digests, spans = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode("utf-8")
                own = removed_runs([f["at"] for f in found], [f["windows"] for f in found], length, len(raw))
                digest, last = hashlib.sha256(), 0
                for start, stop in own:
                    digest.update(raw[last:start])
                    last = stop
                digest.update(raw[last:])
                removed.append(sum(b - a for a, b in own))
                digests.append(digest.hexdigest())
                spans.append([{"start": a, "stop": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)],
                names=["sha", "n_removed", "kept", "spans"],
            )

    schema = "sha string, n_removed long, kept string, spans array<struct<start:long,stop:long>>"
    result = texts.join(runs, "sha").select("sha", "text", "found").mapInArrow(cut, schema)
    result = materialize(result.join(numbered.select(F.col("sha"), "owner"), "sha", "right"), "cut_texts")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    copy = (F.col("n_bytes") >= length) & ~F.col("id").eqNullSafe(F.col("owner"))
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", none))
    return narrow.join(result, "sha", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(copy, EMPTY).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
    )
