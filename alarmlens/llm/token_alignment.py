"""Alignment of two tokenizers over the same texts, with corpus-wide link counts by external spill counting.

Both tokenizers cut a text into byte ranges. Places where tokens of both end cut the text into groups; inside a
group every token of one side is linked with every token of the other. How many documents hold a pair of ids linked
is counted without a shuffle of single links:

1. Tasks encode documents in chunks of a few megabytes. A chunk's links become sorted records (pair, document, times),
   dealt by the low digits of the first side's id (radix) into runs of zstd-compressed columns.
2. The runs of one radix, in groups of bounded size, are merged by a heap in the order of the first side's ids; the heads of the
   runs (pair, documents) are enough for that. Partial counts of the groups are merged in the same way once more: a first-side
   id is then complete when the next one comes up, so its highest count is known at once.
3. Each group streams its runs a second time against the counts of its radix and adds up what each document gets.

A pair that all documents hold is one head in each run, and the groups that share its radix are as many as its bytes ask for, so a hot
token grows no task. A group holds about ``group_bytes`` of compressed runs; the counts of one radix are bounded by the vocabularies.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.bpe import Codec
from alarmlens.llm.tables import id_and_text
from alarmlens.runtime import materialize

RADIX = 64
CHUNK_BYTES = 4 << 20
PART_LINKS = 4_000_000
GROUP_BYTES = 16 << 20
PAIR_BITS = 20  # bits of the second side's id in a pair, and of a document's number in a chunk
_MASK = (1 << PAIR_BITS) - 1


class Tokenizers:
    """Side A: a byte-level BPE file, read by tiktoken; side B: a sentencepiece model. Special tokens are plain text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.codec = Codec(path_a)
        special = set(self.codec.special.values())
        ranks = {raw: i for i, raw in self.codec.bytes_of.items() if i not in special}
        self.a = tiktoken.Encoding("side_a", pat_str=self.codec.pattern.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.codec.bytes_of.get(i, b"") for i in range(max(self.codec.bytes_of) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        one = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # Ids as text with what follows them: more of the group's side, the other side, the next group.
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.written = [f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)]
        self.written += [f"{i},".encode() for i in range(m)] + [f"{i};".encode() for i in range(m)]

    def ids_a(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except BaseException as error:  # its pattern engine gives up on very long runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            pieces = self.codec.pattern.findall(text)
            return [i for p in pieces for f in self.codec.fragments(p.encode("utf-8")) for i in self.codec.merge(f)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if a side does not give back the text with a space before it."""
        if not text:
            return [], []
        raw = b" " + text.encode("utf-8")
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        a = self.ids_a(" " + text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw:
            return [], []
        return a, b


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair per worker process and files."""
    if (path_a, path_b) not in _TOKENIZERS:
        _TOKENIZERS[path_a, path_b] = Tokenizers(path_a, path_b)
    return _TOKENIZERS[path_a, path_b]


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(cell: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns of one length that stand one after another."""
    raw = zstandard.ZstdDecompressor().decompress(cell)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    offsets = np.cumsum([0, *widths[:-1]]) * n
    return [np.frombuffer(raw, k, n, int(at)) for k, at in zip(kinds, offsets)]


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


@dataclass
class Chunk:
    """Documents side by side: counts per document, digests of their groups, and the records of their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    keys: np.ndarray  # pair and document number, ascending
    times: np.ndarray


def align(tools: Tokenizers, texts: list[str]) -> Chunk:
    """Groups and links of every text. Links are made in parts of bounded size and collapse to records at once."""
    n = len(texts)
    both = [tools.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(x[side] for x in both), np.int64, int(c.sum())) for side, c in ((0, n_a), (1, n_b)))
    del both
    end_a, end_b = np.cumsum(tools.length_a[a]), np.cumsum(tools.length_b[b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    many_a, many_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    first_b, upto_a = np.cumsum(many_b) - many_b, np.cumsum(many_a)
    doc_a = np.repeat(np.arange(n), n_a)
    doc_of_group = doc_a[upto_a - 1]
    n_groups = np.bincount(doc_of_group, minlength=n)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, doc_of_group, many_a * many_b)

    digests = _group_digests(tools, a, b, group_a, group_b, first_b, upto_a, n_a, n_b)
    per_token = many_b[group_a]
    done = np.cumsum(per_token)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PART_LINKS, "right")))
        count = per_token[at:stop]
        before = np.cumsum(count) - count
        place = np.arange(int(count.sum())) + np.repeat(first_b[group_a[at:stop]] - before, count)
        key = np.repeat((a[at:stop] << 2 * PAIR_BITS) + doc_a[at:stop], count) + (b[place] << PAIR_BITS)
        found, number = np.unique(key, return_counts=True)
        keys.append(found)
        times.append(number)
        at = stop
    if len(keys) == 2:
        return Chunk(n_a, n_b, n_groups, n_links, digests, keys[1], times[1])
    merged, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(merged), np.int64)
    np.add.at(total, where, np.concatenate(times))
    return Chunk(n_a, n_b, n_groups, n_links, digests, merged, total)


def _group_digests(tools, a, b, group_a, group_b, first_b, upto_a, n_a, n_b) -> list[str]:
    """SHA-256 of the written groups of each document; the empty string where there is no token."""
    stream = np.empty(len(a) + len(b), np.int64)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    size_a, size_b = len(tools.bytes_a), len(tools.bytes_b)
    stream[np.arange(len(a)) + first_b[group_a]] = a + size_a * last_a
    stream[np.arange(len(b)) + upto_a[group_b]] = b + 2 * size_a + size_b * last_b
    out, at = [], 0
    for size in (n_a + n_b).tolist():
        if size:
            written = b"".join(map(tools.written.__getitem__, stream[at : at + size].tolist()))
            out.append(hashlib.sha256(memoryview(written)[:-1]).hexdigest())
        else:
            out.append("")
        at += size
    return out


def runs_of(chunk: Chunk, radix: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, head, body): the records of the chunk by the low digits of the first id. Head: first id, second id, documents of
    each pair; body: document numbers (as distances within a pair) and times of each record."""
    digit = (chunk.keys >> 2 * PAIR_BITS) % radix
    order = np.argsort(digit, kind="stable")
    edges = np.searchsorted(digit[order], np.arange(radix + 1))
    for r in range(radix):
        own = order[edges[r] : edges[r + 1]]
        if not len(own):
            continue
        keys = chunk.keys[own]
        pairs = keys >> PAIR_BITS
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        docs = (keys & _MASK).astype(np.int32)
        steps = _deltas(docs)
        steps[starts] = docs[starts]
        heads = pairs[starts]
        sizes = np.diff(np.append(starts, len(own))).astype(np.int32)
        head = _pack(_deltas(heads >> PAIR_BITS).astype(np.int32), (heads & _MASK).astype(np.int32), sizes)
        yield r, head, _pack(steps, chunk.times[own].astype(np.int32))


def _head(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, second, sizes = _unpack(cell, "i4", "i4", "i4")
    return np.cumsum(steps, dtype=np.int64), second.astype(np.int64), sizes.astype(np.int64)


def merge_counts(runs: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first id, its second ids, documents of each) in the order of first ids, from runs (first, second, documents) in that order.

    The heap holds the next first id of each run, so all runs that have it come up together.
    """
    edges = [np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)).tolist() for first, _, _ in runs]
    heap = [(int(first[0]), k, 0) for k, (first, _, _) in enumerate(runs) if len(first)]
    heapq.heapify(heap)
    while heap:
        current, seconds, counts = heap[0][0], [], []
        while heap and heap[0][0] == current:
            _, k, nth = heap[0]
            lo, hi = edges[k][nth], edges[k][nth + 1]
            seconds.append(runs[k][1][lo:hi])
            counts.append(runs[k][2][lo:hi])
            if hi < len(runs[k][0]):
                heapq.heapreplace(heap, (int(runs[k][0][hi]), k, nth + 1))
            else:
                heapq.heappop(heap)
        if len(seconds) == 1:
            yield current, seconds[0], counts[0]
            continue
        found, where = np.unique(np.concatenate(seconds), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        yield current, found, total


_COUNTS = ("i8", "i8", "i8", "i1")


def _merged_cell(runs: list[tuple[np.ndarray, ...]]) -> bytes:
    """Columns first id, second id, documents, whether that is the first id's highest count."""
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.int8)]]
    for first, seconds, counts in merge_counts(runs):
        for column, values in zip(columns, (np.full(len(seconds), first), seconds, counts, (counts == counts.max()).astype(np.int8))):
            column.append(values)
    return _pack(*(np.concatenate(c) for c in columns))


def _merge_heads(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"radix": [key[0]], "cell": [_merged_cell([_head(h) for h in group["head"]])]})


def _merge_cells(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"radix": [key[0]], "cell": [_merged_cell([tuple(_unpack(c, *_COUNTS)[:3]) for c in group["cell"]])]})


def _contributions(key: tuple, runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Per run what its documents get: links with their first id's highest count, sum of counts over links."""
    first, second, documents, best = _unpack(counts["cell"].iloc[0], *_COUNTS)
    pairs = (first << PAIR_BITS) + second
    chunks, cells = [], []
    for number, head, body in zip(runs["chunk"], runs["head"], runs["body"]):
        own_first, own_second, sizes = _head(head)
        place = np.repeat(np.searchsorted(pairs, (own_first << PAIR_BITS) + own_second), sizes)
        steps, times = _unpack(body, "i4", "i4")
        starts = np.cumsum(sizes) - sizes
        level = np.cumsum(steps, dtype=np.int64)
        docs = level - np.repeat(level[starts] - steps[starts], sizes)
        n_best, total = np.zeros(int(docs.max()) + 1, np.int64), np.zeros(int(docs.max()) + 1, np.int64)
        np.add.at(n_best, docs, times * best[place].astype(np.int64))
        np.add.at(total, docs, times * documents[place])
        chunks.append(number)
        cells.append(_pack(n_best, total))
    return pd.DataFrame({"chunk": chunks, "cell": cells})


def _gathered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Sums over the runs of a chunk, one row per document with links."""
    parts = [_unpack(c, "i8", "i8") for c in group["cell"]]
    size = max(len(p[0]) for p in parts)
    n_best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for best, counts in parts:
        n_best[: len(best)] += best
        total[: len(counts)] += counts
    return pd.DataFrame({"chunk": key[0], "serial": np.arange(size), "n_best": n_best, "count_sum": total})


_ALIGNED = (
    "chunk long, serial long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "radix int, head binary, body binary"
)


def _aligned(docs: DataFrame, path_a: str, path_b: str, radix: int, chunk_bytes: int) -> DataFrame:
    """Rows of documents (radix null) and of runs (id null), told apart by ``radix``."""

    def batch_of(chunk: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        made = align(tokenizers(path_a, path_b), texts)
        n, kinds = len(texts), [pa.int64()] * 7
        numbers = (np.full(n, chunk), np.arange(n), ids, made.n_a, made.n_b, made.n_groups, made.n_links)
        columns = [pa.array(c, k) for c, k in zip(numbers, kinds)]
        nothing = [pa.nulls(n, k) for k in (pa.int32(), pa.binary(), pa.binary())]
        names = [c.split()[0] for c in _ALIGNED.split(", ")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(made.digests, pa.string()), *nothing], names=names)
        runs = list(runs_of(made, radix))
        if runs:
            r, head, body = zip(*runs)
            empty = [pa.nulls(len(runs), k) for k in [pa.int64()] * 6 + [pa.string()]]
            filled = [pa.array(r, pa.int32()), pa.array(head, pa.binary()), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(runs), pa.int64()), *empty, *filled], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1])
                if held >= chunk_bytes or len(texts) > _MASK:
                    yield from batch_of(chunk, ids, texts)
                    ids, texts, held, chunk = [], [], 0, chunk + 1
        if texts:
            yield from batch_of(chunk, ids, texts)

    return docs.mapInArrow(run, _ALIGNED)


def alignments(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    radix: int = RADIX,
    chunk_bytes: int = CHUNK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a``: a byte-level BPE file; ``path_b``: a sentencepiece model; every executor has both. A pair of ids counts once for each row
    that holds it linked; repeated rows are documents of their own and null ids are ids like any other. Null and empty texts,
    and texts that a side does not give back byte for byte, have no tokens: zeros and an empty digest. A text
    is held whole by one task, of any length; an empty table gives no rows.
    """
    source = id_and_text(docs, id_col, text_col)
    made = materialize(_aligned(source, path_a, path_b, radix, chunk_bytes), "aligned")
    runs = made.filter("radix is not null")
    sizes = runs.groupBy("radix").agg(F.sum(F.octet_length("head") + F.octet_length("body")).alias("bytes"))
    groups = materialize(sizes.select("radix", F.ceil(F.col("bytes") / group_bytes).cast("long").alias("groups")), "groups")
    dealt = runs.join(F.broadcast(groups), "radix")  # one row per radix
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("groups"))).select("radix", "part", "chunk", "head", "body")
    partial = dealt.select("radix", "part", "head").groupBy("radix", "part").applyInPandas(_merge_heads, "radix int, cell binary")
    counts = materialize(partial.groupBy("radix").applyInPandas(_merge_cells, "radix int, cell binary"), "link_counts")
    copies = counts.join(F.broadcast(groups), "radix").select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), "cell")
    given = dealt.groupBy("radix", "part").cogroup(copies.groupBy("radix", "part")).applyInPandas(_contributions_if_any, "chunk long, cell binary")
    per_doc = given.groupBy("chunk").applyInPandas(_gathered, "chunk long, serial long, n_best long, count_sum long")
    zero = F.lit(0).cast("long")
    return made.filter("radix is null").join(per_doc, ["chunk", "serial"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def _contributions_if_any(key: tuple, runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """A group to which no chunk was dealt has counts only."""
    if not len(runs):
        return pd.DataFrame({"chunk": np.zeros(0, np.int64), "cell": np.zeros(0, object)})
    return _contributions(key, runs, counts)
