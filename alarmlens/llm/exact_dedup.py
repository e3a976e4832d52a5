"""Exact deduplication over an extendible-hash index kept in shared files.

Every text has a 64-bit key. The index is a directory of buckets, each the owner of one key
prefix: the directory doubles, one more bit at a time, until no bucket holds more than
``capacity`` distinct keys. Copies share a key, so a text with any number of copies takes one
place. The directory places every key: its slot names the bucket, and an owner task processes
whole buckets, key by key, chains the texts that collide in a key, and compares whole bytes; the
hash alone never makes two texts equal. Each bucket's entries are written to files, and every row
reads its ``keep_id`` and ``group_size`` from its entry.

Only texts whose key is met more than once are compared; where the list of those keys is too large
to be broadcast, all texts move once to meet it. Copies are collapsed inside tasks, then inside salted
groups, so a text that makes up a third of all rows reaches its owner a few times.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import id_and_text
from alarmlens.runtime import materialize

SALTS = 32
CAPACITY = 250  # distinct keys of a bucket; texts of one bucket are what an owner task holds as its least share
SPARE_BITS = 2  # the histogram is this much finer than an even spread of keys needs

_LINK = "h long, token long, head long, text string, id long, sha string, link int, bucket long"


@dataclass
class ExactIndex:
    """``directory``: slot, bucket, depth at ``global_depth`` bits. ``entries``: the index files, one row per distinct
    text: bucket, h, key_rows (rows with that key), link (place in the chain of its key), keep_id, group_size.
    ``members``: one row per input row, id, sha, keep_id, group_size, looked up in the entries."""

    directory: DataFrame
    global_depth: int
    entries: DataFrame
    members: DataFrame


def key_of(col: str):
    """64-bit key of a text."""
    return F.xxhash64(col)


def slot(depth: int):
    """First ``depth`` bits of the key ``h``, as a number."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory for distinct keys ``h``: every bucket is the shortest prefix with at most ``capacity`` keys.

    Each doubling splits the overfull buckets by one more bit. The key counts of all depths come
    from one histogram; a bucket exists where its own count fits and that of its parent does not.
    A bucket that is still overfull at the finest depth stays as it is (distinct 64-bit hashes spread evenly).
    """
    total = keys.count()
    finest = min(40, max(1, math.ceil(math.log2(max(1, total / capacity))) + SPARE_BITS))
    histogram = keys.groupBy(slot(finest).alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    depths = histogram.select("fine", "n", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
    nodes = materialize(
        depths.groupBy("depth", F.expr(f"shiftright(fine, {finest} - depth)").alias("prefix")).agg(
            F.sum("n").alias("n")
        ),
        "directory",
    )
    overfull = nodes.filter(F.col("n") > capacity).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
    )
    children = nodes.withColumn("parent", F.shiftright("prefix", 1))
    fits = (F.col("n") <= capacity) | (F.col("depth") == finest)
    leaves = children.filter("depth > 0").filter(fits).join(overfull, ["depth", "parent"]).drop("parent").unionByName(
        nodes.filter("depth = 0").filter(F.col("n") <= capacity)
    )
    leaves = materialize(leaves, "buckets")
    depth = leaves.agg(F.max("depth")).first()[0] or 0
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    directory = leaves.select(
        F.explode(F.sequence(first, first + width - 1)).alias("slot"), first.alias("bucket"), "depth"
    )
    return directory, depth


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key. Each text is compared with the chain of its key; a new one is appended.

    A row gets the token of the equal text already in the chain. Memory: the chain of one key.
    """
    task = TaskContext.get().partitionId() << 33
    serial = 0
    key, chain = None, []
    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        hashes, texts = columns["h"], columns["text"]
        tokens = columns.get("token")
        own, heads, kept, links = [], [], [], []
        for i, (h, text) in enumerate(zip(hashes, texts)):
            if h != key:
                key, chain = h, []
            if tokens is None:
                token = task + serial
                serial += 1
            else:
                token = tokens[i]
            own.append(token)
            for link, (other, head) in enumerate(chain):
                if other == text:
                    heads.append(head)
                    kept.append(None)
                    links.append(link)
                    break
            else:
                links.append(len(chain))
                chain.append((text, token))
                heads.append(token)
                kept.append(text)
        empty = [None] * len(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes, pa.int64()),
                pa.array(own, pa.int64()),
                pa.array(heads, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(columns.get("id", empty), pa.int64()),
                pa.array(columns.get("sha", empty), pa.string()),
                pa.array(links, pa.int32()),
                pa.array(columns.get("bucket", empty), pa.int64()),
            ],
            names=["h", "token", "head", "text", "id", "sha", "link", "bucket"],
        )


def _chained(rows: DataFrame, name: str) -> DataFrame:
    return materialize(rows.sortWithinPartitions(*[c for c in ("bucket", "h") if c in rows.columns]).mapInArrow(_chain, _LINK), name)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> ExactIndex:
    """Index of every row of ``docs``. Null texts count as empty; null and repeated ids are rows like any other."""
    source = id_and_text(docs, id_col, text_col)
    keyed = source.withColumn("h", key_of("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    narrow = materialize(keyed.select("id", "h", "sha"), "keys")
    counts = narrow.groupBy("h").agg(F.count(F.lit(1)).alias("key_rows"), F.max("id").alias("id"))
    counts = materialize(counts, "key_counts")
    directory, depth = build_directory(counts.select("h"), capacity)
    directory = materialize(directory, "slots")
    repeated = materialize(counts.filter("key_rows > 1").select("h"), "repeated_keys")
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def placed(keys: DataFrame) -> DataFrame:
        return keys.withColumn("slot", slot(depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")

    # Copies collapse where they are read, then in salted groups, then at the owner of their bucket.
    local = _chained(keyed.join(repeated, "h"), "chain_local")
    heads = local.filter("text is not null").select("h", F.col("head").alias("token"), "text")
    salt = F.pmod(F.shiftright("token", 33), F.lit(SALTS))
    salted = _chained(heads.repartition("h", salt), "chain_salted")
    heads = salted.filter("text is not null").select("h", F.col("head").alias("token"), "text")
    owned = _chained(placed(heads).repartitionByRange(ranges, "bucket"), "chain_owner")

    to_class = salted.select(F.col("token").alias("head"), F.col("head").alias("next")).join(
        owned.select(F.col("token").alias("next"), F.col("head").alias("class"), "bucket", "h", "link"), "next"
    )
    to_class = materialize(to_class.drop("next"), "class_of_head")
    parts = local.groupBy("head").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    chained = to_class.join(parts, "head").groupBy("bucket", "h", "link").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    chained = chained.join(counts.filter("key_rows > 1").select("h", "key_rows"), "h")
    single = placed(counts.filter("key_rows = 1")).select(
        "bucket", "h", "key_rows", F.lit(0).alias("link"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    entries = chained.select(single.columns).unionByName(single)
    entries = entries.repartitionByRange(ranges, "bucket").sortWithinPartitions("bucket", "h", "link")
    entries = materialize(entries, "exact_index")

    found = entries.filter("key_rows > 1").select("bucket", "h", "link", "keep_id", "group_size")
    of_head = to_class.select("head", "bucket", "h", "link").join(found, ["bucket", "h", "link"])
    copies = local.select("id", "sha", "head").join(of_head.select("head", "keep_id", "group_size"), "head")
    alone = narrow.join(entries.filter("key_rows = 1").select("h", "keep_id", "group_size"), "h")
    columns = ["id", "sha", "keep_id", "group_size"]
    return ExactIndex(directory, depth, entries, copies.select(columns).unionByName(alone.select(columns)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. With repeated rows (same id and text) each row
    counts in ``group_size`` and all rows that carry the largest id are marked kept. A null id never
    stays unless its group has no other; then ``keep_id`` is null and ``kept`` true. An empty table gives no rows.
    """
    return build_index(docs, id_col, text_col, capacity).members.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
