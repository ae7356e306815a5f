"""Exact dedup through an extendible-hash index on shared files.

The index maps a 64-bit key of the normalised text to buckets, each a range of keys. The directory starts with one
bucket and doubles as long as a bucket holds more than its capacity: an overfull bucket splits by the next bit of
the key. Loads are counted over all rows (bytes of distinct keys, which is what an owner holds after copies have been
combined), so a hot text never overfills a bucket. Owners then get the texts of their key range once, in key order,
chain the texts that share a key, compare bytes, and write the entries (key, digest, keep_id, group_size) as shared
files. Each row probes the index by key and digest; that is an ordinary join, whose hot keys Spark may split.

Nulls: a null text is an empty one. Null ids come last; of a group with null ids only, every row stays, as none of them
is smaller than another. Rows repeated with the same id and text stay together. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, id_text, partitions

#: Bits of the key by which one counting pass refines a bucket.
STEP_BITS = 12
#: A task combines copies in a table of at most so many bytes before it passes them on.
COMBINE_BYTES = 32 << 20


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def keyed(docs: DataFrame) -> DataFrame:
    """Every row with its normalised text and the key that the index goes by."""
    rows = id_text(docs).select("doc_id", normalised(F.col("text")).alias("body"))
    return rows.withColumn("key", F.xxhash64("body"))


def _prefix(key, bits: int):
    """The key's top bits as a number from 0, in the order of unsigned keys."""
    return F.shiftrightunsigned(key, 64 - bits)


def directory(entries: DataFrame, capacity: int, max_depth: int = 60) -> np.ndarray:
    """First keys (unsigned) of the buckets, in order: splits every bucket of more than capacity bytes."""
    loads = entries.groupBy("key").agg(F.max("n_bytes").alias("load"))
    buckets, overfull, depth = [], [0], 0
    while overfull:
        bits = min(depth + STEP_BITS, max_depth)
        rows = loads.withColumn("bucket", _prefix(F.col("key"), bits))
        if depth:  # only keys of the buckets that are still overfull
            parents = entries.sparkSession.createDataFrame([(int(x),) for x in overfull], "parent long")
            rows = rows.withColumn("parent", _prefix(F.col("key"), depth)).join(parents, "parent", "left_semi")
        counted = rows.groupBy("bucket").agg(F.sum("load").alias("load")).collect()  # at most 2^STEP_BITS a parent
        load = {int(r["bucket"]): int(r["load"]) for r in counted}
        below = [load]
        for _ in range(bits - depth):  # loads of shorter prefixes, up to the parents
            up: dict[int, int] = {}
            for k, v in below[-1].items():
                up[k >> 1] = up.get(k >> 1, 0) + v
            below.append(up)
        below.reverse()  # below[i]: prefixes of depth + i bits
        pending, overfull = list(overfull), []
        for i, level in enumerate(below):
            split = []
            for p in pending:
                if level.get(p, 0) <= capacity or depth + i == max_depth:
                    buckets.append(p << (64 - depth - i) if depth + i else 0)
                elif depth + i == bits:
                    overfull.append(p)
                else:
                    split += [2 * p, 2 * p + 1]
            pending = split
        depth = bits
    return np.sort(np.array(buckets, np.uint64))


def _owners(starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, keys.view(np.uint64), "right") - 1


COMBINED = pa.schema([("owner", pa.int64()), ("key", pa.int64()), ("body", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _combine(starts: np.ndarray):
    """Copies within a task become one row with their smallest id and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array([x[0] for x in held.values()], np.int64)
            cols = [pa.array(_owners(starts, keys), pa.int64()), pa.array(keys), pa.array(list(held), pa.binary()).cast(pa.string()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([x[2] for x in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, schema=COMBINED)

        for b in batches:
            for i, body, key in zip(b.column("doc_id").to_pylist(), b.column("body").cast(pa.binary()).to_pylist(), b.column("key").to_pylist(), strict=True):
                x = held.get(body)
                if x is None:
                    held[body] = [key, i, 1]
                    size += len(body) + 200
                else:
                    x[1] = i if x[1] is None else x[1] if i is None else min(x[1], i)
                    x[2] += 1
                if size >= COMBINE_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return run


INDEX = pa.schema([("key", pa.int64()), ("body_sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order. The chain of a key holds each different text once, found by comparing bytes."""
    import hashlib

    key, chain, out = None, [], []
    for b in batches:
        for k, body, i, n in zip(b.column("key").to_pylist(), b.column("body").cast(pa.binary()).to_pylist(), b.column("keep_id").to_pylist(), b.column("n").to_pylist(), strict=True):
            if k != key:
                out += [(key, hashlib.sha256(t).digest(), m, c) for t, m, c in chain]
                key, chain = k, []
            for x in chain:
                if x[0] == body:
                    x[1] = i if x[1] is None else x[1] if i is None else min(x[1], i)
                    x[2] += n
                    break
            else:
                chain.append([body, i, n])
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), INDEX.types, strict=True)], schema=INDEX)
            out = []
    out += [(key, hashlib.sha256(t).digest(), m, c) for t, m, c in chain]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), INDEX.types, strict=True)], schema=INDEX)


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, key, keep_id, group_size, kept, text_sha256.

    capacity: bytes of distinct texts a bucket may hold; by default a quarter of a shuffle partition's share, at
    least 64 KiB, so that owners of several buckets get even loads.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark), partitions(spark)
    rows = keyed(docs)
    entries = scratch.save(rows.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("body_sha"), F.octet_length("body").cast("long").alias("n_bytes")))
    if capacity is None:
        total = entries.agg(F.sum("n_bytes")).first()[0] or 0
        capacity = min(max(total // (4 * n), 64 << 10), 256 << 20)
    starts = directory(entries, capacity)
    combined = rows.mapInArrow(_combine(starts), "owner long, key long, body string, keep_id long, n long")
    owned = combined.repartition(n, "owner").sortWithinPartitions("key")
    index = scratch.save(owned.mapInArrow(_chain, "key long, body_sha binary, keep_id long, group_size long"))
    found = entries.drop("n_bytes").join(index, ["key", "body_sha"])
    return found.select("doc_id", "key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("body_sha")).alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    own = F.xxhash64(normalised(docs["text"].cast("string")))
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (own == stay["_key"]), "left_semi")
