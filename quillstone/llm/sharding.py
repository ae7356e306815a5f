"""Sharding by histogram sort, so that shards hold near equal numbers of bytes.

Rows are ordered by the hash of their text, then by a hash of id and place, so equal texts stand next to each other.
Each round counts exactly, over all partitions, the bytes and rows below candidate boundaries, and narrows the bracket
around every target with new candidates; a boundary is accepted within the tolerance or when no row lies between the
candidates around its target. Candidates are whole hash values first, so that a group of equal texts is split only where
it has to be. When all splitters stand, rows are exchanged once, and every row's slot follows from the counts below its
block. Blocks are finer than shards and grow in number with the rows, so no task gets a whole shard.

What the driver holds: a few candidates for each splitter, never rows.

Nulls: a null text has no bytes; null ids are ordered like any other value. Repeated rows are told apart by their place.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, partitions

#: Allowed distance of a shard boundary from its target, as a part of a mean shard; inner boundaries may be rougher.
TOLERANCE, INNER = 0.002, 0.1
PROBES = 32
ROUNDS = 40
KEY_SPACE = 1 << 128
BLOCK_ROWS = 200_000


def _key(n: int) -> bytes:
    return b"%032X" % n


def keyed(rows: DataFrame, group: str, tie: list[str]) -> DataFrame:
    """rows with _key: 32 hex digits, half of them the group's hash, half a hash that tells rows of a group apart."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return rows.withColumn("_key", F.concat(digits(F.col(group)), digits(F.xxhash64(*tie, F.monotonically_increasing_id()))))


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int]]:
    """(probe, bytes below, rows below), exactly. Tasks send one sum for each gap between probes."""
    edges = np.array([_key(p) for p in probes], "S32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            gap = np.searchsorted(edges, np.array(b.column("_key").to_pylist(), "S32"), "right")
            np.add.at(size, gap, b.column("size").to_numpy(zero_copy_only=False))
            np.add.at(rows, gap, 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(size[used]), pa.array(rows[used])], names=["gap", "size", "rows"])

    sums = keys.select("_key", "size").mapInArrow(run, "gap long, size long, rows long").groupBy("gap").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for gap, s, r in sums:
        size[gap], rows[gap] = s, r
    return [(p, int(s), int(r)) for p, s, r in zip(probes, np.cumsum(size), np.cumsum(rows), strict=False)]


def splitters(keys: DataFrame, shards: int, per_shard: int) -> list[tuple[int, int, int]]:
    """Boundaries (key, bytes below, rows below) of shards * per_shard blocks: all inner ones, in order."""
    total, n = (int(x or 0) for x in keys.agg(F.sum("size"), F.count("*")).first())
    blocks = shards * per_shard
    known = {0: (0, 0), KEY_SPACE: (total, n)}
    found: dict[int, tuple[int, int, int]] = {}
    for step in range(ROUNDS):
        at = sorted(known)
        below = np.array([known[k][0] for k in at], np.float64)
        probes = set()
        for i in range(1, blocks):
            if i in found:
                continue
            target = total * i / blocks
            slack = TOLERANCE * total / shards if i % per_shard == 0 else INNER * total / blocks
            j = int(np.searchsorted(below, target, "right"))
            lo, hi = at[j - 1], at[min(j, len(at) - 1)]
            best = min((lo, hi), key=lambda k: abs(known[k][0] - target))
            if abs(known[best][0] - target) <= slack or hi - lo <= 1 or known[hi][1] - known[lo][1] <= 1:
                found[i] = (best, *known[best])
                continue
            # Whole hash values as long as there are any between; then places within one group of equal texts.
            unit = 1 << 64 if hi - lo > 1 << 64 else 1
            # Sizes vary little against many rows: look closely around the place that they suggest, and at the rest.
            guess = lo + (hi - lo) * (target - known[lo][0]) / max(1, known[hi][0] - known[lo][0])
            spread = (hi - lo) / max(2.0, (known[hi][1] - known[lo][1]) ** 0.5)
            ways = PROBES if per_shard == 1 or i % per_shard == 0 else 4
            near = [guess + spread * (2 * w / ways - 1) for w in range(ways + 1)]
            even = [lo + (hi - lo) * w // 4 for w in range(1, 4)]
            probes |= {p for p in ((int(x) + unit - 1) // unit * unit for x in (*near, *even)) if lo < p < hi}
        if not probes:
            if len(found) == blocks - 1:
                break
            # Brackets without a whole hash value inside: their middles.
            probes = {k for lo, hi in zip(at, at[1:], strict=False) if hi - lo > 1 for k in [(lo + hi) // 2]}
        known |= {p: (s, r) for p, s, r in _count(keys, sorted(probes))}
    else:
        raise RuntimeError("splitters have not settled")
    edges, last = [], (0, 0, 0)
    for i in range(1, blocks):  # rough inner boundaries never pass the exact ones after them
        last = max(last, found[i])
        edges.append(last)
    return edges


def shard(rows: DataFrame, shards: int, group: str, tie: list[str]) -> DataFrame:
    """rows with shard int and slot long added. rows has a column size (long, not null) and group, a 64-bit hash."""
    scratch = Scratch(rows.sparkSession)
    placed = scratch.save(keyed(rows, group, tie))
    n = placed.count()
    per_shard = max(1, -(-n // (shards * BLOCK_ROWS)), -(-partitions(rows.sparkSession) // shards) if n > 50 * shards else 1)
    edges = splitters(placed, shards, per_shard)
    starts = [0, *(r for _, _, r in edges)]
    spec = [_key(k) for k, _, _ in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(spec, "S32")
        for b in batches:
            block = np.searchsorted(bounds, np.array(b.column("_key").to_pylist(), "S32"), "right") if len(bounds) else np.zeros(b.num_rows, np.int64)
            first = np.array([starts[i] - starts[i // per_shard * per_shard] for i in range(len(starts))], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int64()), pa.array(first[block], pa.int64())], names=[*b.schema.names, "_block", "_first"])

    dealt = placed.mapInArrow(run, T.StructType([*placed.schema.fields]).add("_block", "long").add("_first", "long"))
    order = W.partitionBy("_block").orderBy("_key")
    slot = F.col("_first") + F.row_number().over(order) - 1
    return dealt.withColumn("slot", slot).withColumn("shard", F.floor(F.col("_block") / per_shard).cast("int")).drop("_key", "_block", "_first")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every document."""
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_group"))
    out = shard(rows, shards, "_group", ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
