"""Repeated windows by winnowed anchors: what the two substring operators share.

A window of n units (bytes or words) holds an anchor: the k-gram with the least hash among those of the window, so equal
windows hold equal anchors at equal distances. Only occurrences of an anchor that occurs more than once can lie in a
repeated window. They are grouped by anchor and context (everything that a window around the anchor can reach): equal
contexts need no comparison, so groups of copies shrink to one row before anything is compared. The different contexts
of one anchor are then resolved by the operator's own method; where an anchor has more than LIMIT of them, windows are
counted by their hashes instead, which is exact and parts the group.

A document is told by its id and the hash of its text (did, uid), so rows that repeat both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged, pieces, texts, window_minima

#: Stands for a null id, and so comes first.
NO_ID = -(1 << 63)
#: Different contexts of one anchor that are compared with one another in a task.
LIMIT = 512


@dataclass(frozen=True)
class Unit:
    """make gives a function of a text: its units' hashes of each k (grams), the bytes of a slice (raw), and digests of
    contexts at some positions (start, end, units before the anchor)."""

    window: int
    gram: int
    make: Callable[[], Callable[[bytes], tuple[np.ndarray, Callable[[int, int], bytes], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]]]

    @property
    def reach(self) -> int:
        return self.window - self.gram


def documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("uid"), "text")


def context(pos: int, n: int, unit: Unit) -> tuple[int, int]:
    return max(0, pos - unit.reach), min(n, pos + unit.window)


ANCHORS = "anchor long, digest long, did long, uid long, pos int"


def anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unit.make()
        for batch in pieces(batches, 128):
            found, digests, places, counts = [], [], [], []
            for t in texts(batch.column("text")):
                grams, _, digest = split(t)
                at = window_minima(grams, unit.reach + 1)
                n = len(grams) + unit.gram - 1
                found.append(grams[at])
                digests.append(digest(np.maximum(at - unit.reach, 0), np.minimum(at + unit.window, n), np.minimum(at, unit.reach)))
                places.append(at)
                counts.append(len(at))
            did, uid = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("did", "uid"))
            cols = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(digests).view(np.int64)), pa.array(did), pa.array(uid), pa.array(np.concatenate(places).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "digest", "did", "uid", "pos"])

    return rows.select("did", "uid", "text").mapInArrow(run, ANCHORS)


def repeated(rows: DataFrame, unit: Unit, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Occurrences of repeated anchors, once each; and their contexts: anchor, digest, first, n, contexts, least_n."""
    found = scratch.save(anchors(rows, unit))  # written, as it is read twice and costs more than it takes
    again = found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    places = scratch.save(found.join(again, "anchor", "left_semi"))
    scratch.drop(found)
    own = places.groupBy("anchor", "digest").agg(F.min(F.struct("did", "uid", "pos")).alias("first"), F.max(F.struct("did", "uid", "pos")).alias("last"), F.count("*").alias("n"))
    own = own.withColumn("n", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("n"))).drop("last")
    groups = own.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least_n"))
    return places, scratch.save(own.join(groups, "anchor"))


SEGMENTS = "anchor long, digest long, n long, did long, uid long, pos int, hot boolean, segment binary"


def segments(rows: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """wanted: contexts, told by their first places; each with the bytes of its context."""
    per_doc = wanted.select("first.did", "first.uid", F.struct("anchor", "digest", "n", F.col("first.pos").alias("pos"), (F.col("contexts") > LIMIT).alias("hot")).alias("x")).groupBy("did", "uid").agg(F.collect_list("x").alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unit.make()
        for batch in pieces(batches, 32):
            out = []
            for did, uid, t, xs in zip(batch.column("did").to_pylist(), batch.column("uid").to_pylist(), texts(batch.column("text")), batch.column("xs").to_pylist(), strict=True):
                grams, raw, _ = split(t)
                n = len(grams) + unit.gram - 1
                out += [(x["anchor"], x["digest"], x["n"], did, uid, x["pos"], x["hot"], raw(*context(x["pos"], n, unit))) for x in xs]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "digest", "n", "did", "uid", "pos", "hot", "segment"])

    return rows.join(per_doc, ["did", "uid"]).select("did", "uid", "text", "xs").mapInArrow(run, SEGMENTS)


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def all_windows(unit: Unit) -> bytes:
    return packed(np.ones(unit.reach + 1, bool))


def covers(hits: list[dict], unit: Unit, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals of a document that its hits (pos, windows) cover; a bit says how far before the anchor a window starts."""
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join(h["windows"] for h in hits), np.uint8).reshape(len(hits), -1), axis=1)[:, : unit.reach + 1]
    row, before = np.nonzero(bits)
    starts = np.array([h["pos"] for h in hits], np.int64)[row] - before
    starts = np.unique(starts[(starts >= 0) & (starts + unit.window <= n)])
    return merged(starts, starts + unit.window)


def one_window(unit: Unit, before) -> Column:
    """The windows of a verdict that speaks of one window."""
    eye = np.eye(unit.reach + 1, dtype=bool)
    return F.element_at(F.array(*(F.lit(packed(row)) for row in eye)), before + 1)


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (doc_id, did, uid, text) with hits array<struct<pos, windows>> from (did, uid, pos, windows)."""
    per_doc = hits.groupBy("did", "uid").agg(F.collect_list(F.struct("pos", "windows")).alias("hits"))
    return rows.join(per_doc, ["did", "uid"], "left")
