"""Substring dedup over words, by seed and extend.

Documents meet on winnowed anchors of GRAM words. A match is extended to the left and to the right of the anchor; it is
kept if the maximal repeat is of WINDOW words at least, and covers every window of that length inside it. Each place is
compared with earlier places of the same anchor (smaller id, or earlier in the document), so the first occurrence of a
passage stays. Equal contexts are compared once (see seeds); of those, all places but the first are repeats.

Nulls: a null text has no words. A null id comes before all others. Of rows with equal id and equal text neither is
earlier; rows with equal id and different text are ordered by the hash of the text. Texts shorter than a window stay
as they are, with words joined by one space. Extra columns stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds
from .common import Powers, Scratch, WordHashes, pieces, runs, slices, texts

WINDOW, GRAM = 20, 6


def _make():
    hashes, powers = WordHashes(), Powers()

    def split(t: bytes):
        h = hashes.of(t.split())
        return runs(h, GRAM), lambda s, e: h[s:e].tobytes(), lambda s, e, left: slices(h, s, e, left, powers)

    return split


UNIT = seeds.Unit(WINDOW, GRAM, _make)
REACH = UNIT.reach


def _aligned(pos: int, segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words left of the anchor, nearest first, and right of it; places past the text's ends hold what equals nothing."""
    h = np.frombuffer(segment, np.uint64)
    left = min(pos, REACH)
    a, b = h[:left][::-1], h[left + GRAM :]
    return a, b


def extended(left: np.ndarray, right: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, i: int) -> np.ndarray:
    """The windows of context i that a context before it repeats, by how many words they start before the anchor."""

    def common(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        same = x[:i] == x[i]
        return np.minimum(np.where(same.all(axis=1), REACH, same.argmin(axis=1)), np.minimum(n[:i], n[i]))

    most_left, most_right = common(left, left_n), common(right, right_n)
    long = most_left + most_right >= REACH
    mask = np.zeros(REACH + 2, np.int64)
    np.add.at(mask, REACH - most_right[long], 1)
    np.add.at(mask, most_left[long] + 1, -1)
    return np.cumsum(mask[:-1]) > 0


HITS = "did long, uid long, pos int, windows binary"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come by anchor, each anchor's in the order of their first places."""
    group: list[tuple] = []

    def resolved() -> list[tuple]:
        m = len(group)
        left, right = np.zeros((m, REACH), np.uint64), np.zeros((m, REACH), np.uint64)
        left_n, right_n = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i, x in enumerate(group):
            a, b = _aligned(x[4], x[5])
            left[i, : len(a)], right[i, : len(b)], left_n[i], right_n[i] = a, b, len(a), len(b)
        out = []
        for i in range(1, m):
            mask = extended(left, right, left_n, right_n, i)
            if mask.any():
                out.append((*group[i][2:5], seeds.packed(mask)))
        return out

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["did", "uid", "pos", "windows"])

    out: list[tuple] = []
    for b in batches:
        for x in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "did", "uid", "pos", "segment")), strict=True):
            if group and group[0][0] != x[0]:
                out += resolved()
                group.clear()
            if not group or group[-1][:2] != x[:2]:  # else a repeated row has brought a context again
                group.append(x)
        if len(out) > 4096:
            yield batch(out)
            out = []
    if group:
        out += resolved()
    yield batch(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 256):
        out = []
        for anchor, digest, did, uid, pos, segment in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "did", "uid", "pos", "segment")), strict=True):
            left, n = min(pos, REACH), len(segment) // 8
            out += [(anchor, digest, did, uid, pos, before, xxhash.xxh3_128_digest(segment[8 * (left - before) : 8 * (left - before + WINDOW)], before)) for before in range(left + 1) if left - before + WINDOW <= n]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "digest", "did", "uid", "pos", "before", "content"])


def _hot(found: DataFrame) -> DataFrame:
    """Anchors with many contexts: each window that has an earlier place, by its hash."""
    rows = found.select("anchor", "digest", "did", "uid", "pos", "segment").mapInArrow(_windows, "anchor long, digest long, did long, uid long, pos int, before int, content binary")
    first = rows.groupBy("anchor", "content").agg(F.min(F.struct("did", "uid", "pos")).alias("first"))
    late = rows.join(first, ["anchor", "content"]).filter(F.struct("did", "uid", "pos") > F.col("first"))
    return late.select("did", "uid", "pos", seeds.one_window(UNIT, F.col("before")).alias("windows"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 128):
        n_words, removed, sha = [], [], []
        for t, hits in zip(texts(b.column("text")), b.column("hits").to_pylist(), strict=True):
            words = t.split()
            keep, at = [], 0
            for s, e in zip(*(x.tolist() for x in seeds.covers(hits or [], UNIT, len(words))), strict=True):
                keep += words[at:s]
                at = e
            keep += words[at:]
            n_words.append(len(words))
            removed.append(len(words) - len(keep))
            sha.append(hashlib.sha256(b" ".join(keep)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, did, uid, text and hits: which windows of a document start earlier elsewhere."""
    rows = seeds.documents(docs)
    places, contexts = seeds.repeated(rows, UNIT, scratch)
    found = scratch.save(seeds.segments(rows, contexts.filter("contexts > 1"), UNIT))
    cold = found.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "did", "uid", "pos")
    first = scratch.save(cold.mapInArrow(_extend, HITS).unionByName(_hot(found.filter("hot"))))
    later = places.join(contexts.filter("n > 1").select("anchor", "digest", "first"), ["anchor", "digest"]).filter(F.struct("did", "uid", "pos") != F.col("first"))
    return seeds.with_hits(rows, first.unionByName(later.select("did", "uid", "pos", F.lit(seeds.all_windows(UNIT)).alias("windows"))))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = marked(docs, Scratch(docs.sparkSession)).select("doc_id", "text", "hits")
    return rows.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")
