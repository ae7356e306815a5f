"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors become one node, so that a very common vector is one point of the graph; its rows come back at the end.
The first graph comes from a few random-projection partitions: rows are ordered by a random direction within random
bucket codes, and every block of that order is compared within itself; one partition at random gives a list to nodes that
are alone in their leaves. Each round of NN-descent then joins every node
with its neighbours and reverse neighbours, compares the neighbours with one another, and keeps each node's best K; it
ends when few lists change. Reverse lists have no bound, so they are cut into blocks of bounded size by hash, which is a
part of NN-descent: pairs that a round misses are met in another.

A query starts from nodes of the graph that its own vector suggests and, round by round, joins the neighbours of its best
nodes, and the nodes that have these among their BACK nearest, until its best BEAM no longer change. A query's beam is one row.
A node's list is a row too, with the vectors of those that it leads to, and stays in its bucket: what a hop shuffles are the queries' vectors,
to the nodes that they open, and the few answers that belong into a beam. How wide the beam has to be depends on the table, so recall is measured in the run: for
SAMPLE queries the nearest nodes are found exactly, by products with all nodes, and as long as less than RECALL of them is
in the beams, all queries go on with beams twice as wide. A doubling that gains nothing ends this with a warning. Scores are inner products in double precision on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids, nor vectors that are not of
the most frequent length (of equally frequent ones, the greater). Nearest of equal score is the smaller id; final scores are
all summed up in one way, component by component, so that equal ones are equal. Rows that repeat an id are different rows.
With fewer candidates than k, all of them come back. Empty tables give empty results; extra columns stay behind.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BASE, Scratch, mixed, partitions

K, BLOCK = 24, 64
TREES, LEAF = 8, 1024
BEAM = 64
#: With more nodes than these beams start wider, by the root of their number, as narrower ones would only have to widen.
BEAM_NODES = 12_800
#: Best neighbours of a node that lead the search back to it.
BACK = 8
#: Bytes of vectors in a row of the lists that are searched, and in a group of such rows: what a task holds of them follows these.
PIECE, ROWS_BYTES = 2048, 8 << 20
#: The share of queries that may still go on when a search is asked whether its beams are wide enough.
FEW = 0.2
#: Queries whose nearest are found exactly, and the share of these that the beams have to hold.
SAMPLE, RECALL = 64, 0.95
#: Descent ends when so small a share of the lists' entries is new.
SETTLED = 0.001
#: Rounds or hops after which something must be wrong.
ENDLESS = 200


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bytes(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive values as rows of bytes; size: how many values each row has."""
    values = np.ascontiguousarray(values)
    ends = np.concatenate(([0], np.cumsum(size))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of rows of bytes, and how many each row has."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // width, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, kind)
    return flat, np.diff(ends) // width


def packed(nodes: DataFrame, kind: str) -> DataFrame:
    """id and v as bytes: float32 (kind <f4) loses nothing where the table has floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), _bytes(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind), size)], names=["id", "v"])

    return nodes.select("id", "v").mapInArrow(run, "id long, v binary")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of these, of rows that come in order of key."""
    rest = None
    for b in _ended(batches):
        t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        rest = None
        if t is None or not t.num_rows:
            continue
        t = t.combine_chunks()
        g = t.column(key).to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
        if b is not None:
            rest, bounds = t.slice(bounds[-2]), bounds[:-1]
        if len(bounds) > 1:
            yield t.slice(0, bounds[-1]), bounds


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _top(src: np.ndarray, dst: np.ndarray, score: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best pairs of each src, in order of src and score; of equal pairs the one that isn't fresh."""
    order = np.lexsort((-score, fresh, dst, src))
    s, d = src[order], dst[order]
    order = order[np.concatenate((np.ones(min(len(s), 1), bool), (s[1:] != s[:-1]) | (d[1:] != d[:-1])))]
    order = order[np.lexsort((dst[order], -score[order], src[order]))]
    s = src[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


#: A node's list as bytes: int64 ids and float64 scores.
LISTS = "id long, ids binary, scores binary"


def _listing(src: np.ndarray, dst: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    keep = _top(src, dst, score, np.zeros(len(src), np.int8), k)
    ids, size = np.unique(src[keep], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), _bytes(dst[keep], size), _bytes(score[keep], size)], names=["id", "ids", "scores"])


def _within(k: int, dim: int, kind: str):
    """Rows come by leaf: (leaf, id, v). Each leaf's nodes are compared; every node keeps its k best there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, "leaf"):
            ids, v = t.column("id").to_numpy(), _values(t.column("v"), kind)[0].astype(float).reshape(-1, dim)
            for s, e in zip(bounds, bounds[1:], strict=False):
                kk = min(k, e - s - 1)
                if kk <= 0:
                    continue
                scores = v[s:e] @ v[s:e].T
                np.fill_diagonal(scores, -np.inf)
                at = np.argpartition(scores, e - s - kk, axis=1)[:, -kk:]
                got = np.take_along_axis(scores, at, 1)
                size = np.full(e - s, kk)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), _bytes(ids[s:e][at].ravel(), size), _bytes(got.ravel(), size)], names=["id", "ids", "scores"])

    return run


def _joined(k: int, dim: int, kind: str):
    """Rows come by hub: (hub, id, v, fresh, floor). Each hub's nodes are compared: pairs of two known neighbours have been compared
    before, and what is under a node's floor is of no use to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, "hub"):
            ids, v = t.column("id").to_numpy(), _values(t.column("v"), kind)[0].astype(float).reshape(-1, dim)
            new, floor = t.column("fresh").to_numpy().astype(bool), t.column("floor").to_numpy()
            out = []
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                scores = v[s:e] @ v[s:e].T
                np.fill_diagonal(scores, -np.inf)
                useful = scores > floor[s:e, None]
                useful[~new[s:e]] &= new[s:e]
                a, b = np.nonzero(useful)
                if len(a):
                    out.append((a + s, b + s, scores[a, b]))
            if out:
                a, b, score = (np.concatenate(c) for c in zip(*out, strict=True))
                yield _listing(ids[a], ids[b], score, k)

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list for each node of lists (id, ids, scores, fresh: 1 if just found), best first, with which entries are new and the score to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _groups(batches, "id"):
            dst, n = _values(t.column("ids"), "<i8")
            src, score, fresh = np.repeat(t.column("id").to_numpy(), n), _values(t.column("scores"), "<f8")[0], np.repeat(t.column("fresh").to_numpy().astype(np.int8), n)
            keep = _top(src, dst, score, fresh, k)
            ids, size = np.unique(src[keep], return_counts=True)
            ends = np.cumsum(size)
            floor = np.where(size < k, -np.inf, score[keep][ends - 1])
            new = np.add.reduceat(fresh[keep].astype(np.int64), ends - size) if len(ends) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _bytes(dst[keep], size), _bytes(score[keep], size), _bytes(fresh[keep], size), pa.array(floor), pa.array(size), pa.array(new)], names=["id", "ids", "scores", "fresh", "floor", "n", "new"])

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(run, f"{LISTS}, fresh binary, floor double, n long, new long")


def _leaves(nodes: DataFrame, n: int, dim: int, kind: str) -> DataFrame:
    """(leaf, id, v): TREES partitions of the nodes by random projections; a leaf holds about LEAF nodes."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    rng = np.random.default_rng(11)
    planes = rng.standard_normal((TREES, depth, dim))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for b in batches:
            total += _values(b.column("v"), kind)[0].astype(float).reshape(-1, dim).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["i", "x"])

    def coded(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                centred = _values(b.column("v"), kind)[0].astype(float).reshape(-1, dim) - middle
                bits = (centred @ planes.reshape(-1, dim).T > 0).reshape(len(centred), TREES, depth)
                code = (bits * 2 ** np.arange(depth)[::-1]).sum(2)
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(code[:, t] * TREES + t), *(b.column(c) for c in names)], names=["leaf", *names])

        return run

    mean = nodes.select("v").mapInArrow(summed, "i long, x double").groupBy("i").agg((F.sum("x") / max(n, 1)).alias("m")).orderBy("i").collect()  # one row for each dimension
    middle = np.array([r["m"] for r in mean])
    # Codes are uneven: full ones are cut by hash into blocks that stay comparable within themselves.
    sizes = nodes.select("v").mapInArrow(coded([]), "leaf long").groupBy("leaf").agg(F.count("*").alias("c"))  # TREES rows for LEAF nodes
    by_code = nodes.select("id", "v").mapInArrow(coded(["id", "v"]), "leaf long, id long, v binary").join(F.broadcast(sizes), "leaf").select(F.xxhash64("leaf", F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("c") / (2 * LEAF)))).alias("leaf"), "id", "v")
    at_random = nodes.select(F.xxhash64(F.lit("any"), F.pmod(F.xxhash64("id"), F.lit(-(-n // LEAF) or 1))).alias("leaf"), "id", "v")
    return by_code.unionByName(at_random)


def _both_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whose neighbourhood each node of a list belongs to: (hub, ids, fresh), by list and, the other way, by listed node."""
    for b in batches:
        dst, n = _values(b.column("ids"), "<i8")
        src, fresh = np.repeat(b.column("id").to_numpy(), n), _values(b.column("fresh"), "i1")[0]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), b.column("fresh")], names=["hub", "ids", "fresh"])
        order = np.argsort(dst, kind="stable")
        hubs, size = np.unique(dst, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hubs), _bytes(src[order], size), _bytes(fresh[order], size)], names=["hub", "ids", "fresh"])


def _blocks(turn: int):
    """Neighbourhoods (hub, id, fresh) of rows that come by hub, cut by hash into blocks if there are many; those with nothing new stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _groups(batches, "hub"):
            node, n = _values(t.column("ids"), "<i8")
            hub, fresh = np.repeat(t.column("hub").to_numpy(), n), _values(t.column("fresh"), "i1")[0]
            order = np.lexsort((-fresh, node, hub))  # who is a neighbour both ways comes twice: new if either is
            hub, node, fresh = hub[order], node[order], fresh[order]
            once = np.concatenate((np.ones(min(len(hub), 1), bool), (hub[1:] != hub[:-1]) | (node[1:] != node[:-1])))
            hub, node, fresh = hub[once], node[once], fresh[once]
            _, at, c = np.unique(hub, return_inverse=True, return_counts=True)
            with np.errstate(over="ignore"):
                part = mixed(mixed(node.astype(np.uint64) + np.uint64(turn) * BASE) + hub.astype(np.uint64)) % (-(-c // BLOCK)).astype(np.uint64)[at]
                key = mixed(mixed(hub.astype(np.uint64)) + part * BASE)
            _, at, c = np.unique(key, return_inverse=True, return_counts=True)
            use = (c[at] > 1) & (np.bincount(at, fresh, len(c))[at] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[use]), pa.array(node[use]), pa.array(fresh[use].astype(np.int32))], names=["hub", "id", "fresh"])

    return run


def graph(nodes: DataFrame, n: int, dim: int, scratch: Scratch, kind: str, k: int = K) -> DataFrame:
    """id, ids, scores: each node's k best neighbours, best first, by NN-descent. nodes: id, v, packed as kind; ids are unique."""
    leaves = _leaves(nodes, n, dim, kind).repartition("leaf").sortWithinPartitions("leaf")
    current = scratch.save(_merged(leaves.mapInArrow(_within(k, dim, kind), LISTS).withColumn("fresh", F.lit(1)), k))
    for turn in range(ENDLESS):
        # A node's neighbourhood: its list and the nodes that list it, in blocks if there are many; new pairs only.
        both = current.select("id", "ids", "fresh").mapInArrow(_both_ends, "hub long, ids binary, fresh binary").repartition("hub").sortWithinPartitions("hub")
        dealt = both.mapInArrow(_blocks(turn), "hub long, id long, fresh int")
        known = nodes.join(current.select("id", "floor"), "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        met = dealt.join(known, "id").select("hub", "id", "v", "fresh", "floor").repartition("hub").sortWithinPartitions("hub")
        found = met.mapInArrow(_joined(k, dim, kind), LISTS).withColumn("fresh", F.lit(1))
        after = scratch.save(_merged(found.unionByName(current.select("id", "ids", "scores", F.lit(0).alias("fresh"))), k))
        scratch.drop(current)
        current = after
        changed, total = after.agg(F.sum("new"), F.sum("n")).first()
        if not total or (changed or 0) <= SETTLED * total:
            break
    else:
        raise RuntimeError("neighbour lists have not settled")
    return current.select("id", "ids", "scores")


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node) with their inner products."""
    rows = pairs.join(nodes.select(F.col("id").alias("node"), F.col("v").alias("b")), "node").join(queries.select(F.col("id").alias("query"), F.col("v").alias("a")), "query")
    return rows.select("query", "node", F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))


def both_ways(lists: DataFrame, back: int = BACK) -> DataFrame:
    """src, dst: each node's neighbours, and the nodes that have it among their best back ones. Without these a node that no list holds
    could not be reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dst, n = _values(b.column("ids"), "<i8")
            src = np.repeat(b.column("id").to_numpy(), n)
            best = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) < back
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((src, dst[best]))), pa.array(np.concatenate((dst, src[best])))], names=["src", "dst"])

    return lists.select("id", "ids").mapInArrow(run, "src long, dst long").distinct()


class Ways:
    """Each node's list with the vectors of those that it leads to (id, ids, vs; a long list in pieces), in buckets by node, so that a hop sends only what it asks.

    edges: src, dst. nodes: id, v, packed as kind. The table is known to the session by a name until drop(); its files are in the scratch folder.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, kind: str, scratch: Scratch):
        self.kind, self.spark, self.name = kind, edges.sparkSession, f"ways_{uuid.uuid4().hex}"
        parts = partitions(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, bounds in _groups(batches, "src"):
                v, n = _values(t.column("v"), kind)
                ends = np.concatenate(([0], np.cumsum(n)))
                each = max(1, PIECE // (n[0] * v.itemsize))
                bounds = np.append(np.flatnonzero((np.arange(len(n)) - np.repeat(bounds[:-1], np.diff(bounds))) % each == 0), len(n))
                yield pa.RecordBatch.from_arrays([t.column("src").combine_chunks().take(pa.array(bounds[:-1])), _bytes(t.column("dst").to_numpy(), np.diff(bounds)), _bytes(v, np.diff(ends[bounds]))], names=["id", "ids", "vs"])

        each = edges.join(nodes.select(F.col("id").alias("dst"), "v"), "dst").select("src", "dst", "v").repartition(parts, "src").sortWithinPartitions("src")
        rows = each.mapInArrow(run, "id long, ids binary, vs binary")
        rows.write.format("parquet").bucketBy(parts, "id").option("compression", "none").option("parquet.block.size", ROWS_BYTES).option("path", f"{scratch.base}/{self.name}").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


STATE = "query long, v binary, nodes array<long>, scores array<double>, open array<int>"


def _lists(x: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(i) for i in x]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Each row of a list column."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)[:-1]) if len(n) else []


def state(queries: DataFrame, entries: DataFrame, kind: str = "<f8") -> DataFrame:
    """A row for each query: its vector, and its entries (query, node, score), none of them open yet."""
    each = entries.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))).alias("e"))
    rows = each.join(packed(queries, kind).withColumnRenamed("id", "query"), "query")
    return rows.select("query", "v", F.col("e.node").alias("nodes"), F.transform("e.s", lambda s: -s).alias("scores"), F.transform("e.s", lambda s: F.lit(1)).alias("open"))


def _entered(queries: DataFrame, lists: DataFrame, kind: str) -> DataFrame:
    """A state of queries that are nodes: each enters the graph at itself and at its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, size = _values(b.column("v"), kind)
            ids, n = _values(b.column("ids").fill_null(b""), "<i8")
            scores, cuts, out = _values(b.column("scores").fill_null(b""), "<f8")[0], np.cumsum(n)[:-1], []
            for q, v, i, s in zip(b.column("id").to_numpy(), np.split(own.astype(float), np.cumsum(size)[:-1]), np.split(ids, cuts), np.split(scores, cuts), strict=True):
                i, s = np.append(i, q), np.append(s, v @ v)
                order = np.lexsort((i, -s))
                out.append((i[order], s[order], np.ones(len(i), np.int32)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), *(_lists(list(c), t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int32()), strict=True))], names=["query", "v", "nodes", "scores", "open"])

    return queries.join(lists, "id", "left").select("id", "v", "ids", "scores").mapInArrow(run, STATE)


def search(queries: DataFrame, entries: DataFrame, edges: DataFrame | Ways, nodes: DataFrame, scratch: Scratch, beam: int = BEAM, enough: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """(query, node, score): the best nodes found by greedy search from entries (query, node, score), no two equal. queries: id, v.

    The beam's nodes are opened; as many again are kept behind it, open or not, so that a wider search goes on from them: entries may
    also be a state(), which then comes back. edges: src, dst, or Ways, which stay where they are: a query's vector goes to the lists of the
    nodes that it opens, and only those that belong into its beam come back. enough(state): whether a search of which few queries
    still go on is worth its last hops; otherwise it ends there, for a wider one to go on.
    """
    if not isinstance(edges, Ways):
        own = Ways(edges, packed(nodes, "<f8"), "<f8", scratch)
        try:
            return search(queries, entries, own, nodes, scratch, beam, enough)
        finally:
            own.drop()
    if "nodes" not in entries.columns:
        best = search(queries, scratch.save(state(queries, entries, edges.kind)), edges, nodes, scratch, beam, enough)
        return best.select("query", F.explode(F.arrays_zip("nodes", "scores")).alias("r")).select("query", F.col("r.nodes").alias("node"), F.col("r.scores").alias("score"))
    kind = edges.kind

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ask = [n[:beam][o[:beam] == 1] for n, o in zip(_rows(b.column("nodes")), _rows(b.column("open")), strict=True)]
            floors = np.array([s[2 * beam - 1] if len(s) >= 2 * beam else -np.inf for s in _rows(b.column("scores"))])
            of, all_ = np.repeat(np.arange(len(ask)), [len(a) for a in ask]), np.concatenate([np.empty(0, np.int64), *ask])
            for i in range(0, len(of), 10_000):
                at = pa.array(of[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(all_[i : i + 10_000]), b.column("query").take(at), pa.array(floors).take(at), b.column("v").take(at)], names=["id", "query", "floor", "q"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = _values(b.column("ids"), "<i8")
            vs, asks = _values(b.column("vs"), kind)[0], b.column("asks")
            m = asks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            asks = asks.flatten()
            query, floor, q = asks.field("query").to_numpy(), asks.field("floor").to_numpy(), _values(asks.field("q"), kind)[0].astype(float)
            vs, q = vs.reshape(len(ids), -1), q.reshape(len(query), -1)
            out, a, s = [], 0, 0
            for size, own in zip(n.tolist(), m.tolist(), strict=True):
                scores = vs[a : a + size].astype(float) @ q[s : s + own].T
                at, by = np.nonzero(scores >= floor[s : s + own])
                if len(at):
                    out.append((at + a, by + s, scores[at, by]))
                a, s = a + size, s + own
            if out:
                at, by, score = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.argsort(query[by], kind="stable")
                who, size = np.unique(query[by], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(who), _bytes(ids[at][order], size), _bytes(score[order], size)], names=["query", "ids", "more"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, s, o, ids, more in zip(*(_rows(b.column(c)) for c in ("nodes", "scores", "open")), b.column("ids").to_pylist(), b.column("more").to_pylist(), strict=True):
                n, s = np.concatenate([n, *(np.frombuffer(x, "<i8") for x in ids or ())]), np.concatenate([s, *(np.frombuffer(x, "<f8") for x in more or ())])
                o = np.concatenate((np.where(np.arange(len(o)) < beam, 0, o), np.ones(len(n) - len(o), np.int32)))
                n, first = np.unique(n, return_index=True)  # what the state has comes first
                s, o = s[first], o[first]
                order = np.lexsort((n, -s))[: 2 * beam]
                out.append((n[order], s[order], o[order]))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("v"), *(_lists(list(c), k) for c, k in zip(cols, (pa.int64(), pa.float64(), pa.int32()), strict=True))], names=["query", "v", "nodes", "scores", "open"])

    turn = F.exists(F.slice("open", 1, beam), lambda o: o == 1)
    best, settled, few = entries, [], int(FEW * entries.count())
    for _ in range(ENDLESS):
        active = best.filter(turn)
        asks = active.mapInArrow(opened, "id long, query long, floor double, q binary")
        of_node = asks.groupBy("id").agg(F.collect_list(F.struct("query", "floor", "q")).alias("asks"))
        met = edges.rows.join(of_node, "id").select("ids", "vs", "asks").mapInArrow(products, "query long, ids binary, more binary")
        found = met.groupBy("query").agg(F.collect_list(F.struct("ids", "more")).alias("r"))
        rows = active.join(found.select("query", F.col("r.ids").alias("ids"), F.col("r.more").alias("more")), "query", "left")
        settled.append(best)
        best = scratch.save(rows.mapInArrow(kept, STATE))
        going, whole = best.filter(turn).count(), reduce(DataFrame.unionByName, [s.filter(~turn) for s in settled], best)
        if going and going <= few and enough is not None:
            going, enough = going if enough(whole) else 0, None
        if not going:
            after = scratch.save(whole)
            scratch.drop(best, *settled[1:])
            return after
    raise RuntimeError("beams have not settled")


def _exact(queries: DataFrame, nodes: DataFrame, dim: int, k: int, kind: str) -> DataFrame:
    """(query, least, n): the score of the k-th nearest node, or of the last one, for SAMPLE queries; n is k or the number of nodes."""
    asked = queries.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    ids, q = np.array([r["id"] for r in asked], np.int64), np.array([np.frombuffer(r["v"], kind) for r in asked], float).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(ids), k), -np.inf)
        for b in batches:
            if b.num_rows:
                top = np.partition(np.concatenate((top, q @ _values(b.column("v"), kind)[0].astype(float).reshape(-1, dim).T), axis=1), -k, axis=1)[:, -k:]
        at = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(top[at])], names=["query", "score"])

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    best = nodes.select("v").mapInArrow(run, "query long, score double").withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))


def _held(best: DataFrame, exact: DataFrame) -> float:
    """The share of the exact queries' nearest nodes that best (a state) holds; sums in another order differ a little."""
    near = best.join(exact, "query").select("n", F.size(F.filter("scores", lambda s: s >= F.col("least") - 1e-9 * F.abs("least"))).alias("c"))
    per = near.agg(F.sum(F.least("c", "n"))).first()[0]
    total = exact.agg(F.sum("n")).first()[0]
    return (per or 0) / total if total else 1.0


def widened(queries: DataFrame, lists: DataFrame, nodes: DataFrame, n: int, dim: int, k: int, kind: str, scratch: Scratch) -> DataFrame:
    """(query, node): the k nearest nodes, and those that are as near but for rounding, by search with beams that are doubled until they
    hold RECALL of the k nearest of a sample of the queries. queries, nodes: id, v, packed as kind. lists: as of graph(). Beams start wider where there are more than BEAM_NODES nodes."""
    exact = scratch.save(_exact(queries, nodes, dim, k, kind))
    ways = Ways(both_ways(lists), nodes, kind, scratch)
    try:
        beam = max(k, int(BEAM * max(1.0, (n / BEAM_NODES) ** 0.5)))
        likely = lambda state: _held(state, exact) >= RECALL or beam >= n
        best = search(queries, scratch.save(_entered(queries, lists, kind)), ways, nodes, scratch, beam, likely)
        held = _held(best, exact)
        while held < RECALL and beam < n:
            beam, before = 2 * beam, held
            best = search(queries, best, ways, nodes, scratch, beam, likely)
            held = _held(best, exact)
            if held < RECALL and held - before < 0.002:
                warnings.warn(f"beams of {beam} hold {held:.3f} of the nearest, as narrower ones do", stacklevel=2)
                best = search(queries, best, ways, nodes, scratch, beam)  # to its end
                break
    finally:
        ways.drop()
    least = F.coalesce(F.get("scores", F.lit(k - 1)), F.lit(float("-inf")))
    near = best.withColumn("least", least - 1e-9 * F.abs(least)).select("query", F.explode(F.filter(F.arrays_zip("nodes", "scores"), lambda r: r["scores"] >= F.col("least"))).alias("r"))
    return near.select("query", F.col("r.nodes").alias("node"))


def nearest(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row for which is_query(id) holds."""
    scratch = Scratch(rows.sparkSession)
    valid = scratch.save(usable(rows, key, vector).withColumn("row", F.monotonically_increasing_id()))
    head = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = head[0] if head else 1
    own = valid.filter(F.size("v") == dim)
    # Equal vectors are one node, known by its smallest id; of its rows, the k + 1 smallest ids can be among the nearest.
    classes = own.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("row").alias("id"))
    nodes = scratch.save(classes.select("id", "h", "v"))
    members = scratch.save(own.select("id", "row", F.xxhash64("v").alias("h"), "v").join(nodes.select(F.col("id").alias("node"), "h", "v"), ["h", "v"]).select("node", F.col("id").alias("vec_id"), "row"))
    n = nodes.count()
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    points = scratch.save(packed(nodes, kind))
    lists = graph(points, n, dim, scratch, kind)
    # A query's vector is in the table, so its node and its node's list are where the search enters the graph.
    asked = members.filter(is_query(F.col("vec_id")))
    at = asked.select(F.col("node").alias("id")).distinct()
    pairs = widened(scratch.save(points.join(at, "id", "left_semi")), lists, points, n, dim, k + 1, kind, scratch)
    found = scratch.save(_scored(pairs, nodes.join(at, "id", "left_semi"), nodes))
    order = F.row_number().over(W.partitionBy("node").orderBy("vec_id", "row"))
    near = members.withColumn("r", order).filter(F.col("r") <= k + 1).drop("r")
    listed = found.join(near, "node").select("query", "score", "vec_id", "row")
    few = listed.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("r") <= k + 1).drop("r")
    each = asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"), F.col("row").alias("own")).join(few, "query").filter("row != own")
    rank = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return each.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
