"""MinHash near-dedup as a chosen-path set similarity join.

A document is the set of its 5-word shingles. Equal sets become one class. Each of TREES independent trees sends classes
down by selected minwise tokens: a node has one function, and one in three has a second; each of its classes goes to the
children named by its minwise tokens of these. So a class is in 4/3 children on average, and a pair of similarity 0.75 stays
together in one child on average, however deep a tree gets. With p(0) = 1 and p(d) = p(d - 1) - 3/16 p(d - 1)^2, a tree
holds such a pair together at depth d with probability 0.75 p(d - 1): 0.75 at depth 1, 0.45 at 4, 0.21 at MAX_LEVELS. TREES
trees find a link at the threshold with 0.99 at least if its node is still large at MAX_LEVELS, with 0.9999 at depth 5.

A node is small if it has at most LEAF classes, or at most LEAF outside its main component; these, its leads, are compared
with the whole node, in cells of bounded size. Others branch, LEVELS levels at a time: a class's paths follow from its
signature alone, and of the nodes on them those count whose ancestors are all large. Nodes that are large at MAX_LEVELS are compared
whole, every two parts in a cell of their own. Only components are wanted, so nodes whose classes are all in one component have nothing
left to find, and only pairs whose ends have different labels (components as far as known) are compared. That loses no
component. A pair that shares several small nodes is compared in the least of them.

To know components early, the classes of first nodes of some trees first meet the smallest one, and those of large first
nodes then meet HUBS of their classes, HUB_ROUNDS times; groups of near copies become few labels at linear cost.

Comparing goes by sketch (one byte of each of the minwise values; pairs whose estimate is under SKETCH_FLOOR, about five
deviations below the threshold, are left out: about one link at exactly 0.75 in a million), then every remaining pair is
confirmed on its full sets.

Nulls: rows with a null id take no part in links; their component is null and they stay. A null or empty text has an
empty set, which is linked with nothing. Rows that repeat an id share its component if their texts are linked. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mixed, pieces, runs, texts
from .components import components, contracted

WORDS, PERCENT = 5, 75
TREES, MAX_LEVELS = 20, 12
#: Minwise values of a class that are computed at once: two functions for each tree at LEVELS levels, and some for the sketch.
WIDTH, LEVELS = 128, 3
LEAF = 256
#: Rows of a cell, besides those that meet all of them.
CELL = 1024
#: So many of a large first node's classes meet all the others before it branches, so often, in so many trees.
HUBS, HUB_ROUNDS, HUB_TREES = 16, 2, 4
SKETCH_FLOOR = 0.5625
#: Leads whose sets a task holds while the texts that they may be linked with pass by.
RUN = 32


def shingles(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than k make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes.of(words), min(k, len(words))))


def _functions(block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """WIDTH hash functions; block 0 is for the first LEVELS levels, 1 for the next ones."""
    rng = np.random.default_rng([20240601, block])
    return rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, WIDTH, dtype=np.uint64)


def minwise(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each hash function over the set, in blocks of bounded size."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            block = s[i : i + 2048]
            np.minimum(out, ((a[:, None] * block[None, :] + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("sig", pa.list_(pa.int32())), ("sketch", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (a, b) = WordHashes(), _functions()
    for batch in pieces(batches):
        n, cid, sig, sketch = [], [], [], []
        for t in texts(batch.column("text")):
            s = shingles(t.lower().split(), hashes)
            m = minwise(s, a, b)
            n.append(len(s))
            cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            sig.append(m.view(np.int32))
            sketch.append((m >> np.uint32(7)).astype(np.uint8).tobytes())
        flat = pa.ListArray.from_arrays(np.arange(0, (len(sig) + 1) * len(a), len(a), dtype=np.int32), pa.array(np.concatenate(sig)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), flat, pa.array(sketch, pa.binary())], schema=SIGNED)


def _signatures(block: int):
    """(cid, text) to (cid, sig) by the functions of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _functions(block)
        for batch in pieces(batches):
            flat = np.concatenate([minwise(shingles(t.lower().split(), hashes), a, b).view(np.int32) for t in texts(batch.column("text"))])
            sig = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), sig], names=["cid", "sig"])

    return run


def _first_nodes(classes: DataFrame) -> DataFrame:
    """(node, cid, tree, hub): first-level nodes of several classes; hub is the smallest one."""
    trees = classes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    rows = trees.select("cid", "tree", F.xxhash64("tree", F.get("sig", 2 * F.col("tree"))).alias("node"))
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("c"), F.min("cid").alias("hub")).filter("c > 1").select("node", "hub"), "node")


def _paths(large: DataFrame, signed: DataFrame, level: int, steps: int) -> DataFrame:
    """(cid, tree, path, first): the nodes of the next levels that a class goes to, one row for each last one.

    Paths of a class that begin alike share nodes; a path accounts for those from position first on, so each node has each class
    once. large: (node, cid, tree) at the level; signed: (cid, sig) of the level's block.
    """
    values = [F.get("sig", 2 * F.col("tree") + 2 * TREES * ((level + i) % LEVELS) + j) for i in range(steps) for j in (0, 1)]
    rows = large.join(signed, "cid").select("cid", "tree", "node", F.array(*values).alias("own"), F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("first"))
    for i in range(steps):
        more = F.pmod(F.xxhash64("node", F.lit("more")), F.lit(3)) == 0
        both = F.array(F.xxhash64("node", F.lit(0), F.get("own", F.lit(2 * i))), F.xxhash64("node", F.lit(1), F.get("own", F.lit(2 * i + 1))))
        rows = rows.select("cid", "tree", "own", "path", "first", F.posexplode(F.when(more, both).otherwise(F.slice(both, 1, 1))).alias("at", "node"))
        rows = rows.select("cid", "tree", "own", "node", F.concat("path", F.array("node")).alias("path"), F.when(F.col("at") > 0, i).otherwise(F.col("first")).alias("first"))
    return rows.select("cid", "tree", "path", "first")


def _on_paths(paths: DataFrame) -> DataFrame:
    """(node, cid, tree, at, above): each node of each class once; at is its place on the path, above the node before it."""
    rows = paths.select("cid", "tree", "path", F.explode(F.sequence(F.col("first"), F.size("path") - 1)).alias("at"))
    return rows.select(F.get("path", "at").alias("node"), "cid", "tree", "at", F.get("path", F.col("at") - 1).alias("above"))


def _reached(rows: DataFrame, steps: int) -> DataFrame:
    """Rows of nodes all of whose ancestors on the path are large; a class has few nodes in a tree. rows: those of _apart, with at and above."""
    own = rows.groupBy("cid", "tree").agg(F.collect_list(F.struct("node", "at", "above", "label", "c", "x", "lead", "large")).alias("own"))

    def below(parents):
        ids = F.transform(F.filter(parents, lambda r: r["large"]), lambda r: r["node"])
        return F.filter("own", lambda r: (r["at"] > 0) & F.array_contains(ids, r["above"]))

    levels = [F.filter("own", lambda r: r["at"] == 0)]
    for _ in range(steps - 1):
        levels.append(below(levels[-1]))
    return own.select("cid", "tree", F.explode(F.concat(*levels)).alias("r")).select("cid", "tree", "r.*")


def _apart(rows: DataFrame) -> DataFrame:
    """rows (node, cid, tree, label) of nodes that hold several labels, with c (classes), x (classes without the main label), lead (is one of these), large; other columns stay."""
    each = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    nodes = each.groupBy("node").agg(F.sum("n").alias("c"), F.max(F.struct("n", "label")).alias("most")).filter("c > most.n")
    known = nodes.select("node", "c", (F.col("c") - F.col("most.n")).alias("x"), F.col("most.label").alias("main"))
    large = (F.col("c") > LEAF) & (F.col("x") > LEAF)
    return rows.join(known, "node").withColumn("lead", F.col("label") != F.col("main")).withColumn("large", large).drop("main")


def _with_hubs(large: DataFrame, time: int) -> DataFrame:
    """Rows of large nodes, HUBS of each node as its leads; others each time."""
    part, least = F.pmod(F.xxhash64("cid", F.lit(time)), F.lit(HUBS)), F.struct(F.xxhash64("cid", F.lit(-time)), "cid")
    hubs = large.groupBy("node", part.alias("part")).agg(F.min(least).alias("h")).select("node", F.col("h.cid").alias("cid"), F.lit(True).alias("is"))
    return large.drop("lead").join(hubs, ["node", "cid"], "left").withColumn("lead", F.coalesce("is", F.lit(False))).drop("is")


def _cells(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows by cell, in which leads meet others, and each other where they are at home. rows: (node, cid, label, lead, c, whole).

    Leads are in every cell of their node, others in one, which is a lead's home too. Of nodes to compare whole, every two parts
    have a cell, in which one part leads; each part also has one for itself.
    """
    n = F.ceil(F.col("c") / CELL).cast("int")
    own = F.pmod(F.xxhash64("cid", "node"), F.ceil(F.col("c") / CELL)).cast("int")
    columns = ["node", "cid", "label"]
    some = rows.filter("NOT whole").select(F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))).alias("part"), own.alias("own"), *columns, "lead")
    some = some.select(F.xxhash64("node", "part").alias("cell"), *columns, "lead", (F.col("part") == F.col("own")).alias("home"))
    parts = rows.filter("whole").select(F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), own.alias("own"), *columns)
    cell, itself = F.xxhash64("node", F.least("own", "part"), F.greatest("own", "part")), F.col("part") == F.col("own")
    whole = parts.select(cell.alias("cell"), *columns, (F.col("own") <= F.col("part")).alias("lead"), itself.alias("home"))
    return some.unionByName(whole).join(known, "cid").select("cell", *columns, "lead", "home", "n", "sketch", "nodes")


RUNS = "run long, first boolean, cid long, label long, leads array<long>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For RUN leads of a cell at a time: those that sizes and sketches allow a link with another label, and the classes in question, each with its leads.

    Rows come by cell. Pairs that share a lesser node are left to that node.
    """
    ones, floor = np.uint64(0x0101010101010101), int(np.ceil(SKETCH_FLOOR * WIDTH))

    def of(cell: int, node: int, cid, label, lead, home, n, sk, nodes: pa.ListArray) -> Iterator[tuple]:
        flat, ends = nodes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(nodes.value_lengths().to_numpy())))
        less = flat < node
        leads = np.flatnonzero(lead)
        for part in range(0, len(leads), RUN):
            own = leads[part : part + RUN]
            likely = np.zeros((len(own), len(cid)), bool)
            for row, i in zip(likely, own, strict=True):
                once = ~lead | ((cid > cid[i]) & home)
                at = np.flatnonzero((label != label[i]) & once & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
                # Each byte of the eight-byte sums counts up to WIDTH / 8 places; the product adds the bytes up.
                with np.errstate(over="ignore"):
                    at = at[((sk[at] == sk[i]).view(np.uint64).sum(axis=1) * ones) >> np.uint64(56) >= floor]
                mine = flat[ends[i] : ends[i + 1]]
                mine = mine[mine < node]
                if len(at) and len(mine):
                    shared = np.concatenate(([0], np.cumsum(np.isin(flat, mine) & less)))
                    at = at[shared[ends[at + 1]] == shared[ends[at]]]
                row[at] = True
            used, met = own[likely.any(axis=1)], np.flatnonzero(likely.any(axis=0))
            if len(met):
                run = xxhash.xxh3_64_intdigest(int(cell).to_bytes(8, "little", signed=True), part) - (1 << 63)
                of_met, by = np.nonzero(likely[:, met].T)
                at = np.concatenate((used, met))
                sizes = np.concatenate((np.zeros(len(used), np.int64), np.bincount(of_met, minlength=len(met))))
                yield np.full(len(at), run), np.arange(len(at)) < len(used), cid[at], label[at], sizes, cid[own[by]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        run, first, cid, label, sizes, leads = (np.concatenate(x) for x in zip(*out, strict=True))
        of = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(leads))
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(first), pa.array(cid), pa.array(label), of], names=["run", "first", "cid", "label", "leads"])

    for t in _whole(batches, "cell"):
        cell, node, cid, label, n = (t.column(c).to_numpy() for c in ("cell", "node", "cid", "label", "n"))
        lead, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("lead", "home"))
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cell), -1)
        nodes = t.column("nodes").combine_chunks()
        bounds, out = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)], []
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                out += of(cell[s], node[s], cid[s:e], label[s:e], lead[s:e], home[s:e], n[s:e], sk[s:e], nodes.slice(s, e - s))
            if sum(len(x[0]) for x in out) > 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no run of equal keys is cut. Rows come by key."""
    rest = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            keys = t.column(key).to_numpy()
            cut = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if keys[0] != keys[-1] else 0
            if cut:
                yield t.slice(0, cut)
            rest = t.slice(cut)
    if rest is not None:
        yield rest


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run, but for those between labels that others of them have joined. Rows come by run, leads first."""
    hashes, run, sets, up = WordHashes(), None, {}, {}

    def top(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        return x

    for batch in pieces(batches, 256):
        a, b = [], []
        for r, first, cid, label, leads, t in zip(*(batch.column(c).to_pylist() for c in ("run", "first", "cid", "label", "leads")), texts(batch.column("text")), strict=True):
            if r != run:
                run, sets, up = r, {}, {}
            own = shingles(t.lower().split(), hashes)
            if first:
                sets[cid] = label, own
                continue
            for x in leads:
                other, theirs = sets[x]
                if top(other) != top(label):
                    both = len(np.intersect1d(theirs, own, assume_unique=True))
                    if 100 * both >= PERCENT * (len(theirs) + len(own) - both):
                        up[top(label)] = top(other)
                        a.append(x)
                        b.append(cid)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_dup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = scratch.save(rows.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, cid long, sig array<int>, sketch binary"))
    members = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = members.groupBy("cid").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "sig", "sketch")).alias("x"))
    classes = scratch.save(firsts.select("cid", "x.*"))
    nodes = scratch.save(_first_nodes(classes))
    ids = nodes.select("cid").distinct().join(classes.select("cid", "doc_id", "text_key"), "cid")
    bodies = scratch.save(rows.join(ids, ["doc_id", "text_key"]).select("cid", "text").dropDuplicates(["cid"]))
    known = classes.select("cid", F.col("n_shingles").alias("n"), "sketch")
    edges = labels = None

    def labelled(some: DataFrame) -> DataFrame:
        return some.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    def compare(some: DataFrame, met: DataFrame | None = None) -> DataFrame:
        """The links of leads and other classes of their nodes, with the edges known before. met: (cid, nodes), where pairs may meet earlier."""
        each = known.withColumn("nodes", F.array().cast("array<bigint>")) if met is None else known.join(met, "cid")
        runs = _cells(some, each).repartition("cell").sortWithinPartitions("cell").mapInArrow(_runs, RUNS)
        found = runs.join(bodies, "cid").select("run", "first", "cid", "label", "leads", "text").repartition("run").sortWithinPartitions("run", F.desc("first"))
        own = scratch.save(found.mapInArrow(_confirm, "a long, b long"))
        return own if edges is None else own.unionByName(edges)

    def learn(links: DataFrame) -> None:
        nonlocal edges, labels
        edges = contracted(links, scratch)
        labels = edges.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("label"))

    # First each class with the smallest one of its node, which joins most of what belongs together.
    some = nodes.filter(F.col("tree") < HUB_TREES)
    sized = some.join(some.groupBy("node").agg(F.count("*").alias("c")), "node")
    learn(compare(sized.select("node", "cid", F.col("cid").alias("label"), (F.col("cid") == F.col("hub")).alias("lead"), "c", F.lit(False).alias("whole"))))

    # Then the classes of large first nodes with hubs.
    first = nodes.select("node", "cid", "tree")
    here = scratch.save(_apart(labelled(first)))
    for time in range(1, HUB_ROUNDS + 1):
        large = here.filter(F.col("large") & (F.col("tree") < HUB_TREES))
        if large.isEmpty():
            break
        learn(compare(_with_hubs(large, time).withColumn("whole", F.lit(False))))
        here = scratch.save(_apart(labelled(first)))

    # Down the trees.
    columns, level, sign = ["node", "cid", "label", "lead", "c"], 1, classes.select("cid", "sig")
    large, ends = here.filter("large"), [here.filter("NOT large")]
    while level < MAX_LEVELS and not large.isEmpty():
        if level % LEVELS == 0:
            own = bodies.join(large.select("cid").distinct(), "cid", "left_semi").select("cid", "text")
            sign = scratch.save(own.mapInArrow(_signatures(level // LEVELS), "cid long, sig array<int>"))
        steps = min(LEVELS - level % LEVELS, MAX_LEVELS - level)
        paths = scratch.save(_paths(large.select("node", "cid", "tree"), sign, level, steps))
        here = scratch.save(_reached(_apart(labelled(_on_paths(paths))), steps))
        level += steps
        large = here.filter(F.col("large") & (F.col("at") == steps - 1))
        ends.append(here.filter("NOT large"))
    small = reduce(DataFrame.unionByName, [e.select(*columns, F.lit(False).alias("whole")) for e in ends])
    met = small.unionByName(large.select(*columns, F.lit(True).alias("whole")))
    joined = components(compare(met, met.groupBy("cid").agg(F.collect_list("node").alias("nodes"))), scratch)

    labels = classes.select("cid", "doc_id").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    heads = labels.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_class = labels.join(heads, "label").select("cid", "component")
    found = signed.select("doc_id", "text_key", "n_shingles", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = found.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def kept(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    stay = near_dup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (F.xxhash64(docs["text"].cast("string")) == stay["_key"]), "left_semi")
