"""A stored inverted index: postings in blocks of points with their greatest count, exact top k that skips blocks, upkeep by batches.

A block holds some BLOCK points (of one value of the locality columns), the same for every token, and a row of the index is a token's
postings in one block with the greatest of its counts. The sum of a query's weights times these maxima bounds the score of every
point of a block. So a search first sums bounds, from three narrow columns; scores the blocks of the greatest bounds; and then
scores only those others whose bound reaches the k-th score so far. Nothing that could be among the k is skipped.

Batches are folders. One that brings points again leaves the older rows where they are, and says which versions are dead; counts of
points and of the points that have a token are kept as differences, which a forward table of the points' tokens gives without
reading postings. A batch that runs again overwrites its own folders. compact() writes the living postings as one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored
from .index import counted
from .search import ranked

#: Points of a block, blocks that each query scores first, and folders that tokens are dealt to.
BLOCK, FIRST, BUCKETS = 128, 8, 16
#: A bound may fall short of a score by so much, as both are rounded sums.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """The tables of an index. blocks: idx, block, batch, most, n, points, tfs. weights: idx, df, idf. dead: point_id, batch."""

    blocks: DataFrame
    weights: DataFrame
    dead: DataFrame
    several: bool


def _folder(path: str, name: str, batch: int) -> str:
    return f"{path}/{name}/batch={batch}"


def _block_rows(points: pa.Table) -> pa.Table:
    """The rows of one block, whose points come with their tokens and counts."""
    lists = points.column("idxs").combine_chunks()
    at = pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()))
    own = pa.table({"idx": lists.flatten(), "point": points.column("point_id").combine_chunks().take(at), "tf": points.column("tfs").combine_chunks().flatten()})
    own = own.sort_by([("idx", "ascending"), ("point", "ascending")]).combine_chunks()
    idx, tf = own.column("idx").to_numpy(), own.column("tf").to_numpy()
    first = np.flatnonzero(np.append(True, idx[1:] != idx[:-1])) if len(idx) else np.empty(0, int)
    ends, n = pa.array(np.append(first, len(idx)).astype(np.int32)), np.diff(np.append(first, len(idx)))
    most = np.maximum.reduceat(tf, first) if len(idx) else tf
    lists_of = lambda c: pa.ListArray.from_arrays(ends, own.column(c).combine_chunks())
    block = np.full(len(first), points.column("block")[0].as_py())
    return pa.table({"idx": idx[first], "block": block, "most": most, "n": n.astype(np.int64), "points": lists_of("point"), "tfs": lists_of("tf"), "bucket": (idx[first] % BUCKETS).astype(np.int32)})


def _blocks(own: DataFrame) -> DataFrame:
    """Rows of the index from point_id, block, idxs, tfs: a block's points meet in one task and are turned to lists of tokens there."""
    kind = own.schema["point_id"].dataType.simpleString()
    some = own.filter(F.size("idxs") > 0).select("point_id", "block", "idxs", "tfs")
    return some.groupBy("block").applyInArrow(_block_rows, f"idx long, block long, most long, n long, points array<{kind}>, tfs array<long>, bucket int")


def _put(rows: DataFrame, path: str, batch: int) -> None:
    """Files of each bucket, sorted by token, so that scans skip row groups. The tasks that made the blocks write them."""
    rows.sortWithinPartitions("bucket", "idx").write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, "blocks", batch))


def _earlier(spark: SparkSession, path: str, name: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").filter(F.col("batch") < batch)


def add(points: DataFrame, path: str, batch: int = 0, locality: tuple[str, ...] = (), deleted: DataFrame | None = None) -> None:
    """Bring points (point_id, text, locality columns) into the index as a batch; deleted: point_id of points that go without new ones.

    Batches are added in ascending order; point ids are unique within one. Points that earlier batches have are replaced.
    """
    spark = points.sparkSession
    n = points.count()
    part = F.pmod(F.xxhash64("point_id"), F.lit(max(1, -(-n // BLOCK))))
    block = F.xxhash64(F.lit(batch), *(F.col(c).cast("string") for c in locality), part)
    counted(points.select("point_id", "text", block.alias("block")), F.col("text"), "block").write.mode("overwrite").parquet(_folder(path, "forward", batch))
    forward = spark.read.parquet(_folder(path, "forward", batch))
    _put(_blocks(forward), path, batch)
    added = forward.select(F.explode("idxs").alias("idx")).groupBy("idx").agg(F.count("*").alias("df"))
    kind = points.schema["point_id"].dataType.simpleString()
    dead, terms, gone = spark.createDataFrame([], f"point_id {kind}, of int"), added, 0
    if batch > 0:
        living = _living(_earlier(spark, path, "forward", batch), _earlier(spark, path, "dead", batch))
        leaving = points.select("point_id") if deleted is None else points.select("point_id").unionByName(deleted.select("point_id"))
        old = stored(living.join(leaving.distinct(), "point_id", "left_semi").select("point_id", "batch", "idxs"))
        dead, gone = old.select("point_id", F.col("batch").alias("of")), old.count()
        removed = old.select(F.explode("idxs").alias("idx")).groupBy("idx").agg((-F.count("*")).alias("df"))
        terms = added.unionByName(removed).groupBy("idx").agg(F.sum("df").alias("df"))
    dead.write.mode("overwrite").parquet(_folder(path, "dead", batch))
    terms.write.mode("overwrite").parquet(_folder(path, "terms", batch))
    spark.createDataFrame([(n - gone,)], "n long").coalesce(1).write.mode("overwrite").parquet(_folder(path, "counts", batch))


def _living(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """rows (point_id, batch, ...) without those versions of points that later batches replaced."""
    own = dead.select(F.col("point_id").alias("_p"), F.col("of").alias("_b"))
    return rows.join(own, (F.col("point_id") == F.col("_p")) & (F.col("batch") == F.col("_b")), "left_anti")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index as its batches have made it."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    n = read("counts").agg(F.sum("n").alias("n_points"))
    df = read("terms").groupBy("idx").agg(F.sum("df").alias("df")).filter("df > 0").crossJoin(F.broadcast(n))  # one row
    weight = F.ln(1 + (F.col("n_points") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    dead, kind = read("dead"), read("forward").schema["point_id"].dataType.simpleString()
    blocks = spark.read.schema(f"idx long, block long, most long, n long, points array<{kind}>, tfs array<long>, batch int, bucket int").parquet(f"{path}/blocks")
    return Index(blocks, df.select("idx", "df", weight.alias("idf")), dead.select("point_id", "of"), bool(dead.limit(1).count()))


def _weighed(index: Index, query_terms: DataFrame) -> DataFrame:
    return query_terms.join(index.weights, "idx").select("query_id", "idx", (F.col("qtf") * F.col("idf")).alias("w"))


def bounds(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, block, bound (of the scores of its points), entries (postings that scoring it reads). asked: query_id, idx, w."""
    met = index.blocks.select("idx", "block", "most", "n").join(asked, "idx")
    return met.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.sum("n").alias("entries"))


def _scored(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, point_id, score of the points in the given blocks of each query."""
    met = index.blocks.select("idx", "block", "batch", "points", "tfs").join(asked, "idx").join(pairs.select("query_id", "block"), ["query_id", "block"])
    rows = met.select("query_id", "batch", "w", F.inline(F.arrays_zip("points", "tfs")))
    hits = rows.groupBy("query_id", F.col("points").alias("point_id"), "batch").agg(F.round(F.sum(F.col("w") * F.col("tfs")), 6).alias("score"))
    return (_living(hits, index.dead) if index.several else hits).filter("score > 0").select("query_id", "point_id", "score")


def search(index: Index, query_terms: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(hits, work). hits: query_id, point_id, score, rank as search.keyword has them. work: query_id, entries (postings of the
    query's tokens), entries_read, blocks, blocks_read. query_terms: query_id, idx, qtf."""
    asked = stored(_weighed(index, query_terms))
    every = stored(ranked(bounds(index, asked), 1 << 30, F.desc("bound"), F.col("block")))
    start = every.filter(F.col("rank") <= first)
    found = stored(ranked(_scored(index, asked, start), k))
    least = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = every.filter(F.col("rank") > first).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    more = _scored(index, asked, rest)
    hits = ranked(found.select("query_id", "point_id", "score").unionByName(more), k)
    read = start.select("query_id", "entries").unionByName(rest.select("query_id", "entries")).groupBy("query_id").agg(F.sum("entries").alias("entries_read"), F.count("*").alias("blocks_read"))
    work = every.groupBy("query_id").agg(F.sum("entries").alias("entries"), F.count("*").alias("blocks")).join(read, "query_id")
    return hits, work.select("query_id", "entries", "entries_read", "blocks", "blocks_read")


def living_postings(index: Index) -> DataFrame:
    """point_id, idx, tf, block of all points as they are now: what search.keyword takes."""
    rows = index.blocks.select("idx", "block", "batch", F.inline(F.arrays_zip("points", "tfs"))).select("idx", "block", "batch", F.col("points").alias("point_id"), F.col("tfs").alias("tf"))
    return (_living(rows, index.dead) if index.several else rows).select("point_id", "idx", "tf", "block")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The index at path as one batch at target, without dead versions; blocks keep their points."""
    index = open_index(spark, path)
    _living(spark.read.parquet(f"{path}/forward"), index.dead).drop("batch").write.mode("overwrite").parquet(_folder(target, "forward", 0))
    _put(_blocks(spark.read.parquet(_folder(target, "forward", 0))), target, 0)
    index.dead.limit(0).write.mode("overwrite").parquet(_folder(target, "dead", 0))
    index.weights.select("idx", "df").write.mode("overwrite").parquet(_folder(target, "terms", 0))
    spark.read.parquet(f"{path}/counts").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(_folder(target, "counts", 0))


