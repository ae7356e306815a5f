"""Search over many queries at once: dense, keyword, hybrid, MMR, HyDE, fallback and several variants of a query.

Every result has query_id, point_id, score and rank, rank from 1 with ties to the smaller point_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import token_hash
from ..sources.stored import stored
from . import blocks, rerank

#: At most so many queries are broadcast as rows; more of them go in blocks, as matrix products.
QUERY_BLOCK = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """A vector of length 1 in double precision; null for null and zero vectors."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def ranked(hits: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k of each query; Spark cuts every partition's rows to k before it shuffles."""
    by_score = order or (F.desc("score"), F.col("point_id"))
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*by_score))).filter(F.col("rank") <= k)


def dense(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, where: Column | None = None, filters: DataFrame | None = None) -> DataFrame:
    """Cosine search. points: point_id, dense, ...; queries: query_id, vector. Filters hold before the ranking.

    where: one condition for all queries. filters: conditions of each query's own (see blocks.compiled). Query sets that are small and
    have one condition are broadcast; others go in blocks, all of them in one pass over the points.
    """
    rows = points if where is None else points.filter(where)
    if filters is not None or queries.count() > QUERY_BLOCK:
        return ranked(blocks.nearest(rows, queries, k, threshold, filters), k)
    rows = rows.select("point_id", normalised(F.col("dense")).alias("_p")).filter("_p IS NOT NULL")
    asked = queries.select("query_id", normalised(F.col("vector")).alias("_q")).filter("_q IS NOT NULL")
    hits = rows.crossJoin(F.broadcast(asked)).select("query_id", "point_id", F.round(dot(F.col("_p"), F.col("_q")), 9).alias("score"))
    return ranked(hits if threshold is None else hits.filter(F.col("score") >= threshold), k)


def postings(points: DataFrame, tokens: Column) -> DataFrame:
    """(point_id, idx, tf): token counts under stable 32-bit ids."""
    return points.select("point_id", F.explode(tokens).alias("t")).select("point_id", token_hash(F.col("t")).alias("idx")).groupBy("point_id", "idx").agg(F.count("*").alias("tf"))


def idf(posting: DataFrame, n: Column) -> DataFrame:
    """(idx, df, idf) with the usual smoothed inverse document frequency."""
    df = posting.groupBy("idx").agg(F.count("*").alias("df"))
    return df.select("idx", "df", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def keyword(posting: DataFrame, query_terms: DataFrame, weights: DataFrame, k: int, allowed: DataFrame | None = None, bitmaps: tuple[DataFrame, DataFrame] | None = None, points: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """Sum over common tokens of tf in the query * idf * tf in the text. query_terms: query_id, idx, qtf.

    allowed: point_id of the points that a filter leaves; bitmaps: what blocks.allowed() made of filters of each query's own. They hold
    before the ranking, and weights stay those of all points. A posting of index.counted() is scored point by point, under the filters of
    points themselves instead of bitmaps; the queries go there, and only k hits of each task come back.
    """
    posting = posting if allowed is None else posting.join(allowed.select("point_id"), "point_id", "left_semi")
    asked = query_terms.join(weights, "idx")
    if "idxs" in posting.columns:
        return ranked(blocks.scored(posting, asked.select("query_id", "idx", (F.col("qtf") * F.col("idf")).alias("w")), k, points, filters), k)
    score = F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("tf")), 6).alias("score")
    if bitmaps is None:
        return ranked(posting.join(asked, "idx").groupBy("query_id", "point_id").agg(score).filter("score > 0"), k)
    bits, numbers = bitmaps
    asked = asked.join(numbers, "query_id", "left")
    hits = posting.join(asked, "idx").groupBy("query_id", "point_id", "block", "n").agg(score).filter("score > 0")
    free, bound = hits.filter("block IS NULL"), hits.filter("block IS NOT NULL").join(bits, ["point_id", "block"])
    fit = bound.filter(blocks.has_bit(F.col("bits"), F.col("n")))
    return ranked(reduce(DataFrame.unionByName, (x.select("query_id", "point_id", "score") for x in (free, fit))), k)


def fuse(arms: list[DataFrame], k: int, rrf_k: int = fixed.HYBRID_RRF_K, first_rank: int = 0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; first_rank: the number that the best hit of a list counts as."""
    tagged = [a.select("query_id", "point_id", "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    every = reduce(DataFrame.unionByName, tagged)
    found = every.groupBy("query_id", "point_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank") - 1 + first_rank)), 9).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("matched"))
    return ranked(found, k)


def hybrid(points: DataFrame, queries: DataFrame, posting: DataFrame, query_terms: DataFrame, weights: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Dense and keyword lists of 2 k each, fused. where: a filter of points, which holds in both."""
    allowed = None if where is None else points.filter(where)
    return fuse([dense(points, queries, 2 * k, where=where), keyword(posting, query_terms, weights, 2 * k, allowed)], k)


def hyde(points: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Dense search by the vector of a hypothetical passage, or by the query's own where there is none. queries: query_id, vector, hyde."""
    return dense(points, queries.select("query_id", F.coalesce("hyde", "vector").alias("vector")), k, where=where)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The hits of second for queries of which first has none."""
    rest = second.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.select("query_id", "point_id", "score", "rank", F.lit("first").alias("source")).unionByName(rest.select("query_id", "point_id", "score", "rank", F.lit("fallback").alias("source")))


def variants(original: Column, generated: Column, n: int) -> Column:
    """The original query first, then generated ones, cleaned of list marks; each once, n at most."""
    clean = F.transform(generated, lambda q: F.trim(F.regexp_replace(F.trim(q), r"^(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.array_distinct(F.concat(F.array(F.trim(original)), F.filter(clean, lambda q: q != ""))), 1, n)


def multi_query(hits: DataFrame, k: int, rrf_k: int = fixed.RRF_K) -> DataFrame:
    """Fusion over variants. hits: query_id, variant, point_id, rank. Ties go to the earlier variant, then its rank."""
    found = hits.groupBy("query_id", "point_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("matched"), F.min(F.struct("variant", "rank")).alias("_first"))
    return ranked(found, k, F.desc("score"), F.col("_first.variant"), F.col("_first.rank"), F.col("point_id")).drop("_first")


def minmax(hits: DataFrame) -> DataFrame:
    """Scores brought to 0..1 within each query."""
    own = W.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumn("relevance", F.round((F.col("score") - low) / (high - low + 1e-5), 6))


def pairwise(candidates: DataFrame) -> DataFrame:
    """Cosines between the candidates of a query. candidates: query_id, point_id, dense; a query has a bounded pool of them."""
    a = candidates.select("query_id", F.col("point_id").alias("a"), normalised(F.col("dense")).alias("va"))
    b = candidates.select("query_id", F.col("point_id").alias("b"), normalised(F.col("dense")).alias("vb"))
    return a.join(b, "query_id").filter("a < b").select("query_id", "a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


def mmr(candidates: DataFrame, k: int, lam: float = fixed.MMR_LAMBDA, penalty: float = fixed.MMR_SAME_FILE, pool: int = fixed.MMR_POOL) -> DataFrame:
    """Greedy choice by relevance against likeness to what has been chosen. candidates: query_id, point_id, score, dense, file_name.

    A query's pool is bounded, so it is one array; the greedy loop runs inside one expression.
    """
    own = minmax(ranked(candidates, pool)).select("query_id", F.struct("rank", "point_id", F.col("relevance").alias("rel"), "file_name", normalised(F.col("dense")).alias("v")).alias("c"))
    pools = own.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    empty = F.slice("cs", 1, 0)

    def step(chosen: Column, _: Column) -> Column:
        def value(c: Column) -> Column:
            likeness = F.aggregate(chosen, F.lit(0.0), lambda m, s: F.greatest(m, (dot(c["v"], s["v"]) + 1) / 2))
            same = F.exists(chosen, lambda s: s["file_name"] == c["file_name"])
            return F.when(F.size(chosen) == 0, c["rel"]).otherwise(lam * c["rel"] - (1 - lam) * likeness - F.when(F.coalesce(same, F.lit(False)), penalty).otherwise(0.0))

        left = F.filter("cs", lambda c: ~F.exists(chosen, lambda s: s["point_id"] == c["point_id"]))
        scored = F.transform(left, lambda c: F.struct(F.round(-value(c), 6).alias("cost"), c["rank"].alias("rank"), c.alias("c")))
        best = F.array_min(scored)
        return F.when(F.size(left) > 0, F.concat(chosen, F.array(best["c"]))).otherwise(chosen)

    picks = pools.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step).alias("picked"))
    return picks.select("query_id", F.posexplode("picked").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("c.point_id").alias("point_id"), F.col("c.rel").alias("relevance"))


def by_mode(mode: str, arms: dict[str, DataFrame]) -> DataFrame:
    """The list of a search mode; modes that aren't known are an error."""
    if mode not in arms:
        raise ValueError(f"unknown search mode: {mode}")
    return arms[mode]


MODES = ("vector", "hyde", "keyword", "hybrid", "mmr")


def retrieve(points: DataFrame, queries: DataFrame, posting: DataFrame, query_terms: DataFrame, weights: DataFrame, k: int, where: Column | None = None, file: str = "file_name", filters: DataFrame | None = None) -> DataFrame:
    """The k hits of each query by its own mode: query_id, mode, point_id, score, rank, source (first, or fallback).

    where is a condition for all queries; filters has conditions of each query's own (filters.from_queries makes it from their
    texts), and queries without a row there have none. Both hold in every list before it is ranked, fallbacks included.

    points: point_id, dense and what where and file name (file: only where a query's mode is mmr). queries: query_id, mode,
    vector, and if they have them hyde (a hypothetical passage's vector) and threshold, which cuts the lists of vector and
    hyde. Keyword queries without a hit are searched by vector. Queries of an unknown or null mode are an error.

    All modes share one dense and one keyword pass, each written once, as deep as the deepest mode of the batch needs.
    """
    modes = {r["mode"] for r in queries.select("mode").distinct().limit(len(MODES) + 1).collect()}
    if unknown := modes - set(MODES):
        raise ValueError(f"unknown search mode: {sorted(map(str, unknown))}")
    own = lambda c, kind: F.col(c) if c in queries.columns else F.lit(None).cast(kind)
    by = queries.select("query_id", "mode", own("threshold", "double").alias("threshold"))
    vector = F.when(F.col("mode") == "hyde", F.coalesce(own("hyde", queries.schema["vector"].dataType), "vector")).otherwise(F.col("vector"))
    depth = 2 * max([k, fixed.MMR_POOL] if "mmr" in modes else [k])
    near = stored(dense(points, queries.select("query_id", vector.alias("vector")), depth, where=where, filters=filters)).join(by, "query_id")
    wordy = by.filter(F.col("mode").isin("keyword", "hybrid", "mmr")).select("query_id")
    own_filters = None if filters is None else filters.join(wordy, "query_id", "left_semi")
    bitmaps = None if filters is None or "idxs" in posting.columns else blocks.allowed(points, own_filters)
    words = stored(keyword(posting, query_terms.join(wordy, "query_id", "left_semi"), weights, depth, None if where is None else points.filter(where), bitmaps, points, own_filters)).join(by, "query_id")
    columns = ["query_id", "point_id", "score", "rank"]
    of = lambda hits, mode, n: hits.filter((F.col("mode") == mode) & (F.col("rank") <= n)).select(columns)
    good = near.filter(F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")))
    lists = [of(good, "vector", k), of(good, "hyde", k), fuse([of(near, "hybrid", 2 * k), of(words, "hybrid", 2 * k)], k).select(columns)]
    if "mmr" in modes:
        pool = fuse([of(near, "mmr", depth), of(words, "mmr", depth)], fixed.MMR_POOL).select(columns)
        chosen = mmr(pool.drop("rank").join(points.select("point_id", "dense", F.col(file).alias("file_name")), "point_id"), k)
        lists.append(chosen.select("query_id", "point_id", F.col("relevance").alias("score"), "rank"))
    first = reduce(DataFrame.unionByName, lists).withColumn("source", F.lit("first"))
    return first.unionByName(with_fallback(of(words, "keyword", k), of(near, "keyword", k))).join(by.select("query_id", "mode"), "query_id")


def retrieve_with_candidates(points: DataFrame, queries: DataFrame, posting: DataFrame, query_terms: DataFrame, weights: DataFrame, k: int, candidate_k: int,
                             reranked: Callable[[DataFrame], DataFrame] | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """(final, candidates): candidates are retrieve()'s hits, max(k, candidate_k) of each query; final their first k, or k of what
    reranked makes of them: query_id, point_id, final_rank, rerank_score.

    reranked: from candidates to those that stay, with rerank_score and rerank_rank. Queries of which it leaves nothing
    keep their first list, with rerank_score null. more: where, file and filters of retrieve().
    """
    candidates = stored(retrieve(points, queries, posting, query_terms, weights, max(k, candidate_k), **more))
    if reranked is None:
        return candidates.filter(F.col("rank") <= k).select("query_id", "point_id", F.col("rank").alias("final_rank"), F.lit(None).cast("double").alias("rerank_score")), candidates
    return rerank.with_fallback(stored(reranked(candidates)), candidates, k), candidates


def compare_modes(arms: dict[str, DataFrame], k: int) -> DataFrame:
    """Where each mode ranks a point, side by side."""
    every = reduce(DataFrame.unionByName, (a.filter(F.col("rank") <= k).select("query_id", "point_id", F.lit(m).alias("mode"), "rank") for m, a in arms.items()))
    return every.groupBy("query_id", "point_id").pivot("mode", list(arms)).agg(F.min("rank"))
