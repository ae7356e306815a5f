"""Ranking quality with binary relevance: per query and over all queries, those without hits included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import rerank


def predicted(hits: DataFrame, key: str = "item") -> DataFrame:
    """hits: query_id, <key>, rank. Blank keys go, each key counts once by its best rank, ranks close up."""
    once = hits.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy("query_id", key).agg(F.min("rank").alias("_r"))
    return once.select("query_id", F.col(key).alias("item"), F.row_number().over(W.partitionBy("query_id").orderBy("_r", key)).alias("rank"))


def marked(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked: query_id, item, rank. qrels: query_id, item. With relevant 0 or 1."""
    gold = qrels.select("query_id", "item").distinct().withColumn("relevant", F.lit(1))
    return ranked.join(gold, ["query_id", "item"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def _hits(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("relevant")))


def per_query(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int, candidate_k: int | None = None) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg at k, and recall at candidate_k in a column of its own. queries: query_id."""
    n_relevant = qrels.select("query_id", "item").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    within = F.col("rank") <= k
    sums = marked(ranked, qrels).groupBy("query_id").agg(
        _hits(k).alias("hits"),
        _hits(candidate_k or k).alias("candidate_hits"),
        F.min(F.when(within & (F.col("relevant") == 1), F.col("rank"))).alias("first"),
        F.sum(F.when(within, F.col("relevant") / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    rows = queries.select("query_id").join(n_relevant, "query_id", "left").join(sums, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "query_id", value(F.col("hits") / k).alias("precision"), value(F.col("hits") / F.col("n_rel")).alias("recall"), value(1 / F.col("first")).alias("mrr"),
        value(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal)).alias("ndcg"), value(F.col("candidate_hits") / F.col("n_rel")).alias("candidate_recall"),
    )


METRICS = ("precision", "recall", "mrr", "ndcg", "candidate_recall")
STATUSES = ("applied", "fallback", "empty_result")


def aggregate(per: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Means over all queries, and of the rerank statuses (query_id, status) their shares."""
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS if m in per.columns]
    if status is None:
        return per.agg(F.count("*").alias("n"), *means)
    rows = per.join(status, "query_id", "left")
    shares = [F.round(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)), 6).alias(f"{s}_ratio") for s in STATUSES]
    return rows.agg(F.count("*").alias("n"), *means, *shares)


def run(queries: DataFrame, final: DataFrame, candidates: DataFrame, qrels: DataFrame, k: int, candidate_k: int, by: str = "mode") -> DataFrame:
    """An evaluation by what retrieve_with_candidates() returns: means and rerank shares for each value of by.

    queries: query_id, by; those without hits count too. The candidates' own recall stands beside the final list's metrics.
    """
    per = per_query(queries, predicted(final.withColumnRenamed("final_rank", "rank"), "point_id"), qrels, k).drop("candidate_recall")
    wide = per_query(queries, predicted(candidates, "point_id"), qrels, candidate_k).select("query_id", F.col("recall").alias("candidate_recall"))
    rows = per.join(wide, "query_id").join(rerank.status(final, queries), "query_id").join(queries.select("query_id", by), "query_id")
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    shares = [F.round(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)), 6).alias(f"{s}_ratio") for s in STATUSES]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *means, *shares)


def unpivoted(per: DataFrame) -> DataFrame:
    """query_id, metric, value: what a tracking system takes."""
    return per.unpivot("query_id", [m for m in METRICS if m in per.columns], "metric", "value")


def compared(results: dict[str, DataFrame]) -> DataFrame:
    """Aggregates of several runs under their names."""
    return reduce(DataFrame.unionByName, (aggregate(p).withColumn("run", F.lit(n)) for n, p in results.items()))
