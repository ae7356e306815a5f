"""Reranking and diversity over ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import fields_text, squeezed, trim_text

#: Fields of a hit in the order in which a reranker reads them.
FIELDS = ("section_title", "title", "organization", "budget", "announcement_date", "bid_start", "bid_deadline")


def rerank_text(columns: list[str], limit: int = 1800) -> Column:
    return fields_text([("content", trim_text(F.col("content"), limit)), *((f, F.col(f)) for f in FIELDS if f in columns)])


def rerank(hits: DataFrame, score: Column, threshold: float = fixed.RERANK_THRESHOLD) -> DataFrame:
    """hits: query_id, point_id, score, rank. Those with a rerank score of the threshold at least, by that score, then the first score."""
    own = hits.withColumn("rerank_score", score).filter(F.col("rerank_score") >= threshold)
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc(F.coalesce("score", F.lit(0.0))), "rank")
    return own.withColumn("rerank_rank", F.row_number().over(order))


def with_fallback(reranked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The reranked list cut to k; the first list's for queries of which nothing is left."""
    kept = reranked.filter(F.col("rerank_rank") <= k).select("query_id", "point_id", F.col("rerank_rank").alias("final_rank"), "rerank_score")
    rest = hits.join(reranked.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= k)
    return kept.unionByName(rest.select("query_id", "point_id", F.col("rank").alias("final_rank"), F.lit(None).cast("double").alias("rerank_score")))


def status(final: DataFrame, queries: DataFrame, enabled: bool = True) -> DataFrame:
    """What reranking did to each query: disabled, empty_result, applied or fallback."""
    own = final.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.col("rerank_score").isNotNull()).alias("scored"))
    state = F.when(F.lit(not enabled), "disabled").when(F.col("n").isNull(), "empty_result").when(F.col("scored"), "applied").otherwise("fallback")
    return queries.select("query_id").join(own, "query_id", "left").select("query_id", state.alias("status"))


def content_key(content: Column, otherwise: Column | None = None) -> Column:
    """A digest of the content regardless of case and spacing; of another text where the content is blank."""
    plain = F.lower(squeezed(F.coalesce(content, F.lit(""))))
    own = F.when(plain != "", plain)
    return F.sha1(F.coalesce(own, otherwise if otherwise is not None else F.lit("")).cast("binary"))


def first_of(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def diversity_key(file: Column, section: Column, page: Column, title: Column) -> Column:
    """File with section, else with page, else with title; null (never capped) without a file or any of them."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    key = lambda kind, c: F.concat_ws("|", F.lit(kind), squeezed(F.lower(file)), squeezed(F.lower(c.cast("string"))))
    return F.when(blank(file), F.lit(None).cast("string")).when(~blank(section), key("section", section)).when(page.isNotNull(), key("page", page)).when(~blank(title), key("title", title))


def capped(hits: DataFrame, per_group: int, key: str = "key") -> DataFrame:
    """The first per_group of each key by rank; rows without a key always."""
    n = F.row_number().over(W.partitionBy("query_id", F.coalesce(key, F.concat(F.lit("-"), F.col("point_id").cast("string")))).orderBy("rank"))
    return hits.withColumn("_n", n).filter(F.col(key).isNull() | (F.col("_n") <= per_group)).drop("_n")


def diverse(hits: DataFrame, k: int, per_group: int, key: str = "key") -> DataFrame:
    """k of each query: capped by key first, then filled up with what the cap has put off, in rank order."""
    if k < 1:
        raise ValueError("k is 1 at least")
    n = F.row_number().over(W.partitionBy("query_id", F.coalesce(key, F.concat(F.lit("-"), F.col("point_id").cast("string")))).orderBy("rank"))
    put_off = F.when(F.lit(per_group > 0) & F.col(key).isNotNull() & (n > per_group), 1).otherwise(0)
    own = hits.withColumn("put_off", put_off)
    order = W.partitionBy("query_id").orderBy("put_off", "rank")
    return own.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)
