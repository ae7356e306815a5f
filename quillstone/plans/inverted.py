"""Plans over the stored inverted index of the documents, which a session writes once and all of them read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inverted, search
from ..sources.stored import shared_dir
from .registry import query, table
from .search import K, SQL_DENSE_ASKED, SQL_INDEX, asked, corpus, index_of, sql_fused, sql_keyword, sql_ranked, terms

@query("index_terms", f"WITH {SQL_INDEX} SELECT idx, df, round(idf, 9) AS idf FROM w")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).weights.select("idx", "df", F.round("idf", 9).alias("idf"))


@query("index_postings", f"WITH {SQL_INDEX} SELECT point_id, idx, tf FROM post")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.living_postings(index_of(spark, sf_dir)).select("point_id", "idx", "tf")


@query("keyword_indexed_work")
def keyword_indexed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each passage, how many postings its tokens have and how many were read; by the blocks that are made, so SQL has nothing to compare."""
    return inverted.search(index_of(spark, sf_dir), terms(asked(spark, sf_dir)), K)[1]


@query("hybrid_indexed", f"WITH {sql_keyword(2 * K)}, {SQL_DENSE_ASKED}, {sql_ranked('de', 'de_all', 2 * K)}, {sql_fused(K)} SELECT * FROM hy")
def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and indexed keyword lists, fused."""
    queries = asked(spark, sf_dir)
    words = inverted.search(index_of(spark, sf_dir), terms(queries), 2 * K)[0]
    return search.fuse([search.dense(corpus(spark, sf_dir), queries, 2 * K), words], K)


@query("keyword_after_batches", f"WITH {sql_keyword(K)} SELECT * FROM kw")
def keyword_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: most documents, some of them with another text; those that were left out; the right texts, which replace the
    others. What is found then is what an index of the documents as they are finds."""
    path, i = f"{shared_dir(spark)}/inverted-{uuid.uuid4().hex}", F.col("point_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    first = docs.filter(i % 7 != 0).withColumn("text", F.when(i % 5 == 0, F.concat(F.lit("an earlier version "), F.reverse("text"))).otherwise(F.col("text")))
    for number, batch in enumerate([first, docs.filter((i % 7 == 0) & (i % 5 != 0)), docs.filter(i % 5 == 0)]):
        inverted.add(batch, path, number)
    return inverted.search(inverted.open_index(spark, path), terms(asked(spark, sf_dir)), K)[0]
