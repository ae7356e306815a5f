"""Retrieval under filters of each query's own. Points: documents with the order of equal id as their tender; queries: benchmark
passages that end with a segment, an amount and at times a date, from which their filters are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_score, token_set
from ..operators import filters, metrics, rerank, search
from .filters import sql_found
from .metrics import containing
from .registry import query, sql_token_set, table
from .rerank import THRESHOLD
from .search import SQL_DENSE_ASKED, corpus, sql_fused, sql_keyword, sql_ranked, statistics, terms

K, CANDIDATES = 5, 20
MODES = ("hybrid", "keyword", "vector")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with organization, budget and announcement_date of the tender, null where there is none."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tenders = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("point_id"), F.col("c_mktsegment").alias("organization"), F.col("o_totalprice").alias("budget"), F.col("o_orderdate").alias("announcement_date"))
    return corpus(spark, sf_dir).join(tenders, "point_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, vector, mode."""
    items, customers, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "embeddings")
    i = F.col("item_id")
    amount = F.concat((5 + i % 20).cast("string"), F.lit("만원 "), F.when(i % 2 == 0, "이상").otherwise("이하"))
    text = F.concat("text", F.lit(" "), "c_mktsegment", F.lit(" 발주, 예산 "), amount, F.when(i % 3 == 0, " 공고일 1996년 6월 이후").otherwise(""))
    own = items.join(customers, items["item_id"] == customers["c_custkey"]).join(vectors, items["item_id"] == vectors["vec_id"], "left")
    return own.select(i.alias("query_id"), text.alias("text"), F.col("embedding").alias("vector"), F.element_at(F.array(*map(F.lit, MODES)), (i % 3 + 1).cast("int")).alias("mode"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(final, candidates) of all questions, reranked by the share of a question's tokens that a text has."""
    rows, asked = points(spark, sf_dir), questions(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("organization")).distinct()
    posting, weights = statistics(spark, sf_dir, terms(asked))

    def reranked(candidates: DataFrame) -> DataFrame:
        texts = rows.select("point_id", token_set(F.col("text")).alias("tokens")).join(candidates.select("point_id").distinct(), "point_id", "left_semi")
        own = candidates.join(texts, "point_id").join(asked.select("query_id", token_set(F.col("text")).alias("wanted")), "query_id")
        return rerank.rerank(own, lexical_score(F.col("wanted"), F.col("tokens")), THRESHOLD).select("query_id", "point_id", "rerank_score", "rerank_rank")

    return search.retrieve_with_candidates(rows, asked, posting, terms(asked), weights, K, CANDIDATES, reranked, filters=filters.from_queries(asked, names))


SQL_QUESTIONS = """SELECT item_id AS query_id, text || ' ' || c_mktsegment || ' 발주, 예산 ' || (5 + item_id % 20) || '만원 ' || CASE WHEN item_id % 2 = 0 THEN '이상' ELSE '이하' END || CASE WHEN item_id % 3 = 0 THEN ' 공고일 1996년 6월 이후' ELSE '' END AS text, ['hybrid', 'keyword', 'vector'][item_id % 3 + 1] AS mode FROM benchmark JOIN customer ON c_custkey = item_id"""
#: Every list is cut to the pairs that the questions' texts allow before it is ranked.
SQL_BOTH = f"""{sql_keyword(2 * CANDIDATES, SQL_QUESTIONS, "kw_all")}, {SQL_DENSE_ASKED}, asked AS ({SQL_QUESTIONS}), {sql_found("SELECT DISTINCT c_mktsegment AS organization FROM customer")},
wants AS (SELECT query_id, nullif(CAST(regexp_extract(text, '(\\d+)만원', 1) AS DOUBLE) * 10000, 0) AS amount, contains(text, '이상') AS at_least, CAST(nullif(regexp_replace(regexp_extract(text, '공고일 \\d{{4}}년 \\d월'), '공고일 (\\d{{4}})년 (\\d)월', '\\1-0\\2-01'), '') AS TIMESTAMP) AS since,
  (SELECT list(organization) FROM found WHERE found.query_id = asked.query_id) AS orgs FROM asked),
tender AS (SELECT doc_id, c_mktsegment, o_totalprice, o_orderdate FROM documents LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON o_orderkey = doc_id),
ok AS (SELECT query_id, doc_id AS point_id FROM wants JOIN tender ON (amount IS NULL OR CASE WHEN at_least THEN o_totalprice >= amount ELSE o_totalprice <= amount END) AND (since IS NULL OR o_orderdate >= since)
  AND (orgs IS NULL OR list_contains(list_transform(orgs, lambda o: lower(o)), lower(c_mktsegment)))),
kw_ok AS (SELECT query_id, point_id, round(sum(qtf * idf * tf), 6) AS score FROM qt JOIN w USING (idx) JOIN post USING (idx) JOIN ok USING (query_id, point_id) GROUP BY ALL HAVING score > 0),
de_ok AS (SELECT de_all.* FROM de_all JOIN ok USING (query_id, point_id)),
{sql_ranked("kw", "kw_ok", 2 * CANDIDATES)}, {sql_ranked("de", "de_ok", 2 * CANDIDATES)}, {sql_fused(CANDIDATES)},
cand AS (SELECT query_id, mode, point_id, score, rank, 'first' AS source FROM de JOIN asked USING (query_id) WHERE mode = 'vector' AND rank <= {CANDIDATES}
  UNION ALL SELECT query_id, mode, point_id, score, rank, 'first' FROM hy JOIN asked USING (query_id) WHERE mode = 'hybrid'
  UNION ALL SELECT query_id, mode, point_id, score, rank, 'first' FROM kw JOIN asked USING (query_id) WHERE mode = 'keyword' AND rank <= {CANDIDATES}
  UNION ALL SELECT query_id, mode, point_id, score, rank, 'fallback' FROM de JOIN asked USING (query_id) WHERE mode = 'keyword' AND rank <= {CANDIDATES} AND query_id NOT IN (SELECT query_id FROM kw)),
lex AS (SELECT query_id, point_id, score, rank, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END AS rerank_score
  FROM (SELECT cand.*, {sql_token_set("asked.text")} AS q, {sql_token_set("d.text")} AS t FROM cand JOIN asked USING (query_id) JOIN documents d ON d.doc_id = point_id)),
re AS (SELECT query_id, point_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, rank) AS rerank_rank FROM lex WHERE rerank_score >= {THRESHOLD}),
final AS (SELECT query_id, point_id, rerank_rank AS final_rank, rerank_score FROM re WHERE rerank_rank <= {K}
  UNION ALL SELECT query_id, point_id, rank, NULL FROM cand WHERE rank <= {K} AND query_id NOT IN (SELECT query_id FROM re))"""


@query("retrieve_filtered_per_query", f"WITH {SQL_BOTH} SELECT cand.*, final_rank, round(rerank_score, 6) AS rerank_score FROM cand LEFT JOIN final USING (query_id, point_id)")
def retrieve_filtered_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by each question's own mode and filter, with the places of those that are final."""
    final, candidates = both(spark, sf_dir)
    return candidates.join(final.withColumn("rerank_score", F.round("rerank_score", 6)), ["query_id", "point_id"], "left")


@query("filter_allowed_points", f"WITH {SQL_BOTH} SELECT query_id, count(*) AS n FROM ok GROUP BY query_id")
def filter_allowed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each question's filter leaves, by the points' bitmaps."""
    from ..operators import blocks

    asked = questions(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("organization")).distinct()
    bits, numbers = blocks.allowed(points(spark, sf_dir), filters.from_queries(asked, names))
    return bits.join(numbers, "block").filter(blocks.has_bit(F.col("bits"), F.col("n"))).groupBy("query_id").agg(F.count("*").alias("n"))


@query("eval_filtered_run", f"""WITH {SQL_BOTH}, gold AS (SELECT item_id AS query_id, doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
nr AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY query_id),
m AS (SELECT final.query_id, final_rank AS rank, CASE WHEN gold.item IS NULL THEN 0 ELSE 1 END AS rel FROM final LEFT JOIN gold ON gold.query_id = final.query_id AND gold.item = final.point_id),
s AS (SELECT query_id, sum(rel) AS hits, min(rank) FILTER (rel = 1) AS first, sum(rel / log2(rank + 1)) AS dcg FROM m GROUP BY query_id),
c AS (SELECT cand.query_id, count(*) AS hits FROM cand JOIN gold ON gold.query_id = cand.query_id AND gold.item = cand.point_id GROUP BY cand.query_id),
st AS (SELECT query_id, bool_or(rerank_score IS NOT NULL) AS scored FROM final GROUP BY query_id)
SELECT mode, count(*) AS n, round(avg(round(coalesce(s.hits / {K}.0::DOUBLE, 0), 6)), 6) AS "precision", round(avg(round(coalesce(s.hits / n_rel, 0), 6)), 6) AS recall, round(avg(round(coalesce(1 / first, 0), 6)), 6) AS mrr,
  round(avg(round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, {K}) + 1), lambda i: 1 / log2(i + 1))), 0), 6)), 6) AS ndcg, round(avg(round(coalesce(c.hits / n_rel, 0), 6)), 6) AS candidate_recall,
  round(avg(CASE WHEN scored THEN 1.0 ELSE 0 END), 6) AS applied_ratio, round(avg(CASE WHEN NOT scored THEN 1.0 ELSE 0 END), 6) AS fallback_ratio, round(avg(CASE WHEN scored IS NULL THEN 1.0 ELSE 0 END), 6) AS empty_result_ratio
FROM asked LEFT JOIN nr USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN st USING (query_id) GROUP BY mode""")
def eval_filtered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole evaluation by mode: filtered, retrieved, reranked; metrics of the final list, recall of the candidates, what reranking did."""
    final, candidates = both(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = questions(spark, sf_dir).select("query_id", "mode")
    return metrics.run(asked, final, candidates, containing(table(spark, sf_dir, "documents"), items), K, CANDIDATES)
