"""Metric plans: the keyword hits of the benchmark passages against the documents that contain the passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, rerank
from ..sources.stored import stored
from ..streaming.ingest import rates
from .registry import query, table
from .rerank import SQL_FALLBACK, _final
from .search import K as HITS
from .search import POOL, SQL_MIXED, keyword_hits, mixed, sql_keyword

K = 5


def containing(docs: DataFrame, passages: DataFrame, seed: int = 5) -> DataFrame:
    """query_id, item of documents that contain a passage. They meet on a run of the passage's inner words, then texts are compared.

    docs: doc_id, text. passages: query_id, text. Passages of fewer than seed + 2 words, of which a text may hold no inner
    word as a whole, are compared with every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    own = passages.withColumn("_w", words(F.col("text")))
    seeded = own.filter(F.size("_w") >= seed + 2).select("query_id", F.col("text").alias("passage"), F.array_join(F.slice("_w", 2, seed), " ").alias("run"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - seed + 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, F.lit(seed)), " "))
    runs = docs.withColumn("_w", words(F.col("text"))).select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(grams)).alias("run"))
    found = runs.join(seeded, "run").join(docs.select(F.col("doc_id").alias("item"), "text"), "item").filter(F.contains("text", "passage"))
    short = own.filter(F.size("_w") < seed + 2).select("query_id", F.col("text").alias("passage"))
    rest = docs.select(F.col("doc_id").alias("item"), "text").join(short, F.contains("text", "passage"))
    return found.select("query_id", "item").unionByName(rest.select("query_id", "item")).distinct()


def _inputs(spark: SparkSession, sf_dir: str, hits: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(queries, ranked, qrels); ranked: of the keyword hits, if there are any."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    gold = containing(table(spark, sf_dir, "documents"), items)
    ranked = None if hits is None else metrics.predicted(hits, "point_id")
    return items.select("query_id"), ranked, stored(gold)


SQL_EVAL = f"""{sql_keyword(POOL)},
gold AS (SELECT item_id AS query_id, doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
m AS (SELECT kw.query_id, rank, CASE WHEN gold.item IS NULL THEN 0 ELSE 1 END AS rel FROM kw LEFT JOIN gold ON gold.query_id = kw.query_id AND gold.item = kw.point_id),
nr AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY query_id),
s AS (SELECT query_id, sum(rel) FILTER (rank <= {K}) AS hits, sum(rel) AS cand, min(rank) FILTER (rank <= {K} AND rel = 1) AS first, sum(rel / log2(rank + 1)) FILTER (rank <= {K}) AS dcg FROM m GROUP BY query_id),
per AS (SELECT item_id AS query_id, round(coalesce(hits / {K}.0::DOUBLE, 0), 6) AS "precision", round(coalesce(hits / n_rel, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, {K}) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(cand / n_rel, 0), 6) AS candidate_recall
  FROM benchmark LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN s ON s.query_id = item_id)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(keyword_hits(spark, sf_dir, POOL))


def _per(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    return metrics.per_query(*_inputs(spark, sf_dir, _hits(spark, sf_dir) if hits is None else hits), K, POOL)


@query("eval_per_record", f"WITH {SQL_EVAL} SELECT * FROM per")
def eval_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per(spark, sf_dir)


def _one(column: str, name: str) -> None:
    @query(name, f'WITH {SQL_EVAL} SELECT query_id, "{column}" FROM per')
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _per(spark, sf_dir).select("query_id", column)


for _column in ("precision", "recall", "mrr", "ndcg"):
    _one(_column, f"{_column}_at_k")


@query("eval_aggregate", f"""{SQL_FALLBACK}, gold AS (SELECT item_id AS query_id, doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
st AS (SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'empty_result' WHEN scored THEN 'applied' ELSE 'fallback' END AS status FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(rerank_score IS NOT NULL) AS scored FROM final GROUP BY query_id) ON query_id = item_id),
m AS (SELECT kw.query_id, rank, CASE WHEN gold.item IS NULL THEN 0 ELSE 1 END AS rel FROM kw LEFT JOIN gold ON gold.query_id = kw.query_id AND gold.item = kw.point_id),
nr AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY query_id),
s AS (SELECT query_id, sum(rel) FILTER (rank <= {K}) AS hits, sum(rel) AS cand, min(rank) FILTER (rank <= {K} AND rel = 1) AS first, sum(rel / log2(rank + 1)) FILTER (rank <= {K}) AS dcg FROM m GROUP BY query_id),
per AS (SELECT item_id AS query_id, round(coalesce(hits / {K}.0::DOUBLE, 0), 6) AS p, round(coalesce(hits / n_rel, 0), 6) AS r, round(coalesce(1 / first, 0), 6) AS mr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, {K}) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS nd, round(coalesce(cand / n_rel, 0), 6) AS cr
  FROM benchmark LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN s ON s.query_id = item_id)
SELECT count(*) AS n, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(mr), 6) AS mrr, round(avg(nd), 6) AS ndcg, round(avg(cr), 6) AS candidate_recall,
  round(avg(CASE WHEN status = 'applied' THEN 1.0 ELSE 0 END), 6) AS applied_ratio, round(avg(CASE WHEN status = 'fallback' THEN 1.0 ELSE 0 END), 6) AS fallback_ratio, round(avg(CASE WHEN status = 'empty_result' THEN 1.0 ELSE 0 END), 6) AS empty_result_ratio FROM per JOIN st USING (query_id)""")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search runs once, for the metrics and for what reranking did."""
    found = _hits(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return metrics.aggregate(_per(spark, sf_dir, found), rerank.status(_final(spark, sf_dir, found), queries))


@query("eval_run", f"""WITH {SQL_MIXED}, gold AS (SELECT item_id AS query_id, doc_id AS item FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
m AS (SELECT mixed.query_id, rank, CASE WHEN gold.item IS NULL THEN 0 ELSE 1 END AS rel FROM mixed LEFT JOIN gold ON gold.query_id = mixed.query_id AND gold.item = mixed.point_id),
nr AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY query_id),
s AS (SELECT query_id, sum(rel) FILTER (rank <= {K}) AS hits, sum(rel) AS cand, min(rank) FILTER (rank <= {K} AND rel = 1) AS first FROM m GROUP BY query_id)
SELECT mode, count(*) AS n, round(avg(round(coalesce(hits / {K}.0::DOUBLE, 0), 6)), 6) AS "precision", round(avg(round(coalesce(hits / n_rel, 0), 6)), 6) AS recall, round(avg(round(coalesce(1 / first, 0), 6)), 6) AS mrr, round(avg(round(coalesce(cand / n_rel, 0), 6)), 6) AS candidate_recall
FROM md LEFT JOIN nr USING (query_id) LEFT JOIN s USING (query_id) GROUP BY mode""")
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole evaluation by mode: every passage retrieved by its own mode and scored, those without hits included."""
    queries, _, gold = _inputs(spark, sf_dir, None)
    part = F.col("query_id") % 4
    modes = queries.withColumn("mode", F.when(part == 0, "vector").when(part == 2, "hybrid").otherwise("keyword"))
    per = metrics.per_query(queries, metrics.predicted(stored(mixed(spark, sf_dir)), "point_id"), gold, K, HITS)
    return per.join(modes, "query_id").groupBy("mode").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "candidate_recall")))


@query("metrics_unpivot", f"WITH {SQL_EVAL} SELECT query_id, unnest(['precision', 'recall', 'mrr', 'ndcg', 'candidate_recall']) AS metric, unnest([\"precision\", recall, mrr, ndcg, candidate_recall]) AS value FROM per")
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unpivoted(_per(spark, sf_dir))


@query("query_log_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def query_log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the whole log as a table."""
    return rates(table(spark, sf_dir, "events")).withColumn("starts", F.col("starts").cast("timestamp_ntz"))
