"""Reranking plans over the keyword hits of the benchmark passages (40 each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_score, token_set
from ..operators import rerank, search
from ..sources.stored import stored
from .registry import query, sql_squeeze, sql_token_set, table
from .search import POOL, asked, keyword_hits, sql_keyword

THRESHOLD = 0.5


def hits(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """query_id, point_id, score, rank with the hit's text, source, lang, n_chars and tokens, and the query's text and tokens.

    Tokens are told apart once for each text that was hit, not for each hit. found: the keyword hits, if they have been made.
    """
    found = stored(keyword_hits(spark, sf_dir, POOL)) if found is None else found
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text", "lang", "source", "n_chars")
    docs = docs.join(found.select("point_id").distinct(), "point_id", "left_semi").withColumn("tokens", token_set(F.col("text")))
    queries = asked(spark, sf_dir).select("query_id", F.col("text").alias("query_text"), token_set(F.col("text")).alias("query_tokens"))
    return found.join(docs, "point_id").join(queries, "query_id")


SQL_HITS = f"{sql_keyword(POOL)}, hits AS (SELECT kw.*, d.text, d.lang, d.source, d.n_chars, b.text AS query_text FROM kw JOIN documents d ON d.doc_id = point_id JOIN benchmark b ON b.item_id = query_id)"
SQL_LEXICAL = f"lex AS (SELECT query_id, point_id, score, rank, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END AS rerank_score FROM (SELECT *, {sql_token_set('query_text')} AS q, {sql_token_set('text')} AS t FROM hits))"
SQL_RERANKED = f"re AS (SELECT query_id, point_id, score, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, rank) AS rerank_rank FROM lex WHERE rerank_score >= {THRESHOLD})"


def _scored(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Hits with their lexical score and content key instead of texts, written once for all that is made of them."""
    own = hits(spark, sf_dir, found).withColumn("lexical", lexical_score(F.col("query_tokens"), F.col("tokens"))).withColumn("ck", rerank.content_key(F.col("text")))
    return stored(own.select("query_id", "point_id", "score", "rank", "source", "lexical", "ck"))


def _reranked(own: DataFrame) -> DataFrame:
    return rerank.rerank(own, F.col("lexical"), THRESHOLD)


@query("lexical_score", f"WITH {SQL_HITS}, {SQL_LEXICAL} SELECT query_id, point_id, round(rerank_score, 6) AS lexical FROM lex")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "point_id", F.round(lexical_score(F.col("query_tokens"), F.col("tokens")), 6).alias("lexical"))


@query("rerank_lexical", f"WITH {SQL_HITS}, {SQL_LEXICAL}, {SQL_RERANKED} SELECT query_id, point_id, rerank_rank, round(rerank_score, 6) AS rerank_score FROM re WHERE rerank_rank <= 5")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(_scored(spark, sf_dir)).filter("rerank_rank <= 5").select("query_id", "point_id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("rerank_threshold", f"WITH {SQL_HITS}, {SQL_LEXICAL} SELECT query_id, count(*) AS n FROM lex WHERE rerank_score >= {THRESHOLD} GROUP BY query_id")
def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(_scored(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"))


SQL_FALLBACK = f"""WITH {SQL_HITS}, {SQL_LEXICAL}, {SQL_RERANKED},
final AS (SELECT query_id, point_id, rerank_rank AS final_rank, rerank_score FROM re WHERE rerank_rank <= 5
  UNION ALL SELECT query_id, point_id, rank, NULL FROM hits WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM re))"""


def _final(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Passages of which the threshold leaves nothing keep the first list."""
    own = _scored(spark, sf_dir, found)
    return rerank.with_fallback(_reranked(own), own, 5)


@query("rerank_fallback", f"{SQL_FALLBACK} SELECT query_id, point_id, final_rank, rerank_score IS NOT NULL AS reranked FROM final")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select("query_id", "point_id", "final_rank", F.col("rerank_score").isNotNull().alias("reranked"))


@query("rerank_status", f"{SQL_FALLBACK} SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'empty_result' WHEN scored THEN 'applied' ELSE 'fallback' END AS status FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(rerank_score IS NOT NULL) AS scored FROM final GROUP BY query_id) ON query_id = item_id")
def rerank_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.status(_final(spark, sf_dir), asked(spark, sf_dir))


SQL_KEY = f"sha1(lower({sql_squeeze('text')}))"


@query("exact_dedup", f"WITH {SQL_HITS} SELECT query_id, point_id, rank, key FROM (SELECT query_id, point_id, rank, {SQL_KEY} AS key FROM hits) QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).withColumn("key", rerank.content_key(F.col("text")))
    return rerank.first_of(own, ["query_id", "key"], "rank").select("query_id", "point_id", "rank", "key")


@query("dedupe_first", f"WITH {SQL_HITS} SELECT query_id, source, point_id, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.first_of(hits(spark, sf_dir), ["query_id", "source"], "rank").select("query_id", "source", "point_id", "rank")


def _keyed(own: DataFrame) -> DataFrame:
    """Half of the hits has a section, others a page, some only a title, some no file."""
    section = F.when(F.col("point_id") % 2 == 0, F.col("lang"))
    page = F.when(F.col("point_id") % 3 == 0, F.col("n_chars") % 5)
    title = F.when(F.col("point_id") % 5 < 4, F.lit("title"))
    file = F.when(F.col("point_id") % 7 > 0, F.col("source"))
    return own.withColumn("key", rerank.diversity_key(file, section, page, title))


SQL_KEYED = f"""{SQL_HITS}, keyed AS (SELECT query_id, point_id, rank, CASE WHEN point_id % 7 = 0 THEN NULL WHEN point_id % 2 = 0 THEN 'section|' || lower(source) || '|' || lower(lang)
  WHEN point_id % 3 = 0 THEN 'page|' || lower(source) || '|' || (n_chars % 5) WHEN point_id % 5 < 4 THEN 'title|' || lower(source) || '|title' END AS key FROM hits)"""
SQL_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(key, '-' || point_id) ORDER BY rank) AS n FROM keyed)"


@query("diversity_key", f"WITH {SQL_KEYED} SELECT query_id, point_id, key FROM keyed")
def diversity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(hits(spark, sf_dir)).select("query_id", "point_id", "key")


@query("diversity_cap", f"WITH {SQL_KEYED}, {SQL_PLACED} SELECT query_id, point_id, rank FROM placed WHERE key IS NULL OR n <= 1")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.capped(_keyed(hits(spark, sf_dir)), 1).select("query_id", "point_id", "rank")


@query("diverse_select", f"WITH {SQL_KEYED}, {SQL_PLACED} SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY (key IS NOT NULL AND n > 1), rank) AS final_rank FROM placed QUALIFY final_rank <= 30")
def diverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.diverse(_keyed(hits(spark, sf_dir)), 30, 1).select("query_id", "point_id", "final_rank")


SQL_WHOLE = f"""WITH {SQL_HITS}, {SQL_LEXICAL},
one AS (SELECT hits.query_id, hits.point_id, hits.score, hits.rank, hits.source, rerank_score FROM hits JOIN lex ON lex.query_id = hits.query_id AND lex.point_id = hits.point_id QUALIFY row_number() OVER (PARTITION BY hits.query_id, {SQL_KEY} ORDER BY hits.rank) = 1),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, rank) AS place FROM one WHERE rerank_score >= {THRESHOLD}),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(source, '-' || point_id) ORDER BY place) AS n FROM re),
di AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (source IS NOT NULL AND n > 1), place) AS final_rank FROM ca)
SELECT query_id, point_id, final_rank, round(rerank_score, 6) AS rerank_score FROM di WHERE final_rank <= 5
UNION ALL SELECT query_id, point_id, rank, NULL FROM hits WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM di)"""


@query("retrieve_rerank", SQL_WHOLE)
def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: 40 candidates, duplicates out, lexical reranking, one hit a source first, what is left filled up, else the first list."""
    own = _scored(spark, sf_dir)
    once = rerank.first_of(own, ["query_id", "ck"], "rank")
    scored = _reranked(once).withColumn("rank", F.col("rerank_rank")).withColumn("key", F.col("source"))
    chosen = rerank.diverse(scored, 5, 1).withColumn("rerank_rank", F.col("final_rank"))
    return rerank.with_fallback(chosen, own, 5).select("query_id", "point_id", "final_rank", F.round("rerank_score", 6).alias("rerank_score"))


def _fields(docs: DataFrame) -> DataFrame:
    labels_free = docs.select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("organization"), F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("budget"), F.lit(" ").alias("section_title"))
    return labels_free


@query("rerank_text", f"""WITH s AS (SELECT *, {sql_squeeze('text')} AS p FROM documents),
t AS (SELECT *, CASE WHEN length(p) > 1800 THEN substr(p, 1, 1200) || ' ... ' || right(p, 600) ELSE p END AS c FROM s)
SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN trim(c) <> '' THEN 'content: ' || c END, 'title: ' || source, CASE WHEN doc_id % 3 > 0 THEN 'organization: ' || lang END, CASE WHEN doc_id % 4 > 0 THEN 'budget: ' || n_chars END)) AS digest FROM t""")
def rerank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _fields(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.md5(rerank.rerank_text(own.columns).cast("binary")).alias("digest"))


@query("rrf_constants", f"WITH {sql_keyword(10)} SELECT query_id, point_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM kw")
def rrf_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list under the constant of multi-query fusion, ranks from 1."""
    return search.fuse([keyword_hits(spark, sf_dir, 10)], 10, 60, 1).select("query_id", "point_id", "score")
