"""Text, name and template plans, over whole documents, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import embed
from ..operators import context, index
from ..operators.verify import evidence_text
from .registry import query, sql_compact, sql_hash, sql_squeeze, sql_token_set, sql_tokens, table
from .rerank import SQL_HITS, hits


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def digest(c):
    return F.md5(c.cast("binary"))


@query("token_set", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(list_sort(s), ' ')) AS tokens FROM (SELECT doc_id, {sql_token_set('text')} AS s FROM documents)")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).select("doc_id", T.token_set(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").alias("n"), digest(F.array_join(F.array_sort("s"), " ")).alias("tokens"))


@query("token_hash", f"SELECT DISTINCT t AS token, {sql_hash('t')} AS idx FROM (SELECT unnest({sql_token_set('text')}) AS t FROM documents)")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(T.token_set(F.col("text"))).alias("token")).distinct().withColumn("idx", T.token_hash(F.col("token")))


SQL_POST = f"post AS (SELECT point_id, {sql_hash('t')} AS idx, count(*) AS tf FROM (SELECT doc_id AS point_id, unnest({sql_tokens('text')}) AS t FROM documents) GROUP BY ALL)"


@query("sparse_tf", f"WITH {SQL_POST} SELECT * FROM post")
def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(docs(spark, sf_dir).select(F.col("doc_id").alias("point_id"), "text"), F.col("text"))[0]


@query("sparse_idf", f"WITH {SQL_POST} SELECT idx, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post GROUP BY idx")
def sparse_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(docs(spark, sf_dir).select(F.col("doc_id").alias("point_id"), "text"), F.col("text"))[1].select("idx", "df", F.round("idf", 6).alias("idf"))


@query("embed_points")
def embed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole texts by the stand-in embedder."""
    return docs(spark, sf_dir).select("doc_id", embed(F.col("text")).alias("dense"))


@query("point_id", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::UBIGINT % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(format('{}_0001', doc_id))) AS h FROM documents)")
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.point_id(F.format_string("%s_%04d", F.col("doc_id").cast("string"), F.lit(1))).alias("point_id"))


@query("strip_control", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[一-鿿]+', '', 'g'), '\p{C}', '', 'g')) AS digest FROM documents")
def strip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", digest(T.strip_control(F.col("text"))).alias("digest"))


@query("snippet", f"SELECT doc_id, CASE WHEN length(p) > 280 THEN rtrim(substr(p, 1, 280)) || '...' ELSE p END AS snippet FROM (SELECT doc_id, {sql_squeeze('text')} AS p FROM documents)")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("trim_text", f"SELECT doc_id, md5(CASE WHEN length(p) > 500 THEN substr(p, 1, 333) || ' ... ' || right(p, 167) ELSE p END) AS digest FROM (SELECT doc_id, {sql_squeeze('text')} AS p FROM documents)")
def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", digest(T.trim_text(F.col("text"), 500)).alias("digest"))


SQL_VALUES = f"""list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(p, '\\d{{4}}\\s*(?:[-./]|년)\\s*\\d{{1,2}}\\s*(?:[-./]|월)\\s*\\d{{1,2}}\\s*(?:일)?'), regexp_extract_all(p, '\\b[A-Z]{{2,5}}-\\d{{3,}}\\b'),
  regexp_extract_all(p, '(?i)\\d[\\d,]*(?:\\.\\d+)?\\s*(?:원|천원|백만원|만원|억원|일|개월|년|명|건|%|won|krw|days?|months?|years?)?')), lambda v: replace({sql_compact('v')}, ',', '')), lambda v: v <> ''))"""


@query("extract_values", f"SELECT doc_id, CAST(len(v) AS INTEGER) AS n, array_to_string(list_sort(v), '|') AS found FROM (SELECT doc_id, {SQL_VALUES} AS v FROM (SELECT doc_id, {sql_squeeze('text')} AS p FROM documents))")
def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).select("doc_id", T.extract_values(F.col("text")).alias("v"))
    return own.select("doc_id", F.size("v").alias("n"), F.array_join(F.array_sort("v"), "|").alias("found"))


@query("url_basename", r"SELECT page_id, trim(regexp_extract(regexp_replace(url_decode(replace(CASE WHEN regexp_matches(url, '^(?i)https?://') THEN (CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN url ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END) ELSE url END, '+', '%2B')), '/+$', ''), '([^/]*)$', 1)) AS name FROM (SELECT page_id, trim(url) AS url FROM pages)")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_basename(F.col("url")).alias("name"))


SQL_NAME = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' (2).pdf' WHEN 1 THEN '.HWP' WHEN 2 THEN ' [v1.0].hwpx' ELSE 'E' || chr(769) || chr(4352) || chr(4449) || '.pdf' END"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 4 == 0, " (2).pdf").when(F.col("p_partkey") % 4 == 1, ".HWP").when(F.col("p_partkey") % 4 == 2, " [v1.0].hwpx").otherwise("E\u0301\u1100\u1161.pdf")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", end).alias("name"))


def sql_key(x: str) -> str:
    return rf"regexp_replace(lower(nfc_normalize(regexp_replace({x}, '(?i)\.(pdf|hwp|hwpx)$', ''))), '[\s_\-&()\[\]{{}}.,·ㆍ]', '', 'g')"


@query("name_key", f"SELECT p_partkey, {sql_key('name')} AS key FROM (SELECT p_partkey, {SQL_NAME} AS name FROM part)")
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", T.name_key(F.col("name")).alias("key"))


@query("copy_suffix_key", f"SELECT p_partkey, {sql_key('name')} AS key FROM (SELECT p_partkey, replace({SQL_NAME}, ' (2)', '') AS name FROM part)")
def copy_suffix_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", T.copy_suffix_key(F.col("name")).alias("key"))


SQL_ITEM = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'i' || doc_id END AS id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'c' || doc_id END AS cid, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS inner_text, text FROM documents"


@query("flatten_chunk", f"SELECT doc_id, CASE WHEN id = '' THEN cid ELSE id END AS id, coalesce(cid, CASE WHEN id = '' THEN cid ELSE id END) AS chunk_id, md5(CASE WHEN inner_text = '' THEN text ELSE inner_text END) AS digest FROM ({SQL_ITEM})")
def flatten_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    items = docs(spark, sf_dir).select(
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("i"), d.cast("string"))).alias("id"), F.col("text").alias("content"),
        F.struct(d, F.when(d % 2 == 1, F.concat(F.lit("c"), d.cast("string"))).alias("chunk_id"), F.when(d % 5 == 0, "").otherwise(F.col("text")).alias("content")).alias("metadata"),
    )
    return index.flattened(items).select("doc_id", "id", "chunk_id", digest(F.col("content")).alias("digest"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the labels say of them, as chunks with all kinds of missing values."""
    labels = table(spark, sf_dir, "labels")
    own = docs(spark, sf_dir).join(labels, "doc_id", "left")
    return own.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_0001")).alias("chunk_id"), F.concat("source", F.lit(".pdf")).alias("file_name"), F.col("source").alias("title"), F.col("lang").alias("organization"), F.when(F.col("quality") == 1, F.col("n_chars").cast("double")).when(F.col("quality") == 0, F.lit(float("nan"))).alias("budget"), F.col("quality").alias("page_number"), F.col("text").alias("content"))


SQL_CHUNKS = "ch AS (SELECT documents.doc_id, documents.doc_id || '_0001' AS chunk_id, source || '.pdf' AS file_name, source AS title, lang AS organization, quality, n_chars, text AS content FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id)"


@query("embed_text", f"WITH {SQL_CHUNKS} SELECT doc_id, md5('title: ' || title || chr(10) || 'organization: ' || organization || chr(10) || 'content: ' || content) AS digest FROM ch")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).drop("budget")
    return own.select("doc_id", digest(index.embed_text(own.columns)).alias("digest"))


@query("evidence_text", f"WITH {SQL_CHUNKS} SELECT doc_id, md5(concat_ws(chr(10), 'doc_id: ' || doc_id, 'chunk_id: ' || chunk_id, 'file_name: ' || file_name, 'title: ' || title, 'organization: ' || organization, CASE WHEN quality = 1 THEN 'budget: ' || n_chars END, 'page_number: ' || quality, CASE WHEN trim(content) <> '' THEN 'content: ' || content END)) AS digest FROM ch")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).withColumn("budget", F.when(~F.isnan("budget"), F.col("budget").cast("long")))
    return own.select("doc_id", digest(evidence_text(own.columns, dict(own.dtypes))).alias("digest"))


def _hit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).drop("budget").withColumnRenamed("doc_id", "point_id")
    return hits(spark, sf_dir).filter("rank <= 5").select("query_id", "point_id", "rank", "query_text").join(own, "point_id")


SQL_LINES = "'file_name: ' || file_name || chr(10) || 'page_number: ' || coalesce(CAST(quality AS VARCHAR), 'N/A') || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'title: ' || title || chr(10) || 'organization: ' || organization || chr(10) || 'content: ' || content"
SQL_CONTEXT = f"WITH {SQL_HITS}, {SQL_CHUNKS}, cx AS (SELECT query_id, string_agg({SQL_LINES}, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN ch ON ch.doc_id = point_id WHERE rank <= 5 GROUP BY query_id)"


@query("prompt_context", f"{SQL_CONTEXT} SELECT item_id AS query_id, md5(coalesce(context, 'No matching documents.')) AS digest FROM benchmark LEFT JOIN cx ON query_id = item_id")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _hit_chunks(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return context.build(asked, own, context.hit_text([c for c in own.columns if c != "query_text"])).select("query_id", digest(F.col("context")).alias("digest"))


@query("prompt_assemble", "SELECT item_id AS query_id, md5(CASE item_id % 3 WHEN 0 THEN 'Answer from the context only, and name the source of each statement.' WHEN 1 THEN 'Answer from the context only. Work step by step, and name the source of each statement.' ELSE 'Answer from the context only, in the manner of the examples, and name the source of each statement.' END || chr(10) || chr(10) || '[context]' || chr(10) || 'C' || item_id || chr(10) || chr(10) || '[question]' || chr(10) || text) AS digest FROM benchmark")
def prompt_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("BASIC"), F.lit("cot_zero"), F.lit("cot_few")), (F.col("item_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "benchmark")
    return own.select(F.col("item_id").alias("query_id"), digest(context.prompt(F.col("text"), F.concat(F.lit("C"), F.col("item_id").cast("string")), mode)).alias("digest"))


@query("source_block", f"WITH {SQL_HITS}, {SQL_CHUNKS}, one AS (SELECT query_id, rank, file_name || coalesce(', p.' || quality, '') || ', chunk=' || chunk_id AS line FROM hits JOIN ch ON ch.doc_id = point_id WHERE rank <= 5) SELECT query_id, string_agg('- ' || line, chr(10) ORDER BY rank) AS sources FROM one GROUP BY query_id")
def source_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.source_block(_hit_chunks(spark, sf_dir).withColumn("section_title", F.lit(None).cast("string")))


@query("table_markdown", "SELECT item_id, '| id | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || item_id || ' | ' || replace(text, chr(10), ' ') || ' |' || chr(10) || '|  | end |' AS markdown FROM benchmark")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.array(F.lit("id"), F.lit("text")), F.array(F.col("item_id").cast("string"), F.col("text")), F.array(F.lit(None).cast("string"), F.lit("end")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.table_markdown(cells).alias("markdown"))


@query("ocr_reading_order", "SELECT l_orderkey, array_to_string(list_transform(list_sort(list({'r': CAST(floor(l_quantity / 10) AS BIGINT), 'x': l_extendedprice, 't': CAST(l_linenumber AS VARCHAR)})), lambda b: b.t), ' ') AS line FROM lineitem GROUP BY l_orderkey")
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as boxes: quantity as the height on a page, price as the place in a line."""
    box = F.struct(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_linenumber").cast("string").alias("text"))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return own.select("l_orderkey", F.array_join(T.reading_order(F.col("boxes")), " ").alias("line"))
