"""Chunking plans over whole documents; embeddings stand for sentence vectors, twenty to a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from .registry import query, table
from .text import digest

SQL_FIXED = "fx AS (SELECT doc_id, lang, source, pos, substr(text, pos * 450 + 1, 500) AS content FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - 50) / 450.0) AS BIGINT)))) AS pos FROM documents WHERE length(text) > 0))"


@query("chunk_fixed", f"WITH {SQL_FIXED} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(content) AS INTEGER) AS n, md5(content) AS digest FROM fx")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.fixed(table(spark, sf_dir, "documents"))
    return own.select("doc_id", "pos", F.length("content").alias("n"), digest(F.col("content")).alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.chunk(table(spark, sf_dir, "documents"), "recursive", "doc_id")
    return own.select("doc_id", "pos", F.length("content").alias("n"), digest(F.col("content")).alias("digest"))


@query("chunk_seq", f"WITH {SQL_FIXED} SELECT doc_id, pos + 1 AS seq, format('{{}}_{{:04d}}', doc_id, pos + 1) AS chunk_id FROM fx")
def chunk_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.numbered(chunking.fixed(table(spark, sf_dir, "documents")), "doc_id", "pos").select("doc_id", "seq", "chunk_id")


SQL_PAYLOAD = f"""WITH {SQL_FIXED},
m AS (SELECT doc_id AS key, CASE WHEN toxic = 1 THEN ' ' ELSE 'N' || doc_id END AS number, quality FROM labels)
SELECT coalesce(nullif(trim(number), ''), 'doc' || fx.doc_id) AS doc_id, coalesce(nullif(trim(number), ''), 'doc' || fx.doc_id) || format('_{{:04d}}', pos + 1) AS chunk_id, coalesce('T' || quality, 'doc' || fx.doc_id) AS title, CASE WHEN key IS NOT NULL THEN 'org' END AS organization, 'pdf' AS file_type, md5(content) AS digest
FROM fx LEFT JOIN m ON m.key = fx.doc_id"""


@query("chunk_payload", SQL_PAYLOAD)
def chunk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the metadata of some files; of those, toxic ones lack a number."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    own = chunking.fixed(table(spark, sf_dir, "documents")).select(name.alias("file_key"), name.alias("stem"), F.lit(None).cast("int").alias("page_number"), "pos", "content", F.lit("pdf").alias("file_type"))
    meta = table(spark, sf_dir, "labels").select(name.alias("file_key"), F.when(F.col("toxic") == 1, " ").otherwise(F.concat(F.lit("N"), F.col("doc_id").cast("string"))).alias("doc_id"), F.concat(F.lit("T"), F.col("quality").cast("string")).alias("title"), F.lit("org").alias("organization"))
    return chunking.payload(own, meta).select("doc_id", "chunk_id", "title", "organization", "file_type", digest(F.col("content")).alias("digest"))


SQL_SENTENCES = r"""se AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS content FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents))"""


@query("sentence_window", f"WITH {SQL_SENTENCES}, l AS (SELECT doc_id, list(content ORDER BY pos) AS xs FROM se GROUP BY doc_id), w AS (SELECT doc_id, xs, unnest(range(0, CAST(ceil(len(xs) / 3.0) AS BIGINT))) AS pos FROM l) SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(substr(array_to_string(xs[pos * 3 + 1:pos * 3 + 4], ' '), 1, 4000)) AS digest FROM w")
def sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sentences a window, one in common with the next."""
    units = chunking.sentences(table(spark, sf_dir, "documents"), "doc_id")
    return chunking.windows(units, "doc_id").select("doc_id", "pos", digest(F.col("content")).alias("digest"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 20).alias("text_id"), (F.col("vec_id") % 20).alias("pos"), F.col("vec_id").cast("string").alias("content"), F.col("embedding").alias("vector"))


SQL_BREAKS = """u AS (SELECT vec_id // 20 AS text_id, vec_id % 20 AS pos, CAST(vec_id AS VARCHAR) AS content, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT *, round(1 - list_cosine_similarity(e, lag(e) OVER (PARTITION BY text_id ORDER BY pos)), 9) AS distance FROM u),
th AS (SELECT text_id, quantile_cont(distance, 0.7) AS threshold FROM d GROUP BY text_id)"""


@query("semantic_breakpoints", f"WITH {SQL_BREAKS} SELECT text_id, round(threshold, 6) AS threshold FROM th")
def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.breakpoints(chunking.distances(_units(spark, sf_dir), "text_id"), "text_id")
    return own.select("text_id", F.round("threshold", 6).alias("threshold"))


@query("chunk_semantic", f"WITH {SQL_BREAKS}, c AS (SELECT text_id, pos, content, CAST(sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY pos) AS INTEGER) AS chunk FROM d JOIN th USING (text_id)) SELECT text_id, chunk, count(*) AS n_units, string_agg(content, ' ' ORDER BY pos) AS content FROM c GROUP BY text_id, chunk")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic(_units(spark, sf_dir), "text_id")


@query("context_inject", "SELECT documents.doc_id, CASE WHEN quality = 1 THEN source END AS context_summary, md5(CASE WHEN quality = 1 THEN source || chr(10) || chr(10) || text ELSE text END) AS digest FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def context_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for a model's summary; where the label is 0 the model gave a blank one."""
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("text", "content")
    out = chunking.with_context(own, F.when(F.col("quality") == 1, F.col("source")).when(F.col("quality") == 0, " "))
    return out.select("doc_id", "context_summary", digest(F.col("content")).alias("digest"))
