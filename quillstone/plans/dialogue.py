"""Conversation plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context
from ..sources.stored import shared_dir
from ..streaming import sessions
from .registry import ORACLES, query, sql_compact, sql_squeeze, table
from .text import digest

KINDS = ["factual", "comparative", "summarization", "procedural", "analytical", "filter_based"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user turn gets words that point back."""
    own = table(spark, sf_dir, "conversations")
    return own.withColumn("text", F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), F.concat(F.lit("그  사업 "), F.col("text"))).otherwise(F.col("text")))


SQL_TURNS = "t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN '그  사업 ' || text ELSE text END AS text FROM conversations)"


@query("ambiguous_turn", f"WITH {SQL_TURNS} SELECT conv_id, turn, role = 'user' AND conv_id % 3 = 0 AS ambiguous FROM t")
def ambiguous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.ambiguous(F.col("text")).alias("ambiguous"))


@query("history_window", f"WITH {SQL_TURNS} SELECT conv_id, turn, CAST(coalesce(len(h), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(h, chr(10)), '')) AS digest FROM (SELECT conv_id, turn, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM t)")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = context.history(turns(spark, sf_dir), 3)
    return own.select("conv_id", "turn", F.size("history").alias("n"), digest(F.array_join("history", "\n")).alias("digest"))


@query("rewrite_context", f"WITH {SQL_TURNS} SELECT conv_id, turn, conv_id % 3 = 0 AND h IS NOT NULL AND len(h) > 0 AS needs_rewrite, md5(coalesce(array_to_string(h, chr(10)), '')) AS digest FROM (SELECT conv_id, turn, role, list(role || ': ' || substr(text, 1, 200)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM t) WHERE role = 'user'")
def rewrite_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.rewrite_context(turns(spark, sf_dir)).select("conv_id", "turn", "needs_rewrite", digest(F.col("dialogue")).alias("digest"))


@query("final_answer", "SELECT conv_id, turn, md5(trim(text)) AS digest FROM conversations WHERE role = 'assistant'")
def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns put between a marker and a list of sources come out again."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    wrapped = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("first thoughts\n▶ 답변 : "), F.col("text"), F.lit("\n\n**출처 상세**\n- a.pdf")))
    return own.select("conv_id", "turn", digest(T.final_answer(wrapped)).alias("digest"))


@query("parse_reply", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparative' ELSE 'unknown' END AS kind FROM conversations")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with and without a code fence, of a kind that isn't known, and not JSON at all."""
    t = F.col("turn") % 4
    reply = F.when(t == 0, '```json\n{"type": " Factual ", "reason": "x"}\n```').when(t == 1, '{"type": "comparative"}').when(t == 2, '{"type": "poem"}').otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.reply_type(reply, KINDS).alias("kind"))


@query("reference_lookup", f"""WITH q AS (SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id * 1000 + turn AS ordinal, CASE WHEN conv_id % 2 = 0 THEN '  ' || text ELSE regexp_replace(text, ' ', '', 'g') END AS question, 'r' || conv_id || '-' || turn AS reference FROM conversations WHERE role = 'user' AND conv_id % 4 < 3),
a AS (SELECT {sql_squeeze('question')} AS key, arg_min(reference, ordinal) AS reference FROM k GROUP BY 1), b AS (SELECT {sql_compact('question')} AS key, arg_min(reference, ordinal) AS reference FROM k GROUP BY 1)
SELECT query_id, coalesce(a.reference, b.reference) AS reference FROM q LEFT JOIN a ON a.key = {sql_squeeze('q.text')} AND a.key <> '' LEFT JOIN b ON b.key = {sql_compact('q.text')} AND b.key <> ''""")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with known answers differ from the queries in spacing; some aren't known."""
    own = table(spark, sf_dir, "conversations").filter("role = 'user'")
    known = own.filter("conv_id % 4 < 3").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("  "), F.col("text"))).otherwise(F.replace("text", F.lit(" "), F.lit(""))).alias("question"), F.concat(F.lit("r"), F.concat_ws("-", "conv_id", "turn")).alias("reference"))
    return context.reference_answers(own.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"), known)


@query("history_stream", ORACLES["history_window"])
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histories from a stream: earlier and later turns arrive in micro-batches of their own, and state carries over."""
    base = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role", "text")
    for part in (F.col("turn") < 3, F.col("turn") >= 3):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = sessions.with_history(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), 3, None)
        own = stream.select("conv_id", "turn", F.size("history").alias("n"), digest(F.array_join("history", "\n")).alias("digest"))
        own.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
