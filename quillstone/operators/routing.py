"""Query routing: a kind by rules, and the search settings of the kind."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

ROUTE_SCHEMA = "query_type string, search_mode string, top_k int, score_threshold double, prompt_mode string, use_multi_query boolean"


class QueryType(StrEnum):
    FACTUAL = "factual"
    COMPARATIVE = "comparative"
    SUMMARIZATION = "summarization"
    PROCEDURAL = "procedural"
    ANALYTICAL = "analytical"
    FILTER_BASED = "filter_based"
    UNKNOWN = "unknown"


class PromptMode(StrEnum):
    BASIC = "basic"
    COT_ZERO = "cot_zero"
    COT_FEW = "cot_few"


def kind(text: Column, rules: list[tuple[str, str]] = fixed.ROUTE_RULES) -> Column:
    """The kind of the first rule that a query meets."""
    out = F.lit(fixed.UNKNOWN)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?U){pattern}"), name).otherwise(out)
    return out


def reason(text: Column, rules: list[tuple[str, str]] = fixed.ROUTE_RULES) -> Column:
    """What made that rule match; null without a match."""
    out = F.lit(None).cast("string")
    for _, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?U){pattern}"), F.regexp_extract(text, f"(?U)({pattern})", 1)).otherwise(out)
    return out


def routes(spark: SparkSession, overrides: list[tuple] | None = None) -> DataFrame:
    """One row for each kind: the defaults, or what overrides says of them (None keeps a default)."""
    base = spark.createDataFrame(fixed.ROUTES, ROUTE_SCHEMA)
    over = spark.createDataFrame(overrides or [], ROUTE_SCHEMA)
    names = [c for c in base.columns if c != "query_type"]
    return base.alias("b").join(over.alias("o"), "query_type", "left").select("query_type", *(F.coalesce(f"o.{c}", f"b.{c}").alias(c) for c in names))


def route(queries: DataFrame, table: DataFrame, rules: list[tuple[str, str]] = fixed.ROUTE_RULES) -> DataFrame:
    """queries: query_id, text, and if they have them forced and model_type: a forced kind, else a model's, else the rules'."""
    own = lambda c: F.col(c) if c in queries.columns else F.lit(None).cast("string")
    chosen = F.coalesce(own("forced"), F.nullif(own("model_type"), F.lit(fixed.UNKNOWN)), kind(F.col("text"), rules))
    return queries.withColumn("query_type", chosen).join(F.broadcast(table), "query_type")  # a row for each of seven kinds
