"""Where queries and their SQL are collected, and helpers that plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query; sql: the same in DuckDB's SQL, where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space as Java's (?U)\s takes it, for RE2.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[A-Za-z0-9_\-]{2,}|[가-힣]{2,}"
STOP = "['the','and','for','with','this','that','from','into','about']"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_compact(x: str) -> str:
    return f"lower(regexp_replace({x}, '{WS}+', '', 'g'))"


def sql_tokens(x: str) -> str:
    """With repeats, without stop words."""
    return f"list_filter(list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t)), lambda t: NOT list_contains({STOP}, t))"


def sql_token_set(x: str) -> str:
    return f"list_distinct({sql_tokens(x)})"


def sql_hash(t: str) -> str:
    return f"CAST(('0x' || substr(md5({t}), 1, 8))::UBIGINT AS BIGINT)"
