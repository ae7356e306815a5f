"""Metadata tables, evaluation sets and chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.text import name_key, url_basename

# Columns of the metadata table, and the fields that they become.
HEADERS = {
    "파일명": "file_name", "공고 번호": "doc_id", "사업명": "title", "발주 기관": "organization", "사업 금액": "budget", "공개 일자": "announcement_date",
    "입찰 참여 시작일": "bid_start", "입찰 참여 마감일": "bid_deadline", "사업 요약": "section_title", "파일형식": "file_type",
}
REQUIRED = "파일명"


def header_map(columns: list[str], headers: dict[str, str] = HEADERS) -> dict[str, str]:
    """Columns by field: equal names first, then the first column that contains a name, spaces apart."""
    bare = {c: c.replace("﻿", "").replace(" ", "") for c in columns}
    out: dict[str, str] = {}
    for test in (lambda c, h: c == h, lambda c, h: h in c):
        for head, field in headers.items():
            if field not in out and (found := next((c for c in columns if c not in out.values() and test(bare[c], head.replace(" ", ""))), None)):
                out[field] = found
    return out


def read_metadata(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "EUC-KR"), headers: dict[str, str] = HEADERS) -> DataFrame:
    """All fields as text but budget; file_key and ordinal (order of rows in the file) besides. The first encoding whose header has the file name's column counts.

    Of Java's charsets Spark takes only a few unless the session allows all of them, so it is told to.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for encoding in encodings:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, inferSchema=False)
        found = header_map(raw.columns, headers)
        if "file_name" in found:
            break
    else:
        raise ValueError(f"no column {REQUIRED} in {path}")
    cell = lambda f: F.nullif(F.trim(F.col(f"`{found[f]}`")), F.lit("")) if f in found else F.lit(None).cast("string")
    own = raw.select(F.monotonically_increasing_id().alias("ordinal"), *((parse_amount(cell(f)) if f == "budget" else cell(f)).alias(f) for f in headers.values()))
    return own.filter("file_name IS NOT NULL").withColumn("file_key", name_key(url_basename(F.col("file_name"))))


EVAL_SCHEMA = "file_name string, user_input string, reference string, comment string"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, user_input, reference, comment, relevant_id; records without a file name are left out."""
    raw = spark.read.json(path, schema=EVAL_SCHEMA, multiLine=True).withColumn("query_id", F.monotonically_increasing_id())
    clean = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    return raw.filter(F.trim("file_name") != "").select("query_id", clean("user_input"), clean("reference"), clean("comment"), name_key(url_basename(F.col("file_name"))).alias("relevant_id"))


CHUNK_FIELDS = ("doc_id", "chunk_id", "title", "organization", "budget", "announcement_date", "bid_start", "bid_deadline", "page_number", "section_title", "content", "file_name", "file_type", "context_summary")
CHUNK_SCHEMA = "id string, metadata struct<" + ", ".join(f"{f}: {'double' if f == 'budget' else 'int' if f == 'page_number' else 'string'}" for f in CHUNK_FIELDS) + ">"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as they are written: id and a struct of the fields."""
    return spark.read.json(path, schema=CHUNK_SCHEMA, multiLine=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions."""
    have = [F.col(f).alias(f) for f in CHUNK_FIELDS if f in chunks.columns]
    chunks.select(F.col("chunk_id").alias("id"), F.struct(*have).alias("metadata")).write.mode("overwrite").json(path)
