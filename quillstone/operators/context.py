"""Prompts and conversations: context from hits, prompt templates, source lists, history windows, reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.amounts import format_amount
from ..functions.text import ambiguous, compact, labelled_text, squeezed

#: Own wording; the mode decides how much of the reasoning is asked for.
INSTRUCTIONS = {
    "basic": "Answer from the context only, and name the source of each statement.",
    "cot_zero": "Answer from the context only. Work step by step, and name the source of each statement.",
    "cot_few": "Answer from the context only, in the manner of the examples, and name the source of each statement.",
}
NOTHING = "No matching documents."
MISSING = "N/A"


def hit_text(columns: list[str]) -> Column:
    """One hit as labelled lines, missing values marked."""
    fields = [(c, format_amount(F.col(c)) if c == "budget" else F.col(c)) for c in ("file_name", "page_number", "chunk_id", "title", "organization", "budget", "announcement_date", "bid_start", "bid_deadline", "section_title", "content") if c in columns]
    return labelled_text(fields, MISSING)


def build(queries: DataFrame, hits: DataFrame, text: Column) -> DataFrame:
    """query_id, context: the hits' texts in rank order, parted by blank lines. A query has few hits (its top k)."""
    own = hits.select("query_id", F.struct("rank", text.alias("text")).alias("h")).groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    joined = F.array_join(F.transform("hs", lambda h: h["text"]), "\n\n")
    return queries.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce(joined, F.lit(NOTHING)).alias("context"))


def prompt(question: Column, context: Column, mode: Column, instructions: dict[str, str] = INSTRUCTIONS) -> Column:
    """The mode's instructions (basic if it isn't known), context and question."""
    head = F.lit(instructions["basic"])
    for m, text in instructions.items():
        head = F.when(F.lower(mode) == m, text).otherwise(head)
    return F.concat(head, F.lit("\n\n[context]\n"), context, F.lit("\n\n[question]\n"), question)


def source_block(hits: DataFrame) -> DataFrame:
    """query_id, sources: one line per source in rank order; a source is a chunk id, else a file, page and section."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat_ws("|", "file_name", F.col("page_number").cast("string"), "section_title"))
    line = F.concat_ws(", ", "file_name", F.concat(F.lit("p."), F.col("page_number").cast("string")), F.concat(F.lit("chunk="), F.nullif("chunk_id", F.lit(""))))
    named = hits.filter(F.coalesce("file_name", F.lit("")) != "").groupBy("query_id", key.alias("_key")).agg(F.min(F.struct("rank", line.alias("line"))).alias("x"))
    every = named.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return every.select("query_id", F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("sources"))


def strip_sources(answer: Column) -> Column:
    """An answer without the list of sources that a model has put at its end."""
    return F.regexp_replace(F.trim(answer), r"(?s)\n*(?:\*{0,2}\s*)?\[?\s*출처\s*(?:상세|파일)\s*\]?\s*(?:\*{0,2})?\s*\n.*$", "")


def history(turns: DataFrame, n_turns: int) -> DataFrame:
    """turns with history: the 2 n messages before each, oldest first. turns: conv_id, turn, role, text."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * n_turns, -1)
    return turns.withColumn("history", F.collect_list(F.concat_ws(": ", "role", "text")).over(before))


def rewrite_context(turns: DataFrame, messages: int = 4, chars: int = 200) -> DataFrame:
    """conv_id, turn, needs_rewrite, dialogue: for user turns, the last messages, each cut to chars."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-messages, -1)
    lines = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars))).over(before)
    own = turns.withColumn("dialogue", F.array_join(lines, "\n")).filter("role = 'user'")
    return own.select("conv_id", "turn", (ambiguous(F.col("text")) & (F.col("dialogue") != "")).alias("needs_rewrite"), "dialogue")


def reference_answers(queries: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, reference: by equal text, else by equal text without white space; of equal questions the first counts.

    queries: query_id, text. known: ordinal, question, reference.
    """
    first = lambda key, name: known.filter(key != "").groupBy(key.alias("_key")).agg(F.min(F.struct("ordinal", "reference"))["reference"].alias(name))
    exact, loose = first(squeezed(F.col("question")), "exact"), first(compact(F.col("question")), "loose")
    rows = queries.withColumn("_a", squeezed(F.col("text"))).withColumn("_b", compact(F.col("text")))
    out = rows.join(exact, rows["_a"] == exact["_key"], "left").drop("_key").join(loose, F.col("_b") == loose["_key"], "left")
    return out.select("query_id", F.coalesce("exact", "loose").alias("reference"))
