"""Citation checks over many answers at once: claims, cited chunks, the best evidence, a status.

answers: answer_id, answer. chunks: answer_id (whose retrieved chunks these are), chunk_id, file_name, page_number, evidence.
An answer has the few chunks that were retrieved for it, so joins on answer_id stay linear in the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import compact, extract_values, fields_text, find_chunk_ids, find_pages, lexical_score, missing_values, not_found, page_match, squeezed, token_set

#: Worst first.
SEVERITY = ("bad_source_location", "missing_citation", "unclear", "partial", "clear")
EVIDENCE = ("doc_id", "chunk_id", "file_name", "title", "organization", "budget", "announcement_date", "bid_start", "bid_deadline", "page_number", "section_title", "requirement_id", "content")


def evidence_text(columns: list[str], kinds: dict[str, str] | None = None) -> Column:
    """'field: value' lines of the fields there are; null, blank and NaN values are left out."""
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if (kinds or {}).get(c) in ("float", "double") else F.col(c)
    return fields_text([(c, value(c)) for c in EVIDENCE if c in columns])


def split_claims(answers: DataFrame, by_line: bool = False) -> DataFrame:
    """answer_id, claim_no (from 1), claim: sentences without list marks, source lines and chunk ids, each once.

    by_line: lines are told apart before white space is collapsed, so that every source line is recognised.
    """
    source = f"(?iU){fixed.SOURCE_LINE}"
    answer = F.coalesce("answer", F.lit(""))
    plain = F.transform(F.split(answer, r"\R"), squeezed) if by_line else F.array(squeezed(answer))
    lines = F.flatten(F.transform(plain, lambda x: F.split(F.replace(x, F.lit(". "), F.lit(".\n")), "\n")))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s*(?:[-*]|\d+[.)])\s*", "")))
    bare = F.filter(bare, lambda x: (x != "") & ~x.rlike(source))
    parts = F.flatten(F.transform(bare, lambda x: F.split(x, rf"(?U)(?<=[{fixed.SENTENCE_ENDS}])\s+")))
    clean = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x, F.lit(" -\t")), fixed.CHUNK_ID, ""), r"\[\s*\]", ""))
    kept = F.filter(F.transform(clean, lambda x: F.trim(x, F.lit(" -\t[]"))), lambda x: (F.length(x) >= fixed.CLAIM_MIN) & ~x.rlike(source))
    rows = answers.select("answer_id", F.posexplode(kept).alias("at", "claim"))
    first = rows.groupBy("answer_id", compact(F.col("claim")).alias("_key")).agg(F.min(F.struct("at", "claim")).alias("x"))
    number = F.row_number().over(W.partitionBy("answer_id").orderBy("x.at"))
    return first.select("answer_id", number.alias("claim_no"), F.col("x.claim").alias("claim"))


def find_file_names(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, file_name: names of the answer's chunks that its text contains, whatever the spacing and case."""
    names = chunks.filter("file_name != ''").select("answer_id", "file_name").distinct()
    return names.join(answers, "answer_id").filter(F.contains(compact(F.col("answer")), compact(F.col("file_name")))).select("answer_id", "file_name")


def citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers with chunk_ids, file_names and pages that they cite."""
    ids = answers.select("answer_id", F.explode(find_chunk_ids(F.col("answer"))).alias("chunk_id")).join(chunks.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi")
    per_id = ids.groupBy("answer_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    names = find_file_names(answers, chunks).groupBy("answer_id").agg(F.array_sort(F.collect_set("file_name")).alias("file_names"))
    none = F.array().cast("array<string>")
    out = answers.join(per_id, "answer_id", "left").join(names, "answer_id", "left")
    return out.withColumns({"chunk_ids": F.coalesce("chunk_ids", none), "file_names": F.coalesce("file_names", none), "pages": find_pages(F.col("answer"))})


def candidates(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, chunk_id, source_mode: cited chunks by id, else by file and page, else by file."""
    rows = chunks.join(cited.select("answer_id", "chunk_ids", "file_names", "pages"), "answer_id")
    by_id = F.array_contains("chunk_ids", F.col("chunk_id"))
    by_file = F.array_contains("file_names", F.col("file_name"))
    by_page = by_file & page_match(F.col("page_number"), F.col("pages"))
    level = F.when(F.size("chunk_ids") > 0, F.when(by_id, 0)).when(by_page, 1).when(by_file, 2)
    placed = rows.select("answer_id", "chunk_id", level.alias("level")).filter("level IS NOT NULL")
    best = placed.groupBy("answer_id").agg(F.min("level").alias("level"))
    mode = F.element_at(F.array(*map(F.lit, ("chunk_id", "file_page", "file_only"))), F.col("level") + 1)
    return placed.join(best, ["answer_id", "level"]).select("answer_id", "chunk_id", mode.alias("source_mode"))


def _scored(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every claim with every chunk of its answer: score, missing values."""
    own = claims.select("answer_id", "claim_no", "claim", token_set(squeezed(F.col("claim"))).alias("_tokens"), extract_values(F.col("claim")).alias("claim_values"))
    texts = chunks.select("answer_id", "chunk_id", "evidence", token_set(squeezed(F.col("evidence"))).alias("_have"))
    rows = own.join(texts, "answer_id").withColumn("missing", missing_values(F.col("claim_values"), F.col("evidence")))
    words = lexical_score(F.col("_tokens"), F.col("_have"))
    n = F.size("claim_values")
    score = F.when(n > 0, fixed.LEXICAL_WEIGHT * words + fixed.VALUE_WEIGHT * (n - F.size("missing")) / n).otherwise(words)
    return rows.select("answer_id", "claim_no", "claim", "claim_values", "chunk_id", "missing", score.alias("score"))


def claim_scores(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    return _scored(claims, chunks).select("answer_id", "claim_no", "chunk_id", F.round("score", 4).alias("score"), F.size("missing").alias("n_missing"))


def best_evidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, claim_no, chunk_id, score, n_missing of the best chunk; the smallest id of equal ones."""
    best = _scored(claims, chunks).groupBy("answer_id", "claim_no").agg(F.min(F.struct((-F.col("score")).alias("cost"), "chunk_id", F.size("missing").alias("n_missing"))).alias("x"))
    return best.select("answer_id", "claim_no", "x.chunk_id", F.round(-F.col("x.cost"), 4).alias("score"), "x.n_missing")


def lexical_top(claims: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The n best chunks of each claim that score at all, ranked."""
    own = claim_scores(claims, chunks).filter("score > 0")
    return own.withColumn("rank", F.row_number().over(W.partitionBy("answer_id", "claim_no").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= n)


def check_claims(answers: DataFrame, chunks: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """answer_id, claim_no, claim, source_mode, status, score, evidence_id of every claim."""
    own = split_claims(answers) if claims is None else claims
    cited = citations(answers, chunks)
    found = candidates(cited, chunks)
    mode = F.when(F.size("chunk_ids") > 0, "chunk_id").when(F.size("file_names") > 0, "file").otherwise("missing")
    modes = cited.select("answer_id", mode.alias("cited")).join(found.groupBy("answer_id").agg(F.max("source_mode").alias("source_mode")), "answer_id", "left")
    scores = _scored(own, chunks).select("answer_id", "claim_no", "chunk_id", "score", F.size("missing").alias("n_missing"))
    in_cited = scores.join(found.select("answer_id", "chunk_id", F.lit(True).alias("is_cited")), ["answer_id", "chunk_id"], "left")
    key = lambda: F.struct((-F.col("score")).alias("cost"), "chunk_id", "n_missing")
    best = in_cited.groupBy("answer_id", "claim_no").agg(F.min(F.when(F.col("is_cited"), key())).alias("of_cited"), F.min(F.when(F.col("score") > 0, key())).alias("of_all"))
    rows = own.join(modes, "answer_id").join(best, ["answer_id", "claim_no"], "left")
    score = F.round(-F.col("of_cited.cost"), 4)
    status = (
        F.when(F.col("cited") == "missing", "missing_citation")
        .when(F.col("source_mode").isNull(), "bad_source_location")
        .when(F.col("of_cited").isNull() | (F.col("of_cited.n_missing") > 0), "unclear")
        .when(score >= fixed.CLEAR, "clear").when(score >= fixed.PARTIAL, "partial").otherwise("unclear")
    )
    evidence = F.when(F.col("cited") == "missing", F.col("of_all.chunk_id")).otherwise(F.col("of_cited.chunk_id"))
    return rows.select("answer_id", "claim_no", "claim", F.coalesce("source_mode", "cited").alias("source_mode"), status.alias("status"), score.alias("score"), evidence.alias("evidence_id"))


def overall(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """answer_id, overall_status, claim_count; answers without claims too."""
    worst = F.min(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status")))
    per = checks.groupBy("answer_id").agg(worst.alias("worst"), F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "no_claims").when(F.col("worst") <= 3, "needs_review").when(F.col("worst") == 4, "partial").otherwise("clear")
    return answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", state.alias("overall_status"), F.coalesce("n", F.lit(0)).alias("claim_count"))


def verify(answers: DataFrame, chunks: DataFrame, nothing: str = fixed.NOT_FOUND) -> tuple[DataFrame, DataFrame]:
    """(checks, overall). Answers that say that nothing was found and cite nothing are not checked; those for which nothing was retrieved need review."""
    cited = citations(answers, chunks)
    told = cited.filter(not_found(F.col("answer"), nothing) & (F.size("chunk_ids") == 0) & (F.size("file_names") == 0)).select("answer_id")
    empty = answers.join(chunks.select("answer_id").distinct(), "answer_id", "left_anti").select("answer_id")
    open_ = answers.join(told.unionByName(empty).distinct(), "answer_id", "left_anti")
    checks = check_claims(open_, chunks)
    zero = F.lit(0).cast("long").alias("claim_count")
    rest = told.join(empty, "answer_id", "left_anti").select("answer_id", F.lit("not_found_response").alias("overall_status"), zero).unionByName(empty.select("answer_id", F.lit("needs_review").alias("overall_status"), zero))
    return checks, overall(open_, checks).unionByName(rest)


def issues(checks: DataFrame, shown: int = 3, limit: int = 100) -> DataFrame:
    """answer_id, summary ('status n, ...' in alphabetical order), examples: the first claims that aren't clear, cut to limit characters."""
    bad = checks.filter(F.col("status") != "clear")
    counts = bad.groupBy("answer_id", "status").agg(F.count("*").alias("n"))
    summary = counts.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "status", F.col("n").cast("string")))), ", ").alias("summary"))
    text = F.when(F.length("claim") > limit, F.concat(F.rtrim(F.substring("claim", 1, limit)), F.lit("..."))).otherwise(F.col("claim"))
    first = bad.withColumn("_n", F.row_number().over(W.partitionBy("answer_id").orderBy("claim_no"))).filter(F.col("_n") <= shown)
    lines = first.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(" | ", "status", text).alias("line")))).alias("xs"))
    return summary.join(lines, "answer_id").select("answer_id", "summary", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("examples"))
