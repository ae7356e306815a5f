"""Citation plans. Answers: a benchmark passage and a citation in one of several forms; chunks: the passage's five first keyword hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import verify
from ..sources.stored import stored
from .registry import WS, query, sql_compact, sql_squeeze, sql_token_set, table
from .rerank import SQL_HITS, hits
from .text import SQL_VALUES, digest

NOTHING = "not found|no information"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, answer. By id modulo 6: chunk ids, file and page, file, no source, nothing found, an id that no chunk has."""
    kind = F.col("item_id") % 6
    tail = (
        F.when(kind == 0, " See c0_0001 and c1_0001.").when(kind == 1, " Read source 0.pdf, p. 3, of 12 days.").when(kind == 2, " Read SOURCE0.PDF now, 1,500 won.")
        .when(kind == 3, " It ends on 2024-05-06.").when(kind == 4, "").otherwise(" Look at c9_0009, source9.pdf.")
    )
    text = F.when(kind == 4, "There is no information.").otherwise(F.concat(F.col("text"), tail))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), text.alias("answer"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage's hits, named by their rank, so that the answers' citations point somewhere; written once, as checks read them often."""
    r = (F.col("rank") - 1).cast("string")
    own = hits(spark, sf_dir).filter("rank <= 5")
    return stored(own.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("c"), r, F.lit("_0001")).alias("chunk_id"), F.concat(F.lit("source"), r, F.lit(".pdf")).alias("file_name"), F.col("rank").cast("int").alias("page_number"), F.col("text").alias("evidence")))


SQL_ANSWERS = """an AS (SELECT item_id AS answer_id, CASE item_id % 6 WHEN 4 THEN 'There is no information.' WHEN 0 THEN text || ' See c0_0001 and c1_0001.' WHEN 1 THEN text || ' Read source 0.pdf, p. 3, of 12 days.'
  WHEN 2 THEN text || ' Read SOURCE0.PDF now, 1,500 won.' WHEN 3 THEN text || ' It ends on 2024-05-06.' ELSE text || ' Look at c9_0009, source9.pdf.' END AS answer FROM benchmark)"""
SQL_CHUNKS = "ck AS (SELECT query_id AS answer_id, 'c' || (rank - 1) || '_0001' AS chunk_id, 'source' || (rank - 1) || '.pdf' AS file_name, CAST(rank AS INTEGER) AS page_number, text AS evidence FROM hits WHERE rank <= 5)"


def sql_claims(source: str, key: str, text: str) -> str:
    """CTEs up to cl: <key>, claim_no, claim. Sentence ends are marked, as RE2 can't look behind."""
    mark = "chr(30)"
    src = r"(?i)^\s*(?:[-*]\s*)?(?:source|sources|citation|citations|reference|references|file|filename|document|doc|page|section|chunk|출처|근거|파일명|문서|페이지|쪽|섹션|청크|제목|기관|예산|공고일|입찰기간|핵심내용|문서id)(?:[^\w\x{80}-\x{10ffff}]|$)"
    return rf"""l1 AS (SELECT {key}, unnest(li) AS line, generate_subscripts(li, 1) AS a FROM (SELECT {key}, string_split(replace({sql_squeeze(text)}, '. ', '.' || chr(10)), chr(10)) AS li FROM {source})),
l2 AS (SELECT {key}, a, trim(regexp_replace(line, '^{WS}*(?:[-*]|\d+[.)]){WS}*', '')) AS line FROM l1),
l3 AS (SELECT * FROM l2 WHERE line <> '' AND NOT regexp_matches(line, '{src}')),
p1 AS (SELECT {key}, a, unnest(ps) AS part, generate_subscripts(ps, 1) AS b FROM (SELECT {key}, a, string_split(regexp_replace(line, '([.!?다요니까]){WS}+', '\1' || {mark}, 'g'), {mark}) AS ps FROM l3)),
p2 AS (SELECT {key}, a, b, trim(regexp_replace(regexp_replace(trim(part, ' -' || chr(9)), '\b[A-Za-z0-9][A-Za-z0-9_.-]*_\d{{4,}}\b', '', 'g'), '\[\s*\]', '', 'g'), ' -[]' || chr(9)) AS claim FROM p1),
p3 AS (SELECT *, {sql_compact('claim')} AS ck FROM p2 WHERE length(claim) >= 8 AND NOT regexp_matches(claim, '{src}')),
p4 AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY {key}, ck ORDER BY a, b) = 1),
cl AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY a, b) AS claim_no, claim FROM p4)"""


@query("split_claims", f"WITH c AS (SELECT conv_id || '-' || turn AS answer_id, text FROM conversations WHERE role = 'assistant'), {sql_claims('c', 'answer_id', 'text')} SELECT answer_id, claim_no, md5(claim) AS digest FROM cl")
def split_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.col("text").alias("answer"))
    return verify.split_claims(own).select("answer_id", "claim_no", digest(F.col("claim")).alias("digest"))


SQL_PAGES = r"list_distinct(list_transform(list_concat(regexp_extract_all(answer, '(?i)(?:p\.?|page|페이지|쪽)\s*[:.]?\s*(\d+)', 1), regexp_extract_all(answer, '(?i)(\d+)\s*(?:p\.?|page|페이지|쪽)\b', 1)), lambda x: CAST(x AS INTEGER)))"


@query("find_pages", f"WITH {SQL_ANSWERS} SELECT answer_id, array_to_string(list_sort({SQL_PAGES}), ',') AS pages FROM an")
def find_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("answer_id", F.array_join(F.array_sort(T.find_pages(F.col("answer"))), ",").alias("pages"))


@query("find_chunk_ids", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' see c' || doc_id || '_0001, and a_123', '\b[A-Za-z0-9][A-Za-z0-9_.-]*_\d{4,}\b'))), ',') AS ids FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM documents)")
def find_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), F.lit(" see c"), F.col("doc_id").cast("string"), F.lit("_0001, and a_123"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.find_chunk_ids(text)), ",").alias("ids"))


@query("not_found_flag", f"WITH {SQL_ANSWERS} SELECT answer_id, regexp_matches(answer, '(?i){NOTHING}') AS nothing FROM an")
def not_found_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("answer_id", T.not_found(F.col("answer"), NOTHING).alias("nothing"))


SQL_CITED = f"""{SQL_HITS}, {SQL_ANSWERS}, {SQL_CHUNKS},
ci AS (SELECT answer_id, answer, {SQL_PAGES} AS pages FROM an),
cid AS (SELECT DISTINCT ck.answer_id, chunk_id FROM ci JOIN ck ON ck.answer_id = ci.answer_id AND list_contains(regexp_extract_all(answer, '\\b[A-Za-z0-9][A-Za-z0-9_.-]*_\\d{{4,}}\\b'), chunk_id)),
cfn AS (SELECT DISTINCT ck.answer_id, file_name FROM ci JOIN ck ON ck.answer_id = ci.answer_id AND contains({sql_compact('answer')}, {sql_compact('file_name')})),
lv AS (SELECT ck.answer_id, ck.chunk_id, CASE WHEN ck.answer_id IN (SELECT answer_id FROM cid) THEN CASE WHEN cid.chunk_id IS NOT NULL THEN 0 END WHEN cfn.file_name IS NOT NULL AND (list_contains(pages, page_number) OR list_contains(pages, page_number + 1)) THEN 1 WHEN cfn.file_name IS NOT NULL THEN 2 END AS level
  FROM ck JOIN ci ON ci.answer_id = ck.answer_id LEFT JOIN cid ON cid.answer_id = ck.answer_id AND cid.chunk_id = ck.chunk_id LEFT JOIN cfn ON cfn.answer_id = ck.answer_id AND cfn.file_name = ck.file_name),
ca AS (SELECT answer_id, chunk_id, ['chunk_id', 'file_page', 'file_only'][level + 1] AS source_mode FROM lv WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY answer_id))"""


@query("find_file_names", f"WITH {SQL_CITED} SELECT * FROM cfn")
def find_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.find_file_names(answers(spark, sf_dir), chunks(spark, sf_dir))


@query("page_match", f"WITH {SQL_CITED} SELECT ck.answer_id, chunk_id, list_contains(pages, page_number) OR list_contains(pages, page_number + 1) AS matches FROM ck JOIN ci ON ci.answer_id = ck.answer_id")
def page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir)
    cited = verify.citations(answers(spark, sf_dir), own)
    return own.join(cited.select("answer_id", "pages"), "answer_id").select("answer_id", "chunk_id", T.page_match(F.col("page_number"), F.col("pages")).alias("matches"))


@query("citation_candidates", f"WITH {SQL_CITED} SELECT * FROM ca")
def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = answers(spark, sf_dir), chunks(spark, sf_dir)
    return verify.candidates(verify.citations(a, c), c)


SQL_CLAIMED = f"""{SQL_CITED}, {sql_claims('an', 'answer_id', 'answer')},
cv AS (SELECT answer_id, claim_no, claim, {sql_token_set(sql_squeeze('claim'))} AS q, {SQL_VALUES.replace('(p,', '(claim,')} AS vals FROM cl),
ev AS (SELECT answer_id, chunk_id, {sql_token_set(sql_squeeze('evidence'))} AS have, replace({sql_compact('evidence')}, ',', '') AS flat FROM ck),
sc AS (SELECT answer_id, claim_no, claim, chunk_id, len(list_filter(vals, lambda v: NOT contains(flat, v))) AS n_missing, len(vals) AS nv, CASE WHEN len(q) > 0 THEN len(list_intersect(q, have)) / len(q) ELSE 0.0 END AS lx FROM cv JOIN ev USING (answer_id)),
sd AS (SELECT answer_id, claim_no, claim, chunk_id, n_missing, CASE WHEN nv > 0 THEN 0.45::DOUBLE * lx + 0.55::DOUBLE * (nv - n_missing) / nv ELSE lx END AS score FROM sc)"""


@query("value_score", f"WITH {SQL_CLAIMED} SELECT answer_id, claim_no, chunk_id, round(CASE WHEN nv > 0 THEN 1 - n_missing / nv ELSE 1.0 END, 6) AS found FROM sc")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = verify.split_claims(answers(spark, sf_dir)).join(chunks(spark, sf_dir), "answer_id")
    return own.select("answer_id", "claim_no", "chunk_id", F.round(T.value_score(T.extract_values(F.col("claim")), F.col("evidence")), 6).alias("found"))


@query("claim_score", f"WITH {SQL_CLAIMED} SELECT answer_id, claim_no, chunk_id, round(score, 4) AS score, CAST(n_missing AS INTEGER) AS n_missing FROM sd")
def claim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.claim_scores(verify.split_claims(answers(spark, sf_dir)), chunks(spark, sf_dir))


@query("claim_best_evidence", f"WITH {SQL_CLAIMED} SELECT answer_id, claim_no, chunk_id, round(score, 4) AS score, CAST(n_missing AS INTEGER) AS n_missing FROM sd QUALIFY row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY score DESC, chunk_id) = 1")
def claim_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.best_evidence(verify.split_claims(answers(spark, sf_dir)), chunks(spark, sf_dir))


@query("lexical_topn", f"WITH {SQL_CLAIMED} SELECT answer_id, claim_no, chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY round(score, 4) DESC, chunk_id) AS rank FROM sd WHERE round(score, 4) > 0 QUALIFY rank <= 3")
def lexical_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lexical_top(verify.split_claims(answers(spark, sf_dir)), chunks(spark, sf_dir), 3).drop("n_missing")


SQL_STATUS = f"""{SQL_CLAIMED},
md AS (SELECT an.answer_id, CASE WHEN an.answer_id IN (SELECT answer_id FROM cid) THEN 'chunk_id' WHEN an.answer_id IN (SELECT answer_id FROM cfn) THEN 'file' ELSE 'missing' END AS cited, (SELECT max(source_mode) FROM ca WHERE ca.answer_id = an.answer_id) AS source_mode FROM an),
be AS (SELECT sd.answer_id, claim_no, score, n_missing FROM sd JOIN ca ON ca.answer_id = sd.answer_id AND ca.chunk_id = sd.chunk_id QUALIFY row_number() OVER (PARTITION BY sd.answer_id, claim_no ORDER BY score DESC, sd.chunk_id) = 1),
st AS (SELECT cl.answer_id, cl.claim_no, claim, coalesce(source_mode, cited) AS source_mode, round(score, 4) AS score,
  CASE WHEN cited = 'missing' THEN 'missing_citation' WHEN source_mode IS NULL THEN 'bad_source_location' WHEN score IS NULL OR n_missing > 0 THEN 'unclear' WHEN round(score, 4) >= 0.55 THEN 'clear' WHEN round(score, 4) >= 0.25 THEN 'partial' ELSE 'unclear' END AS status
  FROM cl JOIN md ON md.answer_id = cl.answer_id LEFT JOIN be ON be.answer_id = cl.answer_id AND be.claim_no = cl.claim_no)"""


@query("claim_status", f"WITH {SQL_STATUS} SELECT answer_id, claim_no, source_mode, status, score FROM st")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.check_claims(answers(spark, sf_dir), chunks(spark, sf_dir)).select("answer_id", "claim_no", "source_mode", "status", "score")


SQL_OVERALL = "ov AS (SELECT an.answer_id, CASE WHEN n IS NULL THEN 'no_claims' WHEN bad THEN 'needs_review' WHEN part THEN 'partial' ELSE 'clear' END AS overall_status, coalesce(n, 0) AS claim_count FROM an LEFT JOIN (SELECT answer_id, count(*) AS n, bool_or(status IN ('bad_source_location', 'missing_citation', 'unclear')) AS bad, bool_or(status = 'partial') AS part FROM st GROUP BY answer_id) x ON x.answer_id = an.answer_id)"


@query("answer_status", f"WITH {SQL_STATUS}, {SQL_OVERALL} SELECT * FROM ov")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return verify.overall(a, verify.check_claims(a, chunks(spark, sf_dir)))


@query("verify_answers", f"WITH {SQL_STATUS}, {SQL_OVERALL} SELECT ov.answer_id, CASE WHEN regexp_matches(answer, '(?i){NOTHING}') AND cited = 'missing' THEN 'not_found_response' ELSE overall_status END AS overall_status, CASE WHEN regexp_matches(answer, '(?i){NOTHING}') AND cited = 'missing' THEN 0 ELSE claim_count END AS claim_count FROM ov JOIN an ON an.answer_id = ov.answer_id JOIN md ON md.answer_id = ov.answer_id")
def verify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify(answers(spark, sf_dir), chunks(spark, sf_dir), NOTHING)[1]


SQL_ISSUES = f"""WITH {SQL_STATUS}, bad AS (SELECT * FROM st WHERE status <> 'clear'),
s AS (SELECT answer_id, string_agg(x, ', ' ORDER BY x) AS summary FROM (SELECT answer_id, status || ' ' || count(*) AS x FROM bad GROUP BY answer_id, status) GROUP BY answer_id),
e AS (SELECT answer_id, string_agg(status || ' | ' || CASE WHEN length(claim) > 100 THEN rtrim(substr(claim, 1, 100)) || '...' ELSE claim END, chr(10) ORDER BY claim_no) AS examples FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY claim_no) <= 3) GROUP BY answer_id)
SELECT answer_id, summary, examples FROM s JOIN e USING (answer_id)"""


@query("issue_summary", SQL_ISSUES)
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.issues(verify.check_claims(answers(spark, sf_dir), chunks(spark, sf_dir)))
