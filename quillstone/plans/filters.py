"""Filter, amount, date and routing plans. Tenders: orders with their customers; conversations give the queries to route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import filters, routing
from ..operators.filters import MetadataFilter
from .registry import query, table


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return own.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("budget"), F.col("o_orderdate").alias("announcement_date"), F.col("c_name").alias("organization"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("file_type"), F.col("o_orderstatus").alias("state"))


SQL_TENDERS = "t AS (SELECT o_orderkey AS doc_id, o_totalprice AS budget, o_orderdate AS announcement_date, c_name AS organization, o_orderpriority AS title, c_mktsegment AS file_type, o_orderstatus AS state FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("filter_range", f"WITH {SQL_TENDERS} SELECT doc_id, budget FROM t WHERE budget BETWEEN 100000 AND 150000")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders(spark, sf_dir).filter(MetadataFilter(budget_min=100000, budget_max=150000).condition()).select("doc_id", "budget")


@query("filter_org_any", f"WITH {SQL_TENDERS} SELECT doc_id, organization FROM t WHERE list_has_all(regexp_split_to_array(lower(organization), '[^a-z0-9_]+'), ['customer', '000000003']) OR list_has_all(regexp_split_to_array(lower(organization), '[^a-z0-9_]+'), ['customer', '000000012'])")
def filter_org_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = MetadataFilter(organization=["customer#000000003", "Customer#000000012"])
    return tenders(spark, sf_dir).filter(wanted.condition()).select("doc_id", "organization")


@query("filter_datetime", f"WITH {SQL_TENDERS} SELECT doc_id, announcement_date FROM t WHERE announcement_date >= TIMESTAMP '1996-02-01' AND announcement_date <= TIMESTAMP '1996-02-29 23:59:59'")
def filter_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month: partial dates become its first and its last second."""
    wanted = MetadataFilter(announcement_after="1996-02", announcement_before="1996-02")
    return tenders(spark, sf_dir).filter(wanted.condition()).select("doc_id", "announcement_date")


@query("filter_keyword_eq", f"WITH {SQL_TENDERS} SELECT doc_id, title FROM t WHERE list_has_all(regexp_split_to_array(lower(title), '[^a-z0-9_]+'), ['high', '2'])")
def filter_keyword_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders(spark, sf_dir).filter(MetadataFilter(title_keyword="high 2").condition()).select("doc_id", "title")


@query("filter_merge", """SELECT query_id, array_to_string(list_distinct_in_order, '|') AS organization, coalesce(a_min, b_min) AS budget_min, b_max AS budget_max FROM (
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN 100.0 END AS a_min, o_totalprice AS b_min, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS b_max,
  CASE WHEN o_orderpriority = o_orderstatus THEN [o_orderpriority] ELSE [o_orderpriority, o_orderstatus] END AS list_distinct_in_order FROM orders)""")
def filter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit filters of many queries over what their texts gave."""
    null = F.lit(None).cast("string")
    make = lambda orgs, low, high: F.struct(orgs.alias("organization"), low.alias("budget_min"), high.alias("budget_max"), *(null.alias(f) for f in filters.FIELDS[3:]))
    k, none = F.col("o_orderkey"), F.lit(None).cast("double")
    own = make(F.array("o_orderpriority"), F.when(k % 2 == 0, F.lit(100.0)), none)
    other = make(F.array("o_orderpriority", "o_orderstatus"), F.col("o_totalprice"), F.when(k % 3 == 0, F.col("o_totalprice")))
    both = table(spark, sf_dir, "orders").select(k.alias("query_id"), own.alias("a"), other.alias("b"))
    return both.select("query_id", *filters.merged_columns("a", "b")).select("query_id", F.array_join("organization", "|").alias("organization"), "budget_min", "budget_max")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query text for each order: a customer with a particle, an amount and a day; the status decides the direction."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    amount = F.concat(F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit("만원 "))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    s = F.col("o_orderstatus")
    text = F.concat("c_name", F.lit("에서 발주한 예산 "), amount, F.when(s == "F", "이상").otherwise("이하"), F.lit(" 공고일 "), day, F.when(s == "P", " 이전").when(s == "F", " 이후").otherwise(""))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("query_id"), text.alias("text"))


SQL_ASKED = """asked AS (SELECT o_orderkey AS query_id, c_name || '에서 발주한 예산 ' || CAST(floor(o_totalprice / 10000) AS BIGINT) || '만원 ' || CASE WHEN o_orderstatus = 'F' THEN '이상' ELSE '이하' END || ' 공고일 ' || strftime(o_orderdate, '%Y-%m-%d')
  || CASE o_orderstatus WHEN 'P' THEN ' 이전' WHEN 'F' THEN ' 이후' ELSE '' END AS text FROM orders JOIN customer ON c_custkey = o_custkey)"""


def sql_found(names: str, queries: str = "asked") -> str:
    """CTE found: query_id, organization; names: SQL of a table with the column organization."""
    return f"""met AS (SELECT DISTINCT query_id, organization FROM {queries} JOIN ({names}) ON contains(lower(text), lower(organization))),
found AS (SELECT * FROM met WHERE NOT EXISTS (SELECT 1 FROM met l WHERE l.query_id = met.query_id AND length(l.organization) > length(met.organization) AND contains(lower(l.organization), lower(met.organization))))"""


@query("filter_auto", f"""WITH {SQL_ASKED}, {sql_found("SELECT c_name AS organization FROM customer")},
p AS (SELECT query_id, nullif(CAST(regexp_extract(text, '(\\d+)만원', 1) AS DOUBLE) * 10000, 0) AS v, regexp_extract(text, '공고일 ([0-9-]+)', 1) AS d, contains(text, '이상') AS low, contains(text, '이후') AS after, contains(text, '이전') AS before FROM asked)
SELECT p.query_id, organization, CASE WHEN low THEN v END AS budget_min, CASE WHEN NOT low THEN v END AS budget_max, CASE WHEN after OR NOT before THEN d END AS announcement_after, CASE WHEN NOT after THEN d END AS announcement_before FROM p LEFT JOIN found ON found.query_id = p.query_id""")
def filter_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text has one customer's name, so a list of them has one item."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("organization"))
    own = filters.from_queries(_asked(spark, sf_dir), names)
    return own.select("query_id", F.array_join("organization", "|").alias("organization"), "budget_min", "budget_max", "announcement_after", "announcement_before")


@query("extract_budget", """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10000) AS BIGINT) || '만원' || CASE o_orderstatus WHEN 'F' THEN ' 이상' WHEN 'P' THEN ' 이하' ELSE ' ~ 1억원' END AS text FROM orders),
o AS (SELECT o_orderkey, text, nullif(CAST(regexp_extract(text, '(\\d+)만', 1) AS DOUBLE) * 10000, 0) AS v, CAST(nullif(regexp_extract(text, '~ (\\d+)억', 1), '') AS DOUBLE) * 100000000 AS w FROM t)
SELECT o_orderkey, CASE WHEN contains(text, '이상') THEN v WHEN contains(text, '~') AND v IS NOT NULL THEN least(v, w) END AS budget_min, CASE WHEN contains(text, '이하') THEN v WHEN contains(text, '~') AND v IS NOT NULL THEN greatest(v, w) END AS budget_max FROM o""")
def extract_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least, at most, or a range up to 1억."""
    amount = F.concat(F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit("만원"))
    s = F.col("o_orderstatus")
    text = F.concat(amount, F.when(s == "F", " 이상").when(s == "P", " 이하").otherwise(" ~ 1억원"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.amount_bounds(text).alias("b")).select("o_orderkey", "b.*")


@query("parse_amount", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN format('{:,.2f}원', CAST(o_totalprice AS DOUBLE)) WHEN o_orderkey % 2 = 0 THEN 'nan' ELSE ' ' END AS cell FROM orders)
SELECT o_orderkey, round(TRY_CAST(nullif(regexp_replace(cell, '[,원 ]', '', 'g'), 'nan') AS DOUBLE), 2) AS amount FROM c""")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with commas and currency; some are blank or nan."""
    cell = F.when(F.col("o_orderstatus") != "P", F.concat(F.format_number("o_totalprice", 2), F.lit("원"))).when(F.col("o_orderkey") % 2 == 0, "nan").otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(amounts.parse_amount(cell), 2).alias("amount"))


@query("parse_compound_amount", "SELECT o_orderkey, floor(o_totalprice / 1000) * 100000000 + o_custkey * 10000 AS amount FROM orders")
def parse_compound_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("억 "), F.col("o_custkey").cast("string"), F.lit("만"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.compound_amount(text).alias("amount"))


@query("extract_date", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS found FROM orders")
def extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    day = F.when(s == "F", F.date_format(d, "yyyy년 M월 d일")).when(s == "O", F.date_format(d, "yyyy년 M월")).otherwise(F.date_format(d, "yyyy년"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.date_near(F.concat(F.lit("이 사업의 마감일은 "), day, F.lit("입니다")), ["마감"]).alias("found"))


@query("date_bounds", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END || 'T00:00:00Z' AS starts,
CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(last_day(o_orderdate), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-12-31') END || 'T23:59:59Z' AS ends FROM orders""")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    text = F.when(s == "F", F.date_format(d, "yyyy-MM-dd")).when(s == "O", F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.date_bounds(text).alias("b")).select("o_orderkey", "b.*")


@query("format_amount", """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS n FROM orders), p AS (SELECT *, format('{:,}원', n) AS plain FROM o)
SELECT o_orderkey, CASE WHEN n >= 100000000 AND n % 100000000 >= 10000000 THEN (n // 100000000) || '억 ' || (n % 100000000 // 10000000) || '천만원 (' || plain || ')' WHEN n >= 100000000 THEN (n // 100000000) || '억원 (' || plain || ')' WHEN n >= 10000 THEN (n // 10000) || '만원 (' || plain || ')' ELSE plain END AS shown FROM p""")
def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.format_amount(F.floor(F.col("o_totalprice") * 1000)).alias("shown"))


@query("org_dictionary", "SELECT DISTINCT trim(c_mktsegment) AS organization, CAST(length(trim(c_mktsegment)) AS INTEGER) AS length FROM customer WHERE trim(c_mktsegment) <> ''")
def org_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.organizations(table(spark, sf_dir, "customer"), "c_mktsegment")


SQL_ORG_TEXT = "asked AS (SELECT o_orderkey AS query_id, c_name || ' ' || c_mktsegment || '에서 발주한 사업, 예산 ' || o_orderpriority AS text FROM orders JOIN customer ON c_custkey = o_custkey)"
SQL_ORG_NAMES = "SELECT c_name || ' ' || c_mktsegment AS organization FROM customer UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer"


@query("org_extract", f"WITH {SQL_ORG_TEXT}, {sql_found(SQL_ORG_NAMES)} SELECT * FROM found")
def org_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts name a customer with its segment and a particle; the dictionary has both together and each alone."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    text = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("에서 발주한 사업, 예산 "), "o_orderpriority")
    asked = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("query_id"), text.alias("text"))
    both, alone = F.concat_ws(" ", "c_name", "c_mktsegment"), [F.col("c_name"), F.col("c_mktsegment")]
    return filters.find_organizations(asked, customers.select(F.explode(F.array(both, *alone)).alias("organization")))


#: Rules for the tables' languages, in their order.
RULES = [("comparative", r"\b(?:vs|versus|than)\b"), ("summarization", r"\b(?:summ\w*|für|para)\b"), ("procedural", r"\b(?:how|wie|como|qui)\b"), ("analytical", r"\b(?:why|with|avec|von)\b"), ("factual", r"\b(?:what|the|des|der)\b")]
SQL_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '{p}') THEN '{k}'" for k, p in RULES) + " ELSE 'unknown' END"


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


@query("route_rules", f"SELECT conv_id || '-' || turn AS query_id, {SQL_KIND} AS kind FROM conversations WHERE role = 'user'")
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boundaries are ASCII ones in SQL, so other letters are put aside first."""
    return _user_turns(spark, sf_dir).select("query_id", routing.kind(F.regexp_replace("text", r"[^\x00-\x7F]", "_"), RULES).alias("kind"))


SQL_ROUTES = "r(query_type, search_mode, top_k, score_threshold, prompt_mode, use_multi_query) AS (VALUES ('factual', 'hybrid', 5, 0.4, 'cot_few', true), ('comparative', 'mmr', 10, 0.4, 'cot_zero', true), ('summarization', 'vector', 7, 0.7, 'cot_few', false), ('procedural', 'hybrid', 5, 0.4, 'cot_zero', true), ('analytical', 'mmr', 5, 0.7, 'cot_zero', true), ('filter_based', 'keyword', 5, 0.3, 'basic', true), ('unknown', 'hybrid', 5, 0.4, 'basic', true))"


@query("route_params", f"WITH {SQL_ROUTES}, q AS (SELECT conv_id || '-' || turn AS query_id, CASE WHEN turn % 5 = 0 THEN 'filter_based' WHEN turn % 5 = 2 THEN 'factual' ELSE {SQL_KIND} END AS query_type FROM conversations WHERE role = 'user') SELECT query_id, query_type, search_mode, top_k, CAST(score_threshold AS DOUBLE) AS score_threshold, prompt_mode, use_multi_query FROM q JOIN r USING (query_type)")
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced kind comes before a model's, that before the rules'; the shipped settings override the defaults."""
    from ..functions.fixed import ROUTE_OVERRIDES

    turn = F.element_at(F.split("query_id", "-"), 2).cast("int") % 5
    own = _user_turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    own = own.withColumn("forced", F.when(turn == 0, "filter_based")).withColumn("model_type", F.when(turn == 2, "factual").otherwise("unknown"))
    out = routing.route(own, routing.routes(spark, ROUTE_OVERRIDES), RULES)
    return out.select("query_id", "query_type", "search_mode", "top_k", "score_threshold", "prompt_mode", "use_multi_query")
