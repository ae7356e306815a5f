"""Matching and audit plans: labels as metadata of documents, part names as file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..functions.udfs import similarity
from ..operators import matching
from .registry import query, table
from .text import sql_key


@query("chunk_meta_join", "SELECT documents.doc_id, source, quality, toxic FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def chunk_meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_metadata(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


SQL_AUDIT = "au AS (SELECT documents.doc_id, labels.doc_id IS NOT NULL AS matched FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id)"


@query("match_audit", f"WITH {SQL_AUDIT} SELECT * FROM au")
def match_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("match_rate", f"WITH {SQL_AUDIT} SELECT CAST(sum(CAST(matched AS INTEGER)) AS BIGINT) AS matched, count(*) AS total, round(100 * avg(CAST(matched AS INTEGER)), 1) AS percent FROM au")
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_rate(match_audit(spark, sf_dir))


@query("null_audit", """WITH j AS (SELECT quality, toxic, CASE WHEN quality = 0 THEN 'nan'::DOUBLE ELSE quality END AS budget FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
l AS (SELECT 'quality' AS "column", count(*) FILTER (quality IS NULL) AS null_count, count(*) AS total FROM j UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM j UNION ALL SELECT 'budget', count(*) FILTER (budget IS NULL OR isnan(budget)), count(*) FROM j)
SELECT *, round(null_count / greatest(total, 1), 6) AS ratio FROM l""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunk_meta_join(spark, sf_dir).withColumn("budget", F.when(F.col("quality") == 0, F.lit(float("nan"))).otherwise(F.col("quality").cast("double")))
    return matching.null_audit(own, ["quality", "toxic", "budget"])


@query("scan_limit", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by key, as a scan with a limit gives them."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(100)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name once, as a file in the order of its first key."""
    return table(spark, sf_dir, "part").groupBy(F.concat("p_name", F.lit(".pdf")).alias("name")).agg(F.min("p_partkey").alias("ordinal"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as files have them: copies, longer ones, misspelt ones, others."""
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    kinds = F.array(F.concat("p_name", F.lit(" (2).pdf")), F.concat("p_name", F.lit(" final.pdf")), F.concat(F.lit("x"), F.substring("p_name", F.lit(2), F.length("p_name")), F.lit(".pdf")), F.concat(F.reverse("p_name"), F.lit(".pdf")), F.concat("p_name", F.lit(".hwp")), F.concat(F.upper("p_name"), F.lit(".PDF")))
    return parts.select(F.explode(kinds).alias("name"))


SQL_FILES = f"""li AS (SELECT p_name || '.pdf' AS csv, min(p_partkey) AS ordinal FROM part GROUP BY p_name),
fi AS (SELECT DISTINCT unnest([p_name || ' (2).pdf', p_name || ' final.pdf', 'x' || substr(p_name, 2) || '.pdf', reverse(p_name) || '.pdf', p_name || '.hwp', upper(p_name) || '.PDF']) AS name FROM part),
fk AS (SELECT name, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext, {sql_key('name')} AS k, {sql_key("regexp_replace(name, ' \\(\\d+\\)(\\.pdf)$', '.pdf')")} AS bare FROM fi),
lk AS (SELECT csv, ordinal, '.pdf' AS ext, {sql_key('csv')} AS k FROM li)"""
SQL_BEST = f"""WITH {SQL_FILES},
sc AS (SELECT name, csv, ordinal, CASE WHEN fk.k = lk.k THEN 1.0 WHEN fk.bare = lk.k THEN 0.99 WHEN contains(lk.k, fk.k) OR contains(fk.k, lk.k) THEN 0.95 ELSE round(1 - levenshtein(fk.k, lk.k) / greatest(length(fk.k), length(lk.k), 1), 6) END AS score,
  CASE WHEN fk.k = lk.k THEN 'exact' WHEN fk.bare = lk.k THEN 'copy_suffix' WHEN contains(lk.k, fk.k) OR contains(fk.k, lk.k) THEN 'contains' ELSE 'similarity' END AS match_type FROM fk JOIN lk ON fk.ext = lk.ext),
b AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ordinal) = 1)
SELECT fi.name, b.csv AS best, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(match_type, 'none') AS match_type, coalesce(score >= CASE WHEN match_type = 'similarity' THEN 0.9 ELSE 0.8 END, false) AS matched FROM fi LEFT JOIN b ON b.name = fi.name"""


@query("fuzzy_best_match", SQL_BEST)
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_match(_files(spark, sf_dir), _listed(spark, sf_dir), ratio=matching.levenshtein_ratio)


@query("fuzzy_match_above", f"SELECT name, CASE WHEN score >= 0.8 THEN best END AS best, CASE WHEN score >= 0.8 THEN score ELSE 0.0 END AS score, CASE WHEN score >= 0.8 THEN match_type ELSE 'none' END AS match_type, matched FROM ({SQL_BEST})")
def fuzzy_match_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only matches of the threshold at least: names meet through the index alone."""
    return matching.best_match(_files(spark, sf_dir), _listed(spark, sf_dir), ratio=matching.levenshtein_ratio, below=False)


@query("fuzzy_best_match_ratio")
def fuzzy_best_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by matching blocks, for which SQL has no function."""
    return matching.best_match(_files(spark, sf_dir), _listed(spark, sf_dir), ratio=similarity)


SQL_RESOLVE = f"""WITH {SQL_FILES},
lb AS (SELECT csv AS file, ext, k FROM lk),
sc AS (SELECT name, file, fk.k = lb.k OR fk.bare = lb.k AS same, length(fk.bare) >= 12 AND starts_with(lb.k, fk.bare) AS longer, CASE WHEN fk.k = lb.k OR fk.bare = lb.k THEN 1.0::DOUBLE ELSE round(1 - levenshtein(fk.k, lb.k) / greatest(length(fk.k), length(lb.k), 1), 6) END AS score FROM fk JOIN lb ON fk.ext = lb.ext),
rk AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS nxt FROM sc WINDOW w AS (PARTITION BY name ORDER BY score DESC, file DESC)),
per AS (SELECT name, min(file) FILTER (same) AS equal, CASE WHEN count(*) FILTER (longer) = 1 THEN min(file) FILTER (longer) END AS only_one, min(file) FILTER (n = 1 AND score >= 0.8 AND score - nxt >= 0.05) AS near FROM rk GROUP BY name)
SELECT fi.name, coalesce(equal, only_one, near, fi.name) AS resolved, CASE WHEN equal IS NOT NULL THEN 'equal' WHEN only_one IS NOT NULL THEN 'prefix' WHEN near IS NOT NULL THEN 'similar' ELSE 'unchanged' END AS how FROM fi LEFT JOIN per ON per.name = fi.name"""


@query("resolve_cascade", SQL_RESOLVE)
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.resolve(_files(spark, sf_dir), _listed(spark, sf_dir).select("name"), matching.levenshtein_ratio)


@query("containment_first_match", f"WITH {SQL_FILES}, c AS (SELECT fk.name, csv FROM fk JOIN lk ON contains(lk.k, fk.k) OR contains(fk.k, lk.k) QUALIFY row_number() OVER (PARTITION BY fk.name ORDER BY ordinal) = 1) SELECT fi.name, c.csv AS listed_name FROM fi LEFT JOIN c ON c.name = fi.name")
def containment_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _files(spark, sf_dir).withColumn("key", name_key(F.col("name")))
    listed = _listed(spark, sf_dir).select("ordinal", F.col("name").alias("listed_name"), name_key(F.col("name")).alias("listed_key"))
    return matching.first_containing(names, listed)
