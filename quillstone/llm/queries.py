"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_dedup, importance, merkle, mixing, near_dup, sentence_pieces, sharding, substring_dedup, suffix_dedup, toxicity, word_pieces
from .common import table

SHARDS, QUERY_EVERY, NEAREST = 24, 20, 20
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def tokenizer() -> tuple[str, str]:
    """A rank file and the pattern that goes with it; both are parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "source_key", "tokens", "block", "weight", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0, k=NEAREST)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.token_counts(table(spark, sf_dir, "documents"), list(bpe.read_ranks(tokenizer()[0])))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def sql_crc(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes; needs the row of crc_table (SQL_CRC) beside it."""
    bytes_ = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: The 256 steps of a byte.
SQL_CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""

SQL_IMPORTANCE = rf"""
WITH {SQL_CRC},
words AS (SELECT false AS aim, doc_id, unnest(ws) AS f FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
  UNION ALL SELECT true, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT aim, doc_id, f, count(*) AS n FROM words GROUP BY ALL),
hashed AS (SELECT f, {sql_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
own AS (SELECT * FROM counted JOIN hashed USING (f)),
per AS (SELECT r.b AS bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM range(10000) r(b) LEFT JOIN own ON own.bucket = r.b GROUP BY r.b),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM per) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM per) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM per),
means AS (SELECT doc_id, sum(n)::BIGINT AS k, sum(gain * n)::BIGINT AS total FROM own JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id),
weighed AS (SELECT documents.doc_id, coalesce(k, 0) AS n_features, CASE WHEN k > 0 THEN (total - ((total % k) + k) % k) // k ELSE 0 END AS weight FROM documents LEFT JOIN means ON means.doc_id = documents.doc_id),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed ON placed.doc_id = scored.doc_id
"""

SQL_MERKLE_FIELDS = "doc_id, source, lang, n_chars"


def _sql_leaf(text: str) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(field, (*SQL_MERKLE_FIELDS.split(', '), text)))})"


def _sql_tree(name: str, grp: str, source: str) -> str:
    """CTE name: lv, grp, pos, node of all levels of the trees of source (grp, pos, node)."""
    return f"""{name} AS (SELECT 0 AS lv, {grp} AS grp, pos, node FROM {source}
  UNION ALL SELECT lv + 1, grp, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY lv, grp, pos // 8)"""


def _sql_siblings(name: str, out: str) -> str:
    """CTE out: lv, grp, pos, and before and after: what stands beside a node in its run; none for the top."""
    return f"""{out}_runs AS (SELECT lv, grp, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM {name} GROUP BY ALL),
{out} AS (SELECT n.lv, n.grp, n.pos, array_to_string(nodes[1:(n.pos % 8)], '') AS before, array_to_string(nodes[(n.pos % 8) + 2:8], '') AS after
  FROM {name} n JOIN {out}_runs r ON r.lv = n.lv AND r.grp = n.grp AND r.run = n.pos // 8 JOIN (SELECT grp, max(lv) AS top FROM {name} GROUP BY grp) h ON h.grp = n.grp WHERE n.lv < top)"""


SQL_MERKLE = f"""
WITH RECURSIVE {SQL_CRC},
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, {_sql_leaf("text")} AS leaf,
  CASE WHEN {sql_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents, crc_table),
placed AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_sql_tree("low", "grp", "placed")},
tops AS (SELECT grp, node FROM low QUALIFY lv = max(lv) OVER (PARTITION BY grp)),
langs AS (SELECT grp AS of_grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos FROM tops),
{_sql_tree("high", "''", "langs")},
{_sql_siblings("low", "low_s")}, {_sql_siblings("high", "high_s")},
steps AS (SELECT p.doc_id, p.leaf, p.grp, p.pos, s.lv, before, after FROM placed p JOIN low_s s ON s.grp = p.grp AND s.pos = p.pos // CAST(pow(8, s.lv) AS BIGINT)
  UNION ALL SELECT p.doc_id, p.leaf, p.grp, p.pos, 1000 + s.lv, before, after FROM placed p JOIN langs l ON l.of_grp = p.grp JOIN high_s s ON s.pos = l.pos // CAST(pow(8, s.lv) AS BIGINT)),
paths AS (SELECT grp, pos, list({{'b': before, 'a': after}} ORDER BY lv) AS path FROM steps GROUP BY grp, pos),
fold AS (SELECT p.grp, p.pos, 1 AS step, coalesce(other, leaf) AS node, coalesce(path, []) AS path FROM placed p LEFT JOIN paths ON paths.grp = p.grp AND paths.pos = p.pos
  UNION ALL SELECT grp, pos, step + 1, sha256(path[step].b || node || path[step].a), path FROM fold WHERE step <= len(path)),
root AS (SELECT node FROM high QUALIFY lv = max(lv) OVER ())
SELECT p.doc_id, leaf, tops.node AS subroot, root.node AS root, sha256(list_reduce(list_prepend('', list_transform(fold.path, lambda x: x.b || x.a)), lambda a, b: a || b)) AS proof_sha256, fold.node AS folded_root, fold.node = root.node AS verified
FROM placed p JOIN tops ON tops.grp = p.grp JOIN fold ON fold.grp = p.grp AND fold.pos = p.pos AND step = len(fold.path) + 1, root
"""

SQL_EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""

SQL_NEAR = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_n FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * both_n >= 75 * (na + nb - both_n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r AS (SELECT a AS id, b AS other FROM both_ways UNION SELECT r.id, l.b FROM r JOIN both_ways l ON r.other = l.a)
  SELECT id, min(other) AS least_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least_id, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(least_id, s.doc_id)) AS kept
FROM s LEFT JOIN reach ON reach.id = s.doc_id
"""

#: Sizes, exponent, budgets and blocks as mixing.plan takes them: targets 0.92 and 2, seed "mix".
SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('s:' || source, 'null') AS source_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source_key, sum(tokens)::BIGINT AS n, count(*) AS docs FROM d GROUP BY source_key),
p AS (SELECT source_key, n / (SELECT sum(n) FROM s) AS p FROM s WHERE n > 0),
coarse AS (SELECT r.k * 1024 AS k FROM range(1025) r(k)),
c1 AS (SELECT k, ln(sum(pow(p, k / 1048576))) - sum(pow(p, k / 1048576) * (k / 1048576) * ln(p)) / sum(pow(p, k / 1048576)) AS e FROM p, coarse GROUP BY k),
lo1 AS (SELECT coalesce(max(k), 0) AS k FROM c1 WHERE e >= 0.92 * ln((SELECT count(*) FROM p))),
fine AS (SELECT k + r.j AS k FROM lo1, range(1025) r(j) WHERE k + r.j <= 1048576),
f1 AS (SELECT k, ln(sum(pow(p, k / 1048576))) - sum(pow(p, k / 1048576) * (k / 1048576) * ln(p)) / sum(pow(p, k / 1048576)) AS e FROM p, fine GROUP BY k),
wanted AS (SELECT coalesce(max(k), 0) AS k FROM f1 WHERE e >= 0.92 * ln((SELECT count(*) FROM p))),
spread AS (SELECT min(p) AS least_p, max(p) AS most_p FROM p),
limited AS (SELECT coalesce(min(r.k), 1048576) AS k FROM range(1048577) r(k), spread WHERE pow(least_p, r.k / 1048576 - 1) / pow(most_p, r.k / 1048576 - 1) <= 2.0),
a AS (SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1.0 ELSE greatest(wanted.k, limited.k) / 1048576 END AS a FROM wanted, limited),
w AS (SELECT source_key, p, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) AS weight FROM p, a),
budget AS (SELECT max(p * (SELECT sum(n) FROM s) / weight) AS b FROM w),
passes AS (
  SELECT s.source_key, docs, round(coalesce(weight, 0), 9) AS weight,
    CASE WHEN n > 0 THEN CAST(floor(round(weight * b, 3)) AS BIGINT) // n ELSE 1 END AS whole, CASE WHEN n > 0 THEN CAST(floor(round(weight * b, 3)) AS BIGINT) % n ELSE 0 END AS rest
  FROM s LEFT JOIN w ON s.source_key = w.source_key, budget),
b AS (SELECT d.*, passes.weight, whole, rest, CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(sqrt(docs)) AS BIGINT) AS block FROM d JOIN passes ON d.source_key = passes.source_key),
blocks AS (SELECT source_key, block, sum(tokens) AS t FROM b GROUP BY source_key, block),
starts AS (SELECT source_key, block, coalesce(sum(t) OVER (PARTITION BY source_key ORDER BY md5('block|' || source_key || '|' || CAST(block AS VARCHAR)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM blocks),
placed AS (SELECT b.*, start + coalesce(sum(tokens) OVER (PARTITION BY b.source_key, b.block ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN starts ON b.source_key = starts.source_key AND b.block = starts.block)
SELECT doc_id, source_key, tokens, block, weight, whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_bytes": op1_shard_bytes,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_near_dup": op8_near_dup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_importance": op12_importance,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op5_mix_sources": SQL_MIX,
    "op8_near_dup": SQL_NEAR,
    "op9_exact_dedup": SQL_EXACT,
    "op12_importance": SQL_IMPORTANCE,
    "op13_merkle": SQL_MERKLE,
}
