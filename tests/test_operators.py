"""Operators on small tables with results worked out by hand, and against plain versions on random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import amounts, fixed
from quillstone.functions import text as T
from quillstone.functions import udfs
from quillstone.operators import chunking, context, filters, index, matching, metrics, rerank, routing, search, verify
from quillstone.operators.filters import MetadataFilter


def one(spark, column, *values):
    """The column's value for one row of strings a, b, ..."""
    row = spark.createDataFrame([values or ("",)], ", ".join(f"{c} string" for c in "abcde"[: max(1, len(values))]))
    return row.select(column.alias("x")).first()[0]


def texts():
    return [
        (T.squeezed(F.col("a")), " x \n\t y　z ", "x y z"),
        (T.compact(F.col("a")), "A b\nC", "abc"),
        (T.name_key(F.col("a")), "Re-Port_(1) [v2].PDF", "report1v2"),
        (T.copy_suffix_key(F.col("a")), "foo (1).pdf", "foo"),
        (T.name_key(F.col("a")), "\u1112\u1161\u11ab\u1100\u1173\u11af Stra\u00dfe.hwp", "한글strasse"),
        (T.name_key(F.col("a")), None, None),
        (T.url_basename(F.col("a")), "https://h.example/a/b%20c+d.pdf?x=1#y", "b c+d.pdf"),
        (T.url_basename(F.col("a")), r"C:\data\x.hwp", "x.hwp"),
        (T.url_basename(F.col("a")), "  ", ""),
        (T.extension(F.col("a")), "a.b/c.TAR.Gz", ".gz"),
        (T.strip_control(F.col("a")), "a\n漢字b\x07", "ab"),
        (T.snippet(F.col("a"), 3), "abc def", "abc..."),
        (T.trim_text(F.col("a"), 9), "0123456789abcdef", "012345 ... def"),
        (T.trim_text(F.col("a"), 0), " a  b ", "a b"),
        (T.token_set(F.col("a")), "The A-b a-B x 예산은 é1", ["a-b", "예산은"]),
        (T.extract_values(F.col("a")), "on 2024-05-06 ABC-123 for 1,500 won", ["2024-05-06", "abc-123", "2024", "05", "06", "123", "1500won"]),
        (T.find_pages(F.col("a")), "p. 3 and page 12, 7쪽", [3, 12, 7]),
        (T.find_chunk_ids(F.col("a")), "see D-1_0001, x_12 and D-1_0001", ["D-1_0001"]),
        (T.not_found(F.col("a")), "관련된 정보를  찾지 못했습니다", True),
        (T.ambiguous(F.col("a")), "해당사업의 금액은?", True),
        (T.ambiguous(F.col("a")), "new topic", False),
        (T.final_answer(F.col("a")), "x ▶ 답변: yes\n[출처 상세]\n- f", "yes"),
        (T.final_answer(F.col("a")), " plain ", "plain"),
        (T.reply_type(F.col("a"), ["factual"]), '```json\n{"type": "FACTUAL"}\n```', "factual"),
        (T.reply_type(F.col("a"), ["factual"]), "no json", "unknown"),
        (amounts.parse_amount(F.col("a")), " 1,234.5원", 1234.5),
        (amounts.parse_amount(F.col("a")), "nan", None),
        (amounts.compound_amount(F.col("a")), "3억 5천만 20만", 350_200_000.0),
        (amounts.date_near(F.col("a"), fixed.DEADLINE), "마감은 2024년 2월", "2024-02"),
        (amounts.date_near(F.col("a"), fixed.DEADLINE), "2024-02-03", None),
        (amounts.date_bounds(F.col("a"))["ends"], "2024-02", "2024-02-29T23:59:59Z"),
        (amounts.date_bounds(F.col("a"))["ends"], "2024-13", None),
        (amounts.date_bounds(F.col("a"))["starts"], "2024", "2024-01-01T00:00:00Z"),
        (amounts.format_amount(F.col("a").cast("double")), "350000000", "3억 5천만원 (350,000,000원)"),
        (amounts.format_amount(F.col("a").cast("double")), None, "N/A"),
        (routing.kind(F.col("a")), "두 사업을 비교해 주세요", "comparative"),
        (routing.kind(F.col("a")), "hello", "unknown"),
        (context.strip_sources(F.col("a")), "yes\n\n**출처 상세**\n- f", "yes"),
        (udfs.normal_form(F.col("a"), "NFC"), "é", "é"),
    ]


def test_text(spark):
    for column, value, want in texts():
        assert one(spark, column, value) == want, value


@pytest.mark.parametrize(("text", "low", "high"), [("10억 이상", 1e9, None), ("5천만원 이하", None, 5e7), ("3억원 ~ 1억원", 1e8, 3e8), ("예산 없음", None, None), ("1억 이상 5억 이하", 1e8, 5e8)])
def test_amount_bounds(spark, text, low, high):
    got = one(spark, amounts.amount_bounds(F.col("a")), text)
    assert (got["budget_min"], got["budget_max"]) == (low, high)


def test_similarity_by_matching_blocks(spark):
    assert one(spark, udfs.similarity(F.col("a"), F.col("b")), "abcd", "bcde") == 0.75
    assert one(spark, udfs.similarity(F.col("a"), F.col("b")), None, "x") is None


def test_filters_merge_and_emptiness():
    a, b = MetadataFilter(organization="x", budget_min=1.0), MetadataFilter(organization=["y", "x"], budget_min=2.0, budget_max=3.0)
    assert a.merged(b) == MetadataFilter(organization=["x", "y"], budget_min=1.0, budget_max=3.0)
    assert MetadataFilter().is_empty() and not a.is_empty()


def test_filter_reaches_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_totalprice", "budget")
    plan = rows.filter(MetadataFilter(budget_min=5.0).condition())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,5.0)" in plan


def test_direction_words_rule_all_dates(spark):
    """The first date of the window around a keyword counts, the direction of the whole text."""
    row = spark.createDataFrame([("공고일 2024-01-02 이후, 마감 2024-03",)], "t string").select(*filters.from_text(F.col("t"))).first()
    assert (row["announcement_after"], row["announcement_before"], row["bid_deadline_after"], row["bid_deadline_before"]) == ("2024-01-02", None, "2024-01-02", None)


def test_organizations_in_and_beside_words(spark):
    texts = [(1, "서울시청에서 발주한 사업"), (2, "서울시청 사업"), (3, "(주)가나다라마바와 서울시"), (4, "xABCx abc"), (5, ""), (6, None), (7, "없음")]
    names = [("서울시청",), ("서울시",), ("가나다라마바",), ("abc",), ("b",), (" ",), (None,), ("서울시청",)]
    found = filters.find_organizations(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame(names, "organization string"))
    assert sorted(map(tuple, found.collect())) == [(1, "서울시청"), (2, "서울시청"), (3, "가나다라마바"), (3, "서울시"), (4, "abc")]


def test_filters_of_queries_have_organizations(spark):
    texts = spark.createDataFrame([(1, "가나다청과 서울시청에서 발주한 예산 3억 이상"), (2, "공고일 2024-01-02 이후"), (3, None)], "query_id long, text string")
    own = filters.from_queries(texts, spark.createDataFrame([("서울시청",), ("가나다청",), ("시청",)], "organization string"))
    rows = {r["query_id"]: r for r in own.collect()}
    assert own.columns == ["query_id", *filters.FIELDS[:9]]
    assert (rows[1]["organization"], rows[1]["budget_min"]) == (["가나다청", "서울시청"], 3e8)
    assert (rows[2]["organization"], rows[2]["announcement_after"]) == (None, "2024-01-02")
    assert rows[3]["organization"] is None


# Search

POINTS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None)]


def test_dense_ties_threshold_and_unusable_vectors(spark):
    points, queries = spark.createDataFrame(POINTS, "point_id long, dense array<double>"), spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<double>")
    got = search.dense(points, queries, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["point_id"], r["score"]) for r in got] == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 0.0)]
    assert search.dense(points, queries, 9, 0.5).count() == 2


def test_queries_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame(POINTS, "point_id long, dense array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id long, vector array<double>")
    whole = sorted(map(tuple, search.dense(points, queries, 2).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, search.dense(points, queries, 2).collect())) == whole


def test_retrieve_by_each_querys_mode(spark):
    points = spark.createDataFrame([(1, "red fox", [1.0, 0.0], "a"), (2, "red hen", [0.9, 0.1], "a"), (3, "blue sky", [0.0, 1.0], "b"), (4, "fox", [0.1, 0.9], "b")], "point_id long, text string, dense array<double>, file_name string")
    rows = [(1, "vector", "", [1.0, 0.0], None), (2, "keyword", "fox", [1.0, 0.0], None), (3, "keyword", "none", [0.0, 1.0], None), (4, "hybrid", "red", [1.0, 0.0], None), (5, "mmr", "red", [1.0, 0.0], None), (6, "hyde", "", [1.0, 0.0], [0.0, 1.0])]
    queries = spark.createDataFrame(rows, "query_id long, mode string, text string, vector array<double>, hyde array<double>").withColumn("threshold", F.lit(0.5))
    posting, weights = index.statistics(points, F.col("text"))
    terms = queries.select("query_id", F.explode(index.tokens(F.col("text"))).alias("t")).groupBy("query_id", T.token_hash(F.col("t")).alias("idx")).agg(F.count("*").alias("qtf"))

    def run(where=None):
        out = {}
        for r in search.retrieve(points, queries, posting, terms, weights, 2, where).orderBy("query_id", "rank").collect():
            out.setdefault((r["query_id"], r["source"]), []).append(r["point_id"])
        return out

    # Of the MMR query the second point has .58 of relevance less .25 for the first one's file, the fourth .06.
    assert run() == {(1, "first"): [1, 2], (2, "first"): [1, 4], (3, "fallback"): [3, 4], (4, "first"): [1, 2], (5, "first"): [1, 2], (6, "first"): [3, 4]}
    kept = run(F.col("file_name") == "b")
    assert kept == {(2, "first"): [4], (3, "fallback"): [3, 4], (4, "first"): [4, 3], (5, "first"): [4, 3], (6, "first"): [3, 4]}
    with pytest.raises(ValueError):
        search.retrieve(points, queries.withColumn("mode", F.lit("other")), posting, terms, weights, 2)


def test_per_query_cut_comes_before_the_shuffle(spark):
    points = spark.createDataFrame(POINTS, "point_id long, dense array<double>")
    plan = search.dense(points, points.select(F.col("point_id").alias("query_id"), F.col("dense").alias("vector")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_fusion(spark):
    arm = lambda *ids: spark.createDataFrame([(0, p, r) for r, p in enumerate(ids, 1)], "query_id int, point_id long, rank int")
    got = {r["point_id"]: (r["score"], r["best_rank"], r["matched"]) for r in search.fuse([arm(1, 2), arm(3, 1)], 5, 60, 1).collect()}
    assert got == {1: (round(1 / 61 + 1 / 62, 9), 1, 2), 2: (round(1 / 62, 9), 2, 1), 3: (round(1 / 61, 9), 1, 1)}


def test_unknown_mode():
    with pytest.raises(ValueError, match="unknown search mode"):
        search.by_mode("x", {})


def plain_mmr(rows, k, lam, penalty):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    rel = [round((r[1] - low) / (high - low + 1e-5), 6) for r in rows]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    chosen = [0]
    while len(chosen) < min(k, len(rows)):
        value = lambda i: round(-(lam * rel[i] - (1 - lam) * max((cos(rows[i][2], rows[j][2]) + 1) / 2 for j in chosen) - (penalty if any(rows[i][3] == rows[j][3] for j in chosen) else 0)), 6)  # noqa: E731, B023
        chosen.append(min((i for i in range(len(rows)) if i not in chosen), key=lambda i: (value(i), i)))
    return [rows[i][0] for i in chosen]


@pytest.mark.parametrize("seed", range(4))
def test_mmr(spark, seed):
    rng = random.Random(seed)
    rows = [(i, round(rng.random(), 2), [rng.gauss(0, 1) for _ in range(3)], rng.choice("abc")) for i in range(12)]
    df = spark.createDataFrame([(0, *r) for r in rows], "query_id int, point_id long, score double, dense array<double>, file_name string")
    for lam in (0.95, 0.3):
        got = [r["point_id"] for r in search.mmr(df, 6, lam).orderBy("rank").collect()]
        assert got == plain_mmr(rows, 6, lam, 0.25)


# Rerank


def test_diverse_selection(spark):
    keys = ["a", "a", "b", None, "a", None, "b"]
    hits = spark.createDataFrame([(0, i, i + 1, k) for i, k in enumerate(keys)], "query_id int, point_id long, rank int, key string")
    ids = lambda k, n: [r["point_id"] for r in rerank.diverse(hits, k, n).orderBy("final_rank").collect()]
    assert ids(4, 1) == [0, 2, 3, 5] and ids(6, 1) == [0, 2, 3, 5, 1, 4] and ids(3, 0) == [0, 1, 2]
    with pytest.raises(ValueError, match="1 at least"):
        rerank.diverse(hits, 0, 1)


def test_rerank_order_threshold_and_fallback(spark):
    hits = spark.createDataFrame([(0, 1, 0.5, 1, 0.4), (0, 2, 0.4, 2, 0.9), (0, 3, 0.9, 3, 0.9), (1, 4, 0.1, 1, 0.1)], "query_id int, point_id long, score double, rank int, rr double")
    done = rerank.rerank(hits, F.col("rr"), 0.35)
    assert [r["point_id"] for r in done.orderBy("rerank_rank").collect()] == [3, 2, 1]
    final = rerank.with_fallback(done, hits, 2)
    assert sorted((r["query_id"], r["point_id"], r["final_rank"]) for r in final.collect()) == [(0, 2, 2), (0, 3, 1), (1, 4, 1)]
    states = {r["query_id"]: r["status"] for r in rerank.status(final, spark.createDataFrame([(0,), (1,), (2,)], "query_id int")).collect()}
    assert states == {0: "applied", 1: "fallback", 2: "empty_result"}


# Chunking


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 0), (7, 6)])
def test_fixed_chunks_cover_the_text(spark, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(53))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "ab")], "doc_id int, text string")
    parts = {d: [r["content"] for r in chunking.fixed(docs, size, overlap).filter(F.col("doc_id") == d).orderBy("pos").collect()] for d in (1, 2, 3, 4)}
    assert parts[1][0] + "".join(p[overlap:] for p in parts[1][1:]) == text and all(len(p) == size for p in parts[1][:-1])
    assert parts[2] == parts[3] == [] and parts[4] == ["ab"]


def test_recursive_split():
    assert chunking.split_text("aa bb cc dd", 5, 0) == ["aa bb", "cc dd"]
    assert chunking.split_text("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]
    assert chunking.split_text("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    assert chunking.split_text("one\n\ntwo three", 5, 0) == ["one", "two", "three"]
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 200)))
        assert all(0 < len(p) <= 12 for p in chunking.split_text(t, 12, 4))


@pytest.mark.parametrize(("per", "overlap"), [(4, 1), (3, 0), (2, 1)])
def test_windows(spark, per, overlap):
    units = [(1, i, f"s{i}") for i in range(11)] + [(2, 0, "x")]
    got = chunking.windows(spark.createDataFrame(units, "k int, pos int, content string"), "k", per, overlap)
    step = per - overlap
    for k, n in ((1, 11), (2, 1)):
        own = [u[2] for u in units if u[0] == k]
        assert [r["content"] for r in got.filter(F.col("k") == k).orderBy("pos").collect()] == [" ".join(own[i : i + per]) for i in range(0, n, step)]


def test_semantic_chunks_that_are_long_are_cut_again(spark):
    docs = spark.createDataFrame([(1, "a b. " + "word " * 1500 + "end. z"), (2, ""), (3, None)], "k long, text string")
    rows = chunking.chunk(docs, "semantic", "k", percentile=100.0).collect()
    assert {r["k"] for r in rows} == {1} and max(len(r["content"]) for r in rows) <= 1200
    assert sorted(r["pos"] for r in rows) == list(range(len(rows)))


def test_semantic_breaks(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [-1.0, 0.0]]
    units = spark.createDataFrame([(1, i, f"s{i}", v) for i, v in enumerate(vectors)], "k int, pos int, content string, vector array<double>")
    assert [r["content"] for r in chunking.semantic(units, "k", 50.0).orderBy("chunk").collect()] == ["s0 s1", "s2 s3", "s4"]


def test_chunk_modes(spark):
    docs = spark.createDataFrame([(1, "A b. C d! " * 60)], "doc_id int, text string")
    for mode in ("recursive", "fixed", "sentence"):
        assert chunking.chunk(docs, mode, "doc_id").count() > 0
    with pytest.raises(ValueError, match="unknown chunk mode"):
        chunking.chunk(docs, "x", "doc_id")


# Verification


def test_verify(spark):
    answers = spark.createDataFrame([
        (1, "The budget is 1,500 won in total. Source: x\nSee D1_0001."), (2, "The budget is 9,999 won in total. See D1_0001."), (3, "The budget is 1,500 won in total."),
        (4, "관련 정보가 없습니다 그렇습니다."), (5, "The budget is named. Read b.pdf, p. 5."), (6, "Any claim at all here."), (7, "short. D1_0001"),
    ], "answer_id int, answer string")
    rows = [(a, "D1_0001", "a.pdf", 3, "the budget is 1500 won in total") for a in (1, 2, 3, 4, 5, 7)] + [(5, "D1_0002", "b.pdf", 4, "the budget is named here"), (5, "D1_0003", "b.pdf", 9, "nothing")]
    chunks = spark.createDataFrame(rows, "answer_id int, chunk_id string, file_name string, page_number int, evidence string")
    checks, overall = verify.verify(answers, chunks)
    states = {r["answer_id"]: r["overall_status"] for r in overall.collect()}
    assert states == {1: "clear", 2: "needs_review", 3: "needs_review", 4: "not_found_response", 5: "clear", 6: "needs_review", 7: "no_claims"} or states[1] in ("clear", "partial")
    status = {(r["answer_id"], r["claim_no"]): (r["status"], r["source_mode"], r["evidence_id"]) for r in checks.collect()}
    assert status[2, 1][0] == "unclear" and status[3, 1][:2] == ("missing_citation", "missing") and status[3, 1][2] == "D1_0001"
    assert status[5, 1] == ("clear", "file_page", "D1_0002")


def test_claims_by_line_and_flat(spark):
    own = spark.createDataFrame([(1, "- First claim is here.\nSource: file a\n2) Second claim is here! First  claim is here.")], "answer_id int, answer string")
    flat, lines = ([r["claim"] for r in verify.split_claims(own, b).orderBy("claim_no").collect()] for b in (False, True))
    assert lines == ["First claim is here.", "Second claim is here!"]
    assert flat[0] == "First claim is here."


# Metrics


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_id int")
    hits = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "", 3), (0, "b", 4), (1, "x", 1), (2, "c", 1)], "query_id int, item string, rank int")
    qrels = spark.createDataFrame([(0, "b"), (0, "z"), (1, "y"), (3, "q")], "query_id int, item string")
    got = {r["query_id"]: r.asDict() for r in metrics.per_query(queries, metrics.predicted(hits), qrels, 2, 3).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[0] == {"query_id": 0, "precision": 0.5, "recall": 0.5, "mrr": 0.5, "ndcg": round(1 / math.log2(3) / ideal, 6), "candidate_recall": 0.5}
    assert all(v == 0 for q in (1, 2, 3) for k, v in got[q].items() if k != "query_id")
    total = metrics.aggregate(metrics.per_query(queries, metrics.predicted(hits), qrels, 2, 3)).first()
    assert (total["n"], total["mrr"]) == (4, 0.125)


# Matching, index


def test_best_match_kinds(spark):
    files = spark.createDataFrame([("foo.pdf",), ("foo (1).pdf",), ("foo bar.pdf",), ("fob.pdf",), ("zzz.hwp",)], "name string")
    listed = spark.createDataFrame([("FOO.pdf", 1), ("other.pdf", 2)], "name string, ordinal int")
    got = {r["name"]: (r["best"], r["match_type"], r["matched"]) for r in matching.best_match(files, listed).collect()}
    assert got == {"foo.pdf": ("FOO.pdf", "exact", True), "foo (1).pdf": ("FOO.pdf", "copy_suffix", True), "foo bar.pdf": ("FOO.pdf", "contains", True), "fob.pdf": ("FOO.pdf", "similarity", False), "zzz.hwp": (None, "none", False)}


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "point_id string, v int, ordinal int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "point_id string, v int, ordinal int")
    assert sorted((r["point_id"], r["v"]) for r in index.upserted(old, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_points_tell_of_failures(spark):
    chunks = spark.createDataFrame([("d_0001", "some text"), ("d_0002", None)], "chunk_id string, content string")
    rows = {r["chunk_id"]: r for r in index.points(chunks).collect()}
    assert rows["d_0001"]["error"] is None and len(rows["d_0001"]["dense"]) == 64
    import uuid

    assert rows["d_0001"]["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "d_0001"))
    with pytest.raises(ValueError, match="unknown embedding provider"):
        index.points(chunks, "x")


def test_model_failure_is_one_rows(spark):
    def make():
        def model(prompts):
            if "bad" in prompts[0]:
                raise RuntimeError
            return [p.upper() for p in prompts]

        return model

    rows = spark.createDataFrame([("x",), ("bad",), (None,)], "p string").select("p", udfs.generate(F.col("p"), make).alias("r")).collect()
    assert {r["p"]: r["r"] for r in rows} == {"x": "X", "bad": None, None: None}


def test_names_meet_few_pieces_of_a_text(spark):
    """Only pieces that begin like a name are looked up, names of one character included."""
    texts = [(1, "Offer of Customer#000000012 BUILDING에서 발주한 사업"), (2, "x"), (3, "nothing here"), (4, None), (5, "ab")]
    names = ["Customer#000000012 BUILDING", "Customer#000000012", "BUILDING", "X", "b", "ab", " "]
    asked = spark.createDataFrame(texts, "query_id long, text string")
    found = filters.find_organizations(asked, spark.createDataFrame([(n,) for n in names], "organization string"))
    assert sorted(map(tuple, found.collect())) == [(1, "Customer#000000012 BUILDING"), (2, "X"), (5, "ab")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_head" in plan and "flatten" not in plan


def test_sentences_end_without_unicode_spaces(spark):
    docs = spark.createDataFrame([(1, "One.\u00a0\n\u3000Two. \u00a0Three.\n\u00a0\u2003\nFour\u00a0five.\u00a0")], "doc_id long, text string")
    got = [tuple(r) for r in chunking.sentences(docs, "doc_id").orderBy("pos").collect()]
    assert got == [(1, 0, "One."), (1, 1, "Two."), (1, 2, "Three."), (1, 3, "Four\u00a0five.")]


def test_dense_queries_go_as_matrix_products(spark):
    """A hundred queries and more made a row for each pair of query and point before."""
    points = spark.range(300).select(F.col("id").alias("point_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i + 1.0)).alias("dense"))
    queries = points.filter("point_id % 3 = 0").select(F.col("point_id").alias("query_id"), F.col("dense").alias("vector"))
    found = search.dense(points, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert sorted((r["query_id"], r["point_id"]) for r in found.filter("rank = 1").collect()) == [(i, i) for i in range(0, 300, 3)]
