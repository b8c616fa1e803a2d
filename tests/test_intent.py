"""Intent of questions, exception routing and the reranking they feed."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import classify, search

QUESTIONS = [
    ("Tôi bán hàng doanh thu 1.2 tỷ/năm, thuế bao nhiêu?", {"who": "HKD", "activity": "goods_distribution", "domain": "HKD", "revenue": 1_200_000_000, "intent": "calculate", "calc": True, "least": 0.45}),
    ("Lương 30 triệu/tháng, 1 con nhỏ, đóng thuế TNCN bao nhiêu?", {"who": "individual", "activity": "salary_wages", "domain": "PIT", "income": 30_000_000, "dependents": 1, "intent": "calculate", "least": 0.45}),
    ("Tiệm vàng của tôi doanh thu 60 tỷ, phải nộp thuế gì?", {"who": "HKD", "activity": "goods_distribution", "domain": "HKD", "revenue": 60_000_000_000, "intent": "calculate", "least": 0.45}),
    ("Trúng xổ số 500 triệu, thuế bao nhiêu?", {"who": "individual", "activity": "lottery_prizes", "domain": "PIT", "intent": "calculate", "least": 0.45}),
    ("Tôi muốn cho thuê nhà 15 triệu/tháng, có phải đóng thuế không?", {"activity": "asset_rental", "intent": "explain", "least": 0.30}),
    ("Kinh doanh online trên Shopee, doanh thu 800 triệu, thuế?", {"who": "HKD", "activity": "e_commerce_platform", "domain": "HKD", "revenue": 800_000_000, "intent": "calculate", "online": True, "least": 0.45}),
    ("Điều kiện để được miễn thuế TNCN là gì?", {"domain": "PIT", "intent": "explain", "calc": False, "conditions": True, "least": 0.20}),
    ("Quán cà phê doanh thu 400 triệu, có phải đóng thuế không?", {"who": "HKD", "activity": "manufacturing_transport", "domain": "HKD", "revenue": 400_000_000, "least": 0.35}),
    ("Công ty tôi trả lương 50 triệu, khấu trừ tại nguồn bao nhiêu?", {"who": "employer", "activity": "salary_wages", "domain": "PIT", "intent": "calculate", "least": 0.35}),
    ("Năm 2026 luật thuế TNCN mới có gì thay đổi?", {"domain": "PIT", "intent": "explain", "calc": False, "year": 2026, "least": 0.15}),
]


@pytest.fixture(scope="module")
def intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)] + [(99, None), (98, "")], "id int, text string")
    return {r.id: r.i for r in df.select("id", classify.query_intent(F.col("text")).alias("i")).collect()}


@pytest.mark.parametrize("i", range(10))
def test_intent_of_question(intents, i):
    got, want = intents[i], QUESTIONS[i][1]
    assert want.get("activity") in [None, *got.activities] and want.get("domain") in [None, *got.domains]
    for key, value in (("who", got.who), ("intent", got.intent), ("calc", got.requires_calculation), ("conditions", got.requires_conditions), ("online", got.online), ("revenue", got.revenue), ("income", got.income), ("dependents", got.dependents), ("year", got.year)):
        assert key not in want or value == want[key], key
    assert want["least"] <= got.confidence <= 1


def test_intent_of_nothing(intents):
    for i in (98, 99):
        assert intents[i].who is None and intents[i].intent is None and list(intents[i].domains) == [] and intents[i].confidence == 0


def test_exceptions_and_intent_change_the_final_score_only(spark):
    hits = spark.createDataFrame([(1, "a", "old", 0.8, 1), (1, "b", "new", 0.5, 2), (2, "a", "old", 0.8, 1), (3, "a", "old", 0.8, 1), (4, "a", "old", 0.8, 1)], "query_id int, chunk_id string, doc_id string, rrf_score double, rank int")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8]), (4, None)], "query_id int, q array<double>")
    entries = spark.createDataFrame([("old", [1.0, 0.0], 0.72, 0.5)], "doc_id string, description array<double>, upper double, lower double")
    got = {(r.query_id, r.chunk_id): (r.exception_tier, r.final_score, r.rank, r.rrf_score) for r in search.route_exceptions(hits, queries, entries).collect()}
    assert got == {(1, "a"): ("block", 0.04, 2, 0.8), (1, "b"): (None, 0.5, 1, 0.5), (2, "a"): ("allow", 0.8, 1, 0.8), (3, "a"): ("soft", 0.28, 1, 0.8), (4, "a"): (None, 0.8, 1, 0.8)}
    notes = spark.createDataFrame([("b", ["PIT"], ["salary"], ["individual"], "tax_rate", None, None)], "chunk_id string, domains array<string>, activities array<string>, who array<string>, content string, effective_from date, effective_to date")
    intents = spark.createDataFrame([(1, ["pit"], ["rental"], "HKD", False)], "query_id int, domains array<string>, activities array<string>, who string, requires_calculation boolean").withColumn("as_of", F.to_date(F.lit("2026-01-01")))
    both = search.route_exceptions(search.rerank_with_intent(hits, notes, intents), queries, entries)
    assert {(r.query_id, r.chunk_id): r.final_score for r in both.collect()}[1, "b"] == 0.55  # domain and validity


def test_search_gives_final_scores(spark):
    chunks = spark.createDataFrame([("a", "old", "alpha beta", [1.0, 0.0]), ("b", "new", "alpha gamma", [0.0, 1.0])], "chunk_id string, doc_id string, text string, v array<double>")
    queries = spark.createDataFrame([(1, "alpha", [0.1, 1.0])], "query_id int, text string, q array<double>")
    registry = spark.createDataFrame([("old", 1, None, None), ("new", 1, None, None)], "doc_id string, legal_level int, effective_from date, effective_to date")
    entries = spark.createDataFrame([("old", [1.0, 0.0], 0.72, 0.5)], "doc_id string, description array<double>, upper double, lower double")
    plain = search.search(queries, chunks, registry, F.to_date(F.lit("2024-01-01")))
    got = {r.chunk_id: r for r in search.search(queries, chunks, registry, F.to_date(F.lit("2024-01-01")), entries=entries).collect()}
    assert "final_score" not in plain.columns and got["b"].final_score == got["b"].rrf_score
    assert got["a"].final_score == pytest.approx(got["a"].rrf_score * 0.05, abs=1e-6)
