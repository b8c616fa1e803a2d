"""Rule tables of search, the whole first tier, gates and wrapper rules on worked cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import search_rules
from lexmill.operators import checks, classify, evaluation, search

c = F.col


def topics(spark, *texts):
    rows = spark.createDataFrame(search_rules.topic_rows(), "rule string, keyword string, doc_id string")
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return sorted((r.query_id, r.doc_id) for r in search.triggered(q, rows).select("query_id", "doc_id").distinct().collect())


def test_topics_add_their_documents(spark):
    got = topics(spark, "Sàn Shopee trừ lố tiền thuế thì sao?", "Quán Karaoke nộp thuế gì", "Tự quyết toán thế nào", "xin chào", None)
    assert got == [(0, "117_2025_NDCP"), (0, "68_2026_NDCP"), (1, "373_2025_NDCP"), (1, "68_2026_NDCP"), (2, "108_2025_QH15"), (2, "126_2020_NDCP")]


def asked_for(spark, text, within, found=()):
    base = spark.createDataFrame([(1, text, within, list(found))], "query_id long, text string, doc_filter string, found_docs array<string>")
    rules = spark.createDataFrame(search_rules.CO_RULES, search_rules.CO_SCHEMA)
    return [(r.target, r.k, r.place) for r in search.co_retrieve(base, rules).orderBy("turn").collect()]


def test_co_retrieval_by_filter_words_and_what_was_found(spark):
    assert asked_for(spark, "Mức phạt là bao nhiêu", "125_2020_NDCP") == [("310_2025_NDCP", 2, "prepend"), ("68_2026_NDCP", 2, "prepend")]
    assert asked_for(spark, "Mức phạt và tiền chậm nộp", "125_2020_NDCP", ["68_2026_NDCP"]) == [("310_2025_NDCP", 2, "prepend"), ("108_2025_QH15", 2, "prepend")]
    assert asked_for(spark, "Lãi chậm nộp tính sao", None) == [("108_2025_QH15", 2, "prepend")]
    assert asked_for(spark, "bất kỳ", "111_2013_TTBTC") == [("86_2024_TTBTC", 3, "append")]
    assert asked_for(spark, "bất kỳ", "126_2020_NDCP") == [] and asked_for(spark, "Uỷ quyền cho ai", "126_2020_NDCP") == [("373_2025_NDCP", 3, "append")]
    assert asked_for(spark, "bất kỳ", None) == []


def test_co_retrieval_around_results(spark):
    """Penalty decrees come before late payment, both before what was found; a document found already is not looked up."""
    docs = ["310_2025_NDCP", "68_2026_NDCP", "108_2025_QH15", "125_2020_NDCP"]
    chunks = spark.createDataFrame([(f"{d}_{i}", d, f"mức phạt tiền chậm nộp {i} " + "x " * i) for d in docs for i in range(4)] + [(f"o{i}", "khac", f"nội dung số {i}") for i in range(60)], "chunk_id string, doc_id string, text string").withColumn("v", F.lit(None).cast("array<float>"))
    registry = spark.createDataFrame([(d, 3, None, None) for d in docs], "doc_id string, legal_level int, effective_from date, effective_to date")
    queries = spark.createDataFrame([(1, "mức phạt tiền chậm nộp", "125_2020_NDCP", None)], "query_id long, text string, doc_filter string, q array<float>")
    as_of = F.lit("2026-11-01").cast("date")
    results = search.search(queries, chunks, registry, as_of, 2, within=queries.select("query_id", F.col("doc_filter").alias("doc_id")))
    rules = spark.createDataFrame(search_rules.CO_RULES, search_rules.CO_SCHEMA)
    got = [(r["rank"], r.doc_id) for r in search.with_co_retrieval(results, queries, chunks, registry, as_of, rules, 20).orderBy("rank").collect()]
    assert got == list(enumerate(["310_2025_NDCP"] * 2 + ["68_2026_NDCP"] * 2 + ["108_2025_QH15"] * 2 + ["125_2020_NDCP"] * 2, start=1))


@pytest.mark.parametrize(
    ("text", "k", "within", "excluded", "want"),
    [
        ("thuế", 50, None, None, (10, None, ["310_2025_NDCP"], False)),
        ("thuế", 0, "", ["a"], (1, None, ["a", "310_2025_NDCP"], False)),
        ("thuế", 3, "310_2025_ndcp", None, (3, "310_2025_ndcp", [], True)),
        ("xử phạt", 3, "310_2025_NDCP", ["b"], (3, "310_2025_NDCP", ["b"], False)),
        (None, None, "125_2020_NDCP", ["310_2025_NDCP"], (5, "125_2020_NDCP", ["310_2025_NDCP"], False)),
    ],
)
def test_search_terms(spark, text, k, within, excluded, want):
    row = spark.createDataFrame([(text, k, within, excluded)], "t string, k int, f string, x array<string>")
    assert tuple(row.select(search.search_terms(c("t"), c("k"), c("f"), c("x")).alias("s")).select("s.*").first()) == want


def test_situations(spark):
    texts = ["Tôi có lương và mở cửa hàng", "Bán trên Shopee", "Chậm nộp thuế 0,03%", "Sổ S2A-HKD", None, "", "lương"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", classify.situations(c("t")).alias("s")).orderBy("i").select("s.*").collect()
    said = [{k for k, v in r.asDict().items() if v} for r in got]
    assert said == [{"multi_income"}, {"online"}, {"penalty", "late_payment"}, {"accounting"}, set(), set(), set()]


@pytest.mark.parametrize(
    ("needs", "values", "expected", "used", "tool", "answer", "want"),
    [
        (False, [5e6], None, [], [], "5.000.000", (None, None)),
        (None, None, None, None, None, None, (None, None)),
        (True, [5e6, 2e7, 0.1], None, [], [], "Nộp 5 triệu và 20.000.000 đồng", (1.0, "tool_skipped")),
        (True, [5e6, 2e7], None, ["calculate_tax_hkd"], [], "Nộp 5 triệu", (0.5, "compliant")),
        (True, [5e6, 2e7], None, [], [], None, (0.2, "tool_skipped")),
        (True, [500.0], "1,5% và 2%; miễn thuế", [], [], "Thuế suất 1,5% và MIỄN THUẾ", (1.0, "tool_skipped")),
        (True, None, "1,5% và 2%", ["calculate_deduction"], [], "1,5%", (0.5, "compliant")),
        (True, None, "1,5% và 2%", [], [], "không rõ", (0.2, "tool_skipped")),
        (True, None, "theo luật", [], [], "gì đó", (1.0, "tool_skipped")),
        (True, None, None, ["search_legal_docs"], [7_000_000], "7 triệu", (0.0, "no_tool")),
        (True, None, "", ["calculate_tax_hkd"], [7_000_000], "Nộp 7 triệu", (1.0, "compliant")),
        (True, None, "", ["calculate_tax_hkd"], [7_000_000], "Nộp 9 triệu", (0.5, "compliant")),
        (True, None, "", ["calculate_tax_hkd"], None, "không có số", (0.5, "compliant")),
    ],
)
def test_first_tier(spark, needs, values, expected, used, tool, answer, want):
    row = spark.createDataFrame([(needs, values, expected, used, tool, answer)], "n boolean, v array<double>, e string, u array<string>, t array<long>, a string")
    assert tuple(row.select(evaluation.tier1(c("n"), c("v"), c("e"), c("u"), c("t"), c("a")).alias("r")).select("r.*").first()) == want


def test_critical_misses_and_gate(spark):
    wanted = spark.createDataFrame([(1, "0,5%"), (1, "miễn thuế"), (2, "10 ngày"), (2, "Điều 5"), (3, "Điều 6")], "case_id long, fact string")
    found = spark.createDataFrame([(1, "mức 0,5%"), (2, "điều 5"), (9, "10 ngày")], "case_id long, value string")
    missed = {r.case_id: r.critical_missed for r in checks.critical_misses(found, wanted).collect()}
    assert missed == {1: 0, 2: 1, 3: 0}
    cases = checks.fact_recall(found, wanted).join(checks.critical_misses(found, wanted), "case_id")
    gate = checks.recall_gate(cases).first()
    assert (gate.n, gate.good, gate.fair, gate.bad, gate.passes) == (3, 0, 2, 1, False) and round(gate.critical_rate, 3) == 0.333
    none = checks.recall_gate(cases.limit(0)).first()
    assert (none.n, none.critical_rate, none.passes) == (0, None, False)


def test_after_a_fact_check(spark):
    rows = [(True, [], 0), (False, [("a", "warning")], 0), (False, [("a", "critical")], 0), (False, [("a", "critical")], 1), (None, None, None), (False, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p boolean, x array<struct<key_fact: string, severity: string>>, n int")
    got = df.select("i", checks.after_fact_check(c("p"), c("x"), c("n")).alias("s")).orderBy("i").select("s.*").collect()
    assert [tuple(r) for r in got] == [("DONE", 1), ("DONE", 1), ("GENERATOR", None), ("DONE", 2), ("DONE", 3), ("DONE", 1)]
