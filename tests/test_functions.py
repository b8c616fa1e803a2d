"""Text, number and rule functions against expected values."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import numbers, text
from lexmill.operators import analytics, classify


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given,want",
    [("5 triệu", 5e6), ("10 tỷ", 1e10), ("5,5 triệu", 5.5e6), ("100 nghìn", 1e5), ("5%", 5.0), ("1.500.000", 1.5e6), ("chữ", None), ("12 k", 12e3)],
)
def test_parse_number(spark, given, want):
    assert one(spark, given, numbers.parse_number) == want


@pytest.mark.parametrize(
    "given,want",
    [("ngày 15 tháng 12 năm 2025", datetime.date(2025, 12, 15)), ("15/2/2025", datetime.date(2025, 2, 15)), ("2025-12-05", datetime.date(2025, 12, 5)), ("ngày 31 tháng 2 năm 2025", None), ("không", None)],
)
def test_parse_date(spark, given, want):
    assert one(spark, given, numbers.parse_date) == want


def test_formats(spark):
    assert one(spark, 5e6, numbers.format_currency, "double") == "5.000.000 đồng"
    assert one(spark, 5.25e9, lambda c: numbers.format_currency(c, short=True), "double") in ("5.2 tỷ đồng", "5.3 tỷ đồng")
    assert one(spark, "20_2026_NDCP", numbers.document_number) == "20/2026/NĐ-CP"
    assert one(spark, "So_Tay", numbers.document_number) == "So/Tay"
    assert one(spark, "Luật", numbers.legal_level) == 1 and one(spark, "Khác", numbers.legal_level) == 99


@pytest.mark.parametrize("given,want", [("Luật thủ đô", "luat_thu_do"), ("pháp luật về công nghệ\ncao", "luat_cong_nghe_cao"), ("Nghị định 123/2024/NĐ-CP", "nghi_dinh_123_2024_nd_cp"), ("!!!", "unknown")])
def test_slugify(spark, given, want):
    assert one(spark, given, text.slugify) == want


def test_text(spark):
    assert one(spark, "a  ,b “c”", text.squeeze) == 'a,b "c"'
    assert one(spark, "thuế GTGT", text.expand_synonyms) == "thuế GTGT giá trị gia tăng"
    assert one(spark, "giá trị gia tăng (GTGT)", text.expand_synonyms) == "giá trị gia tăng (GTGT)"
    assert one(spark, "Nội dung. Nơi nhận: như trên", text.clean_content) == "Nội dung"
    assert one(spark, "Luật Thủ đô, nghị quyêt của", text.clean_law_name) == "Luật Thủ đô"
    assert one(spark, "ê", text.nfc) == "ê"
    assert one(spark, "cánhân", text.fix_merged_words) == "cá nhân"
    assert one(spark, None, text.fix_merged_words) is None


def test_temporal(spark):
    day = F.to_date(F.lit("2026-01-01"))
    at = lambda q: one(spark, q, lambda c: numbers.temporal_context(c, day))
    assert [at("từ 01/07/2026"), at("năm 2025 và 2024"), at("Luật 109"), at("hiện nay"), at("gì")] == ["date:2026", "year:2024", "law:109", "year:2026", ""]


@pytest.mark.parametrize(
    "revenue,category,vat,pit",
    [(3e8, "goods", 3e6, 0), (5e8, "services", 25e6, 0), (1e9, "goods", 1e7, 5e6), (2e9, "services", 1e8, 4e7), (5e9, "manufacturing", 15e7, 75e6), (1e11, "other", 2e9, 1e9), (6e8, "real_estate", 3e7, 3e7)],
)
def test_household_tax(spark, revenue, category, vat, pit):
    r = spark.createDataFrame([(revenue, category)], "r double, c string").select(analytics.household_tax(F.col("r"), F.col("c")).alias("t")).first()["t"]
    assert (r.gtgt_payable, r.tncn_payable, r.total_tax, r.error) == (vat, pit, vat + pit, None)


def test_household_tax_errors(spark):
    r = spark.createDataFrame([(-1.0, "goods"), (1.0, "x"), (None, "goods")], "r double, c string").select(analytics.household_tax(F.col("r"), F.col("c")).alias("t")).collect()
    assert [x.t.error for x in r] == ["negative revenue", "unknown category", "negative revenue"]


@pytest.mark.parametrize("income,tax", [(0, 0), (1e8, 5e6), (1.2e8, 6e6), (2e8, 14e6), (5e8, 58e6), (2e9, 526e6)])
def test_progressive(spark, income, tax):
    assert one(spark, float(income), analytics.progressive_tax, "double") == tax


def test_deduction(spark):
    r = spark.createDataFrame([(1, 12), (0, 0), (0, 13)], "d int, m int").select(analytics.deduction(F.col("d"), F.col("m")).alias("t")).collect()
    assert r[0].t.annual == 260_400_000 and [x.t.error for x in r[1:]] == ["months out of range"] * 2


def test_obligation_edges(spark):
    f = lambda x: one(spark, x, lambda c: analytics.obligation(c, F.lit(True), F.lit(True)), "double")
    assert (f(5e8).is_exempt, f(5e8).einvoice, f(499e6).einvoice, f(1e9).einvoice) == (True, "optional", "false", "true")
    assert (f(3e9).tax_method, f(3.1e9).tax_method, f(5e10).filing, f(5.1e10).filing, f(5.1e10).profit_rate) == ("either", "profit", "quarterly", "monthly", 0.20)


def test_classification(spark):
    intent = lambda q: one(spark, q, classify.classify_query).intent
    assert intent("Điều 9") == "DIRECT_LOOKUP"
    assert intent("Thông tư này hiện nay có còn áp dụng đối với cá nhân không") == "VALIDITY_CHECK"
    assert intent("tính thuế cho người có ba con đang làm việc ở hai nơi") == "CALCULATION"
    assert one(spark, "bóng đá hôm nay", classify.pre_route) == "reject" and one(spark, "thuế bóng đá", classify.pre_route) == "pass"
    s = one(spark, "bán hàng trên shopee", lambda c: classify.classify_scope(c, F.lit(None).cast("string")))
    assert s.scopes == ["HKD", "TMDT"] and s.confidence == 0.5
    assert one(spark, "xin chào", lambda c: classify.classify_scope(c, F.lit("CALCULATION"))).scopes == ["PIT", "HKD"]


@pytest.mark.parametrize("given,want", [("01 tỷ", "1 tỷ"), ("1 tỷ đồng", "1 tỷ"), ("4.000.000", "4 triệu"), ("4,000,000", "4 triệu"), ("15,5 triệu", "15.5 triệu"), ("500.000.000 VND", "500 triệu"), (None, None)])
def test_canonical_amount(spark, given, want):
    assert one(spark, given, numbers.canonical_amount) == want


def test_schemas_parse(spark):
    from lexmill.functions import schemas

    for name in ("NODES", "EDGES", "TABLES", "DOCUMENT", "CHUNKS", "REGISTRY", "CLASSIC", "ANNOTATION", "KEY_FACT", "RESULT", "CACHE", "ANSWER_LOG", "PATCHES", "HITS", "TURNS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_tools_tier(spark):
    from lexmill.operators.evaluation import tier3_tools

    rows = [([], "Thuế tài sản", False, "x" * 60), (["search_legal_docs"], "Thuế hộ kinh doanh", True, ""), (["search_legal_docs"], "Thuế tài sản", False, ""), (["other"], "Thuế tài sản", False, ""), (["other"], "?", False, "")]
    df = spark.createDataFrame(rows, "u array<string>, t string, c boolean, a string")
    assert [r.s for r in df.select(tier3_tools(F.col("u"), F.col("t"), F.col("c"), F.col("a")).alias("s")).collect()] == [0.3, 0.0, 1.0, 0.5, 0.8]


def test_rows_are_read_by_schema(spark, tmp_path):
    from lexmill.sources import readers

    (tmp_path / "p.json").write_text('{"doc_id": "d", "op_seq": 2, "op": "set_field", "other": 1}\n{"doc_id": "e"}\n')
    rows = readers.read_rows(spark, "patches", str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.op_seq, r.value) for r in rows] == [("d", 2, None), ("e", None, None)] and len(rows[0]) == 6
