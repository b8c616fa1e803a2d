"""Queries of scalar operators: worked cases with the real rule tables, dealt to all orders by their keys.

Each order gets the case that its key names; the operator runs over the whole
table, and the oracle holds what each case must give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import numbers, rules, text
from lexmill.operators import checks, classify, evaluation, parse, quality, search
from lexmill.plans.common import table
from lexmill.sources import readers
from lexmill.streaming import state


@dataclass(frozen=True)
class Cases:
    """Input columns (Spark types), result columns (SQL types), rows of inputs and results, and what makes the results."""

    inputs: str
    results: str
    rows: list[tuple]
    make: Callable[[], dict[str, Column]]

    def query(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        width = len(self.inputs.split(", "))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = spark.createDataFrame([(i, *r[:width]) for i, r in enumerate(self.rows)], f"case_no int, {self.inputs}").coalesce(1)
            orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.pmod("o_orderkey", F.lit(len(self.rows))).cast("int").alias("case_no"))
            return orders.join(F.broadcast(given), "case_no").select("k", *[c.alias(n) for n, c in self.make().items()])  # as many rows as are written here

        run.__name__ = run.__qualname__ = name
        return run

    def sql(self) -> str:
        width, columns = len(self.inputs.split(", ")), [c.split(" ", 1) for c in self.results.split(", ")]
        rows = ", ".join("(" + ", ".join([str(i), *map(_literal, r[width:])]) + ")" for i, r in enumerate(self.rows))
        named = ", ".join(f"CAST(c{j} AS {kind}) AS {name}" for j, (name, kind) in enumerate(columns))
        return f"SELECT o_orderkey AS k, {named} FROM orders JOIN (VALUES {rows}) v(case_no, {', '.join(f'c{j}' for j in range(len(columns)))}) ON o_orderkey % {len(self.rows)} = case_no"


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def _joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "|")


c = F.col
CASES: dict[str, Cases] = {
    # texts
    "clean_raw_text": Cases(
        "t string",
        "r VARCHAR",
        [
            ("ĐIỀU CHUNG\n 12 \nNội dung .\n\n\n\nHết", "ĐIỀU CHUNG\nNội dung.\n\nHết"),
            ("CÁ NHÂN KINH D- OANH", "CÁ NHÂN KINH D-OANH"),
            ("Thân bài\n-----\nKết\nCHỦ TỊCH QUỐC HỘI\nNguyễn Văn A", "Thân bài\nKết"),
            ("  a     b , c ; d  ", "a  b, c; d"),
        ],
        lambda: {"r": text.clean_document(text.nfc(c("t")))},
    ),
    "compose_unicode": Cases("t string", "r VARCHAR, chars INTEGER", [("éa", "éa", 2), ("Điều", "Điều", 4), ("plain", "plain", 5)], lambda: {"r": text.nfc(c("t")), "chars": F.length(text.nfc(c("t")))}),
    "clean_node_content": Cases(
        "t string",
        "r VARCHAR",
        [
            ("Luật này có hiệu lực.\nNơi nhận: như trên", "Luật này có hiệu lực"),
            ("a\nb   c", "a b c"),
            ("Thu theo mẫu.\nHỘ, CÁ NHÂN KINH DOANH: ...", "Thu theo mẫu"),
            ("hộ, cá nhân kinh doanh ở lại", "hộ, cá nhân kinh doanh ở lại"),
        ],
        lambda: {"r": parse.clean_content(c("t"))},
    ),
    "clean_law_name": Cases(
        "t string",
        "r VARCHAR",
        [
            ("Luật Quản lý thuế và các văn bản hướng dẫn thi hành", "Luật Quản lý thuế"),
            ("Luật Doanh nghiệp theo quy trình", "Luật Doanh nghiệp"),
            ("Luật Đất đai, ", "Luật Đất đai"),
            ("Luật Thuế thu nhập cá nhân", "Luật Thuế thu nhập cá nhân"),
            ("Luật Nhà ở đối với cá nhân", "Luật Nhà ở"),
        ],
        lambda: {"r": text.clean_law_name(c("t"))},
    ),
    "safe_filename": Cases("t string", "r VARCHAR", [("Nghị định 20/2026: mẫu?", "Nghi dinh 20_2026_ mau"), ("__a//b__", "a_b"), ('x<>|"y', "x_y"), ("Đề án", "De an")], lambda: {"r": text.safe_filename(c("t"))}),
    "expand_synonyms": Cases(
        "t string",
        "r VARCHAR",
        [
            ("thuế GTGT của HKD", "thuế GTGT của HKD giá trị gia tăng hộ kinh doanh"),
            ("vat và gtgt", "vat và gtgt giá trị gia tăng giá trị gia tăng"),
            ("tncn thu nhập cá nhân", "tncn thu nhập cá nhân"),
            ("không có gì", "không có gì"),
        ],
        lambda: {"r": text.expand_synonyms(c("t"))},
    ),
    "expand_abbreviations": Cases(
        "t string",
        "r VARCHAR",
        [("Thuế TNCN của CNKD", "thuế thu nhập cá nhân của cnkd"), ("NĐ-CP và cty", "nghị định và công ty"), ("mst: 01, gtgtx", "mã số thuế: 01, gtgtx"), ("CCCD/CMND", "căn cước công dân/căn cước công dân")],
        lambda: {"r": text.expand_abbreviations(c("t"))},
    ),
    "plain_paraphrase": Cases(
        "t string",
        "r VARCHAR",
        [
            ("Thuộc diện không chịu thuế", "không chịu thuế"),
            ("không cần phải kê khai", "không phải kê khai"),
            ("cá nhân có quyền chọn", "cá nhân được phép chọn"),
            ("có thể bị phạt", "bị phạt"),
            ("họ có thể nộp", "họ được phép nộp"),
            ("không bắt buộc đăng ký", "không phải đăng ký"),
        ],
        lambda: {"r": text.plain_paraphrase(c("t"))},
    ),
    "canonical_amount": Cases("t string", "r VARCHAR", [("01 tỷ đồng", "1 tỷ"), ("4.000.000", "4 triệu"), ("15,5 triệu", "15.5 triệu"), ("1.500.000.000 VND", "1.5 tỷ"), ("Mức 5.000 đồng", "mức 5000")], lambda: {"r": numbers.canonical_amount(c("t"))}),
    "strip_markdown": Cases("t string", "r VARCHAR", [("**Điều 5** __x__", "Điều 5 x"), ("a_b *c*", "a_b c"), ("none", "none")], lambda: {"r": text.strip_markdown(c("t"))}),
    "parse_citations": Cases(
        "t string",
        "r VARCHAR",
        [
            ("Theo Điều 5 Luật 109/2025/QH15 và điều 7a của 68/2026/NĐ-CP, Điều 5 Luật 109/2025/QH15", "109/2025/QH15#5|68/2026/NĐ-CP#7a"),
            ("Điều 5. Luật 109/2025/QH15", ""),
            ("không có", ""),
            ("Điều 12 Thông tư 18/2026/TT-BTC", "18/2026/TT-BTC#12"),
        ],
        lambda: {"r": _joined(text.citations(c("t")))},
    ),
    "answer_sections": Cases(
        "t string",
        "r VARCHAR",
        [("**📌 Trích dẫn:** a", "\n\n## Trích dẫn\n\n** a"), ("📌 Trích dẫn: a 💬 Trả lời: b", "\n\n## Trích dẫn\n\na\n\n## Trả lời\n\nb"), ("plain", "plain")],
        lambda: {"r": checks.answer_sections(c("t"))},
    ),
    "ocr_repair": Cases(
        "t string",
        "r VARCHAR",
        [("Diéu 5 thuê suât 1O0 .", "Điều 5 thuế suất 100."), ("Chương IH và Mục TV", "Chương III và Mục IV"), ("l 5 câ nhân", "1 5 cá nhân"), ("Khoán 2 Ðiều 3", "Khoản 2 Điều 3")],
        lambda: {"r": text.fix_ocr(c("t"))},
    ),
    "split_merged_words": Cases(
        "t string",
        "r VARCHAR",
        [
            ("thuếthunhậpcánhân phảinộp", "thuế thu nhập cá nhân phải nộp"),
            ("Luậtnày quyđịnh về thuế", "Luật này quy định về thuế"),
            ("hộkinhdoanh 02/TNDN và 5trieudong", "hộ kinh doanh 02/TNDN và 5trieudong"),
            ("trường hợp nghịđịnh", "trường hợp nghị định"),
        ],
        lambda: {"r": text.fix_merged_words(c("t"))},
    ),
    "source_dispatch": Cases("t string", "r VARCHAR", [("/a/B.DOCX", "docx"), ("x.doc", "doc"), ("y.Pdf", "pdf"), ("z.json", "json"), ("n.txt", "text")], lambda: {"r": readers.kind_of(c("t"))}),
    # numbers, dates, identifiers
    "currency_parse": Cases("t string", "r DOUBLE", [("1.500.000 đồng", 1500000.0), ("2,5 tỷ đ", 2.5e9), ("300 nghìn VND", 300000.0), ("đồng", None), ("12 triệu đồng", 1.2e7)], lambda: {"r": numbers.parse_currency(c("t"))}),
    "date_format": Cases("t string", "r VARCHAR", [("2026-01-05", "ngày 5 tháng 1 năm 2026"), ("2025-12-31", "ngày 31 tháng 12 năm 2025")], lambda: {"r": numbers.format_date(F.to_date("t"))}),
    "heading_numbers": Cases(
        "t string",
        "article VARCHAR, clause VARCHAR, point VARCHAR, is_chapter BOOLEAN, chapter VARCHAR",
        [
            ("Điều 12. Phạm vi", "12", None, None, False, None),
            ("3. Cá nhân", None, "3", None, False, None),
            ("b) Khoản thu", None, None, "b", False, None),
            ("CHƯƠNG IV", None, None, None, True, "IV"),
            ("Article 7", "7", None, None, False, None),
            ("xem chương 2 và điều 9", "9", None, None, False, "2"),
        ],
        lambda: {"article": numbers.article_number(c("t")), "clause": numbers.clause_number(c("t")), "point": numbers.point_letter(c("t")), "is_chapter": numbers.is_chapter_heading(c("t")), "chapter": numbers.chapter_number(c("t"))},
    ),
    "validity_predicates": Cases(
        "t string",
        "article BOOLEAN, clause BOOLEAN, point BOOLEAN",
        [("1000", True, False, False), ("1001", False, False, False), ("100", True, True, False), ("0", False, False, False), ("z", False, False, True), ("ab", False, False, False), (None, False, False, False)],
        lambda: {"article": numbers.is_article(c("t")), "clause": numbers.is_clause(c("t")), "point": numbers.is_point(c("t"))},
    ),
    "document_number": Cases("t string", "r VARCHAR", [("20_2026_NDCP", "20/2026/NĐ-CP"), ("18_2026_TTBTC", "18/2026/TT-BTC"), ("109_2025_QH15", "109/2025/QH15"), ("So_Tay", "So/Tay"), ("a", "a")], lambda: {"r": numbers.document_number(c("t"))}),
    "document_metadata": Cases(
        "t string, stem string",
        "kind VARCHAR, no VARCHAR, issued VARCHAR, effect VARCHAR",
        [
            ("NGHỊ ĐỊNH\nQuy định về thuế\nHà Nội, ngày 5 tháng 3 năm 2026\nCăn cứ Luật\nNghị định có hiệu lực từ ngày 1/7/2026", "68_2026_NDCP", "Nghị định", "68/2026/NĐ-CP", "2026-03-05", "2026-07-01"),
            ("Số: 18/2026/TT-BTC\nTHÔNG TƯ\nngày 31 tháng 12 năm 2025", "x_2026_TTBTC", "Thông tư", "18/2026/TT-BTC", "2025-12-31", "2030-01-01"),
            ("Văn bản khác", "So_Tay_HKD", "Luật", "So/Tay/HKD", None, "2030-01-01"),
        ],
        lambda: {n: parse.document_metadata(c("t"), c("stem"), F.lit("2030-01-01").cast("date"))[f].cast("string") for n, f in (("kind", "document_type"), ("no", "document_number"), ("issued", "issue_date"), ("effect", "effective_date"))},
    ),
    "legal_level": Cases("t string", "r INTEGER", [("Luật", 1), ("Nghị quyết", 2), ("Nghị định", 3), ("Thông tư", 4), ("Công văn", 5), ("Sổ tay", 99)], lambda: {"r": numbers.legal_level(c("t"))}),
    "amounts_in_text": Cases(
        "t string",
        "r VARCHAR, near BOOLEAN",
        [
            ("thu 15,5 triệu và 2 tỷ, phạt 1.200.000 đồng", "15500000|2000000000|1200000", True),
            ("10.000 đồng, 10.001 đồng", "10001", False),
            ("15 triệu và 15.000.000", "15000000", False),
            ("không", "", False),
        ],
        lambda: {"r": _joined(numbers.amounts(c("t"))), "near": numbers.number_found(F.lit(1_205_000), numbers.amounts(c("t")))},
    ),
    "dialogue_slots": Cases(
        "t string",
        "income VARCHAR, dependents VARCHAR",
        [
            ("Lương tôi 20 triệu/tháng", "20 triệu/tháng", None),
            ("doanh thu 2,5 tỷ năm ngoái", "2,5 tỷ/năm", None),
            ("tôi có 2 người phụ thuộc", None, "2 người phụ thuộc"),
            ("thu nhập 300k, nuôi 3 con nhỏ", "300 k", "3 con nhỏ"),
            ("chào", None, None),
        ],
        lambda: {"income": numbers.income_slot(c("t")), "dependents": numbers.dependents_slot(c("t"))},
    ),
    "nearest_rank": Cases("a array<int>", "p50 INTEGER, p95 INTEGER", [([5, 1, 3], 3, 5), ([4, 2], 4, 4), (list(range(100, 0, -1)), 51, 96), ([7], 7, 7)], lambda: {"p50": numbers.nearest_rank(c("a"), 0.5), "p95": numbers.nearest_rank(c("a"), 0.95)}),
    # questions
    "combined_situations": Cases(
        "t string",
        "both_incomes BOOLEAN, online BOOLEAN",
        [("Tôi có lương và cho thuê nhà", True, False), ("Bán hàng trên Shopee", False, True), ("chỉ có LƯƠNG", False, False), ("lương và quán, bán trên tiktok", True, True)],
        lambda: {"both_incomes": classify.all_of(c("t"), [["lương", "tiền công"], ["cho thuê", "kinh doanh", "quán"]]), "online": classify.holds_any(F.lower("t"), rules.SCOPE_WORDS["TMDT"])},
    ),
    "model_routing": Cases(
        "q double, ctx double, h double, tools double, d double, used int",
        "model VARCHAR",
        [(1.0, 1.0, 1.0, 0.0, 0.0, 5, "premium"), (1.0, 1.0, 0.4, 0.0, 0.0, 5, "fast"), (1.0, 1.0, 1.0, 1.0, 1.0, 10, "fast"), (0.2, 0.2, 0.2, 0.2, 0.2, 0, "fast")],
        lambda: {"model": classify.route_model(c("q"), c("ctx"), c("h"), c("tools"), c("d"), c("used"), 10)},
    ),
    "question_complexity": Cases(
        "t string",
        "r DOUBLE",
        [("so sánh và phân tích", 0.666667), ("điều 5", 0.2), ("a? b? c? so sánh", 0.433333), ("x", 0.0), ("so sánh phân tích ngoại lệ " + "y" * 200, 1.0)],
        lambda: {"r": F.round(classify.complexity(c("t"), ["so sánh", "phân tích", "ngoại lệ"], r"^điều \d+$"), 6)},
    ),
    "specialist_choice": Cases("a array<string>", "r VARCHAR", [(["PIT", "HKD"], "HKD"), (["PENALTY", "TMDT"], "PENALTY"), (["ALL"], "GENERAL"), (["PIT"], "PIT"), (["HKD", "TMDT"], "TMDT")], lambda: {"r": classify.specialist(c("a"))}),
    "rewrite_check": Cases(
        "q string, w string",
        "r VARCHAR",
        [("thuế?", "Thuế thu nhập cá nhân là gì", "Thuế thu nhập cá nhân là gì"), ("Thuế khoán là gì?", "thuế khoán là gì.", "Thuế khoán là gì?"), ("abc", "ngắn", "abc"), ("q", "  một câu hỏi dài hơn  ", "một câu hỏi dài hơn")],
        lambda: {"r": classify.accept_rewrite(c("q"), c("w"))},
    ),
    "query_slots": Cases(
        "t string",
        "amount DOUBLE, period VARCHAR, dependents INTEGER, year INTEGER, is_revenue BOOLEAN",
        [
            ("Doanh thu 600 triệu năm 2026 nộp thuế gì", 6e8, "year", None, 2026, True),
            ("Lương 20 triệu mỗi tháng, 2 người phụ thuộc", 2e7, "month", 2, None, False),
            ("Bán hàng 1,5 tỷ", 1.5e9, None, None, None, False),
            ("Thuế khoán còn không", None, None, None, None, False),
            ("doanh số 3.000 triệu/năm", 3e9, "year", None, None, True),
        ],
        lambda: {n: classify.intent_slots(c("t"))[n] for n in ("amount", "period", "dependents", "year", "is_revenue")},
    ),
    "scope_real": Cases(
        "t string, intent string",
        "scopes VARCHAR, confidence DOUBLE",
        [
            ("Hộ kinh doanh bán trên Shopee", None, "HKD,TMDT", 0.5),
            ("lương tháng này", "CALCULATION", "PIT", 1.0),
            ("xin chào", "CALCULATION", "PIT,HKD", 0.45),
            ("xin chào", None, "ALL", 0.0),
            ("bị phạt chậm nộp", "CALCULATION", "PENALTY,PIT", 1.0),
        ],
        lambda: {"scopes": F.array_join(classify.classify_scope(c("t"), c("intent"))["scopes"], ","), "confidence": classify.classify_scope(c("t"), c("intent"))["confidence"]},
    ),
    # parsing
    "form_lines": Cases(
        "t string, kind string, level string",
        "form BOOLEAN, closes BOOLEAN",
        [
            ("Mẫu số S1a-HKD", "dieu", "khoan", True, True),
            ("SỔ DOANH THU BÁN HÀNG", "diem", "khoan", True, False),
            ("Điều 5. Sổ sách", "khoan", "diem", False, True),
            ("Kỳ kê khai: tháng 1", "chuong", "dieu", True, False),
            ("sổ tay", "khoan", "dieu", False, False),
            ("x", "dieu", "dieu", False, True),
        ],
        lambda: {"form": F.trim("t").rlike(parse.FORM_LINE), "closes": parse.closes(c("kind"), c("level"))},
    ),
    "line_forms": Cases(
        "t string",
        "kind VARCHAR, idx VARCHAR, content VARCHAR",
        [
            ("Điều 5a. Phạm vi", "dieu", "5a", "Phạm vi"),
            ("chương IV", "chuong", "IV", ""),
            ("2. Cá nhân kinh doanh", "khoan", "2", "Cá nhân kinh doanh"),
            ("2025 năm", "text", None, "2025 năm"),
            ("đ) Khoản thu khác", "diem", "đ", "Khoản thu khác"),
            ("a.1) Chi tiết", "tiet", "a.1", "Chi tiết"),
            ("Phụ lục kèm theo Nghị định", "text", None, "Phụ lục kèm theo Nghị định"),
            ("PHẦN II Quy định", "phan", "II", "Quy định"),
            ("1. Tổng cộng", "text", None, "1. Tổng cộng"),
            ("Mục 3 Kê khai", "muc", "3", "Kê khai"),
        ],
        lambda: {"kind": parse.line_type(c("t"))["kind"], "idx": parse.line_type(c("t"))["index"], "content": parse.line_type(c("t"))["content"]},
    ),
    "parse_outcome": Cases("e string, n int, w int, s boolean", "r VARCHAR", [(None, 5, 0, False, "SUCCESS"), (None, 5, 2, False, "PARTIAL"), ("bad", 5, 0, False, "FAIL"), (None, 0, 0, False, "FAIL"), ("bad", 0, 0, True, "SKIP")], lambda: {"r": readers.parse_status(c("e"), c("n"), c("w"), c("s"))}),
    # search and answers
    "exception_factors": Cases("s double", "r DOUBLE", [(0.8, 1.0), (0.72, 1.0), (0.6, 0.35), (0.5, 0.05), (0.1, 0.05)], lambda: {"r": search.exception_factor(c("s"), F.lit(0.72), F.lit(0.5))}),
    "confidence_label": Cases("s double", "r VARCHAR", [(0.02, "HIGH"), (0.018, "HIGH"), (0.0179, "MEDIUM"), (0.01, "MEDIUM"), (0.009, "LOW"), (None, "LOW")], lambda: {"r": search.confidence_label(c("s"))}),
    "old_law_words": Cases("t string, y int", "r BOOLEAN", [("quy định cũ về khoán", None, True), ("năm 2025", 2025, True), ("năm 2026", 2026, False), ("tiền ăn giữa ca", None, True), ("thuế khoán", None, False)], lambda: {"r": search.speaks_of_old_law(c("t"), c("y"))}),
    "filter_names": Cases("t string", "r VARCHAR", [(" 68_2026_ndcp ", "68_2026_NDCP"), ("SO_TAY_HKD", "So_Tay_HKD"), ("unknown", None)], lambda: {"r": search.resolve_filter(c("t"), rules.SCOPE_DOCS["HKD"])}),
    "source_labels": Cases(
        "kind string, idx string, title string, status string",
        "label VARCHAR, needs_check BOOLEAN",
        [("dieu", "5", "Phạm vi", "active", "Điều 5 › Phạm vi", False), ("khoan", "2", "", "superseded", "Khoản 2", True), ("chuong", "I", "Chung", None, "Chung", True), ("diem", "b", None, "active", "Điểm b", False)],
        lambda: {n: checks.source_label(c("kind"), c("idx"), c("title"), c("status"))[n] for n in ("label", "needs_check")},
    ),
    "context_line": Cases(
        "e string, x string, i string, s string",
        "r VARCHAR",
        [("HKD", "GTGT", None, None, "Đối tượng: HKD; Loại thuế: GTGT"), (None, None, "20 triệu/tháng", "2 con", "Thu nhập: 20 triệu/tháng; Tình huống: 2 con"), (None, None, None, None, "")],
        lambda: {"r": state.context_text(c("e"), c("x"), c("i"), c("s"))},
    ),
    "event_frames": Cases("stage string, v int", "r VARCHAR", [("status", 1, 'event: status\ndata: {"v":1}\n\n'), ("done", None, "event: done\ndata: {}\n\n")], lambda: {"r": checks.event_frame(c("stage"), F.struct("v"))}),
    "comparators": Cases(
        "t string, n string",
        "r VARCHAR",
        [("doanh thu trên 500 triệu", "500", ">"), ("thu nhập từ 10 triệu", "10", ">="), ("không quá 3 tỷ", "3", ">"), ("dưới 20 triệu", "20", "<"), ("mức 7 phần trăm", "7", None), ("x", "9", None)],
        lambda: {"r": checks.comparator(c("t"), c("n"))},
    ),
    # evaluation
    "tier1_numbers": Cases(
        "w array<double>, a string",
        "r DOUBLE",
        [([1.2e7, 5e6], "nộp 12 triệu và 5.000.000 đồng", 1.0), ([1.2e7, 5e6], "nộp 12 triệu", 0.5), ([1.2e7], "không rõ", 0.2), ([], "12 triệu", None)],
        lambda: {"r": evaluation.tier1_numbers(c("w"), c("a"))},
    ),
    "tier3_tools": Cases(
        "u array<string>, topic string, calc boolean, a string",
        "r DOUBLE",
        [
            ([], "Kế toán HKD", False, "x" * 60, 0.3),
            ([], "Kế toán HKD", False, "ngắn", 0.0),
            (["search_legal_docs"], "Thuế hộ kinh doanh", True, "", 0.0),
            (["calculate_tax_hkd"], "Thuế hộ kinh doanh", True, "", 1.0),
            (["get_article"], "Chủ đề lạ", False, "", 0.8),
            (["get_article"], "Thuế tài sản", False, "", 0.5),
        ],
        lambda: {"r": evaluation.tier3_tools(c("u"), c("topic"), c("calc"), c("a"))},
    ),
    "tier4_facts": Cases("s double", "r DOUBLE", [(1.0, 1.0), (0.9, 1.0), (0.5, 0.5), (0.4, 0.0), (None, None)], lambda: {"r": evaluation.tier4_facts(c("s"))}),
    "fact_in_answer": Cases(
        "f string, a string",
        "r BOOLEAN",
        [
            ("miễn thuế", "Hộ được **miễn** **thuế**", True),
            ("TNCN", "thuế thu nhập cá nhân", True),
            ("không chịu thuế", "thuộc diện không chịu thuế", True),
            ("được phép nộp", "không được phép nộp", True),
            ("có thể bị phạt", "không bị phạt", False),
            ("5 %", "mức 5%", True),
            ("2 tỷ", "khoảng 2.000.000.000 hoặc 2000000000 đồng", True),
            ("15000000 đồng", "khoảng 15 triệu", True),
            ("chậm nộp", "nộp đúng hạn", False),
        ],
        lambda: {"r": evaluation.fact_in_answer(c("f"), c("a"))},
    ),
    "fuzzy_ratio": Cases("x string, y string", "r DOUBLE", [("abc", "xxabcxx", 100.0), ("abcd", "abxd", 75.0), ("", "", 100.0), ("", "a", 0.0), ("a", "b", 0.0)], lambda: {"r": F.round(evaluation.partial_ratio(c("x"), c("y")), 3)}),
    "batch_pass_rule": Cases(
        "a double, b double, d double, e double",
        "r BOOLEAN, one_calc BOOLEAN",
        [(1.0, 1.0, 0.0, 1.0, True, True), (0.0, 1.0, 1.0, 1.0, True, False), (None, None, 0.5, None, False, False), (None, None, None, None, False, False), (1.0, 0.5, 0.5, 0.5, False, False)],
        lambda: {"r": evaluation.passed_all_tiers(c("a"), c("b"), c("d"), c("e")), "one_calc": evaluation.passed(evaluation.overall_score(c("a"), c("b"), c("e"), F.lit(1)), F.lit(True), c("a"))},
    ),
    "calculator_numbers": Cases("x double, y double, z double", "r VARCHAR", [(1.5, -3.0, 10.4, "2|10"), (None, 0.0, 2.5, "2"), (1e9, 7.0, 0.2, "1000000000|7|0"), (None, None, None, "")], lambda: {"r": _joined(evaluation.calculator_numbers([c("x"), c("y"), c("z")]))}),
    "annotation_check": Cases(
        "who array<string>, dom array<string>, kind string, f string, t string, conf double",
        "r VARCHAR",
        [
            (["HKD"], ["tax"], "tax_rate", "2026-01-01", None, 0.9, ""),
            (["alien"], ["moon"], "rate", "01/01/2026", None, 2.0, "who|domain|content|date|confidence"),
            (None, ["tax"], "other", None, None, 0.5, "missing"),
            (["all"], None, "penalty", None, "2026-13-01", 0.0, "date"),
        ],
        lambda: {"r": _joined(quality.annotation_issues(c("who"), c("dom"), c("kind"), c("f"), c("t"), c("conf"), ["tax", "invoice"]))},
    ),
    "annotation_lists": Cases("a array<string>, t string", "packed VARCHAR, unpacked VARCHAR", [(["x", "y"], "a, b,,c", "x,y", "a|b|c"), ([], "", "", ""), (["one"], None, "one", "")], lambda: {"packed": quality.pack_list(c("a")), "unpacked": _joined(quality.unpack_list(c("t")))}),
    "former_brackets": Cases(
        "m double",
        "bracket INTEGER",
        [(4e6, 1), (5e6, 1), (5000001.0, 2), (1.8e7, 3), (3e7, 4), (5.2e7, 5), (8e7, 6), (1e9, 7)],
        lambda: {"bracket": F.size(F.filter(F.array(*[F.lit(lo) for lo, _, _ in rules.MONTHLY_BRACKETS]), lambda lo: lo < c("m")))},
    ),
}

QUERIES = [x.query(name) for name, x in CASES.items()]
SQL = {name: x.sql() for name, x in CASES.items()}
