"""Numbers, money, dates and identifiers as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def parse_number(text: Column) -> Column:
    """A Vietnamese number as double; a unit anywhere in the text multiplies it.

    Dots before three digits separate thousands, a comma is the decimal point.
    Units are found as mere substrings, so any "k" multiplies by a thousand.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\.(?=\d{3})", ""), ",", ".")
    base = F.regexp_extract(plain, r"([\d.]+)", 1).try_cast("double")
    return (
        F.when(_any(plain, ["tỷ", "ty", "billion"]), base * 1e9)
        .when(_any(plain, ["triệu", "trieu", "million"]), base * 1e6)
        .when(_any(plain, ["nghìn", "ngàn", "ngan", "thousand", "k"]), base * 1e3)
        .otherwise(base)
    )


def parse_percent(text: Column) -> Column:
    """The first percentage, as a share of one."""
    return F.replace(F.regexp_extract(text, r"([\d,.]+)\s*%", 1), F.lit(","), F.lit(".")).try_cast("double") / 100


def parse_currency(text: Column) -> Column:
    return parse_number(F.regexp_replace(text, "(?iu)(đồng|đ|VND)", ""))


def format_currency(amount: Column, short: bool = False) -> Column:
    """An amount in đồng, grouped by dots; ``short`` gives one decimal of thousands, millions or billions."""
    if not short:
        return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")), F.lit(" đồng"))
    unit = lambda by, name: F.format_string(f"%.1f {name} đồng", amount / by)
    return F.when(amount >= 1e9, unit(1e9, "tỷ")).when(amount >= 1e6, unit(1e6, "triệu")).when(amount >= 1e3, unit(1e3, "nghìn")).otherwise(F.format_string("%.0f đồng", amount))


def _date(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(text, pattern, i) for i in order)
    return F.try_to_date(F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """A date written in words, as d/m/y or as y/m/d; what is no date falls through to the next form."""
    return F.coalesce(
        _date(text, r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", (3, 2, 1)),
        _date(text, r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", (3, 2, 1)),
        _date(text, r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})", (1, 2, 3)),
    )


def format_date(day: Column) -> Column:
    return F.concat_ws(" ", F.lit("ngày"), F.dayofmonth(day).cast("string"), F.lit("tháng"), F.month(day).cast("string"), F.lit("năm"), F.year(day).cast("string"))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def article_number(text: Column) -> Column:
    return F.coalesce(_first(text, r"(?iu)điều\s+(\d+)"), _first(text, r"(?i)Article\s+(\d+)"))


def clause_number(text: Column) -> Column:
    return _first(F.trim(text), r"^(\d+)[.\s]")


def point_letter(text: Column) -> Column:
    return _first(F.trim(text), r"^([a-z])\)")


def is_chapter_heading(text: Column) -> Column:
    return F.trim(text).rlike(r"(?iu)^chương\s+([IVXLCDM]+|[0-9]+)")


def chapter_number(text: Column) -> Column:
    return _first(text, r"(?iu)chương\s+([IVXLCDM]+|[0-9]+)")


def is_article(value: Column) -> Column:
    return F.coalesce(value.try_cast("int").between(1, 1000), F.lit(False))


def is_clause(value: Column) -> Column:
    return F.coalesce(value.try_cast("int").between(1, 100), F.lit(False))


def is_point(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-z]$"), F.lit(False))


# Issuers in file stems and in document numbers; ranks of document types.
STEM_TYPES = {"NDCP": "NĐ-CP", "TTBTC": "TT-BTC"}
LEGAL_LEVELS = {"Luật": 1, "Nghị quyết": 2, "Nghị định": 3, "Thông tư": 4, "Công văn": 5}


def document_number(stem: Column) -> Column:
    """A file stem as a document number; stems of fewer than three parts only change their underscores."""
    parts = F.split(stem, "_")
    issuer = F.array_join(F.slice(parts, 3, 99), "_")
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STEM_TYPES.items() for x in p]), issuer), issuer)
    return F.when(F.size(parts) < 3, F.replace(stem, F.lit("_"), F.lit("/"))).otherwise(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), known))


def legal_level(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEGAL_LEVELS.items() for x in p]), kind), F.lit(99))


def temporal_context(question: Column, as_of: Column) -> Column:
    """What time a question speaks of: a date's year, the smallest year, a law's number, the present, or nothing."""
    q = F.lower(question)
    day = F.regexp_extract(q, r"\d{1,2}/\d{1,2}/(\d{4})", 1)
    years = F.regexp_extract_all(q, F.lit(r"(?<![\p{L}\p{N}_])(20(?:2[0-9]|30))(?![\p{L}\p{N}_])"), F.lit(1))
    law = F.regexp_extract(q, r"(?:luật|nghị định|thông tư|nd|tt)\s*(\d{2,3})", 1)
    now = q.rlike("hiện nay|hiện tại|bây giờ|năm nay|ngay bây giờ")
    return (
        F.when(day != "", F.concat(F.lit("date:"), day))
        .when(F.size(years) > 0, F.concat(F.lit("year:"), F.array_min(years)))
        .when(law != "", F.concat(F.lit("law:"), law))
        .when(now, F.concat(F.lit("year:"), F.year(as_of).cast("string")))
        .otherwise(F.lit(""))
    )


def question_key(question: Column, as_of: Column, doc_ids: Column | None = None) -> Column:
    """Cache key of a question: its text, its time and its leading documents."""
    docs = F.lit("") if doc_ids is None else F.coalesce(F.array_join(F.array_sort(doc_ids), "|"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(question)), temporal_context(question, as_of), docs), 256), 1, 32)


def digits_only(text: Column) -> Column:
    """Text without the signs that group digits."""
    return F.regexp_replace(text, "[,.]", "")


def amounts(text: Column) -> Column:
    """Numbers above ten thousand in a text: millions, billions and plain ones, each once, in that order."""
    scaled = lambda unit, by: F.transform(
        F.regexp_extract_all(text, F.lit(rf"(\d+(?:[.,]\d+)?)\s*{unit}"), F.lit(1)), lambda x: (F.replace(x, F.lit(","), F.lit(".")).cast("double") * by).cast("long")
    )
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d.,]*"), F.lit(0)), lambda x: digits_only(x).try_cast("long"))
    return F.array_distinct(F.filter(F.concat(scaled("triệu", 1e6), scaled("tỷ", 1e9), plain), lambda x: x > 10_000))


def number_found(number: Column, among: Column, tolerance: float = 0.01) -> Column:
    """True if a number, or it in millions, is among others up to a relative difference."""
    close = lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1)) <= tolerance
    millions = F.bround(number / 1e6)
    return F.exists(among, lambda n: (n != 0) & (close(n, number) | ((millions > 0) & close(n, millions))))


def income_slot(text: Column) -> Column:
    """The first amount with unit and period of a text that speaks of income."""
    pattern = r"(?iu)(\d+(?:[,.]\d+)?)\s*(triệu|tỷ|nghìn|tr|ty|k)?\s*(?:/|trên)?\s*(tháng|năm|quý|ngày)?"
    n, unit, period = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    found = F.concat(F.trim(F.concat_ws(" ", n, unit)), F.when(period != "", F.concat(F.lit("/"), period)).otherwise(F.lit("")))
    spoken = F.lower(text).rlike("lương|thu nhập|doanh thu|doanh số|kiếm|nhận")
    return F.when(spoken & (n != "") & (F.length(found) > 2), found)


def dependents_slot(text: Column) -> Column:
    """How many dependants a text names, with its words for them."""
    pattern = r"(?iu)(\d+)\s*(người phụ thuộc|npt|con nhỏ|con|người thân)"
    n = F.regexp_extract(text, pattern, 1)
    return F.when(n != "", F.concat_ws(" ", n, F.regexp_extract(text, pattern, 2)))


def percentile_rounded(value: Column, p: int) -> Column:
    """Aggregate: the p-th percentile with linear interpolation, as a whole number."""
    return F.bround(F.percentile(value, p / 100)).cast("long")


def nearest_rank(values: Column, share: float) -> Column:
    """The element at position floor(n * share) of an array, sorted."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * share).cast("int"))


def _in_words(grouped: re.Match) -> str:
    """A grouped number in billions or millions, as far as it reaches them."""
    value = int(re.sub(r"[.,]", "", grouped.group(0)))
    for unit, by in (("tỷ", 1_000_000_000), ("triệu", 1_000_000)):
        if value >= by:
            return f"{value // by} {unit}" if value % by == 0 else f"{value / by:.1f} {unit}"
    return str(value)


@F.pandas_udf(StringType())
def canonical_amount(text: pd.Series) -> pd.Series:
    """Amounts written alike: short units, decimal points, grouped numbers in words, no leading zeros, no currency."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r"(tỷ|triệu|nghìn) (?:đồng|vnđ|vnd)", r"\1", t.lower().strip())
        t = re.sub(r"\b\d{1,3}(?:[.,]\d{3})+\b", _in_words, t)
        t = re.sub(r"(\d),(\d)", r"\1.\2", t)
        t = re.sub(r"\b0+(\d)", r"\1", re.sub(r"\b(?:vnd|vnđ|đồng)\b", "", t))
        return " ".join(t.split())

    return text.map(one)
