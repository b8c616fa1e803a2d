"""The parsers and calculators as SQL functions: their bodies are SQL, so Catalyst inlines them and no Python worker is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexmill.functions import rules


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in values.items()) + " END"


def _date(pattern: str, y: int, m: int, d: int) -> str:
    part = lambda i: f"regexp_extract(t, r'{pattern}', {i})"
    return f"try_to_date(nullif(concat_ws('-', nullif({part(y)}, ''), lpad({part(m)}, 2, '0'), lpad({part(d)}, 2, '0')), '00-00'), 'yyyy-MM-dd')"


def _brackets() -> str:
    return " + ".join(f"greatest(0D, {'income' if hi is None else f'least(income, {hi}D)'} - {lo}D) * {rate}D" for lo, hi, rate in rules.INCOME_BRACKETS)


#: Name to (parameters, type, body).  A body may call those before it.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "plain_number": ("t STRING", "STRING", r"regexp_replace(regexp_replace(trim(lower(t)), r'\.(?=\d{3})', ''), ',', '.')"),
    "number_unit": (
        "p STRING",
        "DOUBLE",
        "CASE WHEN contains(p, 'tỷ') OR contains(p, 'ty') OR contains(p, 'billion') THEN 1e9D WHEN contains(p, 'triệu') OR contains(p, 'trieu') OR contains(p, 'million') THEN 1e6D "
        "WHEN contains(p, 'nghìn') OR contains(p, 'ngàn') OR contains(p, 'ngan') OR contains(p, 'thousand') OR contains(p, 'k') THEN 1e3D ELSE 1D END",
    ),
    "parse_number": ("t STRING", "DOUBLE", r"try_cast(regexp_extract(plain_number(t), r'([\d.]+)', 1) AS DOUBLE) * number_unit(plain_number(t))"),
    "parse_percent": ("t STRING", "DOUBLE", r"try_cast(replace(regexp_extract(t, r'([\d,.]+)\s*%', 1), ',', '.') AS DOUBLE) / 100"),
    "parse_currency": ("t STRING", "DOUBLE", "parse_number(regexp_replace(t, '(?iu)(đồng|đ|VND)', ''))"),
    "parse_legal_date": (
        "t STRING",
        "DATE",
        "coalesce("
        + ", ".join((_date(r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", 3, 2, 1), _date(r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", 3, 2, 1), _date(r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})", 1, 2, 3)))
        + ")",
    ),
    "format_currency": ("amount DOUBLE", "STRING", "concat(replace(format_number(amount, 0), ',', '.'), ' đồng')"),
    "format_legal_date": ("d DATE", "STRING", "concat_ws(' ', 'ngày', day(d), 'tháng', month(d), 'năm', year(d))"),
    "progressive_tax": ("income DOUBLE", "DOUBLE", f"CASE WHEN income >= 0 THEN {_brackets()} END"),
    "deduction_total": ("dependents INT, months INT", "BIGINT", f"CASE WHEN dependents >= 0 AND months BETWEEN 1 AND 12 THEN CAST(({rules.SELF_DEDUCTION} + {rules.DEPENDENT_DEDUCTION} * dependents) * months AS BIGINT) END"),
    "vat_rate": ("category STRING", "DOUBLE", _case("category", rules.VAT_RATES)),
    "pit_rate": ("category STRING", "DOUBLE", _case("category", rules.PIT_RATES)),
    "tax_method": ("revenue DOUBLE", "STRING", f"CASE WHEN revenue <= {rules.EXEMPT_UP_TO}D THEN 'none' WHEN revenue <= {rules.PROFIT_FROM}D THEN 'either' ELSE 'profit' END"),
}


def register_sql(spark: SparkSession) -> None:
    """Make the functions known to a session, in place of those of the same names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
