"""Tools by name, SQL functions and table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lexmill.functions import numbers, rules, text
from lexmill.operators import analytics, parse, search

#: Tools that take and give tables: name to (input columns, function of the columns).
TOOLS: dict[str, tuple[list[str], Callable]] = {
    "calculate_tax_hkd": (["annual_revenue", "business_category"], analytics.household_tax),
    "calculate_tax_hkd_profit": (["annual_revenue", "annual_expenses", "business_category", "profit_rate"], analytics.profit_tax),
    "calculate_tncn_progressive": (["annual_income"], analytics.progressive_tax),
    "calculate_deduction": (["dependents", "months"], analytics.deduction),
    "evaluate_tax_obligation": (["annual_revenue", "has_online_sales", "platform_has_payment"], analytics.obligation),
}


#: Tools that answer rows from tables: name to (input columns, function of the rows and named tables).
TABLE_TOOLS: dict[str, tuple[list[str], Callable]] = {
    "search_legal_docs": (["query_id", "text", "q"], lambda rows, chunks, registry, as_of, **more: search.search(rows, chunks, registry, as_of, **more)),
    "check_doc_validity": (["doc_id"], lambda rows, manifest, missing, as_of: analytics.validity(rows, manifest, missing, as_of)),
}


def run_tool(name: str, rows: DataFrame, **tables: object) -> DataFrame:
    """A tool over ``rows``: each with ``ok`` and ``error``, and with ``result`` or, for tools on tables, the columns found.

    An unknown name, a missing column or table is an error in every row; a tool
    whose own result says what is wrong gives that as the error.
    """
    failed = lambda message: rows.withColumns({"ok": F.lit(False), "error": F.lit(message)})
    if name not in TOOLS and name not in TABLE_TOOLS:
        return failed(f"unknown tool {name}")
    needs, f = TOOLS.get(name) or TABLE_TOOLS[name]
    lacking = [c for c in needs if c not in rows.columns]
    if lacking:
        return failed(f"missing {', '.join(lacking)}")
    if name in TABLE_TOOLS:
        try:
            found = f(rows, **tables)
        except TypeError as e:  # a table that the tool needs was not given
            return failed(str(e))
        return found.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    out = rows.withColumn("result", f(*map(F.col, needs)))
    said = F.col("result.error") if "error" in out.schema["result"].dataType.names else F.lit(None).cast("string")
    wrong = F.coalesce(said, F.when(F.col("result").isNull(), F.lit("no result")))
    return out.withColumns({"ok": wrong.isNull(), "error": wrong})


@udtf(returnType="bracket int, slice double, rate double, tax double")
class ProgressiveBrackets:
    """Brackets of a yearly income."""

    def eval(self, income: float) -> Iterator[tuple]:
        for i, (lo, hi, rate) in enumerate(rules.INCOME_BRACKETS, 1):
            if income is not None and income > lo:
                part = (income if hi is None else min(income, hi)) - lo
                yield i, part, rate, part * rate


@udtf(returnType="line_no int, kind string, number string, content string")
class DocumentLines:
    """Lines of a document with their kind and number, by the forms of headings."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, line in enumerate((text or "").split("\n")):
            for kind, pattern in LINE_PATTERNS:
                found = pattern.match(line.strip())
                if found:
                    yield i, kind, found.group(1) or "", found.group(2)
                    break
            else:
                yield i, "text", None, line


#: The forms of headings for use in Python; the flags that Java takes for Unicode are Python's default.
LINE_PATTERNS = [(kind, re.compile(pattern.replace("(?iu)", "(?i)"))) for kind, pattern in parse.LINE_FORMS]


@udtf(returnType="part int, body string")
class TableChunks:
    """A table's lines packed into parts of bounded length that repeat its head."""

    def eval(self, head: str, lines: list, chars: int) -> Iterator[tuple]:
        part, held = 0, ""
        for line in lines or []:
            if held and len(head) + 1 + len(held) + 1 + len(line) > chars:
                yield part, f"{head}\n{held}" if head else held
                part, held = part + 1, ""
            held = f"{held}\n{line}" if held else line
        if held:
            yield part, f"{head}\n{held}" if head else held


def register(spark: SparkSession) -> None:
    """Make the table function and SQL macros of the scalar functions known to a session."""
    spark.udtf.register("progressive_brackets", ProgressiveBrackets)
    spark.udtf.register("document_lines", DocumentLines)
    spark.udtf.register("table_chunks", TableChunks)
    spark.udf.register("nfc", text.nfc)
    spark.udf.register("fix_merged_words", text.fix_merged_words)


#: Functions of columns by name, for use from plans that are put together by name.
SCALARS: dict[str, Callable] = {
    "parse_number": numbers.parse_number,
    "parse_percent": numbers.parse_percent,
    "parse_currency": numbers.parse_currency,
    "parse_date": numbers.parse_date,
    "slugify": text.slugify,
    "strip_accents": text.strip_accents,
    "clean_document": text.clean_document,
}


def apply_plugin(rows: DataFrame, column: str, plugin: Callable | None, default: str = "") -> DataFrame:
    """The boundary of model-dependent steps: a user's function of the rows, or a constant without one."""
    return plugin(rows) if plugin else rows.withColumn(column, F.lit(default))
