"""Queries of the calculators, of validity, and of text and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import numbers, rules, text
from lexmill.operators import analytics
from lexmill.plans.common import MANIFEST_SQL, MISSING, REVENUE_SQL, case_sql, manifest, revenues, table


def tax_hkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revenues(spark, sf_dir).withColumn("t", analytics.household_tax(F.col("revenue"), F.col("category")))
    return r.select("c_custkey", "revenue", "category", "t.exempt", "t.gtgt_payable", "t.tncn_payable", "t.total_tax", "t.must_use_profit")


TAX_HKD_SQL = f"""
WITH {REVENUE_SQL},
t AS (SELECT *, revenue * {case_sql("category", rules.VAT_RATES)} AS v, CASE WHEN revenue <= 5e8 THEN 0.0 ELSE revenue * {case_sql("category", rules.PIT_RATES)} END AS p FROM r)
SELECT c_custkey, revenue, category, revenue <= 5e8 AS exempt, CAST(round_even(v, 0) AS BIGINT) AS gtgt_payable, CAST(round_even(p, 0) AS BIGINT) AS tncn_payable,
  CAST(round_even(v + p, 0) AS BIGINT) AS total_tax, revenue > 3e9 AS must_use_profit FROM t"""


def profit_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.with_profit_rate(revenues(spark, sf_dir)).select("c_custkey", "profit_rate")


RATE_SQL = "CASE WHEN revenue <= 5e8 THEN 0.0 WHEN revenue <= 3e9 THEN 0.15 WHEN revenue <= 5e10 THEN 0.17 ELSE 0.20 END"
PROFIT_BRACKET_SQL = f"WITH {REVENUE_SQL} SELECT c_custkey, CAST({RATE_SQL} AS DOUBLE) AS profit_rate FROM r"


def tax_hkd_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expenses are 60 to 104 percent of revenue, so some are refused."""
    r = analytics.with_profit_rate(revenues(spark, sf_dir)).withColumn("expenses", F.floor(F.col("revenue") * (60 + F.col("c_custkey") % 45) / 100).cast("double"))
    t = r.withColumn("t", analytics.profit_tax(F.col("revenue"), F.col("expenses"), F.col("category"), F.col("profit_rate")))
    return t.select("c_custkey", "t.profit", "t.margin", "t.gtgt_payable", "t.tncn_payable", "t.total_tax", "t.error")


TAX_PROFIT_SQL = f"""
WITH {REVENUE_SQL},
e AS (SELECT *, floor(revenue * (60 + c_custkey % 45) / 100) AS expenses FROM r),
t AS (SELECT *, CASE WHEN revenue <= 5e8 THEN 'revenue is exempt' WHEN expenses < 0 THEN 'negative expenses' WHEN expenses >= revenue THEN 'expenses reach revenue' END AS error,
  CAST(round_even(revenue * {case_sql("category", rules.VAT_RATES)}, 0) AS BIGINT) AS v, CAST(round_even((revenue - expenses) * {RATE_SQL}, 0) AS BIGINT) AS p FROM e)
SELECT c_custkey, CASE WHEN error IS NULL THEN revenue - expenses END AS profit, CASE WHEN error IS NULL THEN round_even((revenue - expenses) / revenue, 4) END AS margin,
  CASE WHEN error IS NULL THEN v END AS gtgt_payable, CASE WHEN error IS NULL THEN p END AS tncn_payable, CASE WHEN error IS NULL THEN v + p END AS total_tax, error FROM t"""


def tncn_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revenues(spark, sf_dir).withColumn("tax", analytics.progressive_tax(F.col("revenue")))
    return r.select("c_custkey", F.round("tax", 2).alias("tax"), F.bround(F.col("tax") / F.col("revenue"), 4).alias("effective_rate"))


INCOME_SQL = " + ".join(f"greatest(least(revenue, {'revenue' if hi is None else hi}) - {lo}, 0) * {rate}" for lo, hi, rate in rules.INCOME_BRACKETS)
PROGRESSIVE_SQL = f"WITH {REVENUE_SQL}, t AS (SELECT c_custkey, revenue, {INCOME_SQL} AS tax FROM r) SELECT c_custkey, round(tax, 2) AS tax, round_even(tax / revenue, 4) AS effective_rate FROM t"


def tncn_progressive_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revenues(spark, sf_dir).select("c_custkey", F.col("revenue").alias("income"))
    return analytics.progressive_slices(r).select("c_custkey", "bracket", F.round("slice", 2).alias("slice"), F.round("slice_tax", 2).alias("slice_tax"))


BRACKETS_SQL = (
    f"WITH {REVENUE_SQL}, b(bracket, lo, hi, rate) AS (VALUES "
    + ", ".join(f"({i}, {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {rate}::DOUBLE)" for i, (lo, hi, rate) in enumerate(rules.INCOME_BRACKETS, 1))
    + ") SELECT c_custkey, bracket, round(least(revenue, coalesce(hi, revenue)) - lo, 2) AS slice, round((least(revenue, coalesce(hi, revenue)) - lo) * rate, 2) AS slice_tax FROM r JOIN b ON revenue > lo"
)


def deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", analytics.deduction(k % 5, k % 14).alias("d")).select("c_custkey", "d.*")


DEDUCTION_SQL = """
WITH t AS (SELECT c_custkey, c_custkey % 5 AS n, c_custkey % 14 AS m FROM customer), e AS (SELECT *, CASE WHEN m NOT BETWEEN 1 AND 12 THEN 'months out of range' END AS error FROM t)
SELECT c_custkey, CASE WHEN error IS NULL THEN 15500000 + 6200000 * n END AS monthly, CASE WHEN error IS NULL THEN (15500000 + 6200000 * n) * m END AS annual,
  CASE WHEN error IS NULL THEN (11000000 + 4400000 * n) * m END AS old_annual, CASE WHEN error IS NULL THEN (4500000 + 1800000 * n) * m END AS gain, error FROM e"""


def tax_obligation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = revenues(spark, sf_dir).withColumn("o", analytics.obligation(F.col("revenue"), k % 2 == 0, k % 3 == 0))
    return r.select("c_custkey", "o.is_exempt", "o.tax_method", "o.profit_rate", "o.filing", "o.einvoice", "o.withholding", F.array_join("o.obligations", ",").alias("obligations"))


OBLIGATION_SQL = f"""
WITH {REVENUE_SQL},
t AS (SELECT *, revenue <= 5e8 AS x, CASE WHEN revenue <= 5e8 THEN 'none' WHEN revenue <= 3e9 THEN 'either' ELSE 'profit' END AS m,
  CASE WHEN revenue < 5e8 THEN 'false' WHEN revenue < 1e9 THEN 'optional' ELSE 'true' END AS e, c_custkey % 2 = 0 AS o, c_custkey % 3 = 0 AS p FROM r)
SELECT c_custkey, x AS is_exempt, m AS tax_method, CAST(CASE WHEN m = 'profit' THEN CASE WHEN revenue <= 5e10 THEN 0.17 ELSE 0.20 END END AS DOUBLE) AS profit_rate,
  CASE WHEN x THEN 'exempt' WHEN revenue <= 5e10 THEN 'quarterly' ELSE 'monthly' END AS filing, e AS einvoice, o AND p AS withholding,
  concat_ws(',', CASE WHEN x THEN 'exempt' END, CASE WHEN m = 'either' THEN 'choose_method' END, CASE WHEN m = 'profit' THEN 'profit_method' END, CASE WHEN NOT x THEN 'file_vat' END,
    CASE WHEN e = 'optional' THEN 'einvoice_optional' END, CASE WHEN e = 'true' THEN 'einvoice_required' END, CASE WHEN o AND p THEN 'platform_withholds' END, CASE WHEN o AND NOT p THEN 'declare_online_sales' END) AS obligations FROM t"""

ASKED = ["109_2025", "111_2013", "117_2025", "126_2020", "40_2021", "999_1999", "92_2015"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = F.array(*map(F.lit, ASKED))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(docs, (F.col("c_custkey") % len(ASKED)).cast("int")).alias("doc_id"))


def doc_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = spark.createDataFrame(MISSING, "doc_id string, name string, note string").coalesce(1)
    found = analytics.validity(_asked(spark, sf_dir), manifest(spark), missing, F.to_date(F.lit("2026-03-01")))
    return found.select("c_custkey", "doc_id", "found", "status", "is_currently_valid", "effective_from", "effective_to", "name", "note", "superseded_by")


VALIDITY_SQL = f"""
WITH a AS (SELECT c_custkey, {ASKED!r}[1 + c_custkey % {len(ASKED)}] AS doc_id FROM customer)
SELECT c_custkey, a.doc_id, m.doc_id IS NOT NULL AS found, coalesce(m.status, CASE WHEN a.doc_id = '40_2021' THEN 'not_in_database' END, 'unknown') AS status,
  coalesce(CASE m.status WHEN 'active' THEN true WHEN 'active_until_superseded' THEN m.t IS NULL OR DATE '2026-03-01' <= CAST(m.t AS DATE) ELSE false END, false) AS is_currently_valid,
  CAST(m.f AS DATE) AS effective_from, CAST(m.t AS DATE) AS effective_to, coalesce(m.name, CASE WHEN a.doc_id = '40_2021' THEN 'Circular G' END, a.doc_id) AS name,
  CASE WHEN a.doc_id = '40_2021' THEN 'Not in the corpus.' ELSE '' END AS note, m.superseded_by FROM a LEFT JOIN {MANIFEST_SQL} ON m.doc_id = a.doc_id"""


def law_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.law_section(manifest(spark))


LAW_SQL = f"""
WITH m AS (SELECT * FROM {MANIFEST_SQL})
SELECT CAST(CASE WHEN starts_with(m.status, 'active') THEN 1 ELSE 2 END AS INTEGER) AS section, m.doc_id,
  CASE WHEN starts_with(m.status, 'active') THEN m.doc_number || ' (' || m.name || ')' ELSE m.doc_number || ' → ' || coalesce(s.doc_number, m.superseded_by, '?') END AS line
FROM m LEFT JOIN m s ON s.doc_id = m.superseded_by"""


def pending_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    answers = table(spark, sf_dir, "orders").select(k.alias("answer_id"), F.concat(F.lit("Theo Luật "), (k % 3 + 108).cast("string"), F.lit("/2025/QH15, mức thuế là 5%.")).alias("answer"))
    return analytics.pending_citations(answers, manifest(spark))


PENDING_SQL = "SELECT o_orderkey AS answer_id, '109_2025' AS doc_id FROM orders WHERE o_orderkey % 3 = 1"


def effective_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders in force on a day, the one that wins a conflict."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).cast("int").alias("legal_level"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("effective_from"), F.date_add(F.to_date("o_orderdate"), 900).alias("effective_to"))
    return analytics.resolve_conflict(analytics.effective_on(o, F.to_date(F.lit("1998-06-01"))), "o_custkey")


EFFECTIVE_SQL = """
SELECT o_custkey, arg_min(o_orderkey, (o_orderkey % 4) * 1000000000 + o_orderkey) AS winner FROM orders
WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-01' AND CAST(o_orderdate AS DATE) + 900 >= DATE '1998-06-01' GROUP BY 1"""


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 900 + 100).cast("string")
    s = F.when(k % 5 == 0, F.concat(n, F.lit(" triệu"))).when(k % 5 == 1, F.concat((k % 9).cast("string"), F.lit(","), (k % 7).cast("string"), F.lit(" tỷ"))).when(k % 5 == 2, F.concat(n, F.lit(".000.000"))).when(k % 5 == 3, F.concat(n, F.lit(" nghìn"))).otherwise(F.lit("không có"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.round(numbers.parse_number(F.col("s")), 2).alias("value"), F.round(numbers.parse_currency(F.concat("s", F.lit(" đồng"))), 2).alias("money"))


NUMBER_SQL = """
WITH t AS (SELECT o_orderkey, o_orderkey % 900 + 100 AS n, CAST(o_orderkey % 5 AS INTEGER) AS c FROM orders),
v AS (SELECT o_orderkey, CASE c WHEN 0 THEN n * 1e6 WHEN 1 THEN (o_orderkey % 9 + (o_orderkey % 7) / 10.0) * 1e9 WHEN 2 THEN n * 1e6 WHEN 3 THEN n * 1e3 END AS value FROM t)
SELECT o_orderkey, round(CAST(value AS DOUBLE), 2) AS value, round(CAST(value AS DOUBLE), 2) AS money FROM v"""


def percent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("thuế suất "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(","), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(" % trên doanh thu"))
    return li.select("l_orderkey", "l_linenumber", F.round(numbers.parse_percent(s), 6).alias("share"))


PERCENT_SQL = "SELECT l_orderkey, l_linenumber, round((round(l_discount * 100) + round(l_tax * 100) / 10) / 100, 6) AS share FROM lineitem"


def currency_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.format_currency(v).alias("long_form"), numbers.format_currency(F.floor(v / 1000) * 100_000, short=True).alias("short_form"))


CURRENCY_SQL = """
SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') || ' đồng' AS long_form,
  CASE WHEN v >= 1000000 THEN format('{:.1f}', v / 1000000) || ' triệu đồng' WHEN v >= 1000 THEN format('{:.1f}', v / 1000) || ' nghìn đồng' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) || ' đồng' END AS short_form
FROM (SELECT o_orderkey, o_totalprice, floor(floor(o_totalprice) / 1000) * 100000 AS v FROM orders)"""


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    s = F.when(k % 4 == 0, numbers.format_date(d)).when(k % 4 == 1, F.date_format(d, "d/M/yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("ngày 31 tháng 2 năm 2020"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_date(s).alias("day"))


DATE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"


def _accents() -> str:
    return f"translate(%s, '{text.ACCENTS}', '{text.BARE}')"


def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("digest"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug")).select("doc_id", F.length("slug").alias("n"), F.md5("slug").alias("digest"))


SLUG_SQL = f"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower({_accents() % "trim(regexp_replace(text, '\\s+', ' ', 'g'))"}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents)
SELECT doc_id, CAST(length(slug) AS INTEGER) AS n, md5(slug) AS digest FROM s"""


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("squeezed"), F.length(text.squeeze_lines(F.col("text"))).alias("line_chars"), F.md5(text.for_search(F.col("text"))).alias("searched"))


CLEAN_SQL = r"""
SELECT doc_id, md5(trim(translate(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '“”‘’', '""'''''))) AS squeezed,
  CAST(length(array_to_string(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), chr(10))) AS INTEGER) AS line_chars,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS searched FROM documents"""


def char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.round(text.char_jaccard(F.col("c_mktsegment"), F.col("n_name")), 6).alias("similarity"))


JACCARD_SQL = """
WITH t AS (SELECT c_custkey, list_distinct(string_split(lower(c_mktsegment), '')) AS a, list_distinct(string_split(lower(n_name), '')) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t"""


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    q = F.when(k % 3 == 0, F.concat(F.lit("Thuế suất năm "), (k % 15 + 2016).cast("string"))).when(k % 3 == 1, F.concat(F.lit("Quy định từ 01/07/"), (k % 10 + 2020).cast("string"))).otherwise(F.lit("Thuế hiện nay"))
    day = F.to_date(F.lit("2026-03-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.temporal_context(q, day).alias("context"), numbers.question_key(q, day).alias("key"))


CACHE_KEY_SQL = """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Thuế suất năm ' || (o_orderkey % 15 + 2016) WHEN 1 THEN 'Quy định từ 01/07/' || (o_orderkey % 10 + 2020) ELSE 'Thuế hiện nay' END AS q,
  CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 15 >= 4 THEN 'year:' || (o_orderkey % 15 + 2016) ELSE '' END WHEN 1 THEN 'date:' || (o_orderkey % 10 + 2020) ELSE 'year:2026' END AS context FROM orders)
SELECT o_orderkey, context, substr(sha256(lower(q) || '|' || context || '|'), 1, 32) AS key FROM t"""


QUERIES = [tax_hkd, profit_bracket, tax_hkd_profit, tncn_progressive, tncn_progressive_brackets, deduction, tax_obligation, doc_validity, law_section, pending_citations, effective_documents, number_parse, percent_parse, currency_format, date_parse, strip_accents, slugify, clean_text, char_jaccard, cache_key]
SQL = {
    "tax_hkd": TAX_HKD_SQL,
    "profit_bracket": PROFIT_BRACKET_SQL,
    "tax_hkd_profit": TAX_PROFIT_SQL,
    "tncn_progressive": PROGRESSIVE_SQL,
    "tncn_progressive_brackets": BRACKETS_SQL,
    "deduction": DEDUCTION_SQL,
    "tax_obligation": OBLIGATION_SQL,
    "doc_validity": VALIDITY_SQL,
    "law_section": LAW_SQL,
    "pending_citations": PENDING_SQL,
    "effective_documents": EFFECTIVE_SQL,
    "number_parse": NUMBER_SQL,
    "percent_parse": PERCENT_SQL,
    "currency_format": CURRENCY_SQL,
    "date_parse": DATE_SQL,
    "strip_accents": f"SELECT doc_id, md5({_accents() % 'text'}) AS digest FROM documents",
    "slugify": SLUG_SQL,
    "clean_text": CLEAN_SQL,
    "char_jaccard": JACCARD_SQL,
    "cache_key": CACHE_KEY_SQL,
}
