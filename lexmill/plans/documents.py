"""Queries of SQL functions and of nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.sql import register_sql
from lexmill.operators import nested
from lexmill.plans.common import table

c = F.col


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven SQL functions over texts and amounts made of the orders."""
    register_sql(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("lexmill_orders")
    return spark.sql("""
        WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 2000 AS INT) AS n, CAST(o_orderdate AS DATE) AS d FROM lexmill_orders)
        SELECT k, parse_number(concat('mức ', n, ',5 triệu')) AS millions, parse_percent(concat('thuế ', n, ',25 % nay')) AS share, parse_currency(concat(n, '.500 đồng')) AS amount,
               parse_legal_date(concat('ngày ', day(d), ' tháng ', month(d), ' năm ', year(d))) AS said, parse_legal_date(date_format(d, 'd/M/yyyy')) AS written,
               format_currency(n * 1e6D) AS shown, format_legal_date(d) AS dated, round(progressive_tax(n * 1e6D), 2) AS tax, deduction_total(n % 4 - 1, n % 14) AS deducted,
               vat_rate(element_at(array('goods', 'services', 'moon'), n % 3 + 1)) AS vat, pit_rate(element_at(array('goods', 'services', 'moon'), n % 3 + 1)) AS pit, tax_method(n * 2e6D) AS method
        FROM o""")


SQL_FUNCTIONS_SQL = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 2000 AS INTEGER) AS n, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, (n + 0.5) * 1e6::DOUBLE AS millions, (n + 0.25)::DOUBLE / 100 AS share, CASE WHEN n = 0 THEN 500 ELSE n * 1000 + 500 END::DOUBLE AS amount, d AS said, d AS written,
  replace(format('{:,}', n::BIGINT * 1000000), ',', '.') || ' đồng' AS shown, 'ngày ' || day(d) || ' tháng ' || month(d) || ' năm ' || year(d) AS dated,
  round((least(n, 120) * 0.05 + greatest(least(n, 360) - 120, 0) * 0.10 + greatest(least(n, 720) - 360, 0) * 0.20 + greatest(least(n, 1200) - 720, 0) * 0.30 + greatest(n - 1200, 0) * 0.35)::DOUBLE * 1e6, 2) AS tax,
  CASE WHEN n % 4 - 1 >= 0 AND n % 14 BETWEEN 1 AND 12 THEN (15500000 + 6200000 * (n % 4 - 1))::BIGINT * (n % 14) END AS deducted,
  CASE n % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.05 END::DOUBLE AS vat, CASE n % 3 WHEN 0 THEN 0.005 WHEN 1 THEN 0.02 END::DOUBLE AS pit,
  CASE WHEN n <= 250 THEN 'none' WHEN n <= 1500 THEN 'either' ELSE 'profit' END AS method FROM o"""


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as articles, lines as clauses, returned parts as points: nested, written, read and flattened again."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select(c("o_orderkey").alias("l_orderkey"), c("o_custkey")), "l_orderkey").groupBy("o_custkey", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    doc, art, none = c("o_custkey").cast("string").alias("doc_id"), c("l_orderkey").cast("string").alias("article"), F.lit(None).cast("string")
    blank = {"title": none, "effective_date": F.lit(None).cast("date"), "supersedes": F.lit(None).cast("array<string>")}
    articles = o.select(doc, c("o_orderkey").cast("string").alias("article"), none.alias("clause"), none.alias("point"), c("o_orderkey").alias("place"), F.concat(F.lit("Order \""), "o_orderkey", F.lit('"')).alias("title"), c("o_orderpriority").alias("content"), F.to_date("o_orderdate").alias("effective_date"), F.array("o_orderstatus").alias("supersedes"))
    clauses = li.select(doc, art, c("l_linenumber").cast("string").alias("clause"), none.alias("point"), c("l_linenumber").cast("long").alias("place"), F.concat(F.lit("Khoản\n"), "flag").alias("content")).withColumns(blank)
    points = li.where("flag = 'R'").select(doc, art, c("l_linenumber").cast("string").alias("clause"), F.lit("a").alias("point"), F.lit(0).cast("long").alias("place"), c("part").cast("string").alias("content")).withColumns(blank)
    heads = table(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("doc_id"), c("c_name").alias("title"), F.to_date(F.lit("2020-02-29")).alias("issued_date"), F.to_date(F.lit("2020-03-01")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    whole = nested.rebuild(heads, articles.unionByName(clauses).unionByName(points))
    read = whole.select("doc_id", nested.to_text(c("document")).alias("text")).select("doc_id", nested.from_text(c("text")).alias("document"))
    return nested.flatten(read).select("doc_id", "place", "article", "clause", "point", "title", "content", "effective_date", F.array_join("supersedes", "|").alias("supersedes"))


NESTED_SQL = """
WITH l AS (SELECT o_custkey, l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n AS (SELECT o_custkey AS d, o_orderkey AS a, 0 AS c, 0 AS p, 'Order "' || o_orderkey || '"' AS title, o_orderpriority AS content, CAST(o_orderdate AS DATE) AS effective_date, o_orderstatus AS supersedes FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, 0, NULL, 'Khoản' || chr(10) || flag, NULL, NULL FROM l JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, 1, NULL, CAST(part AS VARCHAR), NULL, NULL FROM l JOIN customer ON c_custkey = o_custkey WHERE flag = 'R')
SELECT CAST(d AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY a, c, p) - 1 AS INTEGER) AS place, CAST(a AS VARCHAR) AS article, CASE WHEN c > 0 THEN CAST(c AS VARCHAR) END AS clause, CASE WHEN p > 0 THEN 'a' END AS point, title, content, effective_date, supersedes FROM n"""

PAIRS = [(sql_functions, SQL_FUNCTIONS_SQL), (nested_documents, NESTED_SQL)]
QUERIES = [f for f, _ in PAIRS]
SQL = {f.__name__: s for f, s in PAIRS}
