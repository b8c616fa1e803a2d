"""Carriers that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Business categories by market segment.
SEGMENTS = {"AUTOMOBILE": "manufacturing", "BUILDING": "real_estate", "FURNITURE": "goods", "HOUSEHOLD": "services", "MACHINERY": "other"}
#: A validity manifest: doc_id, number, name, from, to, status, successor.
MANIFEST = [
    ("109_2025", "109/2025/QH15", "Law A", "2026-07-01", None, "pending", None),
    ("111_2013", "111/2013/TT-BTC", "Circular B", "2013-10-01", "2026-06-30", "active_until_superseded", "109_2025"),
    ("117_2025", "117/2025/NĐ-CP", "Decree C", "2025-07-01", None, "active", None),
    ("125_2020", "125/2020/NĐ-CP", "Decree D", "2020-12-05", None, "active", None),
    ("126_2020", "126/2020/NĐ-CP", "Decree E", "2020-12-05", "2025-01-01", "superseded", "117_2025"),
    ("92_2015", "92/2015/TT-BTC", "Circular F", "2015-07-30", "2025-12-31", "active_until_superseded", "117_2025"),
]
MISSING = [("40_2021", "Circular G", "Not in the corpus.")]
MANIFEST_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in MANIFEST) + ") m(doc_id, doc_number, name, f, t, status, superseded_by)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*r, "") for r in MANIFEST], "doc_id string, doc_number string, name string, f string, t string, status string, superseded_by string, note string").coalesce(1)
    return rows.withColumns({"effective_from": F.to_date("f"), "effective_to": F.to_date("t"), "status_changed_date": F.lit(None).cast("date")})


def revenues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a revenue (a thousand times their orders) and a business category."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") * 1000).alias("revenue"))
    category = F.create_map(*[F.lit(x) for p in SEGMENTS.items() for x in p])
    return spent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "revenue", F.try_element_at(category, F.col("c_mktsegment")).alias("category"))


REVENUE_SQL = (
    "r AS (SELECT c_custkey, round(s * 1000) AS revenue, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
    + " END AS category FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey)"
)


def case_sql(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
