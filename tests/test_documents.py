"""SQL functions against the column functions, and nested documents there and back."""

import json

from pyspark.sql import functions as F

from lexmill.functions import numbers
from lexmill.functions.sql import FUNCTIONS, register_sql
from lexmill.operators import analytics, nested

TEXTS = ["1.200.000 đồng", "1,5 tỷ", "30 triệu", "12%", "7,5 %", "ngày 1 tháng 2 năm 2026", "31/12/2025", "2025-3-4", "30/2/2025", "không", "", None, "15k", "1.5 million", "3 nghìn VND"]


def test_sql_functions_say_what_columns_say(spark):
    register_sql(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for name, f in (("parse_number", numbers.parse_number), ("parse_percent", numbers.parse_percent), ("parse_currency", numbers.parse_currency), ("parse_legal_date", numbers.parse_date)):
        for r in df.select("t", F.expr(f"{name}(t)").alias("a"), f(F.col("t")).alias("b")).collect():
            assert r.a == r.b, (name, r)
    amounts = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.2e8, 3.7e8, 9e8, 5e9)], "x double")
    for r in amounts.select(F.expr("progressive_tax(x)").alias("a"), analytics.progressive_tax(F.col("x")).alias("b"), F.expr("format_currency(x)").alias("c"), numbers.format_currency(F.col("x")).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
    assert len(FUNCTIONS) >= 8
    plan = df.selectExpr("parse_currency(t)", "parse_legal_date(t)", "vat_rate(t)")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "regexp_extract" in plan  # the bodies stand in the plan


def test_nested_round_trip(spark):
    heads = spark.createDataFrame([("d", "Title", "2020-01-01"), ("bare", None, None)], "doc_id string, title string, f string").select("doc_id", "title", F.to_date("f").alias("issued_date"), F.to_date("f").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    rows = [
        ("d", "2", None, None, 2, "Second", "text", None, ["x"]), ("d", "1", None, None, 1, 'First "q"', "line\nbreak é", "2024-02-29", []),
        ("d", "1", "2", None, 2, None, "c2", None, None), ("d", "1", "1", None, 1, None, "c1", None, None), ("d", "1", "1", "b", 2, None, "pb", None, None), ("d", "1", "1", "a", 1, None, "pa", None, None),
    ]
    nodes = spark.createDataFrame(rows, "doc_id string, article string, clause string, point string, place int, title string, content string, f string, supersedes array<string>").withColumn("effective_date", F.to_date("f")).drop("f")
    whole = nested.rebuild(heads, nodes)
    texts = {r.doc_id: r.t for r in whole.select("doc_id", nested.to_text(F.col("document")).alias("t")).collect()}
    made = json.loads(texts["d"])
    assert [a["number"] for a in made["articles"]] == ["1", "2"] and made["articles"][0]["effective_date"] == "2024-02-29" and "effective_to" not in made
    assert [p["content"] for p in made["articles"][0]["clauses"][0]["points"]] == ["pa", "pb"] and json.loads(texts["bare"])["articles"] == []
    read = whole.select("doc_id", nested.from_text(nested.to_text(F.col("document"))).alias("document"))
    assert sorted(map(str, read.collect())) == sorted(map(str, whole.collect()))
    flat = [(r.article, r.clause, r.point, r.title, r.content) for r in nested.flatten(read).orderBy("place").collect()]
    assert flat == [("1", None, None, 'First "q"', "line\nbreak é"), ("1", "1", None, None, "c1"), ("1", "1", "a", None, "pa"), ("1", "1", "b", None, "pb"), ("1", "2", None, None, "c2"), ("2", None, None, "Second", "text")]
    bad = spark.createDataFrame([('{"doc_id": 1, "issued_date": "soon"}',), ("no json",)], "t string").select(nested.from_text(F.col("t")).alias("d")).collect()
    assert bad[0].d.issued_date is None
