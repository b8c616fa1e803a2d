"""Queries of answer judging whose inputs are made from columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import evaluation
from lexmill.plans.common import table

c = F.col
#: What turns say before their own text: refusals, and what is none.
SAYINGS = [
    "không đủ cơ sở", "không có thông tin", "chưa thể xác định", "không tìm thấy quy định", "không có căn cứ", "ngoài phạm vi",
    "chưa có quy định", "không thể trả lời", "không có căn cứ pháp lý", "không tìm thấy", "theo điều 5",
]


def false_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers that may decline: short and long ones, with and without facts, with the right and wrong documents."""
    t = table(spark, sf_dir, "conversations").where("text is not null")
    saying = F.element_at(F.array(*map(F.lit, SAYINGS)), ((c("conv_id") + c("turn")) % len(SAYINGS) + 1).cast("int"))
    answer = F.concat(F.lit(" "), F.upper(saying), F.lit(". "), "text", F.lit(" "))
    expected = F.when(c("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array((c("conv_id") % 3).cast("string")))
    tier4 = F.element_at(F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.5), F.lit(1.0)), (c("conv_id") % 4 + 1).cast("int"))
    return t.select("conv_id", "turn", evaluation.false_refusal(answer, expected, F.array((c("turn") % 3).cast("string"), F.lit("9")), tier4).alias("refused"))


_SAYINGS = "[" + ", ".join(f"'{x}'" for x in SAYINGS) + "]"
REFUSALS_SQL = f"""
WITH t AS (SELECT conv_id, turn, trim(lower(' ' || upper({_SAYINGS}[(conv_id + turn) % 11 + 1]) || '. ' || text || ' '), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS a FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, length(a) < 250 AND len(list_filter({_SAYINGS}[1:9], lambda x: contains(a, x))) > 0 AND conv_id % 7 <> 0 AND conv_id % 3 = turn % 3 AND conv_id % 4 IN (0, 1) AS refused FROM t"""


def fact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of orders as facts, and answers that give another order's amount in millions or billions, whole or with a fraction."""
    k = c("o_orderkey")
    value = ((k % 60 + 1) * 25_000_000).cast("long")
    fact = F.concat(F.regexp_replace(F.format_number(value, 0), ",", "."), F.element_at(F.array(F.lit(""), F.lit(" đồng"), F.lit(" VND")), (k % 3 + 1).cast("int")))
    said = ((k % 60 + k % 2 + 1) * 25_000_000).cast("long")
    whole = lambda unit, places: F.when(said % unit == 0, (said / unit).cast("long").cast("string")).otherwise(F.replace(F.format_string(f"%.{places}f", F.bround(said / unit, places)), F.lit("."), F.lit(",")))
    answer = F.when(k % 5 == 0, F.concat(F.lit("Khoảng "), whole(1_000_000_000, 1), F.lit(" Tỷ"))).when(k % 5 == 1, F.concat(whole(1_000_000, 2), F.lit(" triệu đồng"))).otherwise(F.concat(F.lit("mức "), F.format_number(said, 0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluation.fact_in_answer(fact, answer).alias("stated"))


_WHOLE = "CASE WHEN {v} % {u} = 0 THEN CAST({v} // {u} AS VARCHAR) ELSE replace(printf('%.{p}f', round_even({v} / {u}, {p})), '.', ',') END"
_BILLIONS, _MILLIONS = (lambda v: _WHOLE.format(v=v, u=1_000_000_000, p=1)), (lambda v: _WHOLE.format(v=v, u=1_000_000, p=2))
FACT_AMOUNTS_SQL = f"""
WITH o AS (SELECT o_orderkey, (o_orderkey % 60 + 1) * 25000000 AS v, (o_orderkey % 60 + o_orderkey % 2 + 1) * 25000000 AS w FROM orders),
a AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'khoảng ' || {_BILLIONS("w")} || ' tỷ' WHEN o_orderkey % 5 = 1 THEN {_MILLIONS("w")} || ' triệu đồng' ELSE 'mức ' || format('{{:,}}', w) END AS a FROM o)
SELECT o_orderkey, contains(a, {_MILLIONS("v")} || ' triệu') OR (v >= 1000000000 AND contains(a, {_BILLIONS("v")} || ' tỷ')) OR contains(a, format('{{:,}}', v))
       OR (o_orderkey % 3 = 0 AND contains(a, replace(format('{{:,}}', v), ',', '.'))) AS stated FROM a"""

PAIRS = [(false_refusals, REFUSALS_SQL), (fact_amounts, FACT_AMOUNTS_SQL)]
QUERIES = [f for f, _ in PAIRS]
SQL = {f.__name__: s for f, s in PAIRS}
