"""Queries of the fixed rule tables: topics, co-retrieval, situations, first tier, gates and idle conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import search_rules
from lexmill.operators import checks, classify, evaluation, search
from lexmill.plans.checks import DIALOGUE_SQL, ENTITIES, GOES_ON, TAXES
from lexmill.plans.common import table
from lexmill.streaming import ordered

c = F.col

#: What turns also say, and within which document they ask.
OPENINGS = [
    "Sàn TMĐT trừ lố tiền thuế", "Ủy quyền quyết toán thuế cho công ty", "Tiền chậm nộp 0,03% một ngày", "Ghi sổ kế toán S2A-HKD", "Mức phạt hóa đơn", "Đại lý thuế khai theo quý",
    "Lương và cửa hàng Shopee", "Nhân viên mở tiệm", "Giảm trừ gia cảnh theo luật 109", "Quán karaoke", "Đổi mới sáng tạo 198/2025", "Xin chào",
]
FILTERS = [None, "125_2020_NDCP", "310_2025_NDCP", "68_2026_NDCP", "117_2025_NDCP", "126_2020_NDCP", "111_2013_TTBTC"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations behind an opening, asked within a document."""
    t = table(spark, sf_dir, "conversations")
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((c("conv_id") + c("turn")) % len(OPENINGS) + 1).cast("int"))
    within = F.element_at(F.array(*map(F.lit, FILTERS)), (c("conv_id") % len(FILTERS) + 1).cast("int"))
    return t.select((c("conv_id") * 1000 + c("turn")).alias("query_id"), F.concat(opening, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"), within.alias("doc_filter"), (c("conv_id") % 4).alias("quarter"))


def _quoted(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


ASKED_SQL = f"""
q AS (SELECT conv_id * 1000 + turn AS query_id, {_quoted(OPENINGS)}[CAST((conv_id + turn) % {len(OPENINGS)} + 1 AS INTEGER)] || '. ' || coalesce(text, '') AS text,
  {_quoted(FILTERS)}[CAST(conv_id % {len(FILTERS)} + 1 AS INTEGER)] AS doc_filter, conv_id % 4 AS quarter FROM conversations)"""


def _any_sql(words: list[str], text: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def topic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the real topics add to each question."""
    rows = spark.createDataFrame(search_rules.topic_rows(), "rule string, keyword string, doc_id string").coalesce(1)
    return search.triggered(_asked(spark, sf_dir), rows)


TOPIC_RULES_SQL = (
    f"WITH {ASKED_SQL} SELECT DISTINCT query_id, rule, doc_id FROM q JOIN (VALUES " + ", ".join(str(r) for r in search_rules.topic_rows()) + ") r(rule, keyword, doc_id) ON contains(lower(text), keyword)"
)


def co_retrieval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-searches that the real co-retrieval rules ask for, where a quarter of the questions has found decree 68 already."""
    have = F.when(c("quarter") == 0, F.array(F.lit("68_2026_NDCP"))).otherwise(F.array().cast("array<string>"))
    rows = spark.createDataFrame(search_rules.CO_RULES, search_rules.CO_SCHEMA).coalesce(1)
    return search.co_retrieve(_asked(spark, sf_dir).withColumn("found_docs", have), rows).select("query_id", "target", "k", "place", "turn")


def _co_sql(rule: tuple) -> str:
    when, words, target, k, place, turn = rule
    fits = "doc_filter IS NULL" if when is None else f"doc_filter = '{when}'"
    said = _any_sql(words) if words else "true"
    return f"SELECT query_id, '{target}' AS target, CAST({k} AS INTEGER) AS k, '{place}' AS place, CAST({turn} AS INTEGER) AS turn FROM q WHERE {fits} AND {said} AND NOT (quarter = 0 AND '{target}' = '68_2026_NDCP')"


CO_RULES_SQL = f"WITH {ASKED_SQL} " + " UNION ALL ".join(_co_sql(r) for r in search_rules.CO_RULES)


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question is searched: number of results, document, what is left out, and which searches give nothing."""
    q = _asked(spark, sf_dir)
    given = F.when(c("quarter") == 1, F.array(F.lit("92_2015_TTBTC")))
    terms = search.search_terms(c("text"), (c("query_id") % 17 - 2).cast("int"), c("doc_filter"), given)
    return q.select("query_id", terms.alias("t")).select("query_id", "t.top_k", "t.doc_filter", F.array_join("t.excluded", "|").alias("excluded"), "t.is_empty")


TERMS_SQL = f"""
WITH {ASKED_SQL}
SELECT query_id, CAST(greatest(1, least(10, query_id % 17 - 2)) AS INTEGER) AS top_k, doc_filter,
  concat_ws('|', CASE WHEN quarter = 1 THEN '92_2015_TTBTC' END, CASE WHEN doc_filter IS DISTINCT FROM '310_2025_NDCP' THEN '310_2025_NDCP' END) AS excluded,
  doc_filter IS NOT DISTINCT FROM '310_2025_NDCP' AND NOT {_any_sql(search_rules.PENALTY_WORDS)} AS is_empty FROM q"""


def question_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", classify.situations(c("text")).alias("s")).select("query_id", "s.*")


SITUATIONS_SQL = f"""
WITH {ASKED_SQL}
SELECT query_id, {_any_sql(search_rules.SALARY_WORDS)} AND {_any_sql(search_rules.BUSINESS_WORDS)} AS multi_income, {_any_sql(search_rules.ONLINE_WORDS)} AS online,
  {_any_sql(search_rules.PENALTY_WORDS)} AS penalty, {_any_sql(search_rules.ACCOUNTING_WORDS)} AS accounting, {_any_sql(search_rules.LATE_WORDS)} AS late_payment FROM q"""


def tier1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calculations: answers that state their price or another amount, with expected values, texts or neither, and tools or none."""
    k, cents = c("o_orderkey"), F.bround(c("o_totalprice")).cast("long")
    said = F.when(k % 3 == 0, cents).otherwise(cents * 2 + 50_000)
    answer = F.concat(F.lit("Phải nộp "), said.cast("string"), F.lit(" đồng, thuế suất "), (k % 5).cast("string"), F.lit(",5%"), F.when(k % 7 == 0, ", miễn thuế").otherwise(""))
    values = F.when(k % 4 == 0, F.array(c("o_totalprice"), F.lit(0.5), c("o_totalprice") * 2 + 50_000))
    expected = F.when(k % 4 == 1, F.concat(F.lit("Thuế suất 1,5% và 2,5%"), F.when(k % 8 == 1, "; miễn thuế").otherwise("")))
    used = F.when(k % 2 == 0, F.array(F.lit("calculate_tax_hkd"))).when(k % 5 == 0, F.array(F.lit("evaluate_tax_obligation"), F.lit("search_legal_docs"))).otherwise(F.array(F.lit("search_legal_docs")))
    judged = evaluation.tier1(k % 11 != 0, values, expected, used, F.array(cents), answer)
    return table(spark, sf_dir, "orders").select(k.alias("order_id"), judged.alias("t")).select("order_id", "t.score", "t.compliance")


TIER1_SQL = """
WITH o AS (SELECT o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS BIGINT) AS cents, o_totalprice AS p FROM orders),
a AS (SELECT *, CASE WHEN k % 3 = 0 THEN cents ELSE cents * 2 + 50000 END AS said, (k % 2 = 0 OR k % 5 = 0) AS calc, k % 5 IN (1, 2) AS half,
  [x FOR x IN [CAST(round_even(p, 0) AS BIGINT), CAST(round_even(p * 2 + 50000, 0) AS BIGINT)] IF x > 10000] AS w FROM o),
n AS (SELECT *, list_sum([CASE WHEN (said > 10000 AND (abs(said - x) / greatest(abs(x), 1) <= 0.01 OR (round_even(x / 1e6, 0) > 0 AND abs(said - round_even(x / 1e6, 0)) / greatest(abs(round_even(x / 1e6, 0)), 1) <= 0.01))) THEN 1.0 ELSE 0.0 END FOR x IN w]) / len(w) AS share,
  said > 10000 AND abs(said - cents) / greatest(abs(cents), 1) <= 0.01 AS met,
  (CASE WHEN half THEN 1.0 ELSE 0.0 END + CASE WHEN k % 8 = 1 AND k % 7 = 0 THEN 1.0 ELSE 0.0 END) / CASE WHEN k % 8 = 1 THEN 3 ELSE 2 END AS tokens FROM a)
SELECT k AS order_id, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN CASE WHEN share >= 0.8 THEN 1.0 WHEN share >= 0.5 THEN 0.5 ELSE 0.2 END
  WHEN k % 4 = 1 THEN CASE WHEN tokens >= 0.6 THEN 1.0 WHEN tokens >= 0.3 THEN 0.5 ELSE 0.2 END WHEN NOT calc THEN 0.0 WHEN met THEN 1.0 ELSE 0.5 END::DOUBLE AS score,
  CASE WHEN k % 11 = 0 THEN NULL WHEN calc THEN 'compliant' WHEN k % 4 IN (0, 1) THEN 'tool_skipped' ELSE 'no_tool' END AS compliance FROM n"""


def fact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as wanted facts of their order, rates among them; found are those not returned. By line status, whether the facts found suffice."""
    li = table(spark, sf_dir, "lineitem")
    fact = F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("mức "), c("l_linenumber").cast("string"), F.lit(" %"))).otherwise(F.concat(F.lit("dòng "), c("l_linenumber").cast("string")))
    facts = li.select(c("l_orderkey").alias("case_id"), fact.alias("fact"), "l_returnflag", "l_linestatus")
    found = facts.where("l_returnflag <> 'R'").select("case_id", F.upper("fact").alias("value"))
    wanted = facts.select("case_id", "fact")
    topic = facts.groupBy("case_id").agg(F.min("l_linestatus").alias("topic"))
    cases = checks.fact_recall(found, wanted).join(checks.critical_misses(found, wanted), "case_id").join(topic, "case_id")
    gate = checks.recall_gate(cases, "topic")
    return gate.select("topic", "n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("critical_rate", 6).alias("critical_rate"), "good", "fair", "bad", "passes")


GATE_SQL = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS h, min(l_linestatus) AS m FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, avg(h) AS recall, 1.0 AS precision, count_if(h = 0 AND n % 2 = 0) AS missed, min(m) AS topic FROM l GROUP BY 1)
SELECT topic, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6)::DOUBLE AS precision, round(count_if(missed > 0) / count(*), 6) AS critical_rate, count_if(recall >= 0.75) AS good,
  count_if(recall >= 0.5 AND recall < 0.75) AS fair, count_if(recall < 0.5) AS bad, avg(recall) >= 0.75 AND count_if(missed > 0) / count(*) < 0.1 AS passes FROM r GROUP BY 1"""


def chunk_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of three types: counts by type, sizes, references."""
    kind = F.element_at(F.array(F.lit("dieu"), F.lit("khoan"), F.lit("diem"), F.lit("bang")), (c("doc_id") % 4 + 1).cast("int"))
    return evaluation.type_stats(table(spark, sf_dir, "documents").select(kind.alias("chunk_type"), F.length("text").alias("chars"), (c("doc_id") % 3).alias("n_refs")))


TYPES_SQL = """SELECT count(*) AS total, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, round(avg(length(text)), 1) AS avg_chars,
round(avg(length(text) // 3), 1) AS avg_tokens, count_if(doc_id % 3 > 0) AS with_references, count_if(doc_id % 4 = 0) AS n_dieu, count_if(doc_id % 4 = 1) AS n_khoan, count_if(doc_id % 4 = 2) AS n_diem FROM documents"""


def degrade_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fact checks of a draft: what follows, and how much of the answer goes out."""
    issue = F.struct(c("l_linestatus").alias("key_fact"), F.when(c("l_returnflag") == "R", "critical").otherwise("warning").alias("severity"))
    passed = F.when(c("l_linenumber") == 7, F.lit(None).cast("boolean")).otherwise(c("l_returnflag") == "N")
    after = checks.after_fact_check(passed, F.array(issue), c("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", after.alias("a")).select("l_orderkey", "l_linenumber", "a.next", "a.degrade_level")


DEGRADE_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 AND l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'GENERATOR' ELSE 'DONE' END AS next,
  CAST(CASE WHEN l_linenumber = 7 THEN 3 WHEN l_returnflag <> 'R' THEN 1 WHEN l_linenumber % 2 = 0 THEN NULL ELSE 2 END AS INTEGER) AS degrade_level FROM lineitem"""


def dialogue_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker over turns an hour and some minutes, or less, apart; idle conversations are forgotten (the stream's batch form)."""
    t = table(spark, sf_dir, "conversations")
    minutes = c("turn") * 40 + ((c("conv_id") + c("turn")) % 3) * 15
    timed = t.withColumn("ts", F.timestamp_seconds(F.lit(1_767_225_600) + minutes * 60))
    return ordered.dialogue_sessions(timed, entities=ENTITIES, taxes=TAXES, goes_on=GOES_ON)


_SESSIONS = """
s0 AS (SELECT *, turn * 40 + ((conv_id + turn) % 3) * 15 AS due FROM t),
s1 AS (SELECT *, CASE WHEN due - lag(due) OVER (PARTITION BY conv_id ORDER BY due, turn) > 60 THEN 1 ELSE 0 END AS rests FROM s0),
s AS (SELECT * REPLACE (conv_id || '_' || sum(rests) OVER (PARTITION BY conv_id ORDER BY due, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS conv_id), conv_id AS conv FROM s1),"""
IDLE_SQL = (
    DIALOGUE_SQL.replace("\nw AS (", _SESSIONS + "\nw AS (").replace("FROM t WINDOW", "FROM s WINDOW").replace("SELECT conv_id, turn, last_value(e IGNORE NULLS) OVER o", "SELECT conv AS conv_id, turn, last_value(e IGNORE NULLS) OVER o").replace("ORDER BY turn", "ORDER BY due, turn")
)

SQL = {
    "topic_rules": TOPIC_RULES_SQL,
    "co_retrieval_rules": CO_RULES_SQL,
    "search_terms": TERMS_SQL,
    "question_situations": SITUATIONS_SQL,
    "tier1_answers": TIER1_SQL,
    "fact_gate": GATE_SQL,
    "chunk_type_stats": TYPES_SQL,
    "degrade_levels": DEGRADE_SQL,
    "dialogue_idle": IDLE_SQL,
}
QUERIES = [topic_rules, co_retrieval_rules, search_terms, question_situations, tier1_answers, fact_gate, chunk_type_stats, degrade_levels, dialogue_idle]
