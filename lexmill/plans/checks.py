"""Queries of answer checks, evaluation and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import checks, evaluation
from lexmill.plans.common import manifest, table
from lexmill.streaming import state

#: Patterns of facts for the given conversations: plain numbers and words of eight and more letters.
PLAIN_FACTS = [(r"[0-9]+", "numeric"), (r"[a-z]{14,}", "citation")]
ENTITIES = {"HKD": ["thinble", "tionwh"], "CNKD": ["ereaha"], "enterprise": ["thand"], "individual": ["onst"]}
TAXES = {"TMDT": ["edsh"], "HKD_TAX": ["wher"], "Penalty": ["shthe"], "TNCN": ["ingre"], "GTGT": ["tionor"]}
GOES_ON = ["that the"]


def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return checks.key_facts(c, node_id="turn", text="text", seq="turn", families=PLAIN_FACTS, per=["conv_id"]).select("conv_id", "value", "fact_type", F.col("evidence_node").alias("turn"))


KEY_FACTS_SQL = """
WITH f AS (SELECT conv_id, turn, 0 AS family, 'numeric' AS fact_type, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS pos, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'citation', generate_subscripts(regexp_extract_all(text, '[a-z]{14,}'), 1), unnest(regexp_extract_all(text, '[a-z]{14,}')) FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(value) ORDER BY turn, family, pos) AS n FROM f)
SELECT conv_id, value, fact_type, turn FROM r WHERE n = 1"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as answers and as what was retrieved for them."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("q"))
    a = li.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("Doanh thu trên "), F.col("q") + 10, F.lit(" triệu được miễn thuế")).alias("answer"))
    t = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("doanh thu dưới "), F.col("q") + 10, F.lit(" triệu"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("mức "), F.col("q") + 60, F.lit(" triệu phải nộp"))).otherwise(F.concat(F.lit("vượt quá "), F.col("q") + 10, F.lit(" triệu miễn thuế")))
    return a, li.where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("answer_id"), t.alias("text"))


ANSWERS_SQL = "a AS (SELECT l_orderkey AS k, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"


def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_facts(*_answers(spark, sf_dir))


FACT_SQL = f"""
WITH {ANSWERS_SQL},
m AS (SELECT k, q + 10 AS n, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 3 AS INTEGER) END AS c FROM a)
SELECT k AS answer_id, CAST(CASE WHEN c IS NULL THEN 0 ELSE 1 END AS INTEGER) AS numeric_checked, CAST(CASE WHEN c IN (0, 2) THEN 1 ELSE 0 END AS INTEGER) AS numeric_matched,
  CAST(CASE WHEN c = 0 THEN 1 ELSE 0 END AS INTEGER) AS flips, CAST(CASE WHEN c = 1 THEN 1 ELSE 0 END AS INTEGER) AS polarity, CASE WHEN c IN (0, 1) THEN 'fail' ELSE 'ok' END AS level FROM m"""


def numeric_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.numeric_alignment(*_answers(spark, sf_dir))


ALIGN_SQL = f"WITH {ANSWERS_SQL} SELECT k AS answer_id, CAST(q + 10 AS VARCHAR) AS number FROM a WHERE k % 5 <> 0 AND k % 3 = 1"


def confidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    call = lambda tool, n: F.struct(F.lit(tool).alias("tool"), n.cast("int").alias("n_results"))
    none = F.slice(F.array(call("x", F.lit(0))), 1, 0)
    calls = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(call("search_legal_docs", k % 3))).when(k % 4 == 2, F.array(call("calculate_tax_hkd", k % 3))).otherwise(F.array(call("search_legal_docs", F.lit(1)), call("other", F.lit(1))))
    answer = F.when(k % 7 < 4, "theo Điều 5").otherwise("có thể")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.confidence_level(calls, answer).alias("level"))


CONFIDENCE_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 > 0 THEN 'ok' WHEN o_orderkey % 4 IN (0, 2) THEN 'no_search' WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 'no_results'
  WHEN o_orderkey % 7 < 4 THEN 'ok' ELSE 'no_citation' END AS level FROM orders"""


def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = lambda c: li.select(F.col("l_orderkey").alias("answer_id"), F.col(c).alias("source"), (F.col("l_linenumber") * 10_000_000 + F.col(c)).alias("seq"))
    return checks.dedup_sources([part("l_suppkey"), part("l_partkey")], ["source"])


DEDUP_SQL = """
WITH u AS (SELECT l_orderkey AS answer_id, l_suppkey AS source, l_linenumber * 10000000 + l_suppkey AS seq, 0 AS kind FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber * 10000000 + l_partkey, 1 FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id, source ORDER BY kind, seq) AS n FROM u)
SELECT answer_id, source, seq, CAST(kind AS INTEGER) AS kind FROM r WHERE n = 1"""


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("rank"), F.length("text").alias("length"))
    return checks.context_budget(d).select("query_id", "chunk_id", "position", "used")


BUDGET_SQL = """
WITH u AS (SELECT source AS query_id, doc_id AS chunk_id, CAST(row_number() OVER w AS INTEGER) AS position, CAST(sum(length(text)) OVER w AS BIGINT) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT * FROM u WHERE position <= 8 AND used <= 12000"""


def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    got = li.select(F.col("l_orderkey").alias("answer_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    cited = li.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.min("l_suppkey").alias("m")).select("answer_id", F.when(F.col("answer_id") % 2 == 0, F.col("m")).otherwise(F.lit(-1)).cast("long").alias("doc_id"), F.lit(1).alias("pos"))
    return checks.validate_citations(cited, got)


CITATION_SQL = """
WITH b AS (SELECT l_orderkey AS answer_id, l_suppkey AS doc_id, min(l_linenumber) AS rank FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2),
r AS (SELECT answer_id, doc_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY rank, doc_id) AS INTEGER) AS pos FROM b)
SELECT answer_id, doc_id, pos, true AS is_fallback FROM r WHERE pos <= 2
UNION ALL SELECT l_orderkey, min(l_suppkey), 1, false FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evaluated questions."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("question_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("difficulty"), (k % 2 == 0).alias("needs_calculation"),
        F.when(k % 3 == 0, None).otherwise((k % 5) / 4).alias("t1"), F.when(k % 11 == 0, None).otherwise((k % 9) / 8).alias("t2"), ((k % 7) / 6).alias("t4"), (k % 3 + 1).cast("int").alias("level"),
        F.floor("o_totalprice").cast("long").alias("latency_ms"), F.when(k % 13 == 0, "timeout").alias("error"),
    )
    scored = rows.withColumn("score", evaluation.overall_score(F.col("t1"), F.col("t2"), F.col("t4"), F.col("level")))
    return scored.withColumn("passed", evaluation.passed(F.col("score"), F.col("needs_calculation"), F.col("t1")))


RESULTS_SQL = """x AS (SELECT o_orderkey AS question_id, o_orderpriority AS topic, o_orderstatus AS difficulty, o_orderkey % 2 = 0 AS calc, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 5) / 4 END AS t1,
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 9) / 8 END AS t2, (o_orderkey % 7) / 6 AS t4, CASE o_orderkey % 3 + 1 WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.0 END::DOUBLE AS f,
CAST(floor(o_totalprice) AS BIGINT) AS latency_ms, o_orderkey % 13 = 0 AS bad FROM orders),
y AS (SELECT *, (coalesce(t1, 0) + coalesce(t2, 0) + t4) / (1 + CAST(t1 IS NOT NULL AS INTEGER) + CAST(t2 IS NOT NULL AS INTEGER)) * f AS score FROM x),
z AS (SELECT *, coalesce(score >= 0.667 AND NOT (calc AND t1 = 0), score >= 0.667 AND NOT calc, false) AS passed FROM y)"""


def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("question_id", F.round("score", 6).alias("score"))


OVERALL_SQL = f"WITH {RESULTS_SQL} SELECT question_id, round(score, 6) AS score FROM z"


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.element_at(F.array(*map(F.lit, ["compliant", "tool_skipped", "no_tool", "compliant"])), (F.col("question_id") % 4 + 1).cast("int"))
    return evaluation.report(_results(spark, sf_dir).withColumns({"passed": F.col("score") >= 0.667, "tool_compliance": told}))


def failed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failed_questions(_results(spark, sf_dir)).select("question_id", F.round("score", 6).alias("score"), "error")


FAILED_SQL = f"WITH {RESULTS_SQL} SELECT question_id, round(score, 6) AS score, CASE WHEN bad THEN 'timeout' END AS error FROM z WHERE NOT passed ORDER BY question_id LIMIT 20"


REPORT_SQL = f"""
WITH {RESULTS_SQL}
SELECT topic, difficulty, count(*) AS n, CAST(sum(CASE WHEN score >= 0.667 THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, round(avg(score), 6) AS avg_score, round(avg(t1), 6) AS avg_t1, round(avg(t2), 6) AS avg_t2, round(avg(t4), 6) AS avg_t4,
  count_if(bad) AS n_errors, count(t1) AS n_t1, count(t2) AS n_t2, count(t4) AS n_t4,
  count_if(t1 IS NOT NULL AND question_id % 4 IN (0, 3)) AS n_compliant, count_if(t1 IS NOT NULL AND question_id % 4 = 1) AS n_tool_skipped, count_if(t1 IS NOT NULL AND question_id % 4 = 2) AS n_no_tool,
  round(count_if(t1 IS NOT NULL AND question_id % 4 IN (0, 3)) / nullif(count(t1), 0), 3) AS compliance_rate,
  min(CASE WHEN NOT bad THEN latency_ms END) AS min_ms, max(CASE WHEN NOT bad THEN latency_ms END) AS max_ms, CAST(round_even(avg(CASE WHEN NOT bad THEN latency_ms END), 0) AS BIGINT) AS avg_ms,
  CAST(round_even(quantile_cont(CASE WHEN NOT bad THEN latency_ms END, 0.5), 0) AS BIGINT) AS p50_ms, CAST(round_even(quantile_cont(CASE WHEN NOT bad THEN latency_ms END, 0.95), 0) AS BIGINT) AS p95_ms
FROM z GROUP BY GROUPING SETS ((), (topic), (difficulty))"""


def tier2_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("e"), F.collect_list(F.when(F.col("l_linenumber") != 2, F.col("l_suppkey"))).alias("c"), F.collect_list(F.col("l_partkey") % 10).alias("x"))
    return li.select("l_orderkey", evaluation.tier2_citations(F.col("e"), F.concat("c", "x")).alias("t2"))


TIER2_SQL = """
WITH t AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS e, list_distinct(list_concat(coalesce(list(l_suppkey) FILTER (l_linenumber <> 2), []), list(l_partkey % 10))) AS c FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, len(e) AS ne, len(c) AS nc, len(list_intersect(e, c)) AS m FROM t)
SELECT l_orderkey, round(m / ne * least(1.0, m / nc / 0.5), 3) AS t2 FROM m"""


def failure_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda *xs: F.array(*[x.cast("long") for x in xs])
    kind = evaluation.failure_class(s(k % 10, k % 10 + 1), s(k % 4, k % 4 + 1, k % 4 + 2), s(k % 3), F.array(*[F.lit(i).cast("long") for i in range(9)]), (k % 3) / 2, (k % 5) / 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("failure"))


FAILURE_SQL = """
WITH t AS (SELECT o_orderkey AS k, [o_orderkey % 10, o_orderkey % 10 + 1] AS e, [o_orderkey % 4, o_orderkey % 4 + 1, o_orderkey % 4 + 2] AS r FROM orders),
m AS (SELECT k, e, len(list_filter(e, lambda x: x > 8)) AS absent, len(list_filter(e, lambda x: NOT list_contains(r, x))) AS missed FROM t)
SELECT k AS o_orderkey, CASE WHEN absent = 2 THEN 'corpus_gap' WHEN missed = 2 THEN 'routing' WHEN missed > 0 THEN 'partial' WHEN (k % 3) / 2 >= 0.5 AND (k % 5) / 4 < 0.5 THEN 'annotation'
  WHEN NOT list_contains(e, k % 3) THEN 'citation' ELSE 'hard' END AS failure FROM m"""


def merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), "o_totalprice")
    return evaluation.merge_batches([o.where("question_id % 2 = 0").withColumn("batch", F.lit("a")), o.where("question_id % 3 = 0").withColumn("batch", F.lit("b")), o.withColumn("batch", F.lit("c"))])


MERGE_SQL = "SELECT o_orderkey AS question_id, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'a' WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'c' END AS batch FROM orders"


def failure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shares(failure_classify(spark, sf_dir), "failure")


SHARES_SQL = f"SELECT failure, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2)::DOUBLE AS percent FROM ({FAILURE_SQL}) GROUP BY 1"


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.col("embedding").alias("q"))
    cache = v.select(F.col("vec_id").alias("entry_id"), F.transform("embedding", lambda x, i: F.when(i > 0, x).otherwise(-x)).alias("v"), F.lit(1).alias("cache_version"), (F.col("vec_id") % 3 == 0).alias("is_stale"))
    return state.cache_hits(asked, cache, F.lit(1), least=0.3)


CACHE_SQL = """
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_concat([-v[1]], v[2:]) AS u FROM embeddings),
s AS (SELECT 'q' || q.vec_id AS query_id, c.vec_id AS entry_id, round(list_dot_product(q.v, c.u) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.u, c.u))), 6) AS score
  FROM d q, d c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS n FROM s)
SELECT query_id, entry_id, score FROM r WHERE n = 1 AND score >= 0.3 AND entry_id % 3 <> 0"""


def law_staleness_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 27 years")).alias("created_at"))
    return state.stale_entries(o, manifest(spark), F.to_date(F.lit("2026-12-31"))).select("o_orderkey", "next_change", "is_stale")


STALE_SQL = """
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 27 YEAR < TIMESTAMP '2025-07-01' THEN DATE '2025-07-01' END AS next_change, o_orderdate + INTERVAL 27 YEAR < TIMESTAMP '2025-07-01' AS is_stale FROM orders"""


def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.when(F.col("user_id") % 2 == 0, "user").otherwise("seed").alias("source_round"))
    return state.fresh(e, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).select("event_id", "source_round")


TTL_SQL = "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'seed' END AS source_round FROM events WHERE user_id % 2 <> 0 OR epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '2024-01-09 00:00:00')"


def next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each event with the user's next purchase."""
    e = table(spark, sf_dir, "events")
    return state.next_event(e.select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at")), "user_id", "ts", "at").select("event_id", "next_at")


NEXT_SQL = "SELECT e.event_id, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts) AS next_at FROM events e"


def dialogue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dialogue_states(table(spark, sf_dir, "conversations"), entities=ENTITIES, taxes=TAXES, goes_on=GOES_ON)


def dialogue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dialogue_states_no_reset(table(spark, sf_dir, "conversations"), entities=ENTITIES, taxes=TAXES, goes_on=GOES_ON).select("conv_id", "turn", "entity_type", "tax_type", "turn_count")


def _label_sql(labels: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in labels.items()) + " END"


WINDOWS_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_label_sql(ENTITIES)} AS e, {_label_sql(TAXES)} AS x FROM conversations WHERE role = 'user')
SELECT conv_id, turn, last_value(e IGNORE NULLS) OVER w AS entity_type, last_value(x IGNORE NULLS) OVER w AS tax_type, CAST(count(*) OVER w AS INTEGER) AS turn_count FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


DIALOGUE_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_label_sql(ENTITIES)} AS e, {_label_sql(TAXES)} AS x, nullif(regexp_extract(coalesce(text, ''), '(?i)(\\d+)\\s*(người phụ thuộc|npt|con nhỏ|con|người thân)', 1) || ' ' || regexp_extract(coalesce(text, ''), '(?i)(\\d+)\\s*(người phụ thuộc|npt|con nhỏ|con|người thân)', 2), ' ') AS s,
  contains(lower(coalesce(text, '')), '{GOES_ON[0]}') AS g FROM conversations WHERE role = 'user'),
w AS (SELECT *, last_value(e IGNORE NULLS) OVER b AS we, last_value(x IGNORE NULLS) OVER b AS wx, last_value(s IGNORE NULLS) OVER b AS ws FROM t WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, coalesce(we, wx, ws) IS NULL AS bare, NOT g AND coalesce(we, wx, ws) IS NOT NULL AND x IS NOT NULL AND x IS DISTINCT FROM wx AND e IS NOT NULL AND e IS DISTINCT FROM we AS anew FROM w),
p AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS topic FROM n)
SELECT conv_id, turn, last_value(e IGNORE NULLS) OVER o AS entity_type, last_value(x IGNORE NULLS) OVER o AS tax_type, CAST(NULL AS VARCHAR) AS income_info, last_value(s IGNORE NULLS) OVER o AS scenario, CAST(count(*) OVER o AS INTEGER) AS turn_count,
  CASE WHEN anew THEN 'new_topic' WHEN g THEN 'continuation' WHEN bare THEN 'new' WHEN x IS NOT NULL OR e IS NOT NULL THEN 'continuation' ELSE 'clarification' END AS intent
FROM p WINDOW o AS (PARTITION BY conv_id, topic ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def daily_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.daily_counts(table(spark, sf_dir, "events"))


DAILY_SQL = """
WITH d AS (SELECT date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS day_start, count(*) AS used FROM events GROUP BY 1)
SELECT day_start, used, greatest(0, 10000 - used) AS remaining, CASE WHEN used >= 10000 THEN 'over' WHEN used >= 6500 THEN 'warn' ELSE 'ok' END AS level FROM d"""


def rate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.col("t") / 1e6)
    return state.rate_gaps(e, "user_id", "s", least=3600.0).select("user_id", "t", F.round("wait", 3).alias("wait"))


GAP_SQL = """
WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events)
SELECT user_id, t, round(greatest(0.0, coalesce(3600.0 - (t / 1e6 - lag(t / 1e6) OVER (PARTITION BY user_id ORDER BY t)), 0.0)), 3)::DOUBLE AS wait FROM e"""


def consecutive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("error", "view", "click"))


STREAK_SQL = """
WITH m AS (SELECT user_id, event_id, event_type IN ('error', 'view', 'click') AS e FROM events),
g AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
SELECT user_id, min(event_id) AS first, count(*) AS length FROM g WHERE e GROUP BY user_id, island"""


def duplicate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.repeated_calls(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "event_type", "event_id")


DUPLICATE_SQL = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1"


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return state.token_bucket(calls, capacity=600.0, cost=60.0 * 3600.0 / 6).select("key", "seq", F.round("waited").alias("waited"))


# Each call after the one before: when it may start is the later of its time and of what the calls from any earlier one on have used up.
BUCKET_SQL = """
WITH e AS (SELECT user_id % 8 AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS n, min(t) OVER (PARTITION BY key) AS first FROM e),
z AS (SELECT *, max(t - 60.0 - (n - 1) * 3600.0) OVER (PARTITION BY key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS old FROM n)
SELECT key, seq, round(greatest(t, greatest(first, old) + n * 3600.0) - t)::DOUBLE AS waited FROM z"""


def router_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("ts", F.when(F.col("value") > 50, "premium").otherwise("fast").alias("model"))
    return state.router_usage(calls, 400)


ROUTER_SQL = """
WITH d AS (SELECT date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS day_start, count(*) AS n, count_if(value > 50) AS p FROM events GROUP BY 1)
SELECT day_start, n, round(100 * p / n, 2) AS premium_percent, greatest(0, 400 - p) AS "left" FROM d"""


QUERIES = [key_facts, fact_check, numeric_alignment, confidence_level, source_dedup, context_budget, citation_validate, overall_score, eval_report, failed_questions, tier2_citation, failure_classify, failure_shares, merge_batches, cache_lookup, law_staleness_asof, cache_ttl, next_purchase, dialogue_state, dialogue_windows, daily_counter, rate_gap, consecutive_errors, duplicate_calls, token_bucket, router_usage]
SQL = {
    "key_facts": KEY_FACTS_SQL,
    "fact_check": FACT_SQL,
    "numeric_alignment": ALIGN_SQL,
    "confidence_level": CONFIDENCE_SQL,
    "source_dedup": DEDUP_SQL,
    "context_budget": BUDGET_SQL,
    "citation_validate": CITATION_SQL,
    "overall_score": OVERALL_SQL,
    "eval_report": REPORT_SQL,
    "failed_questions": FAILED_SQL,
    "tier2_citation": TIER2_SQL,
    "failure_classify": FAILURE_SQL,
    "failure_shares": SHARES_SQL,
    "merge_batches": MERGE_SQL,
    "cache_lookup": CACHE_SQL,
    "law_staleness_asof": STALE_SQL,
    "cache_ttl": TTL_SQL,
    "next_purchase": NEXT_SQL,
    "dialogue_state": DIALOGUE_SQL,
    "dialogue_windows": WINDOWS_SQL,
    "token_bucket": BUCKET_SQL,
    "daily_counter": DAILY_SQL,
    "rate_gap": GAP_SQL,
    "consecutive_errors": STREAK_SQL,
    "duplicate_calls": DUPLICATE_SQL,
    "router_usage": ROUTER_SQL,
}
