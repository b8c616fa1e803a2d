"""Queries of operators on tables: graphs, facts, answers, sources, stores, runs and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import rules
from lexmill.functions.staging import new_table, staged
from lexmill.operators import analytics, checks, chunks, classify, evaluation, graph, quality, search
from lexmill.plans import registry
from lexmill.plans.common import MANIFEST_SQL, manifest, table
from lexmill.sources import readers
from lexmill.streaming import state

c = F.col


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


MODES = ["TRUCK", "MAIL", "RAIL", "REG AIR", "SHIP"]
MODE_SQL = f"{MODES}[l_partkey % 5 + 1]"


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a way of shipping made from their part."""
    return _lines(spark, sf_dir).withColumn("l_shipmode", F.element_at(F.array(*map(F.lit, MODES)), (c("l_partkey") % 5 + 1).cast("int")))


# --- graphs ----------------------------------------------------------------------------------


def latest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event as the row that stays of a node loaded again and again."""
    e = table(spark, sf_dir, "events").select(c("user_id").alias("node_id"), c("event_id").alias("load_seq"), "event_type")
    return graph.latest_nodes(e)


LATEST_SQL = "SELECT user_id AS node_id, max(event_id) AS load_seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"


def resolve_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of customers to articles of two laws, one named in two ways; nations stand for the laws' articles."""
    k = c("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ["luat_quan_ly_thue", "luat_thue_tncn", "luat_la"])), (k % 3 + 1).cast("int"))
    targets = table(spark, sf_dir, "customer").select(F.concat(F.lit("external_"), name, F.lit("_dieu_"), k % 7 + 1).alias("target_id"))
    documents = spark.createDataFrame([(1, "quan_ly_thue", "qlt"), (2, "thue", "tncn")], "priority int, keyword string, doc_id string").coalesce(1)
    n = c("n_nationkey")
    nodes = table(spark, sf_dir, "nation").select(F.when(n % 2 == 0, "qlt").otherwise("tncn").alias("doc_id"), F.concat(F.lit("doc_x_chuong_"), n, F.lit("_dieu_"), n % 5 + 1).alias("node_id"))
    return graph.resolve_external(targets, documents, nodes)


RESOLVE_SQL = """
WITH t AS (SELECT DISTINCT ['luat_quan_ly_thue', 'luat_thue_tncn', 'luat_la'][c_custkey % 3 + 1] AS law, c_custkey % 7 + 1 AS a FROM customer),
n AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'qlt' ELSE 'tncn' END AS d, 'doc_x_chuong_' || n_nationkey || '_dieu_' || (n_nationkey % 5 + 1) AS node_id, n_nationkey % 5 + 1 AS a FROM nation),
m AS (SELECT 'external_' || law || '_dieu_' || t.a AS target_id, node_id FROM t JOIN n ON n.a = t.a AND n.d = CASE law WHEN 'luat_quan_ly_thue' THEN 'qlt' WHEN 'luat_thue_tncn' THEN 'tncn' END)
SELECT target_id, arg_min(node_id, (length(node_id), node_id)) AS node_id FROM m GROUP BY 1"""


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines below their orders: paths of customer, order and line; asked for are the orders of every third customer."""
    o, li = _orders(spark, sf_dir), _lines(spark, sf_dir)
    both = o.join(li, c("o_orderkey") == c("l_orderkey"))
    nodes = both.select(c("o_custkey").alias("doc_id"), F.array(c("o_orderkey") * 10, c("o_orderkey") * 10 + c("l_linenumber")).alias("path"), c("l_partkey").alias("part"))
    tops = o.where("o_custkey % 3 = 0").select(c("o_custkey").alias("doc_id"), (c("o_orderkey") * 10).alias("seq"))
    return graph.descendants(nodes, tops).select("doc_id", "top", F.get("path", F.lit(1)).alias("line"), "part")


DESCENDANTS_SQL = "SELECT o_custkey AS doc_id, o_orderkey * 10 AS top, o_orderkey * 10 + l_linenumber AS line, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 3 = 0"


def first_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an order's lines with an asked number."""
    li = _lines(spark, sf_dir)
    nodes = li.select(c("l_orderkey").alias("doc_id"), F.lit("dieu").alias("kind"), (c("l_linenumber") % 3).cast("string").alias("index"), c("l_linenumber").alias("seq"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("node_id"))
    asked = _orders(spark, sf_dir).select(c("o_orderkey").alias("doc_id"), (c("o_orderkey") % 3).cast("string").alias("number"))
    return graph.first_article(nodes, asked)


ARTICLE_SQL = """
SELECT o_orderkey AS doc_id, CAST(o_orderkey % 3 AS VARCHAR) AS number, o_orderkey || '_' || min(l_linenumber) AS node_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber % 3 = o_orderkey % 3 GROUP BY o_orderkey"""


def holds_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a whole test item."""
    texts = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text")
    phrases = table(spark, sf_dir, "benchmark").select(c("item_id").alias("phrase_id"), c("text").alias("phrase"))
    return graph.holds_phrase(texts, phrases)


PHRASE_SQL = "SELECT item_id AS phrase_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))"


def article_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles, their odd lines as clauses, parts of returned ones as points."""
    li = _lines(spark, sf_dir)
    clause = F.concat_ws("_", "l_orderkey", "l_linenumber")
    articles = _orders(spark, sf_dir).select(c("o_orderkey").alias("article_id"))
    clauses = li.where("l_linenumber % 2 = 1").select(c("l_orderkey").alias("article_id"), clause.alias("clause_id"))
    points = li.where("l_returnflag = 'R'").select(clause.alias("clause_id"), c("l_partkey").alias("point"))
    return graph.article_context(articles, clauses, points).select("article_id", "clause_id", "point")


CONTEXT_SQL = """
WITH cl AS (SELECT l_orderkey AS article_id, l_orderkey || '_' || l_linenumber AS clause_id FROM lineitem WHERE l_linenumber % 2 = 1),
p AS (SELECT l_orderkey || '_' || l_linenumber AS clause_id, l_partkey AS point FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS article_id, cl.clause_id, point FROM orders LEFT JOIN cl ON article_id = o_orderkey LEFT JOIN p ON p.clause_id = cl.clause_id"""


def valid_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders in force on a day, the order of rank."""
    o = _orders(spark, sf_dir)
    day = F.to_date("o_orderdate")
    docs = o.select("o_custkey", c("o_orderkey").alias("doc_id"), (c("o_orderkey") % 4).cast("int").alias("legal_level"), day.alias("effective_from"), F.when(c("o_orderkey") % 5 != 0, F.date_add(day, 400)).alias("effective_to"))
    return graph.by_rank(graph.valid_at(docs, F.to_date(F.lit("1997-03-01"))), "o_custkey").select("o_custkey", "doc_id", "place")


RANK_SQL = """
WITH d AS (SELECT o_custkey, o_orderkey AS doc_id, o_orderkey % 4 AS l, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 400 END AS t FROM orders)
SELECT o_custkey, doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l, f DESC, doc_id) AS INTEGER) AS place FROM d WHERE f <= DATE '1997-03-01' AND (t IS NULL OR t > DATE '1997-03-01')"""


def explanation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lines(spark, sf_dir).groupBy(c("l_suppkey").alias("src"), c("l_partkey").alias("dst")).agg(F.round(F.sum("l_quantity") / 60, 6).alias("confidence"))
    return graph.explanations(e).select("src", "dst", "place")


EXPLAIN_SQL = """
WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, round(sum(l_quantity) / 60, 6) AS confidence FROM lineitem GROUP BY 1, 2)
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS INTEGER) AS place FROM e WHERE confidence >= 0.82"""


def chunk_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = c("o_orderkey"), F.to_date("o_orderdate")
    pairs = _orders(spark, sf_dir).select(k.alias("a_id"), (k % 5).alias("a_level"), day.alias("a_date"), (-k).alias("b_id"), (k % 3).alias("b_level"), F.date_add(day, (k % 7 - 3).cast("int")).alias("b_date"))
    return analytics.chunk_conflicts(pairs).select("a_id", "winner", "loser")


CONFLICT_SQL = """
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_orderkey % 3 AS b, o_orderkey % 7 - 3 AS later FROM orders)
SELECT k AS a_id, CASE WHEN a < b OR a = b AND later <= 0 THEN k ELSE -k END AS winner, CASE WHEN a < b OR a = b AND later <= 0 THEN -k ELSE k END AS loser FROM p"""


def hierarchy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders stand for both a superseded document and its successor."""
    names = F.array(*map(F.lit, ["111_2013", "109_2025", "126_2020", "117_2025", "125_2020", "x"]))
    hits = _orders(spark, sf_dir).select(c("o_custkey").alias("query_id"), F.element_at(names, (c("o_orderkey") % 6 + 1).cast("int")).alias("doc_id"))
    return checks.hierarchy_conflicts(hits, manifest(spark))


HIERARCHY_SQL = f"""
WITH h AS (SELECT DISTINCT o_custkey AS query_id, ['111_2013', '109_2025', '126_2020', '117_2025', '125_2020', 'x'][o_orderkey % 6 + 1] AS doc_id FROM orders)
SELECT a.query_id, a.doc_id, m.superseded_by FROM h a JOIN {MANIFEST_SQL} ON m.doc_id = a.doc_id JOIN h b ON b.query_id = a.query_id AND b.doc_id = m.superseded_by"""


# --- facts -----------------------------------------------------------------------------------


def merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands as facts by rule, types, and some brands in other case, as facts of a model."""
    p = table(spark, sf_dir, "part")
    by_rule = p.select(c("p_brand").alias("value"), c("p_partkey").alias("seq"))
    by_model = p.select(F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(c("p_type")).alias("value"), c("p_partkey").alias("seq"))
    return checks.merge_facts(by_rule, by_model)


MERGE_FACTS_SQL = """
WITH b AS (SELECT p_brand AS value, p_partkey AS seq, 'regex' AS source FROM part UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_brand) ELSE p_type END, p_partkey, 'llm' FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(value)) ORDER BY CASE source WHEN 'regex' THEN 0 ELSE 1 END, seq) AS n FROM b)
SELECT value, seq, source FROM r WHERE n = 1"""


def verify_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items as facts of a model, word by word; documents bear them out or not."""
    words = F.regexp_replace("text", r"[^\p{L} ]+", " ")
    facts = table(spark, sf_dir, "benchmark").select(words.alias("value")).distinct().withColumns({"source": F.lit("llm"), "evidence_node": F.lit("").cast("string")})
    ruled = spark.createDataFrame([("5 %", "regex", "n0")], "value string, source string, evidence_node string")
    nodes = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("node_id"), c("doc_id").alias("seq"), "text")
    return checks.verify_facts(facts.unionByName(ruled), nodes).select("value", "source", "confidence", "evidence_node")


VERIFY_SQL = r"""
WITH f AS (SELECT DISTINCT regexp_replace(text, '[^\p{L} ]+', ' ', 'g') AS value FROM benchmark),
t AS (SELECT value, unnest(list_distinct(list_filter(regexp_extract_all(lower(value), '[\p{L}\p{N}_]+'), lambda x: length(x) > 3))) AS term FROM f),
n AS (SELECT value, count(*) AS n FROM t GROUP BY 1),
u AS (SELECT DISTINCT term FROM t),
h AS (SELECT doc_id, term FROM documents JOIN u ON contains(lower(text), term)),
m AS (SELECT value, doc_id, count(*) AS own FROM t JOIN h USING (term) GROUP BY 1, 2),
b AS (SELECT value, arg_max(doc_id, (own, -doc_id)) AS node FROM m GROUP BY 1),
e AS (SELECT value, count(DISTINCT term) AS met FROM t JOIN h USING (term) GROUP BY 1)
SELECT value, 'llm' AS source, (round_even(0.8 * (met / n) * 100, 0) / 100)::DOUBLE AS confidence, CAST(node AS VARCHAR) AS evidence_node FROM e JOIN n USING (value) JOIN b USING (value) WHERE met / n >= 0.6
UNION ALL SELECT '5 %', 'regex', 1.0, 'n0'"""


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("l_returnflag") == "R", "numeric").when(c("l_returnflag") == "A", "condition").otherwise("citation")
    facts = _lines(spark, sf_dir).select("l_orderkey", kind.alias("fact_type"), c("l_discount").alias("confidence"), F.concat_ws("_", "l_linenumber", "l_partkey").alias("value"))
    return checks.order_facts(facts, "l_orderkey").select("l_orderkey", "value", "place")


ORDER_FACTS_SQL = """
SELECT l_orderkey, l_linenumber || '_' || l_partkey AS value, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_discount DESC, l_linenumber || '_' || l_partkey) AS INTEGER) AS place FROM lineitem"""


def fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of shipping as wanted facts of an order; found are those of its even lines and its instructions."""
    li = _shipped(spark, sf_dir)
    wanted = li.select(c("l_orderkey").alias("case_id"), c("l_shipmode").alias("fact")).distinct()
    found = li.where("l_linenumber % 2 = 0").select(c("l_orderkey").alias("case_id"), F.concat(F.lit("by "), F.lower("l_shipmode")).alias("value")).unionByName(li.where("l_linenumber % 3 = 0").select(c("l_orderkey").alias("case_id"), c("l_returnflag").alias("value"))).distinct()
    out = checks.fact_recall(found, wanted)
    return out.select("case_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "passes")


RECALL_SQL = f"""
WITH w AS (SELECT DISTINCT l_orderkey AS case_id, {MODE_SQL} AS fact FROM lineitem),
f AS (SELECT DISTINCT * FROM (SELECT l_orderkey AS case_id, 'by ' || lower({MODE_SQL}) AS value FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber % 3 = 0)),
x AS (SELECT w.case_id, fact, value, contains(lower(value), lower(fact)) OR contains(lower(fact), lower(value)) AS hit FROM w LEFT JOIN f ON f.case_id = w.case_id),
r AS (SELECT case_id, avg(h) AS recall FROM (SELECT case_id, fact, max(CASE WHEN hit THEN 1 ELSE 0 END) AS h FROM x GROUP BY ALL) GROUP BY 1),
p AS (SELECT case_id, avg(h) AS precision FROM (SELECT case_id, value, max(CASE WHEN hit THEN 1 ELSE 0 END) AS h FROM x WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT case_id, round(recall, 6) AS recall, round(coalesce(precision, 1.0), 6) AS precision, recall >= 0.75 AS passes FROM r LEFT JOIN p USING (case_id)"""


# --- search steps ----------------------------------------------------------------------------

SCOPE_TEXTS = ["Hộ kinh doanh doanh thu 600 triệu", "Bán trên shopee của hộ kinh doanh", "lương tháng này", "thuế khoán tính sao, mở quán"]


def scope_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the real scopes and gate add to questions of orders; every fifth order has one of them already."""
    k = c("o_orderkey")
    text = F.element_at(F.array(*map(F.lit, SCOPE_TEXTS)), (k % 4 + 1).cast("int"))
    q = _orders(spark, sf_dir).select(k.alias("query_id"), text.alias("text"))
    scopes = q.select("query_id", classify.classify_scope(c("text"), F.lit(None).cast("string"))["scopes"].alias("scopes"))
    docs = spark.createDataFrame([(s, d) for s, ds in rules.SCOPE_DOCS.items() for d in ds], "scope string, doc_id string").coalesce(1)
    have = q.where("query_id % 5 = 0").select("query_id", F.lit("68_2026_NDCP").alias("doc_id"))
    return search.scope_injection(q, scopes, docs, have, rules.HOUSEHOLD_GATE).select("query_id", "doc_id")


SCOPE_SQL = "SELECT o_orderkey AS query_id, d AS doc_id FROM orders, (SELECT unnest([" + ", ".join(f"'{d}'" for d in rules.SCOPE_DOCS["HKD"]) + "]) AS d) WHERE o_orderkey % 4 IN (0, 3) AND NOT (o_orderkey % 5 = 0 AND d = '68_2026_NDCP')"


def exception_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of orders' articles: a hit finds those of its own id and of the article above it."""
    o, li = _orders(spark, sf_dir), _lines(spark, sf_dir)
    chunk = F.concat(F.lit("d_dieu_"), "o_orderkey", F.when(c("o_orderkey") % 2 == 0, F.lit("_khoan_1")).otherwise(F.lit("")), F.lit("_chunk"))
    hits = o.select(c("o_custkey").alias("query_id"), chunk.alias("chunk_id"), c("o_orderkey").alias("rank"), F.lit(0.01).alias("rrf_score"))
    index = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("e"), c("l_partkey") % 50))).alias("exception_chunk_ids")).select(F.concat(F.lit("d_dieu_"), "l_orderkey", F.lit("_chunk")).alias("rule_chunk_id"), "exception_chunk_ids")
    return search.expand_exceptions(hits, index).select("query_id", "chunk_id", "exception_of", "rrf_score")


EXCEPTION_SQL = """
WITH e AS (SELECT l_orderkey, list_sort(list_distinct(list('e' || (l_partkey % 50)))) AS es FROM lineitem GROUP BY 1),
h AS (SELECT o_custkey AS query_id, o_orderkey AS k, 'd_dieu_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_khoan_1' ELSE '' END || '_chunk' AS chunk_id FROM orders),
x AS (SELECT query_id, k, chunk_id AS exception_of, unnest(es[1:3]) AS chunk_id, unnest(range(1, len(es[1:3]) + 1)) AS pos FROM h JOIN e ON l_orderkey = k),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY k, pos) AS n FROM x)
SELECT query_id, chunk_id, exception_of, 0.0065::DOUBLE AS rrf_score FROM r WHERE n = 1"""


def specific_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    hits = _orders(spark, sf_dir).select(k.alias("chunk_id"), F.when(k % 4 != 3, k % 4 == 0).alias("specific_entity"))
    return search.drop_specific(hits, c("chunk_id") % 5 != 0).select("chunk_id")


SPECIFIC_SQL = "SELECT o_orderkey AS chunk_id FROM orders WHERE NOT (o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0)"


CO_RULES = [("125", [], ["310", "68"], 2, "prepend"), ("117", [], ["68"], 3, "append"), ("126", ["ủy quyền"], ["373"], 3, "append")]


def co_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-searches that orders, as questions within a document, ask for."""
    k = c("o_orderkey")
    base = _orders(spark, sf_dir).select(
        k.alias("query_id"), F.when(k % 2 == 0, "Ủy quyền quyết toán").otherwise("hỏi").alias("text"), F.element_at(F.array(*map(F.lit, ["125", "117", "126"])), (k % 3 + 1).cast("int")).alias("doc_filter"), F.when(k % 5 == 0, F.array(F.lit("68"))).otherwise(F.array().cast("array<string>")).alias("found_docs")
    )
    flat = [(w, kw, t, n, p) for w, kw, ts, n, p in CO_RULES for t in ts]
    rows = spark.createDataFrame(flat, "when_filter string, keywords array<string>, target string, k int, place string").coalesce(1)
    return search.co_retrieve(base, rows).select("query_id", "target", "k", "place")


CO_SQL = """
WITH r(f, need, target, k, place) AS (VALUES (0, false, '310', 2, 'prepend'), (0, false, '68', 2, 'prepend'), (1, false, '68', 3, 'append'), (2, true, '373', 3, 'append'))
SELECT o_orderkey AS query_id, target, CAST(k AS INTEGER) AS k, place FROM orders JOIN r ON f = o_orderkey % 3 WHERE (NOT need OR o_orderkey % 2 = 0) AND NOT (o_orderkey % 5 = 0 AND target = '68')"""


def topic_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of two labels for each asked vector, without those its pool has, put before the pool."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("q"))
    items = v.select(c("vec_id").alias("chunk_id"), c("label").alias("doc_id"), c("embedding").alias("v"))
    wanted = q.select("query_id", F.explode(F.array((c("query_id") / 100 % 10).cast("int"), (c("query_id") / 50 % 10).cast("int"))).alias("doc_id"))
    pool = q.select("query_id", F.posexplode(F.sequence(F.lit(0), F.lit(40), F.lit(2)).cast("array<bigint>")).alias("r", "chunk_id")).select("query_id", "chunk_id", (c("r") + 1).alias("rank"))
    return search.prepend(pool, search.inject(q, items, wanted, pool)).select("query_id", "chunk_id", "rank")


POOL_SQL = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
w AS (SELECT DISTINCT query_id, unnest([CAST(trunc(query_id / 100 % 10) AS INTEGER), CAST(trunc(query_id / 50 % 10) AS INTEGER)]) AS doc_id FROM q),
s AS (SELECT q.query_id, w.doc_id, vec_id AS chunk_id, round(list_dot_product(q, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score
  FROM q JOIN w USING (query_id) JOIN embeddings ON label = w.doc_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS n FROM s),
e AS (SELECT query_id, chunk_id, 0 AS late, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, n, chunk_id) AS rank FROM n WHERE n <= 3 AND NOT (chunk_id <= 40 AND chunk_id % 2 = 0)),
b AS (SELECT * FROM e UNION ALL SELECT query_id, x, 1, x // 2 + 1 FROM q, range(0, 42, 2) t(x))
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late, rank, chunk_id) AS INTEGER) AS rank FROM b"""


# --- answers ---------------------------------------------------------------------------------


def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as retrieved chunks of a few documents: what a context of four takes, and where."""
    k = c("o_orderkey")
    chunk = _orders(spark, sf_dir).select(c("o_custkey").alias("query_id"), k.alias("chunk_id"), (k % 5).alias("doc_id"), k.alias("rank"), F.when(k % 3 == 0, "Được miễn thuế").otherwise("Phải nộp").alias("text"))
    return checks.order_context(chunk, 4)


CONTEXT_ORDER_SQL = """
WITH x AS (SELECT o_custkey AS q, o_orderkey AS k, o_orderkey % 5 AS d, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS late FROM orders),
y AS (SELECT *, sum(late) OVER (PARTITION BY q) AS nl, count(*) OVER (PARTITION BY q) - sum(late) OVER (PARTITION BY q) AS nr, row_number() OVER (PARTITION BY q, late ORDER BY k) AS nth FROM x),
z AS (SELECT *, least(nr, greatest(1, 4 - least(nl, 2))) AS kept FROM y),
p AS (SELECT *, CASE WHEN late = 0 AND nth <= kept THEN nth WHEN late = 1 AND kept + nth <= 4 THEN kept + nth END AS place FROM z),
t AS (SELECT q, count(place) AS taken FROM p GROUP BY 1),
m AS (SELECT q, d, min(k) AS k FROM p GROUP BY 1, 2 HAVING count(place) = 0),
j AS (SELECT m.*, taken, row_number() OVER (PARTITION BY m.q ORDER BY k) AS j, count(*) OVER (PARTITION BY m.q) AS n FROM m JOIN t USING (q)),
a AS (SELECT q, k, taken + j AS position FROM j WHERE taken + j <= 4 AND NOT (n > 4 - taken AND taken + j = 4) UNION ALL SELECT q, k, 4 FROM j WHERE n > 4 - taken AND j = n)
SELECT q AS query_id, k AS chunk_id, CAST(position AS INTEGER) AS position FROM a
UNION ALL SELECT q, k, CAST(place AS INTEGER) FROM p WHERE place IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.q = p.q AND a.position = p.place)"""


def bad_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of runs, made of order lines, that may not follow the one before."""
    stages = F.array(*map(F.lit, ["ROUTER", "RETRIEVAL", "CALC", "GENERATOR", "FACT_CHECK", "DONE"]))
    log = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(c("l_orderkey").alias("run_id"), c("l_linenumber").alias("seq"), F.element_at(stages, (c("p") % 6 + 1).cast("int")).alias("stage"))
    return checks.bad_transitions(log).select("run_id", "seq", "previous", "stage")


TRANSITION_SQL = (
    """WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS seq, ['ROUTER', 'RETRIEVAL', 'CALC', 'GENERATOR', 'FACT_CHECK', 'DONE'][min(l_partkey) % 6 + 1] AS stage FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY seq) AS previous FROM l)
SELECT run_id, seq, previous, stage FROM p WHERE previous IS NOT NULL AND previous || '>' || stage NOT IN ("""
    + ", ".join(f"'{a}>{b}'" for a, bs in checks.TRANSITIONS.items() for b in bs)
    + ")"
)


def answer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How orders, as tool calls, are logged, and what a draft with critical issues is told."""
    k, price = c("o_orderkey"), c("o_totalprice")
    arg = lambda name, text, number: F.struct(F.lit(name).alias("name"), text.alias("text"), number.cast("double").alias("number"))
    args = F.array(arg("revenue", F.round(price, 2).cast("string"), F.round(price) * 1000 + 500), arg("note", F.repeat(F.lit("ab"), (k % 20).cast("int")), F.lit(None)))
    issue = lambda fact, bad: F.struct(fact.alias("key_fact"), F.when(bad, "critical").otherwise("minor").alias("severity"))
    issues = F.array(issue(F.concat(F.lit("f"), k), k % 2 == 0), issue(F.lit("5 %"), k % 3 == 0))
    long = checks.short_value(F.when(k % 2 == 0, "content").otherwise("title"), F.repeat(F.lit("x"), (k % 300).cast("int")))
    return _orders(spark, sf_dir).select("o_orderkey", checks.short_args(args).alias("args"), F.length(long).alias("chars"), F.md5(checks.correction_text(issues)).alias("correction"), checks.top_score(F.filter(F.array(k % 7, k % 5), lambda x: x > 2)).alias("top"))


LOGS_SQL = """
SELECT o_orderkey, 'revenue=' || CASE WHEN round(o_totalprice) * 1000 + 500 > 1000000 THEN CAST(round_even((round(o_totalprice) * 1000 + 500) / 1e6, 0) AS BIGINT) || 'M' ELSE CAST(round(o_totalprice, 2) AS VARCHAR) END || ', note=' || repeat('ab', CAST(o_orderkey % 20 AS INTEGER))[1:30] AS args,
  CAST(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 300 > 200 THEN 203 ELSE o_orderkey % 300 END AS INTEGER) AS chars,
  md5(CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN '' ELSE 'BẢN NHÁP TRƯỚC BỊ LOẠI DO VI PHẠM QUY TẮC.' || chr(10) || 'TUYỆT ĐỐI KHÔNG đề cập các thông tin sau:' || chr(10)
    || concat_ws(chr(10), CASE WHEN o_orderkey % 2 = 0 THEN '  - f' || o_orderkey END, CASE WHEN o_orderkey % 3 = 0 THEN '  - 5 %' END)
    || chr(10) || 'Chỉ sử dụng dữ liệu có trong chunks được cung cấp.' || chr(10) || 'Nếu không đủ cơ sở pháp lý → viết đúng câu: ''Không đủ cơ sở pháp lý để xác định [vấn đề].''' END) AS correction,
  CASE WHEN greatest(o_orderkey % 7, o_orderkey % 5) > 2 THEN greatest(o_orderkey % 7, o_orderkey % 5) END AS top FROM orders"""


# --- quality and chunks ----------------------------------------------------------------------


def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chunks with faults of every kind."""
    n, k = c("l_linenumber"), c("l_orderkey")
    kind = F.when(n % 2 == 1, "dieu").otherwise("khoan")
    text = F.when(n == 7, "").when(n % 3 == 0, F.concat(F.lit("[VB 1/2025 | Đ"), n, F.lit("] "), F.repeat(F.lit("x"), F.lit(40)))).otherwise(F.concat(F.lit("[VB 1/2025 | Đ"), n, F.lit(" Tên] "), F.repeat(F.lit("x"), (k % 30).cast("int"))))
    made = _lines(spark, sf_dir).select(k.alias("doc_id"), F.concat_ws("_", k, n % 4).alias("node_id"), kind.alias("kind"), F.when(n != 5, n.cast("string")).alias("index"), text.alias("text"), F.repeat(F.lit("y"), (k % 15).cast("int")).alias("body"))
    return quality.validate_chunks(made).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


CHUNK_CHECKS_SQL = """
WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber % 3 = 0 THEN '[VB 1/2025 | Đ' || l_linenumber || '] ' || repeat('x', 40) ELSE '[VB 1/2025 | Đ' || l_linenumber || ' Tên] ' || repeat('x', CAST(l_orderkey % 30 AS INTEGER)) END AS t, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 4) AS d FROM lineitem),
i AS (SELECT 'header' AS code FROM m WHERE n % 2 = 1 AND n <> 5 AND (n = 7 OR n % 3 = 0)
UNION ALL SELECT 'field' FROM m WHERE t = '' UNION ALL SELECT 'length' FROM m WHERE length(t) < 30 OR length(t) > 1500 UNION ALL SELECT 'duplicate' FROM m WHERE d > 1
UNION ALL SELECT 'short' FROM m WHERE n % 2 = 0 AND k % 15 < 10 UNION ALL SELECT 'index' FROM m WHERE n = 5)
SELECT code, count(*) AS n FROM i GROUP BY 1"""


def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, order lines as issues of theirs, and whether they may be taken in."""
    o = _orders(spark, sf_dir)
    issues = o.where("o_orderkey % 4 = 0").select(c("o_custkey").alias("doc_id"), F.when(c("o_orderkey") % 3 == 0, "error").otherwise("warning").alias("severity"))
    return quality.ingest_gate(table(spark, sf_dir, "customer").select(c("c_custkey").alias("doc_id")), issues)


GATE_SQL = """
WITH i AS (SELECT o_custkey AS doc_id, count_if(o_orderkey % 3 = 0) AS e, count_if(o_orderkey % 3 <> 0) AS w FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT c_custkey AS doc_id, CAST(coalesce(e, 0) AS BIGINT) AS errors, CAST(coalesce(w, 0) AS BIGINT) AS warnings, coalesce(e, 0) = 0 AS passes FROM customer LEFT JOIN i ON doc_id = c_custkey"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of customers: some gone, some changed, all with another date, which does not count."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = base.where("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(c("c_custkey") % 7 == 0, "NEW").otherwise(c("c_mktsegment"))).withColumn("at", F.lit(2))
    return quality.snapshot_diff(new, base.withColumn("at", F.lit(1)), ["at"])


DIFF_SQL = """
SELECT c_custkey, 'NEW' AS c_mktsegment, 'new' AS side FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, c_mktsegment, 'old' FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0"""


def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    key = lambda df, n: df.select(c("l_orderkey").alias("doc_id"), n.cast("string").alias("key"))
    out = quality.coverage(key(li, c("l_linenumber")), key(li.where("l_linenumber <> 2"), F.when(c("l_linenumber") == 5, 50).otherwise(c("l_linenumber"))))
    return out.select("doc_id", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


COVERAGE_SQL = """
WITH k AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS s, count(DISTINCT CASE WHEN l_linenumber <> 2 THEN l_linenumber END) AS p, count(DISTINCT CASE WHEN l_linenumber NOT IN (2, 5) THEN l_linenumber END) AS b FROM lineitem GROUP BY 1)
SELECT doc_id, round(b / s, 6) AS coverage, CASE WHEN p = 0 THEN 1.0 ELSE round(b / p, 6) END AS accuracy FROM k"""


def stage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parsed nodes: appendices that are mere mentions, nodes without id, and expected titles."""
    k = c("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(
        F.lit("d").alias("doc_id"), F.when(k % 11 != 0, F.concat(F.lit("n"), k)).alias("node_id"), F.when(k % 4 == 0, "phu_luc").otherwise("dieu").alias("kind"), k.cast("string").alias("index"), F.when(k % 3 == 0, "Kèm theo Nghị định").otherwise(c("c_name")).alias("title"), c("c_mktsegment").alias("content")
    )
    expected = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.concat(F.lit("n"), k).alias("node_id"), F.when(k % 2 == 0, "title").otherwise("content").alias("field"), F.when(k % 2 == 0, c("c_name")).otherwise(F.lit("BUILD")).alias("value"))
    issues = quality.stage_invariants(nodes).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return issues.unionByName(quality.spot_checks(nodes, expected).where("holds").agg(F.count(F.lit(1)).alias("n")).select(F.lit("spots").alias("code"), "n"))


STAGE_SQL = """
SELECT 'appendix_mention' AS code, count(*) AS n FROM customer WHERE c_custkey % 12 = 0 UNION ALL SELECT 'missing_id', count(*) FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT 'spots', count(*) FROM customer WHERE c_custkey % 11 <> 0 AND CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 <> 0 ELSE contains(c_mktsegment, 'BUILD') END"""


def supersession_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of the manifest's documents, tagged, and with the documents that amend theirs."""
    names = F.array(*map(F.lit, ["126_2020", "111_2013", "125_2020_NDCP", "x"]))
    rows = _orders(spark, sf_dir).select(c("o_orderkey").alias("chunk_id"), F.element_at(names, (c("o_orderkey") % 4 + 1).cast("int")).alias("doc_id"))
    out = chunks.attach_amendments(chunks.tag_superseded(rows, manifest(spark)))
    return out.select("chunk_id", "superseded", "superseded_by", F.array_join("amended_by", ",").alias("amended_by"))


TAGS_SQL = """
SELECT o_orderkey AS chunk_id, o_orderkey % 4 = 0 AS superseded, CASE WHEN o_orderkey % 4 = 0 THEN '117_2025' END AS superseded_by, CASE WHEN o_orderkey % 4 = 2 THEN '310_2025_NDCP' ELSE '' END AS amended_by FROM orders"""


def annotation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of annotations put into chunks and into the progress of a run; what is left to do is counted."""
    o = _orders(spark, sf_dir)
    k = c("o_orderkey")
    rows = o.select(k.alias("chunk_id"), F.lit("old").alias("who"))
    new = o.where("o_orderkey % 3 = 0").select(F.when(k % 2 == 0, k).otherwise(-k).alias("chunk_id"), (k % 4 == 0).alias("is_valid"), F.lit("new").alias("who"))
    merged = chunks.merge_annotations(rows, new, ["who"]).groupBy("who").agg(F.count(F.lit(1)).alias("n")).select(c("who").alias("what"), "n")
    outcome = chunks.annotation_outcome(rows, new).select(F.explode(F.array(*[F.struct(F.lit(x).alias("what"), c(x).alias("n")) for x in ("updated", "failed", "skipped")])).alias("o")).select("o.*")
    done = chunks.save_annotations(o.where("o_orderkey % 5 = 0").select(k.alias("chunk_id"), F.lit("first").alias("who")), new.select("chunk_id", "who"))
    progress = done.groupBy("who").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("done_"), "who").alias("what"), "n")
    left = chunks.to_annotate(rows, done).agg(F.count(F.lit(1)).alias("n")).select(F.lit("to_do").alias("what"), "n")
    return merged.unionByName(outcome).unionByName(progress).unionByName(left)


ANNOTATION_SQL = """
WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT CASE WHEN k % 12 = 0 THEN 'new' ELSE 'old' END AS what, count(*) AS n FROM o GROUP BY 1
UNION ALL SELECT 'updated', count(*) FROM o WHERE k % 12 = 0 UNION ALL SELECT 'failed', count(*) FROM o WHERE k % 6 = 0 AND k % 12 <> 0 UNION ALL SELECT 'skipped', count(*) FROM o WHERE k % 3 = 0 AND k % 2 <> 0
UNION ALL SELECT 'done_first', count(*) FROM o WHERE k % 5 = 0 AND k % 6 <> 0 UNION ALL SELECT 'done_new', count(*) FROM o WHERE k % 3 = 0
UNION ALL SELECT 'to_do', count(*) FROM o WHERE k % 5 <> 0 AND k % 6 <> 0"""


# --- state -----------------------------------------------------------------------------------


def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of orders looked up by their key in a cache that took half of them, some past their day; counts of what is there."""
    o, now = _orders(spark, sf_dir), F.to_timestamp(F.lit("2026-01-10 00:00:00"))
    day = F.to_date(F.lit("2026-01-10"))
    docs = F.array(F.lit("b"), F.lit("a"))
    asked = o.select(c("o_orderkey").alias("query_id"), F.concat(F.lit(" Câu hỏi "), "o_orderkey", F.lit(" năm nay ")).alias("question"), docs.alias("doc_ids"))
    from lexmill.functions.numbers import question_key

    entry = asked.select(question_key(F.upper("question"), day, F.array(F.lit("a"), F.lit("b"))).alias("entry_id"), F.when(c("query_id") % 3 == 0, "seed").otherwise("user").alias("source_round"), (now - F.make_dt_interval((c("query_id") % 4).cast("int"))).alias("created_at"), "query_id")
    cache = state.store_new(entry.where("query_id % 4 < 2").drop("query_id"), entry.where("query_id % 2 = 0").drop("query_id"))
    hits = state.cache_by_key(asked, cache, day, now).agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("total")).select(F.lit("hits").alias("what"), "n", "total")
    count = lambda df, name: state.cache_counts(df).select(F.concat(F.lit(name), "source_round").alias("what"), "n", F.lit(None).cast("long").alias("total"))
    return hits.unionByName(count(cache, "held_")).unionByName(count(state.flushed(cache, "user"), "left_"))


CACHE_STORE_SQL = """
WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'seed' ELSE 'user' END AS r FROM orders WHERE o_orderkey % 4 < 2 OR o_orderkey % 2 = 0)
SELECT 'hits' AS what, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM e WHERE r = 'seed' OR k % 4 <= 1
UNION ALL SELECT 'held_' || r, count(*), NULL FROM e GROUP BY r UNION ALL SELECT 'left_seed', count(*), NULL FROM e WHERE r = 'seed'"""


def retained_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last days, each with how many its day has had so far."""
    e = state.retained(table(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit("2024-01-20 00:00:00")), 5)
    return state.running_count(e).select("event_id", "used")


RETAINED_SQL = """
WITH e AS (SELECT event_id, ts, date_trunc('day', ts + INTERVAL 7 HOUR) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')
SELECT event_id, CAST(row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS INTEGER) AS used FROM e"""


# --- evaluation ------------------------------------------------------------------------------


def missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where facts about orders were lost; retrieved, chunks and nodes hold fewer and fewer of the ways of shipping."""
    li, o = _shipped(spark, sf_dir), _orders(spark, sf_dir)
    facts = o.select(c("o_orderkey").alias("question_id"), F.element_at(F.array(*map(F.lit, ["Truck", "mail", "ROCKET", "REG AIR", "ship"])), (c("o_orderkey") % 5 + 1).cast("int")).alias("fact"))
    texts = lambda where: li.where(where).select(F.concat(F.lit("sent by "), "l_shipmode", F.lit(" now")).alias("text")).distinct()
    retrieved = li.select(c("l_orderkey").alias("question_id"), c("l_shipmode").alias("text"))
    return evaluation.missing_facts(facts, retrieved, texts("l_shipmode <> 'REG AIR' and l_shipmode <> 'SHIP'"), texts("l_shipmode <> 'SHIP'"))


MISSING_SQL = f"""
WITH f AS (SELECT o_orderkey AS question_id, ['Truck', 'mail', 'ROCKET', 'REG AIR', 'ship'][o_orderkey % 5 + 1] AS fact FROM orders),
g AS (SELECT DISTINCT question_id FROM f JOIN lineitem ON l_orderkey = question_id WHERE contains(lower({MODE_SQL}), lower(fact)))
SELECT question_id, fact, CASE WHEN g.question_id IS NOT NULL THEN 'synthesis' WHEN fact IN ('Truck', 'mail') THEN 'retrieval_miss' WHEN fact = 'REG AIR' THEN 'chunk_missing' ELSE 'doc_missing' END AS lost_in FROM f LEFT JOIN g USING (question_id)"""


def question_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of urgent orders that need a calculation, without those an older run has passed; then what both runs have."""
    k = c("o_orderkey")
    rows = _orders(spark, sf_dir).select(k.alias("id"), c("o_orderpriority").alias("topic"), c("o_orderstatus").alias("difficulty"), (k % 2 == 0).alias("needs_calculation"), F.when(k % 3 == 0, "done").otherwise("open").alias("annotated"))
    chosen = evaluation.select_questions(rows, topic="URGENT", difficulty="O", needs_calculation=True, annotated=["done", "checked"], offset=2, limit=20)
    old = rows.select(c("id").alias("question_id"), (c("id") % 5 == 0).alias("passed"))
    left = evaluation.resume(chosen, old)
    new = left.select(c("id").alias("question_id"), (c("id") % 7 == 0).alias("passed"))
    return evaluation.merge_resumed(new, old)


SELECTION_SQL = """
WITH c AS (SELECT o_orderkey AS id FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 ORDER BY 1 LIMIT 20 OFFSET 2),
n AS (SELECT id AS question_id, id % 7 = 0 AS passed FROM c WHERE id % 5 <> 0)
SELECT * FROM n UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey NOT IN (SELECT question_id FROM n)"""


def summed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts of all orders, summed up, and smoke cases that hold."""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.create_map(F.concat(F.lit("fm"), c("o_orderkey") % 4), F.lit(1), F.lit("all"), F.lit(2)).alias("m"))
    sums = evaluation.sum_maps(rows, "m")
    ok = evaluation.smoke_cases(rows, {"even": c("o_orderkey") % 2 == 0, "small": c("o_orderkey") % 10 < 5}).where("ok").agg(F.count(F.lit(1)).alias("total")).select(F.lit("smoke").alias("key"), "total")
    return sums.unionByName(ok)


SUMMED_SQL = """
SELECT 'fm' || (o_orderkey % 4) AS key, count(*) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'all', 2 * count(*) FROM orders UNION ALL SELECT 'smoke', count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 < 5"""


# --- sources and stores ----------------------------------------------------------------------


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, their lines as pages of some length: which kind a file is."""
    pages = _lines(spark, sf_dir).select(c("l_orderkey").alias("path"), c("l_linenumber").alias("page"), F.repeat(F.lit("x"), (c("l_quantity") * (c("l_orderkey") % 40)).cast("int")).alias("text"))
    return readers.pdf_kind(pages)


PAGES_SQL = """
WITH m AS (SELECT l_orderkey AS path, avg(CAST(l_quantity * (l_orderkey % 40) AS INTEGER)) AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT path, CASE WHEN m > 500 THEN 'digital' WHEN m > 50 THEN 'scanned_ocr' ELSE 'scanned_pure' END AS kind FROM m"""


def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tables found by three strategies; the first that has rows wins its page."""
    n = c("l_linenumber")
    row = F.when(c("l_partkey") % 3 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit(" a\n"), "l_partkey"), F.lit("b")))
    found = _lines(spark, sf_dir).select(c("l_orderkey").alias("path"), (n % 2).alias("page"), (n % 3).alias("strategy_order"), F.concat(F.lit("s"), n % 3).alias("strategy"), F.array(F.lit("h"), F.lit(" k ")).alias("headers"), F.array(row).alias("rows"))
    return readers.best_tables(found).select("path", "page", "strategy", F.array_join("headers", "|").alias("headers"), F.array_join(F.get("rows", F.lit(0)), "|").alias("row"))


TABLES_SQL = """
WITH f AS (SELECT l_orderkey AS path, l_linenumber % 2 AS page, l_linenumber % 3 AS s, l_partkey FROM lineitem WHERE l_partkey % 3 <> 0),
b AS (SELECT *, min(s) OVER (PARTITION BY path, page) AS best FROM f)
SELECT path, page, 's' || s AS strategy, 'h|k' AS headers, 'a ' || l_partkey || '|b' AS row FROM b WHERE s = best"""


def file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of order lines: one for each stem, and of these the ones without a text of some length yet."""
    ext = F.element_at(F.array(*map(F.lit, [".doc", ".pdf", ".docx", ".txt"])), (c("l_partkey") % 4 + 1).cast("int"))
    files = _lines(spark, sf_dir).select(F.concat(F.lit("/in/"), "l_orderkey", ext).alias("path")).distinct()
    picked = readers.pick_files(files)
    extracted = picked.where("cast(stem as bigint) % 3 = 0").select("path", F.repeat(F.lit("t"), F.when(c("stem").cast("long") % 2 == 0, 100).otherwise(99)).alias("text"))
    return readers.cache_misses(picked, extracted)


FILES_SQL = """
WITH f AS (SELECT DISTINCT l_orderkey AS k, ['.doc', '.pdf', '.docx', '.txt'][l_partkey % 4 + 1] AS e FROM lineitem),
p AS (SELECT k, arg_min(e, CASE e WHEN '.docx' THEN 1 WHEN '.pdf' THEN 2 WHEN '.doc' THEN 3 ELSE 9 END) AS e FROM f GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS stem, '/in/' || k || e AS path FROM p WHERE NOT (k % 3 = 0 AND k % 2 = 0)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return one.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"), (c("l_orderkey") % 500).cast("string").alias("doc_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), F.concat(F.lit("t"), c("p") % 3).alias("kind"), c("p").alias("part"))


STORE_SQL = "s AS (SELECT l_orderkey || '_' || l_linenumber AS chunk_id, CAST(l_orderkey % 500 AS VARCHAR) AS doc_id, l_orderkey * 10 + l_linenumber AS seq, 't' || (min(l_partkey) % 3) AS kind, min(l_partkey) AS part, l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written to a store, scanned, put in again with other parts, some documents deleted, then counted."""
    path = new_table(spark, "store")
    readers.write_store(_store(spark, sf_dir), path)
    held = readers.scan_store(spark, path)
    after = readers.upsert(held, held.where("seq % 10 = 1").withColumn("part", F.lit(-1).cast("long")))
    gone = readers.delete_docs(after, after.where("cast(doc_id as int) % 7 = 0").select("doc_id"))
    changed = gone.groupBy("doc_id").agg(F.count_if(c("part") == -1).alias("changed"))
    return readers.count_store(gone).join(changed, "doc_id").unionByName(readers.scan_store(spark, path, "7").agg(F.count(F.lit(1)).alias("n")).select(F.lit("scan of 7").alias("doc_id"), "n", F.lit(0).cast("long").alias("changed")))


UPSERT_SQL = f"""WITH {STORE_SQL}
SELECT doc_id, count(*) AS n, CAST(count_if(n = 1) AS BIGINT) AS changed FROM s WHERE k % 500 % 7 <> 0 GROUP BY 1 UNION ALL SELECT 'scan of 7', count(*), 0 FROM s WHERE doc_id = '7'"""


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by id, missing ones absent, and the first chunks of one document."""
    store = staged(_store(spark, sf_dir))
    ids = _orders(spark, sf_dir).select(F.concat(c("o_orderkey").cast("string"), F.lit("_2")).alias("chunk_id"))
    return readers.by_ids(store, ids).select("chunk_id", "part").unionByName(readers.first_of_doc(store, "42", 3).select(F.concat(F.lit("first "), "chunk_id").alias("chunk_id"), "part"))


LOOKUP_SQL = f"""WITH {STORE_SQL}
SELECT chunk_id, part FROM s WHERE n = 2 AND k IN (SELECT o_orderkey FROM orders)
UNION ALL (SELECT 'first ' || chunk_id, part FROM s WHERE doc_id = '42' ORDER BY seq, chunk_id LIMIT 3)"""


def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text for each document of the store."""
    return readers.export_document(_store(spark, sf_dir).select("doc_id", "seq", "kind", "part"))


EXPORT_SQL = f"""
WITH {STORE_SQL},
t AS (SELECT doc_id, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS types FROM (SELECT doc_id, kind, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT doc_id, count(*) AS n, string_agg('{{"seq":' || seq || ',"kind":"' || kind || '","part":' || part || '}}', ',' ORDER BY seq) AS body FROM s GROUP BY 1)
SELECT doc_id, '{{"total_chunks":' || n || ',"chunk_types":' || types || ',"chunks":[' || body || ']}}' AS json FROM w JOIN t USING (doc_id)"""


def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations saved twice, some deleted, listed with their titles."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(c("conv_id") * 100 + c("turn")).alias("ts"))
    store = readers.save_sessions(m.where("conv_id % 2 = 0"), m.where("conv_id % 3 = 0"))
    kept = readers.delete_sessions(store, m.where("conv_id % 5 = 0").select("conv_id"))
    listed = readers.sessions(kept).select("conv_id", "title", F.unix_timestamp("updated_at").alias("updated_at"), "messages")
    one = readers.load_session(kept, 6).agg(F.lit(-6).cast("long").alias("conv_id"), F.array_join(F.collect_list("turn"), ",").alias("title"), F.lit(0).cast("long").alias("updated_at"), F.count(F.lit(1)).alias("messages"))
    return listed.unionByName(one)


SESSION_SQL = """
WITH m AS (SELECT * FROM conversations WHERE (conv_id % 2 = 0 OR conv_id % 3 = 0) AND conv_id % 5 <> 0)
SELECT conv_id, arg_min(text[1:60], CASE WHEN role = 'user' THEN turn END) AS title, max(conv_id * 100 + turn) AS updated_at, count(*) AS messages FROM m GROUP BY 1
UNION ALL SELECT -6, coalesce(string_agg(turn, ',' ORDER BY turn), ''), 0, count(*) FROM m WHERE conv_id = 6"""


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in two batches as JSON lines, read back."""
    path = new_table(spark, "log")
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    readers.append_log(o.where("o_orderkey % 2 = 0"), path)
    readers.append_log(o.where("o_orderkey % 2 <> 0"), path)
    return spark.read.schema(o.schema).json(path)


LOG_SQL = "SELECT o_orderkey, o_orderpriority FROM orders"


def parsed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as parsed documents in JSON, one of them broken, read back as nodes."""
    path = new_table(spark, "parsed")
    cust = table(spark, sf_dir, "customer")
    kid = F.struct(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit("khoan").alias("node_type"), c("c_custkey").cast("string").alias("node_index"), c("c_name").alias("content"), F.array(F.struct(F.concat(F.lit("doc_"), "c_custkey").alias("target_id"))).alias("references"))
    docs = cust.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", kid.alias("n")))).alias("ns"))
    root = F.struct(F.concat(F.lit("n"), "c_nationkey").alias("node_id"), F.lit("dieu").alias("node_type"), F.lit("1").alias("node_index"), F.transform("ns", lambda x: x["n"]).alias("children"))
    text = F.when(c("c_nationkey") == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("d"), "c_nationkey").alias("document_id")).alias("metadata"), F.array(root).alias("data"))))
    docs.select("c_nationkey", text.alias("value")).repartition(8, "c_nationkey").write.partitionBy("c_nationkey").text(path)
    rows = readers.read_parsed(spark, f"{path}/c_nationkey=*")
    return rows.select(F.when(c("error").isNull(), c("doc_id")).otherwise("bad").alias("doc_id"), "node_id", "parent_id", "depth", "node_type", "content", F.array_join("refs", ",").alias("refs"), c("error").isNotNull().alias("bad"))


PARSED_SQL = """
SELECT 'd' || c_nationkey AS doc_id, 'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id, CAST(1 AS INTEGER) AS depth, 'khoan' AS node_type, c_name AS content, 'doc_' || c_custkey AS refs, false AS bad FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT DISTINCT 'd' || c_nationkey, 'n' || c_nationkey, NULL, 0, 'dieu', '', '', false FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT DISTINCT 'bad', NULL, NULL, NULL, NULL, NULL, NULL, true FROM customer WHERE c_nationkey = 3"""


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as JSON, read back, and its lists counted; and the classic registry with one bad row."""
    path = new_table(spark, "manifest")
    m = manifest(spark).withColumn("allowed", c("status") == "superseded")
    entry = F.struct(c("doc_number"), c("name"), c("effective_from").cast("string").alias("effective_from"), c("effective_to").cast("string").alias("effective_to"), c("status"), c("superseded_by"), F.struct(c("allowed").alias("allowed")).alias("exception_use"))
    whole = m.agg(F.map_from_entries(F.collect_list(F.struct("doc_id", entry.alias("d")))).alias("documents")).withColumn("not_in_database", F.create_map(F.lit("40_2021"), F.struct(F.lit("Circular G").alias("name"), F.lit("none").alias("note"))))
    whole.coalesce(1).write.json(path)
    docs, missing = readers.read_manifest(spark, path)
    lists = {**readers.manifest_lists(docs), "missing": missing}
    counted = None
    for name, df in lists.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "n")
        counted = one if counted is None else counted.unionByName(one)
    other = new_table(spark, "registry")
    rows = spark.createDataFrame([('[{"doc_id":"a","name":"A","effective_from":"2026-01-01","extra":1}, {"doc_id":"b","name":"B"}]',), ('{"doc_id": 5, "name"',)], "value string")
    rows.repartition(2).write.text(other)
    found = readers.read_registry_json(spark, other, "doc_id string, name string, effective_from date")
    listed = analytics.registry_list(found.where("_corrupt_record is null and doc_id is not null")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(listed.select(F.concat(F.lit("listed_"), "status").alias("list"), "n"))


MANIFEST_SCAN_SQL = f"""
SELECT 'active' AS list, count_if(status LIKE 'active%') AS n FROM {MANIFEST_SQL} UNION ALL SELECT 'superseded', count_if(status = 'superseded') FROM {MANIFEST_SQL}
UNION ALL SELECT 'exceptions', count_if(status = 'superseded') FROM {MANIFEST_SQL} UNION ALL SELECT 'all', count(*) FROM {MANIFEST_SQL} UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'listed_active', 1 UNION ALL SELECT 'listed_unknown', 1"""


def registry_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registered documents: those of one category, by rank."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("doc_id"), c("p_brand").alias("category"), (c("p_partkey") % 4).alias("legal_level"))
    return analytics.by_category(p, "Brand#13").select("doc_id", "place")


CATEGORY_SQL = "SELECT p_partkey AS doc_id, CAST(row_number() OVER (ORDER BY p_partkey % 4, p_partkey) AS INTEGER) AS place FROM part WHERE p_brand = 'Brand#13'"


def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as word-processor files, one of them broken, scanned: their text and the rows of their tables."""
    import io
    import zipfile

    folder = new_table(spark, "docx")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    words = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    for k, name in ((r[0], r[1]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()):  # twenty-five rows
        cells = "".join(f"<w:tr><w:tc>{words(a)}</w:tc><w:tc>{words(b)}</w:tc></w:tr>" for a, b in [("h", "k"), ("", ""), *[(name, i) for i in range(k % 3)]])
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{words("Điều 1 " + name)}<w:p/><w:tbl>{cells}</w:tbl></w:body></w:document>')
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}.docx")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(data.getvalue() if k != 7 else b"broken"))
        out.close()
    rows = readers.read_office(spark, folder)
    return rows.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("int").alias("k"), "text", F.coalesce(F.size("tables"), F.lit(0)).alias("tables"), F.coalesce(F.size(F.try_element_at("tables", F.lit(1))["rows"]), F.lit(0)).alias("n_rows"), c("error").isNotNull().alias("bad"))


DOCX_SQL = """
SELECT CAST(n_nationkey AS INTEGER) AS k, CASE WHEN n_nationkey <> 7 THEN 'Điều 1. ' || n_name END AS text, CAST(CASE WHEN n_nationkey <> 7 AND n_nationkey % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS tables,
  CAST(CASE WHEN n_nationkey <> 7 THEN n_nationkey % 3 ELSE 0 END AS INTEGER) AS n_rows, n_nationkey = 7 AS bad FROM nation"""


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts with their lines in a table of pipes, taken out of the text."""
    line = F.concat(F.lit("| "), c("l_linenumber"), F.lit(" | "), c("l_partkey"), F.when(c("l_linenumber") % 2 == 0, F.lit(" | x |")).otherwise(F.lit("|")))
    texts = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("s")))), lambda x: x["s"]), "\n").alias("rows"))
    made = texts.select(c("l_orderkey").alias("path"), F.concat(F.lit("before\n| no | part |\n|---|---|\n"), "rows", F.lit("\nafter\n|alone|")).alias("text"))
    out = readers.split_tables(made.withColumn("path", c("path").cast("string")))
    first = F.try_element_at("tables", F.lit(1))
    return out.select("path", "text", F.size("tables").alias("n"), F.size(first["headers"]).alias("width"), F.size(first["rows"]).alias("n_rows"))


PIPE_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS path, 'before' || chr(10) || 'after' || chr(10) || '|alone|' AS text, CAST(1 AS INTEGER) AS n, CAST(CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 3 ELSE 2 END AS INTEGER) AS width, CAST(count(*) AS INTEGER) AS n_rows FROM lineitem GROUP BY 1"""


def table_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a table each; patches add a second one to some and try to add the first again to others."""
    from lexmill.operators import parse

    k = c("o_orderkey")
    o = _orders(spark, sf_dir)
    held = o.select(k.cast("string").alias("doc_id"), F.lit(0).alias("table_index"), F.lit(1).alias("page_number"), F.array(F.lit("h")).alias("headers"), F.array(F.array(c("o_orderpriority"))).alias("rows"))
    value = F.to_json(F.struct(F.when(k % 3 == 0, 1).otherwise(0).alias("table_index"), F.lit(2).alias("page_number"), F.array(F.lit("new")).alias("headers"), F.array(F.array(c("o_orderstatus"))).alias("rows")))
    patches = o.where("o_orderkey % 3 = 0 or o_orderkey % 5 = 0").select(k.cast("string").alias("doc_id"), F.lit(1).alias("op_seq"), F.lit("add_table").alias("op"), value.alias("value"))
    return parse.add_tables(held, patches).select("doc_id", "table_index", "page_number", F.get("headers", F.lit(0)).alias("head"), F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("cell"))


PATCHES_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(0 AS INTEGER) AS table_index, CAST(1 AS INTEGER) AS page_number, 'h' AS head, o_orderpriority AS cell FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 2, 'new', o_orderstatus FROM orders WHERE o_orderkey % 3 = 0"""


def min_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, started at least an hour apart, waits adding up."""
    e = table(spark, sf_dir, "events").select(c("user_id").alias("key"), c("event_id").alias("seq"), (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("t"))
    return state.min_interval(e, 3600.0).select("key", "seq", F.round("start").alias("start"))


INTERVAL_SQL = """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(key, seq, n, start) AS (SELECT key, seq, n, t FROM e WHERE n = 1 UNION ALL SELECT e.key, e.seq, e.n, greatest(e.t, w.start + 3600.0) FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT key, seq, round(start)::DOUBLE AS start FROM w"""


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of orders with two citations, one repeated, numbered."""
    from lexmill.functions.text import numbered_citations

    k = c("o_orderkey")
    answer = F.concat(F.lit("Theo Điều "), k % 9 + 1, F.lit(" của 68/2026/NĐ-CP, điều "), k % 4 + 1, F.lit(" Luật 109/2025/QH15, Điều "), k % 9 + 1, F.lit(" của 68/2026/NĐ-CP"))
    return numbered_citations(_orders(spark, sf_dir).select(k.alias("answer_id"), answer.alias("answer")))


CITED_SQL = """
SELECT o_orderkey AS answer_id, CAST(1 AS INTEGER) AS number, '68/2026/NĐ-CP' AS document, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS article FROM orders
UNION ALL SELECT o_orderkey, 2, '109/2025/QH15', CAST(o_orderkey % 4 + 1 AS VARCHAR) FROM orders"""


# --- tools and table functions ---------------------------------------------------------------


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool called for orders: how many calls are ok, and which errors come back."""
    o = _orders(spark, sf_dir)
    k = c("o_orderkey")
    rows = o.select(k.alias("query_id"), F.when(k % 5 != 0, c("o_totalprice")).otherwise(F.lit(-1.0)).alias("annual_revenue"), F.when(k % 3 == 0, "goods").otherwise("nothing").alias("business_category"), (k % 4 - 1).cast("int").alias("dependents"), F.lit(12).alias("months"), F.when(k % 2 == 0, "109_2025").otherwise("zz").alias("doc_id"))
    calls = [("calculate_tax_hkd", {}), ("calculate_deduction", {}), ("calculate_tax_hkd_profit", {}), ("nothing", {}), ("check_doc_validity", {"manifest": manifest(spark), "missing": spark.createDataFrame([], "doc_id string, name string, note string"), "as_of": F.to_date(F.lit("2026-01-01"))})]
    out = None
    for name, tables in calls:
        one = registry.run_tool(name, rows, **tables).groupBy(F.lit(name).alias("tool"), "ok", "error").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


TOOL_SQL = """
WITH r AS (SELECT o_orderkey AS k FROM orders),
x AS (SELECT 'calculate_tax_hkd' AS tool, CASE WHEN k % 5 = 0 THEN 'negative revenue' WHEN k % 3 <> 0 THEN 'unknown category' END AS error FROM r
UNION ALL SELECT 'calculate_deduction', CASE WHEN k % 4 = 0 THEN 'negative dependents' END FROM r UNION ALL SELECT 'calculate_tax_hkd_profit', 'missing annual_expenses, profit_rate' FROM r
UNION ALL SELECT 'nothing', 'unknown tool nothing' FROM r UNION ALL SELECT 'check_doc_validity', NULL FROM r)
SELECT tool, error IS NULL AS ok, error, count(*) AS n FROM x GROUP BY ALL"""


def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table functions in SQL: lines of made documents with their kinds, packed lines of tables, brackets of incomes."""
    registry.register(spark)
    li = _lines(spark, sf_dir)
    li.groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.lpad(c("l_partkey").cast("string"), 8, "0"))).alias("ls")).createOrReplaceTempView("lexmill_lines")
    lines = spark.sql("SELECT 'lines ' || kind AS what, count(*) AS n FROM (SELECT 'Điều ' || k || '. a\n1. clause\n' || concat_ws('\n', ls) AS t FROM lexmill_lines) d, LATERAL document_lines(d.t) GROUP BY 1")
    parts = spark.sql("SELECT 'part ' || part AS what, count(*) AS n FROM lexmill_lines d, LATERAL table_chunks('h', d.ls, 24) GROUP BY 1")
    brackets = spark.sql("SELECT 'bracket ' || bracket AS what, count(*) AS n FROM (SELECT CAST(k AS DOUBLE) * 1000 AS income FROM lexmill_lines) d, LATERAL progressive_brackets(d.income) GROUP BY 1")
    return lines.unionByName(parts).unionByName(brackets)


FUNCTION_SQL = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'lines dieu' AS what, count(*) AS n FROM l UNION ALL SELECT 'lines khoan', count(*) FROM l UNION ALL SELECT 'lines text', CAST(sum(n) AS BIGINT) FROM l
UNION ALL SELECT 'part ' || p, count(*) FROM l, range(0, 10) t(p) WHERE 2 * p < n GROUP BY 1
UNION ALL SELECT 'bracket ' || b, count(*) FROM l JOIN (VALUES (1, 0.0), (2, 1.2e8), (3, 3.6e8), (4, 7.2e8), (5, 1.2e9)) v(b, lo) ON k * 1000 > lo GROUP BY 1"""


PAIRS = [
    (latest_nodes, LATEST_SQL), (resolve_external, RESOLVE_SQL), (descendants, DESCENDANTS_SQL), (first_article, ARTICLE_SQL), (holds_phrase, PHRASE_SQL), (article_context, CONTEXT_SQL), (valid_by_rank, RANK_SQL),
    (explanation_edges, EXPLAIN_SQL), (chunk_conflicts, CONFLICT_SQL), (hierarchy_conflicts, HIERARCHY_SQL), (merge_facts, MERGE_FACTS_SQL), (verify_facts, VERIFY_SQL), (order_facts, ORDER_FACTS_SQL), (fact_recall, RECALL_SQL),
    (scope_injection, SCOPE_SQL), (exception_expand, EXCEPTION_SQL), (specific_filter, SPECIFIC_SQL), (co_retrieval, CO_SQL), (topic_pool, POOL_SQL), (context_order, CONTEXT_ORDER_SQL), (bad_transitions, TRANSITION_SQL), (answer_logs, LOGS_SQL),
    (chunk_checks, CHUNK_CHECKS_SQL), (ingest_gate, GATE_SQL), (snapshot_diff, DIFF_SQL), (parse_coverage, COVERAGE_SQL), (stage_checks, STAGE_SQL), (supersession_tags, TAGS_SQL), (annotation_run, ANNOTATION_SQL),
    (cache_store, CACHE_STORE_SQL), (retained_logs, RETAINED_SQL), (missing_facts, MISSING_SQL), (question_selection, SELECTION_SQL), (summed_counts, SUMMED_SQL), (page_kinds, PAGES_SQL), (best_tables, TABLES_SQL), (file_choice, FILES_SQL),
    (store_upsert, UPSERT_SQL), (store_lookup, LOOKUP_SQL), (document_export, EXPORT_SQL), (session_store, SESSION_SQL), (answer_log, LOG_SQL), (parsed_scan, PARSED_SQL), (manifest_scan, MANIFEST_SCAN_SQL), (registry_category, CATEGORY_SQL),
    (docx_scan, DOCX_SQL), (pipe_tables, PIPE_SQL), (table_patches, PATCHES_SQL), (min_interval, INTERVAL_SQL), (citation_numbers, CITED_SQL), (tool_calls, TOOL_SQL), (table_functions, FUNCTION_SQL),
]
QUERIES = [f for f, _ in PAIRS]
SQL = {f.__name__: s for f, s in PAIRS}
