"""Queries of ranked retrieval on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.staging import hint_if_small
from lexmill.operators import classify, postings, search, vectors
from lexmill.plans.common import table

WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
#: Scopes, triggers and topics for the English conversations.
SCOPES = {"PIT": ["the", "this"], "HKD": ["tion", "ment"], "TMDT": ["wh", "sh"], "PENALTY": ["ble", "ou"]}
TRIGGERS = [("r1", "tion", "src1"), ("r1", "tion", "src2"), ("r2", "ment", "src3"), ("r3", "keit", "src4"), ("r4", "ción", "src5")]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Stored indexes by application and table: built by the first query that needs one, in the shared folder.
_INDEXES: dict[tuple[str, str], postings.KeywordIndex] = {}


def keywords_of(spark: SparkSession, sf_dir: str) -> postings.KeywordIndex:
    """The stored keyword index of the documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = postings.build_index(table(spark, sf_dir, "documents"))
    return _INDEXES[key]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.bm25_indexed(keywords_of(spark, sf_dir), _items(spark, sf_dir), 10)


def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id")
    return postings.bm25_indexed(keywords_of(spark, sf_dir), _items(spark, sf_dir), 5, keep=keep)


def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking without an index: texts are tokenised for the batch."""
    return search.bm25(_items(spark, sf_dir), table(spark, sf_dir, "documents"), 10)


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index says of every term: documents, idf, occurrences, and the highest gain of its blocks."""
    index = keywords_of(spark, sf_dir)
    occurrences = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))
    blocks = index.postings(spark).groupBy("term").agg(F.sum(F.size("ids")).alias("postings"), occurrences.alias("occurrences"), F.round(F.max("most"), 6).alias("most"))
    return index.terms(spark).select("term", "df", F.round("idf", 6).alias("idf")).join(blocks, "term")


KEYWORD_INDEX_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS most FROM tf, c GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM t, c)
SELECT term, df, df AS postings, occurrences, round(most, 6) AS most,
       round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM t JOIN raw USING (term)"""


def bm25_sql(k: int, keep: str = "true") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, c),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d WHERE {keep}) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN q USING (term) JOIN idf USING (term), c GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, rank, score FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_top(*_vectors(spark, sf_dir), 10)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_top(*_vectors(spark, sf_dir), 10, keep=F.col("label") == 1)


_LISTS: dict[tuple[str, str], vectors.VectorIndex] = {}


def _vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored index of the vectors, with their labels."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LISTS:
        _LISTS[key] = vectors.build_vector_index(_vectors(spark, sf_dir)[1])
    return _LISTS[key]


def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_top_indexed(_vector_index(spark, sf_dir), _vectors(spark, sf_dir)[0], 10, exact=True)


def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_top_indexed(_vector_index(spark, sf_dir), _vectors(spark, sf_dir)[0], 10, keep=F.col("label") == 1, exact=True)


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest the partial search finds for each query, and whether it is nine in ten of all."""
    asked = _vectors(spark, sf_dir)[0]
    some = vectors.vector_top_indexed(_vector_index(spark, sf_dir), asked, 10).select("query_id", "chunk_id")
    met = vector_topk(spark, sf_dir).join(some.withColumn("found", F.lit(1)), ["query_id", "chunk_id"], "left")
    return met.agg(F.count(F.lit(1)).alias("nearest"), (F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"))


RECALL_SQL = "SELECT sum(least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS nearest, true AS nine_in_ten FROM embeddings WHERE vec_id % 100 = 0"


def vector_sql(keep: str = "true", k: int = 10) -> str:
    d = lambda a, b: f"list_dot_product(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))"
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({d("q", "c")} / (sqrt({d("q", "q")}) * sqrt({d("c", "c")})), 6) AS score
           FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.{keep}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
SELECT query_id, chunk_id, rank, score FROM r WHERE rank <= {k}""".replace("c.true", "true")


def _events_pool(spark: SparkSession, sf_dir: str, order: list) -> DataFrame:
    """Events of a user, best first: a ranked pool."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "value", "ts")
    return search.top(rows, 15, *order)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _events_pool(spark, sf_dir, [F.desc("value"), F.col("chunk_id")])
    b = _events_pool(spark, sf_dir, [F.desc("ts"), F.col("chunk_id")])
    return search.rrf([(a, search.VECTOR_WEIGHT), (b, search.BM25_WEIGHT)], 5)


RRF_SQL = """
WITH a AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
b AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events),
u AS (SELECT *, 0 AS pool, 0.7 / (60 + rank) AS share FROM a WHERE rank <= 15 UNION ALL SELECT *, 1, 0.3 / (60 + rank) FROM b WHERE rank <= 15),
f AS (SELECT query_id, chunk_id, round(sum(share), 6) AS rrf_score, min(pool * 1000 + rank) AS first FROM u GROUP BY ALL),
r AS (SELECT query_id, chunk_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, chunk_id) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE rank <= 5"""


def _order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of their customers."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.round(F.col("o_totalprice") / 1e7, 4).alias("rrf_score"), "o_orderdate", "o_orderstatus")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")))


ORDER_HITS = """h AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, o_orderkey AS doc_id, round(o_totalprice / 1e7, 4) AS rrf_score, o_orderdate, o_orderstatus,
row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 1e7, 4) DESC, o_orderkey) AS rank FROM orders)"""


def authority_recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("legal_level"), F.to_date("o_orderdate").alias("effective_from"))
    return search.boost_authority(_order_hits(spark, sf_dir), reg, F.to_date(F.lit("2001-09-01"))).select("query_id", "chunk_id", "rrf_score", "rank")


AUTHORITY_SQL = f"""
WITH {ORDER_HITS},
s AS (SELECT query_id, chunk_id, rank AS before, round(rrf_score * CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE
  (CASE doc_id % 5 + 1 WHEN 1 THEN 1.10 WHEN 2 THEN 1.07 WHEN 3 THEN 1.05 WHEN 4 THEN 1.0 ELSE 0.85 END)
  * (1 + 0.15 / (1 + ln(1 + greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01'), 0) / 365))) END, 6) AS rrf_score FROM h)
SELECT query_id, chunk_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, before, chunk_id) AS INTEGER) AS rank FROM s"""


def supersession_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _order_hits(spark, sf_dir).withColumn("superseded", F.col("o_orderstatus") == "F")
    return search.penalise_superseded(hits, F.col("query_id") % 3 == 0).select("query_id", "chunk_id", "rrf_score", "rank")


SUPERSESSION_SQL = f"""
WITH {ORDER_HITS},
s AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN o_orderstatus = 'F' AND query_id % 3 <> 0 THEN round(rrf_score * 0.25, 6) ELSE rrf_score END AS rrf_score FROM h)
SELECT query_id, chunk_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, before, chunk_id) AS INTEGER) AS rank FROM s"""


def expired_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("effective_to"))
    hits = _order_hits(spark, sf_dir)
    ended = reg.where(F.col("effective_to") < F.to_date(F.lit("1998-01-01"))).select("doc_id")
    return hits.join(ended, "doc_id", "left_anti").select("query_id", "doc_id", "rrf_score")


EXPIRED_SQL = f"WITH {ORDER_HITS} SELECT query_id, doc_id, rrf_score FROM h WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01'"


def exclude_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return search.exclude(_order_hits(spark, sf_dir), out).select("query_id", "doc_id", "rrf_score")


EXCLUDE_SQL = f"WITH {ORDER_HITS} SELECT query_id, doc_id, rrf_score FROM h WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    found = c.select("conv_id", "turn", classify.classify_scope(F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit("CALCULATION")), SCOPES).alias("s"))
    return found.select("conv_id", "turn", F.array_join("s.scopes", ",").alias("scopes"), F.col("s.confidence").alias("confidence"))


def _scope_sql() -> str:
    n = ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{'|'.join(w)}')) AS n{i}" for i, w in enumerate(SCOPES.values()))
    met = ", ".join(f"CASE WHEN n{i} > 0 THEN '{s}' END" for i, s in enumerate(SCOPES))
    return f"""
WITH n AS (SELECT conv_id, turn, turn % 2 = 0 AS calc, {n} FROM conversations),
t AS (SELECT *, n0 + n1 + n2 + n3 AS total, greatest(n0, n1, n2, n3) AS most, concat_ws(',', {met}) AS met FROM n)
SELECT conv_id, turn, CASE WHEN total = 0 THEN CASE WHEN calc THEN 'PIT,HKD' ELSE 'ALL' END WHEN most / total < 0.4 THEN 'ALL'
  WHEN calc AND n0 = 0 AND n1 = 0 THEN met || ',PIT' ELSE met END AS scopes,
  CASE WHEN total = 0 THEN CASE WHEN calc THEN 0.45 ELSE 0.0 END ELSE round(most / total, 6) END AS confidence FROM t"""


def scope_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_hits(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("d"), (F.col("chunk_id") % 6).cast("string")))
    scopes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("TMDT"), F.lit("HKD"))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("PIT"))).otherwise(F.array(F.lit("ALL"))).alias("scopes"))
    docs = spark.createDataFrame([("PIT", "d1"), ("PIT", "d2"), ("HKD", "d3"), ("TMDT", "d3"), ("TMDT", "d4")], "scope string, doc_id string")
    return search.boost_scope(o, scopes, docs).select("query_id", "chunk_id", "rrf_score", "rank")


SCOPE_BOOST_SQL = f"""
WITH {ORDER_HITS},
s AS (SELECT query_id, chunk_id, rank AS before, round(rrf_score * CASE WHEN query_id % 4 = 0 AND chunk_id % 6 IN (3, 4) THEN 1.5 WHEN query_id % 4 = 1 AND chunk_id % 6 IN (1, 2) THEN 1.3 ELSE 1.0 END, 6) AS rrf_score FROM h)
SELECT query_id, chunk_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, before, chunk_id) AS INTEGER) AS rank FROM s"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of several forms, made from orders."""
    k = F.col("o_orderkey")
    n = (k % 40 + 1).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Điều "), n))
        .when(k % 6 == 1, F.concat(F.lit("Văn bản này còn hiệu lực từ thời điểm nào và áp dụng cho ai trong năm "), n))
        .when(k % 6 == 2, F.concat(F.lit("Nghị định nào hướng dẫn luật này theo Điều "), n))
        .when(k % 6 == 3, F.concat(F.lit("Tôi có thu nhập "), n, F.lit(" triệu thì phải nộp bao nhiêu tiền thuế mỗi tháng")))
        .when(k % 6 == 4, F.concat(F.lit("Theo khoản 2 Điều "), n, F.lit(" của 109/2025/QH15")))
        .otherwise(F.concat(F.lit("Thời tiết hôm nay ra sao "), n))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), text.alias("text"))


QUESTIONS_SQL = """q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 6 WHEN 0 THEN 'Điều ' || n WHEN 1 THEN 'Văn bản này còn hiệu lực từ thời điểm nào và áp dụng cho ai trong năm ' || n
WHEN 2 THEN 'Nghị định nào hướng dẫn luật này theo Điều ' || n WHEN 3 THEN 'Tôi có thu nhập ' || n || ' triệu thì phải nộp bao nhiêu tiền thuế mỗi tháng'
WHEN 4 THEN 'Theo khoản 2 Điều ' || n || ' của 109/2025/QH15' ELSE 'Thời tiết hôm nay ra sao ' || n END AS text FROM (SELECT *, CAST(o_orderkey % 40 + 1 AS VARCHAR) AS n FROM orders))"""


def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).select("query_id", classify.classify_query(F.col("text")).alias("c"))
    return q.select("query_id", "c.intent", F.array_join("c.article_refs", "|").alias("articles"), F.array_join("c.doc_refs", "|").alias("documents"), "c.needs_validity", "c.needs_guidance", "c.needs_cross_doc")


QUERY_SQL = rf"""
WITH {QUESTIONS_SQL},
f AS (SELECT query_id, text, lower(text) AS l, regexp_extract_all(text, '(?i)(?:điều|Điều|khoản|Khoản)\s+\d+[a-zđ]?') AS a,
  regexp_matches(lower(text), 'còn hiệu lực|thời điểm|hiện (nay|tại|đang)') AS v, regexp_matches(lower(text), 'nghị định nào|hướng dẫn (luật|nghị định)|theo (luật|nghị định|thông tư)') AS x FROM q),
i AS (SELECT *, CASE WHEN len(a) > 0 AND len(string_split(text, ' ')) <= 8 AND NOT x THEN 'DIRECT_LOOKUP' WHEN v THEN 'VALIDITY_CHECK' WHEN x THEN 'CROSS_DOC'
  WHEN regexp_matches(l, 'bao nhiêu tiền|phải nộp|\d+\s*(triệu|nghìn|đồng)') THEN 'CALCULATION' ELSE 'GENERAL_QA' END AS intent FROM f)
SELECT query_id, intent, array_to_string(a, '|') AS articles, array_to_string(regexp_extract_all(text, '\d{{1,4}}/\d{{4}}/[A-ZĐ]{{2,20}}'), '|') AS documents,
  v OR intent = 'VALIDITY_CHECK' AS needs_validity, intent NOT IN ('DIRECT_LOOKUP', 'CROSS_DOC') AS needs_guidance, x OR intent = 'CROSS_DOC' AS needs_cross_doc FROM i"""


def pre_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("query_id", classify.pre_route(F.col("text")).alias("route"), classify.is_off_topic(F.col("text")).alias("off_topic"))


PRE_ROUTE_SQL = f"WITH {QUESTIONS_SQL} SELECT query_id, CASE WHEN query_id % 6 = 5 THEN 'reject' ELSE 'pass' END AS route, query_id % 6 IN (1, 5) AS off_topic FROM q WHERE query_id % 6 <> 0 UNION ALL SELECT query_id, 'pass', false FROM q WHERE query_id % 6 = 0"


def topic_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(TRIGGERS, "rule string, keyword string, doc_id string").coalesce(1)
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return search.triggered(c, rules)


TOPIC_SQL = "SELECT DISTINCT conv_id * 1000 + turn AS query_id, rule, doc_id FROM conversations JOIN (VALUES " + ", ".join(str(t) for t in TRIGGERS) + ") r(rule, keyword, doc_id) ON contains(lower(text), keyword)"


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as numbered sub-points of their order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("parent"), F.col("l_orderkey").cast("string").alias("parent_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("doc_id"), "l_quantity", "l_orderkey")


def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _line_chunks(spark, sf_dir)
    hits = li.where("number = 3").select((F.col("parent") % 50).alias("query_id"), "chunk_id", "parent", "number", F.round(F.col("l_quantity") / 1000, 6).alias("rrf_score"), F.lit("theo quy định").alias("text"))
    return search.expand_siblings(hits, li.select("chunk_id", "parent", "number"))


SIBLING_SQL = """
SELECT h.l_orderkey % 50 AS query_id, s.l_orderkey || '_' || s.l_linenumber AS chunk_id, round(max(round(h.l_quantity / 1000, 6) * 0.6), 6) AS rrf_score
FROM lineitem h JOIN lineitem s ON h.l_orderkey = s.l_orderkey AND abs(s.l_linenumber - h.l_linenumber) BETWEEN 1 AND 2 WHERE h.l_linenumber = 3 GROUP BY 1, 2"""


def children_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.round(F.col("o_totalprice") / 1e7, 4).alias("rrf_score"), F.col("o_orderkey").alias("rank"), F.lit("gồm:").alias("text"))
    return search.expand_children(hits, _line_chunks(spark, sf_dir).select("chunk_id", "parent_id", "number")).select("query_id", "chunk_id", "child_expansion_of", "rrf_score", "pos")


CHILDREN_SQL = """
WITH c AS (SELECT o_custkey AS query_id, l_orderkey || '_' || l_linenumber AS chunk_id, CAST(o_orderkey AS VARCHAR) AS child_expansion_of, round(round(o_totalprice / 1e7, 4) * 0.85, 6) AS rrf_score,
  o_orderkey AS k, l_linenumber AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_linenumber BETWEEN 1 AND 6),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, k, n, chunk_id) AS INTEGER) AS pos FROM c)
SELECT query_id, chunk_id, child_expansion_of, rrf_score, pos FROM r WHERE pos <= 4"""


def reference_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to the parts of their lines; a part is met once for each customer."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    chunks = li.select(F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"), F.transform("l", lambda x: F.concat(F.lit("p"), x["l_partkey"])).alias("refs"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.array().cast("array<string>").alias("refs"))
    o = table(spark, sf_dir, "orders")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("rank"), F.round(F.col("o_totalprice") / 1e7, 4).alias("rrf_score"))
    return search.expand_references(hits, chunks.unionByName(parts)).select("query_id", "chunk_id", "expanded_from", "rrf_score")


REFERENCE_SQL = """
WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem),
c AS (SELECT o_custkey AS query_id, 'p' || l_partkey AS chunk_id, 'o' || o_orderkey AS expanded_from, round(round(o_totalprice / 1e7, 4) * 0.7, 6) AS rrf_score,
  row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderkey, pos) AS n
  FROM orders JOIN l ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE pos <= 3 AND round(o_totalprice / 1e7, 4) >= 0.005)
SELECT query_id, chunk_id, expanded_from, rrf_score FROM c WHERE n = 1"""


def amendment_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation's leading parts stand for amending documents; their first parts are their chunks."""
    li = table(spark, sf_dir, "lineitem")
    chunks = li.select(F.concat_ws("_", "l_suppkey", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    supp = li.groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])).alias("amended_by"))
    hits = o.join(supp, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("rank"), F.lit(0.01).alias("rrf_score"), "amended_by")
    return search.expand_amendments(hits, chunks).select("query_id", "chunk_id", "amendment_of")


AMENDMENT_SQL = """
WITH c AS (SELECT l_suppkey || '_' || l_orderkey || '_' || l_linenumber AS chunk_id, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey || '_' || l_orderkey || '_' || l_linenumber) AS pos FROM lineitem),
a AS (SELECT o_custkey AS query_id, l_suppkey, min(o_orderkey) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT query_id, chunk_id, CAST(min(k) AS VARCHAR) AS amendment_of FROM a JOIN c USING (l_suppkey) WHERE pos <= 3 GROUP BY 1, 2"""


def ood_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    return search.ood_signal(_order_hits(spark, sf_dir), c)


OOD_SQL = f"""
WITH {ORDER_HITS},
t AS (SELECT query_id, max(rrf_score) AS top1, max(CASE WHEN rank = 2 THEN rrf_score END) AS top2 FROM h GROUP BY 1)
SELECT c_custkey AS query_id, top1, round(top1 - top2, 6) AS gap, coalesce(top1 IS NULL OR top1 < 0.005 OR coalesce(round(top1 - top2, 6) < 0.0008, false), false) AS is_ood FROM customer LEFT JOIN t ON query_id = c_custkey"""


def exception_router_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("d"))
    sims = v.join(hint_if_small(first, 64 + 4 * F.size("d")), "label").select(F.col("label").cast("string").alias("doc_id"), (F.col("vec_id") % 2 == 0).alias("should_match"), F.round(search.cosine(F.col("embedding"), F.col("d")), 6).alias("similarity"))
    return search.calibrate(sims)


CALIBRATE_SQL = """
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS d FROM embeddings GROUP BY 1),
s AS (SELECT CAST(label AS VARCHAR) AS doc_id, vec_id % 2 = 0 AS y, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(d AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(d AS DOUBLE[]), CAST(d AS DOUBLE[])))), 6) AS s
  FROM embeddings JOIN f USING (label)),
t AS (SELECT doc_id, round(0.95 * min(CASE WHEN y THEN s END), 4) AS u, round(1.10 * max(CASE WHEN NOT y THEN s END), 4) AS l FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(u > l, false) THEN u ELSE 0.72 END AS upper, CASE WHEN coalesce(u > l, false) THEN l ELSE 0.5 END AS lower FROM t"""


def intent_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda n, prefix: F.array(F.concat(F.lit(prefix), (k % n).cast("string")))
    content = F.when(k % 4 == 0, "tax_rate").when(k % 4 == 1, "threshold").otherwise("other")
    bonus = search.intent_bonus(pick(3, "d"), pick(5, "a"), pick(2, "w"), content, k % 7 == 0, F.array(F.lit("d1")), F.array(F.lit("a2")), F.array(F.lit("w0")), F.lit(True))
    return p.select("p_partkey", F.round(bonus, 6).alias("bonus"))


INTENT_SQL = """
SELECT p_partkey, round(least(0.15, CASE WHEN p_partkey % 3 = 1 THEN 0.05 ELSE 0 END + CASE WHEN p_partkey % 5 = 2 THEN 0.1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.05 ELSE 0 END
 + CASE p_partkey % 4 WHEN 0 THEN 0.15 WHEN 1 THEN 0.075 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS bonus FROM part"""


def exception_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors as hits of their labels' documents; labels of even number are superseded and described by their first vector."""
    asked, items = _vectors(spark, sf_dir)
    found = search.vector_top(asked, items.select("chunk_id", "v"), 10).join(items.select("chunk_id", F.col("label").alias("doc_id")), "chunk_id")
    hits = found.select("query_id", "chunk_id", "doc_id", "rank", F.round(1 / (60 + F.col("rank")), 6).alias("rrf_score"))
    entries = items.where("label % 2 = 0").groupBy(F.col("label").alias("doc_id")).agg(F.min_by("v", "chunk_id").alias("description"))
    entries = entries.withColumns({"upper": F.lit(0.2), "lower": F.lit(-0.05)})
    return search.route_exceptions(hits, asked, entries).select("query_id", "chunk_id", "final_score", "exception_tier", "rank")


_DOT = lambda a, b: f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_COS = lambda a, b: f"({_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)})))"
ROUTING_SQL = f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS doc_id, q.embedding AS q, round({_COS("q.embedding", "c.embedding")}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
e AS (SELECT label AS doc_id, arg_min(embedding, vec_id) AS d FROM embeddings WHERE label % 2 = 0 GROUP BY label),
n AS (SELECT query_id, chunk_id, rank, round(1 / (60 + rank), 6) AS rrf_score, CASE WHEN d IS NOT NULL THEN {_COS("q", "d")} END AS near FROM h LEFT JOIN e USING (doc_id) WHERE rank <= 10),
t AS (SELECT *, CASE WHEN near >= 0.2 THEN 'allow' WHEN near <= -0.05 THEN 'block' WHEN near IS NOT NULL THEN 'soft' END AS exception_tier FROM n),
f AS (SELECT *, round(rrf_score * CASE exception_tier WHEN 'block' THEN 0.05 WHEN 'soft' THEN 0.35 ELSE 1.0 END, 6) AS final_score FROM t)
SELECT query_id, chunk_id, final_score, exception_tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank, chunk_id) AS INTEGER) AS rank FROM f"""

#: Evidence for the English conversations.
EVIDENCE = {
    "who": {"HKD": [("tion", 0.7), ("ing", 0.4)], "individual": [("ment|ness", 0.6), ("ly", 0.5)], "employer": [("^the", 1.0)]},
    "activity": {"goods": [("er", 0.8)], "services": [("st", 0.8), ("nd", 0.3)], "rental": [("ou", 0.9)]},
    "domain": {"HKD": [("an", 0.8), ("re", 0.3)], "PIT": [("en", 1.0)]},
    "intent": {"calculate": [("\\?", 1.0), ("ble", 0.7)], "explain": [("th", 0.6)]},
}


def intent_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is about, by weighted evidence, with the confidence of it."""
    i = classify.query_intent(F.col("text"), EVIDENCE)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", i.alias("i"))
    return rows.select("conv_id", "turn", "i.who", F.array_join("i.activities", "|").alias("activities"), F.array_join("i.domains", "|").alias("domains"), "i.intent", "i.requires_calculation", "i.year", "i.confidence")


INTENT_BUILDER_SQL = """
WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, regexp_extract(text, '(20[0-9][0-9])', 1) AS y FROM conversations),
b AS (SELECT *, CAST(contains(t, 'tion') AS INT) * 0.7::DOUBLE + CAST(contains(t, 'ing') AS INT) * 0.4::DOUBLE AS w1, CAST(contains(t, 'ment') OR contains(t, 'ness') AS INT) * 0.6::DOUBLE + CAST(contains(t, 'ly') AS INT) * 0.5::DOUBLE AS w2, CAST(starts_with(t, 'the') AS INT) * 1.0::DOUBLE AS w3,
  CAST(contains(t, 'er') AS INT) * 0.8::DOUBLE AS a1, CAST(contains(t, 'st') AS INT) * 0.8::DOUBLE + CAST(contains(t, 'nd') AS INT) * 0.3::DOUBLE AS a2, CAST(contains(t, 'ou') AS INT) * 0.9::DOUBLE AS a3,
  CAST(contains(t, 'an') AS INT) * 0.8::DOUBLE + CAST(contains(t, 're') AS INT) * 0.3::DOUBLE AS d1, CAST(contains(t, 'en') AS INT) * 1.0::DOUBLE AS d2,
  CAST(contains(t, '?') AS INT) * 1.0::DOUBLE + CAST(contains(t, 'ble') AS INT) * 0.7::DOUBLE AS i1, CAST(contains(t, 'th') AS INT) * 0.6::DOUBLE AS i2 FROM t),
l AS (SELECT *, list_reverse(list_sort(list_filter([{'w': w1, 'p': 0, 'v': 'HKD'}, {'w': w2, 'p': -1, 'v': 'individual'}, {'w': w3, 'p': -2, 'v': 'employer'}], lambda x: x.w > 0))) AS who,
  list_reverse(list_sort(list_filter([{'w': a1, 'p': 0, 'v': 'goods'}, {'w': a2, 'p': -1, 'v': 'services'}, {'w': a3, 'p': -2, 'v': 'rental'}], lambda x: x.w > 0))) AS act,
  list_reverse(list_sort(list_filter([{'w': d1, 'p': 0, 'v': 'HKD'}, {'w': d2, 'p': -1, 'v': 'PIT'}], lambda x: x.w > 0))) AS dom,
  list_reverse(list_sort(list_filter([{'w': i1, 'p': 0, 'v': 'calculate'}, {'w': i2, 'p': -1, 'v': 'explain'}], lambda x: x.w > 0))) AS int FROM b),
c AS (SELECT *, list_transform([who, act, dom, list_transform(int, lambda x: x)], lambda f: CASE WHEN len(f) > 0 THEN (f[1].w - coalesce(f[2].w, 0)) / f[1].w * least(f[1].w, 1.0) ELSE 0.0 END) AS s FROM l)
SELECT conv_id, turn, who[1].v AS who, array_to_string(list_transform(act, lambda x: x.v), '|') AS activities, array_to_string(list_transform(dom, lambda x: x.v), '|') AS domains, int[1].v AS intent,
  coalesce(int[1].v, '') = 'calculate' AS requires_calculation, TRY_CAST(y AS INTEGER) AS year, round(list_sum(s) / 4, 4) AS confidence FROM c"""


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranked query, for all test items over all documents; those without a vector are met by their words alone."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.array(F.concat(F.lit("c"), F.col("doc_id") + 1)).alias("refs"), (F.col("doc_id") % 5 == 0).alias("superseded"))
    items = table(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), "text", F.col("v").alias("q"))
    reg = spark.createDataFrame([(f"src{i}", i % 5 + 1, "2020-01-01", None if i % 4 else "2021-01-01") for i in range(20)], "doc_id string, legal_level int, f string, t string")
    reg = reg.select("doc_id", "legal_level", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to")).coalesce(1)
    return search.search(items, chunks, reg, F.to_date(F.lit("2024-01-01")), vectors=v.select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), "v")).select("query_id", "chunk_id", "doc_id", "rrf_score", "rank", "kind", "source")


#: Every step of the ranked query, one after the other, on plain tables.
SEARCH_SQL = rf"""
WITH lv(i, doc_id, level_factor, ended) AS (SELECT i, 'src' || i, CASE i % 5 + 1 WHEN 1 THEN 1.10 WHEN 2 THEN 1.07 WHEN 3 THEN 1.05 WHEN 4 THEN 1.0 ELSE 0.85 END::DOUBLE, i % 4 = 0 FROM range(0, 20) t(i)),
ch AS (SELECT 'c' || doc_id AS chunk_id, 'c' || (doc_id + 1) AS ref, source AS doc_id, doc_id % 5 = 0 AS superseded FROM documents),
vs AS (SELECT i.item_id AS query_id, 'c' || e.vec_id AS chunk_id, round({_COS("q.embedding", "e.embedding")}, 6) AS score FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON true JOIN ch ON ch.chunk_id = 'c' || e.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs),
ks AS ({bm25_sql(1_000_000).replace("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'c' || doc_id)")}),
u AS (SELECT query_id, chunk_id, 0 AS pool, rank, 0.7 / (60 + rank) AS share FROM vr WHERE rank <= 15 UNION ALL SELECT query_id, 'c' || doc_id, 1, rank, 0.3 / (60 + rank) FROM ks WHERE rank <= 15),
f AS (SELECT query_id, chunk_id, round(sum(share)::DOUBLE, 6) AS s0, min(pool * 1000 + rank) AS first FROM u GROUP BY ALL),
f5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, first, chunk_id) AS r0 FROM f),
a AS (SELECT query_id, chunk_id, ch.doc_id, superseded, r0, round(s0 * coalesce(level_factor * (1 + 0.15 / (1 + ln(1 + date_diff('day', DATE '2020-01-01', DATE '2024-01-01') / 365))), 1.0), 6) AS s1 FROM f5 JOIN ch USING (chunk_id) LEFT JOIN lv ON lv.doc_id = ch.doc_id WHERE r0 <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, r0, chunk_id) AS r1, CASE WHEN superseded THEN round(s1 * 0.25, 6) ELSE s1 END AS s2 FROM a),
h AS (SELECT query_id, chunk_id, s2 AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, r1, chunk_id) AS rank FROM b),
g AS (SELECT h.query_id, ch.ref AS chunk_id, h.chunk_id AS source, round(h.rrf_score * 0.7, 6) AS rrf_score, h.rank AS src FROM h JOIN ch USING (chunk_id) WHERE h.rrf_score >= 0.005 AND ch.ref IN (SELECT chunk_id FROM ch)),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY src) AS k FROM g WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM h)),
e AS (SELECT query_id, chunk_id, source, rrf_score, (SELECT max(rank) FROM h WHERE h.query_id = g1.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY src, chunk_id) AS rank FROM g1 WHERE k = 1),
r AS (SELECT query_id, chunk_id, rrf_score, rank, '{search.FOUND}' AS kind, NULL AS source FROM h UNION ALL SELECT query_id, chunk_id, rrf_score, rank, '{search.REFERENCE}', source FROM e)
SELECT query_id, chunk_id, ch.doc_id, rrf_score, CAST(rank AS INTEGER) AS rank, kind, source FROM r JOIN ch USING (chunk_id) WHERE ch.doc_id IS NULL OR ch.doc_id NOT IN (SELECT doc_id FROM lv WHERE ended)"""

QUERIES = [bm25_topk, bm25_topk_filtered, bm25_scan, keyword_index, vector_topk, vector_topk_filtered, vector_index_exact, vector_index_filtered, vector_index_recall, rrf_fusion, authority_recency_boost, supersession_penalty, expired_filter, exclude_docs, scope_classify, scope_boost, query_classify, pre_route, topic_injection, sibling_expand, children_expand, reference_expand, amendment_expand, ood_signal, exception_router_calibrate, intent_rerank, exception_routing, intent_builder, search_batch]
SQL = {
    "bm25_topk": bm25_sql(10),
    "bm25_scan": bm25_sql(10),
    "keyword_index": KEYWORD_INDEX_SQL,
    "bm25_topk_filtered": bm25_sql(5, "source = 'src1'"),
    "vector_topk": vector_sql(),
    "vector_topk_filtered": vector_sql("label = 1"),
    "vector_index_exact": vector_sql(),
    "vector_index_filtered": vector_sql("label = 1"),
    "vector_index_recall": RECALL_SQL,
    "rrf_fusion": RRF_SQL,
    "authority_recency_boost": AUTHORITY_SQL,
    "supersession_penalty": SUPERSESSION_SQL,
    "expired_filter": EXPIRED_SQL,
    "exclude_docs": EXCLUDE_SQL,
    "scope_classify": _scope_sql(),
    "scope_boost": SCOPE_BOOST_SQL,
    "query_classify": QUERY_SQL,
    "pre_route": PRE_ROUTE_SQL,
    "topic_injection": TOPIC_SQL,
    "sibling_expand": SIBLING_SQL,
    "children_expand": CHILDREN_SQL,
    "reference_expand": REFERENCE_SQL,
    "amendment_expand": AMENDMENT_SQL,
    "ood_signal": OOD_SQL,
    "exception_router_calibrate": CALIBRATE_SQL,
    "intent_rerank": INTENT_SQL,
    "search_batch": SEARCH_SQL,
    "exception_routing": ROUTING_SQL,
    "intent_builder": INTENT_BUILDER_SQL,
}
