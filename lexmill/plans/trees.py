"""Queries of parsing, chunking, data quality and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import chunks, graph, parse, quality
from lexmill.plans.common import table


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the documents' lines, with headings made from their numbers."""
    lines = parse.lines_of(table(spark, sf_dir, "documents"))
    made = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("Điều "), F.col("line_no") + 1, F.lit(". "), F.col("line"))).when(F.col("line_no") % 5 == 1, F.concat(F.lit("1. "), F.col("line"))).when(F.col("line_no") % 5 == 2, F.concat(F.lit("a) "), F.col("line"))).otherwise(F.col("line"))
    t = lines.select("doc_id", "line_no", parse.line_type(made).alias("t"))
    return t.groupBy("doc_id", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.trim("t.index"))).alias("index_chars"))


LINE_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(coalesce(text, ''), chr(10)) AS ls, i FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
x AS (SELECT doc_id, line_no, ls[i] AS line FROM l),
t AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 5 = 0 AND trim(line) <> '' THEN 'dieu' WHEN line_no % 5 = 1 AND length(trim(line)) >= 4 AND NOT regexp_matches(line, '\S.*\.{4,}') THEN 'khoan'
  WHEN line_no % 5 = 2 AND trim(line) <> '' THEN 'diem' ELSE 'other' END AS k FROM x),
u AS (SELECT doc_id, line_no, CASE WHEN k <> 'other' THEN k WHEN line_no % 5 > 2 AND regexp_matches(trim(line), '^\d+\.\s+.{4,}$') THEN 'khoan' ELSE 'text' END AS kind FROM t)
SELECT doc_id, kind, count(*) AS n, CAST(sum(CASE kind WHEN 'dieu' THEN length(CAST(line_no + 1 AS VARCHAR)) WHEN 'khoan' THEN 1 WHEN 'diem' THEN 1 END) AS BIGINT) AS index_chars FROM u GROUP BY 1, 2"""


def guidance_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents; a line of up to twelve characters counts as a heading."""
    lines = parse.lines_of(table(spark, sf_dir, "documents"))
    return parse.guidance_sections(lines, heading=r"^.{1,12}$").select("doc_id", "section", "title", F.length("body").alias("chars"), F.md5("body").alias("digest"))


GUIDANCE_SQL = r"""
WITH l AS (SELECT doc_id, i AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
h AS (SELECT *, regexp_matches(line, '^.{1,12}$') AS head FROM l),
s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN trim(line) END), 'Nội dung') AS title, coalesce(string_agg(CASE WHEN NOT head AND trim(line) <> '' THEN trim(line) END, ' ' ORDER BY line_no), '') AS body FROM s GROUP BY 1, 2)
SELECT doc_id, section, title, CAST(length(body) AS INTEGER) AS chars, md5(body) AS digest FROM g WHERE length(body) >= 30"""


def merge_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one-row tables; a line on the next page with as many columns goes on."""
    li = table(spark, sf_dir, "lineitem")
    cols = F.when(F.col("l_quantity") < 25, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), cols.alias("headers"), F.array(F.array(F.col("l_partkey").cast("string"))).alias("rows"), "l_quantity")
    t = t.withColumn("table_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "rows", "l_quantity"))).withColumn("page_number", F.col("table_index"))
    return parse.merge_split_tables(t).select("doc_id", "table_index", "page_number", "row_count", "col_count")


MERGE_SQL = """
WITH t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_quantity) AS i, CASE WHEN l_quantity < 25 THEN 2 ELSE 1 END AS c FROM lineitem),
s AS (SELECT *, coalesce(c = lag(c) OVER w, false) AS goes_on FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s)
SELECT doc_id, CAST(run - 1 AS INTEGER) AS table_index, CAST(min(i) AS INTEGER) AS page_number, CAST(sum(CASE WHEN goes_on THEN 2 ELSE 1 END) AS INTEGER) AS row_count, CAST(max(c) AS INTEGER) AS col_count FROM r GROUP BY doc_id, run"""


def _legal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal texts made of the whole documents: four sentences or lines an article, as its title, a clause and two points."""
    d = table(spark, sf_dir, "documents")
    s = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n"), lambda x: x.rlike(r"\S"))
    pieces = F.transform(s, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    number = lambda g: g.cast("string")

    def article(p: Column, g: Column) -> Column:
        piece = lambda i: F.get(p, 4 * (g - 1) + i)
        return F.concat_ws(
            "\n", F.concat(F.lit("Điều "), number(g), F.lit(". "), piece(0)), F.concat(F.lit("1. Theo khoản 2 Điều "), number(g + 1), F.lit(" và "), piece(1)), F.concat(F.lit("a) "), piece(2)), F.concat(F.lit("b) "), piece(3)),
            F.lit("2. Luật này áp dụng theo Nghị định số 20/2026/NĐ-CP."), F.when(g > 1, F.concat(F.lit("3. Trừ trường hợp quy định tại Điều "), number(g - 1))),
        )

    articles = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.size(p) / 4).cast("int"), F.lit(1))), lambda g: article(p, g))
    made = lambda p: F.concat_ws("\n", F.lit("Chương I"), F.lit("QUY ĐỊNH CHUNG"), articles(p), F.lit("4. Điều khoản cuối cùng"), F.lit("Nơi nhận: như trên"))
    text = F.element_at(F.transform(F.array(pieces), made), 1)  # split once for each document
    return d.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), text.alias("text"))


def parse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.finish_nodes(parse.build_nodes(_legal_texts(spark, sf_dir))).select("doc_id", "node_id", "seq", "parent_seq", "depth", "kind", "index", "title", "content", "lead_in", "breadcrumb")


def reference_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse.finish_nodes(parse.build_nodes(_legal_texts(spark, sf_dir)))
    return parse.find_references(nodes.withColumn("text", F.concat_ws(" ", "content", "lead_in")))


def _made_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse.finish_nodes(parse.build_nodes(_legal_texts(spark, sf_dir)))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id")).distinct()
    return chunks.node_chunks(nodes, docs.withColumn("document_number", F.lit("1/2025/QH15")))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the made texts with what they refer to."""
    return chunks.with_references(_made_chunks(spark, sf_dir)).select("doc_id", "chunk_id", "kind", "text", F.array_join("refs", "|").alias("refs"))


def exception_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exception_index(_made_chunks(spark, sf_dir)).select("rule_chunk_id", F.array_join("exception_chunk_ids", "|").alias("exceptions"))


def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of customers as nodes below their nations: names set twice, one nation's subtree removed."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.lit("d").alias("doc_id"), F.concat_ws("_", F.lit("n"), "c_nationkey", "c_custkey").alias("node_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content"), F.lit("").alias("lead_in"))
    one = c.where("c_custkey % 3 = 0").select(F.lit("d").alias("doc_id"), F.lit(1).alias("op_seq"), F.lit("set_field").alias("op"), F.concat_ws("_", F.lit("n"), "c_nationkey", "c_custkey").alias("node_id"), F.lit("title").alias("field"), F.lit("first").alias("value"))
    two = one.where("node_id like '%5'").withColumn("op_seq", F.lit(2)).withColumn("value", F.lit("second"))
    gone = spark.createDataFrame([("d", 3, "remove_node", "n_7", None, None)], one.schema.simpleString()[7:-1].replace(":", " "))
    return parse.apply_patches(nodes, one.unionByName(two).unionByName(gone)).select("node_id", "title", "content")


PATCH_SQL = """
SELECT 'n_' || c_nationkey || '_' || c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 10 = 5 THEN 'second' ELSE 'first' END ELSE c_name END AS title, c_mktsegment AS content FROM customer WHERE c_nationkey <> 7"""


def _geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    row = lambda df, kind, key, parent, index, depth, body: df.select(F.lit("geo").alias("doc_id"), key.alias("node_id"), parent.alias("parent_id"), F.lit(kind).alias("node_type"), index.cast("string").alias("node_index"), F.lit(depth).alias("depth"), body.alias("content"))
    rid, nid = lambda k: F.concat(F.lit("r"), k), lambda k: F.concat(F.lit("n"), k)
    a = row(r, "region", rid("r_regionkey"), none, F.col("r_regionkey"), 0, F.col("r_name"))
    b = row(n, "nation", nid("n_nationkey"), rid("n_regionkey"), F.col("n_nationkey"), 1, F.col("n_name"))
    d = row(c, "customer", F.concat(F.lit("c"), "c_custkey"), nid("c_nationkey"), F.col("c_custkey") % 17, 2, F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    return a.unionByName(b).unionByName(d).withColumn("seq", F.xxhash64("node_id") * 0 + F.regexp_extract("node_id", r"\d+", 0).cast("long"))


GEO_SQL = """geo AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, 'region' AS node_type, CAST(r_regionkey AS VARCHAR) AS node_index, 0 AS depth, r_name AS content, r_regionkey AS seq FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', CAST(n_nationkey AS VARCHAR), 1, n_name, n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', CAST(c_custkey % 17 AS VARCHAR), 2, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END, c_custkey FROM customer)"""


def validate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _geo_nodes(spark, sf_dir).withColumn("breadcrumb", F.when(F.col("seq") % 5 == 0, F.col("content")).otherwise(F.lit("a > b"))).withColumn("refs", F.array(F.when(F.col("seq") % 4 == 0, F.lit("bad")).otherwise(F.lit("doc_x"))))
    issues = quality.validate(nodes).unionByName(quality.empty_articles(nodes, "customer"))
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


VALIDATE_SQL = f"""
WITH {GEO_SQL},
d AS (SELECT row_number() OVER (PARTITION BY parent_id, node_type, node_index ORDER BY seq) AS k FROM geo),
i AS (SELECT 'duplicate' AS code, 'error' AS severity FROM d WHERE k > 1
UNION ALL SELECT 'breadcrumb', 'warning' FROM geo WHERE seq % 5 = 0 AND (trim(content) = '' OR parent_id IS NOT NULL)
UNION ALL SELECT 'reference', 'error' FROM geo WHERE seq % 4 = 0
UNION ALL SELECT 'empty', 'warning' FROM geo WHERE node_type = 'customer' AND content = '')
SELECT code, severity, count(*) AS n FROM i GROUP BY 1, 2"""


def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tree_metrics(_geo_nodes(spark, sf_dir))


METRICS_SQL = f"WITH {GEO_SQL} SELECT 'geo' AS doc_id, count_if(parent_id IS NULL) AS root_count, count(*) AS total_nodes, max(depth) AS max_depth, 'region' AS root_types FROM geo"


def chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First children of regions and nations, as far as they fit."""
    return chunks.children_text(_geo_nodes(spark, sf_dir), body="content", chars=60, items=5).select("parent_id", F.md5("children_text").alias("digest"), "shown", "total")


CHUNK_TREE_SQL = f"""
WITH {GEO_SQL},
o AS (SELECT *, row_number() OVER w AS nth, sum(length(content)) OVER w AS used FROM geo WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY seq)),
g AS (SELECT parent_id, coalesce(string_agg(CASE WHEN nth <= 5 AND used <= 60 AND content <> '' THEN content END, chr(10) ORDER BY nth), '') AS t, CAST(sum(CASE WHEN nth <= 5 AND used <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS shown, count(*) AS total FROM o GROUP BY 1)
SELECT parent_id, md5(t || CASE WHEN total > shown THEN chr(10) || '[... còn ' || (total - shown) || ' điểm nữa]' ELSE '' END) AS digest, shown, total FROM g"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.operators.evaluation import token_stats

    return token_stats(table(spark, sf_dir, "documents").select(F.length("text").alias("chars"), (F.col("doc_id") % 3).alias("n_refs")))


STATS_SQL = """SELECT count(*) AS total, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, round(avg(length(text)), 1) AS avg_chars,
round(avg(length(text) // 3), 1) AS avg_tokens, count_if(doc_id % 3 > 0) AS with_references FROM documents"""


def bfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at most two steps from each region."""
    nodes = _geo_nodes(spark, sf_dir)
    seeds = nodes.where("parent_id is null").select(F.col("node_id").alias("query_id"), "node_id")
    return graph.expand(seeds, nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst")), 2)


BFS_SQL = f"""
WITH RECURSIVE {GEO_SQL},
w(query_id, node_id, depth) AS (SELECT node_id, node_id, 0 FROM geo WHERE parent_id IS NULL UNION SELECT w.query_id, g.node_id, w.depth + 1 FROM w JOIN geo g ON g.parent_id = w.node_id WHERE w.depth < 2)
SELECT query_id, node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2"""


def bfs_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer's nation along the nations: every second step leads to depth 0 again, so all later ones are reached."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ahead = n.select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") + 1).cast("string").alias("dst"), (F.col("n_nationkey") % 2).alias("odd")).where("n_nationkey < 24")
    seeds = c.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("string").alias("node_id"))
    return graph.expand(seeds, ahead.where("odd = 0").drop("odd"), 2, ahead.where("odd = 1").drop("odd"))


RESETS_SQL = """
SELECT c_custkey AS query_id, CAST(n_nationkey AS VARCHAR) AS node_id, CAST(CASE WHEN n_nationkey = c_nationkey OR n_nationkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS depth
FROM customer JOIN nation ON n_nationkey >= c_nationkey"""


def patch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of their lines: nodes added behind added ones, fields of added nodes, and what comes after a removal."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    doc, line = F.col("l_orderkey"), lambda x: F.concat_ws("_", "doc_id", F.lit(x))
    nodes = li.select(doc.alias("doc_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("node_id"), F.col("l_linenumber").cast("double").alias("seq"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("content"), F.lit("").alias("lead_in"))
    ops = [
        (1, "add_node", "1", "a", "first"), (2, "add_node", "a", "b", "second"), (3, "set_field", "a", "title", "named"), (4, "remove_node", "2", None, None), (5, "set_field", "2", "content", "lost"),
        (6, "add_node", "2", "c", "lost"), (7, "set_field", "1", "title", "once"), (8, "set_field", "1", "title", "twice"), (9, "remove_node", "b", None, None), (10, "add_node", "1", "b", "again"), (11, "set_field", "3", "lead_in", "so"),
    ]
    docs = li.select(doc.alias("doc_id")).distinct().where("doc_id % 4 <> 1")
    with_id = lambda op, x: F.lit(x) if op != "add_node" else line(x)
    each = [F.struct(F.lit(s).alias("op_seq"), F.lit(op).alias("op"), line(n).alias("node_id"), (F.lit(None).cast("string") if f is None else with_id(op, f)).alias("field"), F.lit(v).cast("string").alias("value")) for s, op, n, f, v in ops]
    patches = docs.select("doc_id", F.inline(F.array(*each)))
    return parse.apply_patches(nodes, patches).select("doc_id", "node_id", "title", "content", "lead_in", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("place"))


REPLAY_SQL = """
WITH l AS (SELECT l_orderkey AS doc_id, l_orderkey % 4 <> 1 AS p, l_linenumber AS n, max(l_returnflag) AS title, max(l_linestatus) AS content FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT doc_id, doc_id || '_' || n AS node_id, n AS spot, CASE WHEN p AND n = 1 THEN 'twice' ELSE title END AS title, content, CASE WHEN p AND n = 3 THEN 'so' ELSE '' END AS lead_in FROM l WHERE NOT (p AND n = 2)
UNION ALL SELECT doc_id, doc_id || '_a', 1.5, 'named', 'first', '' FROM l WHERE p AND n = 1
UNION ALL SELECT doc_id, doc_id || '_b', 1.25, 'twice', 'again', '' FROM l WHERE p AND n = 1)
SELECT doc_id, node_id, title, content, lead_in, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS INTEGER) AS place FROM r"""


def twin_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as clauses and points, several of one index below a parent: twins whose ids end in a count are warnings."""
    li = table(spark, sf_dir, "lineitem")
    n, k = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    kind = F.when(F.col("l_returnflag") == "R", "khoan").when(F.col("l_returnflag") == "A", "diem").otherwise("dieu")
    count = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("_"), n)).otherwise(F.lit(""))
    node = F.when(kind == "diem", F.concat(F.lit("d"), k, F.lit("_diem_a"), count)).when(kind == "khoan", F.concat(F.lit("d"), k, F.lit("_khoan_1"), count)).otherwise(F.concat(F.lit("d"), k, F.lit("x"), count))
    nodes = li.select(k.alias("doc_id"), k.alias("parent_id"), kind.alias("node_type"), F.when(F.col("l_linenumber") == 5, "").otherwise(F.lit("1")).alias("node_index"), node.alias("node_id"), F.col("l_linenumber").alias("seq"))
    found = quality.duplicate_siblings(nodes)
    return found.select("doc_id", "node_id", "severity")


TWINS_SQL = """
WITH n AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'khoan' WHEN 'A' THEN 'diem' ELSE 'dieu' END AS kind FROM lineitem WHERE l_linenumber <> 5),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY seq) AS k FROM n)
SELECT doc_id, 'd' || doc_id || CASE kind WHEN 'khoan' THEN '_khoan_1' WHEN 'diem' THEN '_diem_a' ELSE 'x' END || CASE WHEN seq % 2 = 0 THEN '_' || seq ELSE '' END AS node_id,
       CASE WHEN seq % 2 = 0 THEN 'warning' ELSE 'error' END AS severity FROM w WHERE k > 1"""


def impl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to three steps from key to a third of it."""
    c = table(spark, sf_dir, "customer")
    edges = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst"))
    return graph.implementation_chain(c.select(F.col("c_custkey").alias("doc_id")), edges)


CHAIN_SQL = """
WITH RECURSIVE w(root, doc_id, hop) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION SELECT root, doc_id // 3, hop + 1 FROM w WHERE hop < 3 AND doc_id % 2 = 0 AND doc_id IN (SELECT c_custkey FROM customer))
SELECT root, doc_id, CAST(min(hop) AS INTEGER) AS hop FROM w WHERE hop > 0 GROUP BY 1, 2"""


QUERIES = [line_classify, guidance_sections, merge_split_tables, parse_tree, reference_detect, chunk_index, exception_index, patch_apply, validate_nodes, tree_metrics, chunk_tree, chunk_stats, bfs_expand, bfs_resets, patch_replay, twin_nodes, impl_chain]
SQL = {
    "line_classify": LINE_SQL,
    "guidance_sections": GUIDANCE_SQL,
    "merge_split_tables": MERGE_SQL,
    "patch_apply": PATCH_SQL,
    "bfs_resets": RESETS_SQL,
    "patch_replay": REPLAY_SQL,
    "twin_nodes": TWINS_SQL,
    "validate_nodes": VALIDATE_SQL,
    "tree_metrics": METRICS_SQL,
    "chunk_tree": CHUNK_TREE_SQL,
    "chunk_stats": STATS_SQL,
    "bfs_expand": BFS_SQL,
    "impl_chain": CHAIN_SQL,
}
