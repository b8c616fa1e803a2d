"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.staging import hint_if_small, phrases_in, staged


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node id, the last one loaded (load_seq)."""
    w = Window.partitionBy("node_id").orderBy(F.desc("load_seq"))
    return nodes.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 2, resets: DataFrame | None = None) -> DataFrame:
    """Nodes reached from seeds (query_id, node_id): (query_id, node_id, depth), the least depth of each.

    Every round joins the frontier with the edges (src, dst) and drops what was
    reached at no greater depth, so loops end.  An edge of ``resets`` (src, dst)
    leads to depth 0 again; with them rounds go on until nothing is new.  Only
    whether the frontier is empty comes to the driver; each round is written to
    the shared folder, so that a lost executor costs one round.
    """
    seen = seeds.select("query_id", "node_id", F.lit(0).alias("depth")).distinct()
    frontier, rounds = seen, 0
    while rounds < depth or resets is not None:
        step = frontier.where(F.col("depth") < depth).join(edges, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"), (F.col("depth") + 1).alias("depth"))
        if resets is not None:
            jump = frontier.where(F.col("depth") < depth).join(resets, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"), F.lit(0).alias("depth"))
            step = step.unionByName(jump)
        step = step.groupBy("query_id", "node_id").agg(F.min("depth").alias("depth"))
        known = seen.withColumnRenamed("depth", "old")
        frontier = staged(step.join(known, ["query_id", "node_id"], "left").where(F.col("old").isNull() | (F.col("depth") < F.col("old"))).select("query_id", "node_id", "depth"))
        if frontier.isEmpty():
            break
        seen = staged(seen.unionByName(frontier).groupBy("query_id", "node_id").agg(F.min("depth").alias("depth")))
        rounds += 1
    return seen


def resolve_external(targets: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets outside a document to nodes of the corpus: documents (priority, keyword, doc_id).

    The first keyword found in the target names the document; of its nodes that end
    like the target (from an article on) the shortest id is taken.
    """
    low = F.lower("target_id")
    asked = targets.where(low.startswith("external_")).select("target_id").distinct()
    met = phrases_in(asked.withColumn("text", F.col("target_id")), "text", documents, "keyword").select("target_id", F.col("phrase").alias("keyword"))
    met = met.join(hint_if_small(documents.withColumn("keyword", F.lower("keyword")), 96), "keyword")
    first = met.groupBy("target_id").agg(F.min_by("doc_id", "priority").alias("of"))
    tail = F.regexp_extract(low, r"(_dieu_.*)$", 1)
    asked = first.withColumn("tail", tail).where("tail <> ''")
    ends = F.regexp_extract_all(F.lower("node_id"), F.lit(r"(?=(_dieu_.*)$)"), F.lit(1))  # one for each article in the id
    ids = nodes.select(F.col("doc_id").alias("of"), "node_id", F.explode(ends).alias("tail"))
    fits = asked.join(ids, ["of", "tail"])
    return fits.groupBy("target_id").agg(F.min_by("node_id", F.struct(F.length("node_id"), "node_id")).alias("node_id"))


def descendants(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes below (and at) given ones by their paths: tops (doc_id, seq)."""
    return nodes.withColumn("top", F.explode(F.array_distinct("path"))).join(tops.withColumnRenamed("seq", "top"), ["doc_id", "top"])


def first_article(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The first node, in document order, of each asked article: asked (doc_id, number)."""
    return nodes.where("kind = 'dieu'").join(asked, (nodes["doc_id"] == asked["doc_id"]) & (nodes["index"] == asked["number"])).groupBy(asked["doc_id"], "number").agg(F.min_by("node_id", "seq").alias("node_id"))


def holds_phrase(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, id) of texts (id, text) that hold a phrase (phrase_id, phrase), whatever the case."""
    met = phrases_in(texts.select("id", "text"), "text", phrases, "phrase").select("id", "phrase")
    return met.join(phrases.select("phrase_id", F.lower("phrase").alias("phrase")), "phrase").select("phrase_id", "id")


def article_context(articles: DataFrame, clauses: DataFrame, points: DataFrame) -> DataFrame:
    """Articles with their clauses and points, where they have any."""
    return articles.join(clauses, "article_id", "left").join(points, "clause_id", "left")


def implementation_chain(start: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Documents that implement others over up to three steps: (root, doc_id, hop): edges (src, dst)."""
    level = start.select(F.col("doc_id").alias("root"), "doc_id", F.lit(0).alias("hop"))
    out = None
    for i in range(1, hops + 1):
        level = level.join(edges, F.col("doc_id") == F.col("src")).select("root", F.col("dst").alias("doc_id"), F.lit(i).alias("hop")).distinct()
        out = level if out is None else out.unionByName(level)
    return out.groupBy("root", "doc_id").agg(F.min("hop").alias("hop"))


def valid_at(docs: DataFrame, day: Column) -> DataFrame:
    return docs.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))


def by_rank(docs: DataFrame, *per: str) -> DataFrame:
    """Conflicting documents with their place: the highest rank and then the newest first; within ``per`` columns."""
    return docs.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy("legal_level", F.desc("effective_from"), "doc_id")))


def explanations(edges: DataFrame, least: float = 0.82) -> DataFrame:
    """Edges sure enough to explain their source, each with its place: the surest first."""
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    return edges.where(F.col("confidence") >= least).withColumn("place", F.row_number().over(w))
