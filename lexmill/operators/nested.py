"""Documents as flat rows and as nested values, there and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The nested form: a document's articles, their clauses, their points.
POINT = "number: string, content: string"
CLAUSE = f"number: string, content: string, points: array<struct<{POINT}>>"
ARTICLE = f"number: string, title: string, content: string, effective_date: date, supersedes: array<string>, clauses: array<struct<{CLAUSE}>>"
DOCUMENT = f"struct<doc_id: string, title: string, issued_date: date, effective_from: date, effective_to: date, articles: array<struct<{ARTICLE}>>>"


def _gathered(rows: DataFrame, keys: list[str], into: str, columns: list[str]) -> DataFrame:
    """Rows of the same keys as one array in the order of their ``place``."""
    held = F.array_sort(F.collect_list(F.struct("place", *columns)))
    return rows.groupBy(*keys).agg(F.transform(held, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(into))


def rebuild(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, document) from flat rows: documents (doc_id and the document's fields), nodes (doc_id, article, clause, point,
    place, title, content, effective_date, supersedes).

    A row without a clause is an article, one without a point a clause.  Children
    are gathered level by level, points first; what has none gets an empty array.
    Groups are as large as one parent's children.
    """
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    points = nodes.where("point is not null").select("doc_id", "article", "clause", "place", F.col("point").alias("number"), "content")
    clauses = nodes.where("clause is not null and point is null").select("doc_id", "article", "clause", "place", F.col("clause").alias("number"), "content")
    articles = nodes.where("clause is null").select("doc_id", "article", "place", F.col("article").alias("number"), "title", "content", "effective_date", "supersedes")
    with_points = clauses.join(_gathered(points, ["doc_id", "article", "clause"], "points", ["number", "content"]), ["doc_id", "article", "clause"], "left").withColumn("points", F.coalesce("points", none(POINT)))
    held = _gathered(with_points, ["doc_id", "article"], "clauses", ["number", "content", "points"])
    with_clauses = articles.join(held, ["doc_id", "article"], "left").withColumn("clauses", F.coalesce("clauses", none(CLAUSE)))
    whole = _gathered(with_clauses, ["doc_id"], "articles", ["number", "title", "content", "effective_date", "supersedes", "clauses"])
    out = documents.join(whole, "doc_id", "left").withColumn("articles", F.coalesce("articles", none(ARTICLE)))
    return out.select("doc_id", F.struct("doc_id", "title", "issued_date", "effective_from", "effective_to", "articles").cast(DOCUMENT).alias("document"))


def to_text(document: Column) -> Column:
    """The JSON of a nested document; dates in ISO, nulls kept out."""
    return F.to_json(document, {"dateFormat": "yyyy-MM-dd"})


def from_text(text: Column) -> Column:
    """A nested document from its JSON; null if it is none, a wrong date is null."""
    return F.from_json(text, DOCUMENT, {"dateFormat": "yyyy-MM-dd", "mode": "PERMISSIVE"})


def flatten(documents: DataFrame, document: str = "document") -> DataFrame:
    """Flat rows of nested documents, one for each article, clause and point, in order: the nodes of ``rebuild``.

    The tree is opened inside the row, without a loop over levels and without a shuffle.
    """
    none, no_date, no_list = F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(None).cast("array<string>")

    def row(article: Column, clause: Column, point: Column, title: Column, content: Column, day: Column, old: Column) -> Column:
        return F.struct(article.alias("article"), clause.alias("clause"), point.alias("point"), title.alias("title"), content.alias("content"), day.alias("effective_date"), old.alias("supersedes"))

    def of_clause(a: Column, c: Column) -> Column:
        own = F.array(row(a["number"], c["number"], none, none, c["content"], no_date, no_list))
        return F.concat(own, F.transform(c["points"], lambda p: row(a["number"], c["number"], p["number"], none, p["content"], no_date, no_list)))

    def of_article(a: Column) -> Column:
        own = F.array(row(a["number"], none, none, a["title"], a["content"], a["effective_date"], a["supersedes"]))
        return F.concat(own, F.flatten(F.transform(a["clauses"], lambda c: of_clause(a, c))))

    rows = F.flatten(F.transform(F.col(document)["articles"], of_article))
    return documents.select("doc_id", F.posexplode(rows).alias("place", "r")).select("doc_id", "place", "r.*")
