"""Data-quality checks of node tables, chunks and annotations: each gives a table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _issues(rows: DataFrame, code: str, severity: Column | str, detail: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("doc_id", "node_id", F.lit(code).alias("code"), level.alias("severity"), detail.cast("string").alias("detail"))


def duplicate_siblings(nodes: DataFrame) -> DataFrame:
    """Second nodes of the same type and index (one without an index has no twin) below one parent.

    A warning if the id ends in a count, as ids of flattened amendments do: what
    follows its last clause is looked at, or else its last point, or else all of it.
    """
    tail = F.when(F.contains("node_id", F.lit("_khoan_")), F.substring_index("node_id", "_khoan_", -1)).when(F.contains("node_id", F.lit("_diem_")), F.substring_index("node_id", "_diem_", -1)).otherwise(F.col("node_id"))
    nodes = nodes.where(F.coalesce(F.col("node_index").cast("string"), F.lit("")) != "")
    w = Window.partitionBy("doc_id", "parent_id", "node_type", "node_index").orderBy("seq")
    rows = nodes.withColumn("n__", F.row_number().over(w)).withColumn("first__", F.first("node_id").over(w)).where("n__ > 1")
    return _issues(rows, "duplicate", F.when(tail.rlike(r"_\d+$"), "warning").otherwise("error"), F.col("first__"))


def missing_ids(nodes: DataFrame) -> DataFrame:
    return _issues(nodes.where(F.coalesce(F.trim("node_id"), F.lit("")) == ""), "missing_id", "error", F.col("node_index"))


def bad_breadcrumbs(nodes: DataFrame) -> DataFrame:
    crumb = F.coalesce("breadcrumb", F.lit(""))
    return _issues(nodes.where((F.trim(crumb) == "") | (F.col("parent_id").isNotNull() & ~F.contains(crumb, F.lit(">")))), "breadcrumb", "warning", crumb)


def bad_targets(nodes: DataFrame) -> DataFrame:
    """References whose target is missing or of no known form."""
    each = nodes.select("doc_id", "node_id", F.explode("refs").alias("target"))
    return _issues(each.where(~F.coalesce(F.col("target"), F.lit("")).rlike("^(doc_|external_)")), "reference", "error", F.col("target"))


def empty_articles(nodes: DataFrame, kind: str = "dieu") -> DataFrame:
    parents = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    empty = (F.col("node_type") == kind) & (F.trim(F.coalesce("content", F.lit(""))) == "")
    return _issues(nodes.where(empty).join(parents, ["doc_id", "node_id"], "left_anti"), "empty", "warning", F.col("node_index"))


def unsplit_references(edges: DataFrame) -> DataFrame:
    """Reference texts with several numbers and a comma."""
    many = (F.size(F.regexp_extract_all("match", F.lit(r"\d+"), F.lit(0))) > 1) & F.contains("match", F.lit(","))
    return _issues(edges.where(many), "unsplit", "warning", F.col("match"))


def validate(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All node checks, and that of reference texts (doc_id, node_id, match) if there are any."""
    found = [f(nodes) for f in (duplicate_siblings, missing_ids, bad_breadcrumbs, bad_targets, empty_articles)]
    return reduce(DataFrame.unionByName, found if edges is None else [*found, unsplit_references(edges)])


def stage_invariants(nodes: DataFrame) -> DataFrame:
    """What a parse must never give: an appendix whose title is a mention (kind phu_luc), and nodes without an id."""
    mention = (F.col("kind") == "phu_luc") & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("kèm theo"))
    bare = F.coalesce(F.trim("node_id"), F.lit("")) == ""
    return _issues(nodes.where(mention), "appendix_mention", "warning", F.col("title")).unionByName(_issues(nodes.where(bare), "missing_id", "warning", F.col("index")))


def spot_checks(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether nodes hold what is expected of them: expected (doc_id, node_id, field, value), a title or a part of the content."""
    both = expected.join(nodes.select("doc_id", "node_id", "title", "content"), ["doc_id", "node_id"], "left")
    holds = F.when(F.col("field") == "title", F.col("title") == F.col("value")).otherwise(F.contains("content", F.col("value")))
    return both.select("doc_id", "node_id", "field", F.coalesce(holds, F.lit(False)).alias("holds"))


def ingest_gate(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts by severity for every document, and whether it may be taken in."""
    counted = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    both = docs.select("doc_id").distinct().join(counted, "doc_id", "left").fillna(0, ["errors", "warnings"])
    return both.withColumn("passes", F.col("errors") == 0)


def validate_chunks(chunks: DataFrame, least: int = 30, most: int = 1500, short_clause: int = 10) -> DataFrame:
    """Issues of chunks (doc_id, node_id, kind, index, text, body): head, fields, length, repeated nodes, short clauses."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "node_id"))
    head = F.regexp_extract("text", r"^(\[[^\]]*\])", 1)
    codes = [
        (F.col("kind").isin("dieu") & ~F.contains(head, F.concat(F.lit("Đ"), F.col("index"), F.lit(" "))) & ~F.contains(head, F.concat(F.lit("Đ"), F.col("index"), F.lit(")"))), "header"),
        (F.coalesce("text", F.lit("")) == "", "field"),
        (~F.length("text").between(least, most), "length"),
        (F.col("n__") > 1, "duplicate"),
        ((F.col("kind") == "khoan") & (F.length("body") < short_clause), "short"),
        (F.coalesce("index", F.lit("")) == "", "index"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in codes]), lambda x: x.isNotNull())
    return chunks.withColumn("n__", n).select("doc_id", "node_id", F.explode(found).alias("code"))


# Closed sets of annotations.
WHO = ["individual", "HKD", "CNKD", "enterprise", "employer", "platform", "tax_authority", "all"]
CONTENT = ["tax_rate", "threshold", "procedure", "definition", "exemption", "penalty", "deadline", "other"]


def annotation_issues(who: Column, domains: Column, content: Column, start: Column, end: Column, confidence: Column, known_domains: list[str]) -> Column:
    """Names of what is wrong with an annotation; missing fields end the check."""
    missing = who.isNull() | content.isNull() | confidence.isNull()
    iso = lambda d: d.isNull() | F.try_to_date(d, "yyyy-MM-dd").isNotNull()
    rest = F.filter(
        F.array(
            F.when(F.size(F.array_except(who, F.array(*map(F.lit, WHO)))) > 0, "who"),
            F.when(F.size(F.array_except(F.coalesce(domains, F.array().cast("array<string>")), F.array(*map(F.lit, known_domains)))) > 0, "domain"),
            F.when(~content.isin(CONTENT), "content"),
            F.when(~iso(start) | ~iso(end), "date"),
            F.when(~confidence.between(0, 1), "confidence"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(missing, F.array(F.lit("missing"))).otherwise(rest)


def pack_list(values: Column) -> Column:
    return F.array_join(values, ",")


def unpack_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """Size and shape of each document's tree."""
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("parent_id").isNull()).alias("root_count"), F.count(F.lit(1)).alias("total_nodes"), F.max("depth").alias("max_depth"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("parent_id").isNull(), F.col("node_type")))), ",").alias("root_types"))


def snapshot_diff(new: DataFrame, old: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows that only one of two snapshots has, without volatile columns."""
    cols = [c for c in new.columns if c not in ignore]
    a, b = new.select(*cols), old.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("new")).unionByName(b.exceptAll(a).withColumn("side", F.lit("old")))


def coverage(source: DataFrame, parsed: DataFrame) -> DataFrame:
    """Share of a source's (doc_id, key) that a parse has, and of the parse that the source has."""
    a = source.distinct().withColumn("in_source", F.lit(1)).join(parsed.distinct().withColumn("in_parsed", F.lit(1)), ["doc_id", "key"], "full")
    both = F.sum(F.coalesce("in_source", F.lit(0)) * F.coalesce("in_parsed", F.lit(0)))
    return a.groupBy("doc_id").agg(F.coalesce(both / F.nullif(F.sum("in_source"), F.lit(0)), F.lit(1.0)).alias("coverage"), F.coalesce(both / F.nullif(F.sum("in_parsed"), F.lit(0)), F.lit(1.0)).alias("accuracy"))
