"""From text lines to a tree of legal nodes, held as adjacency tables.

The tree is found with running pointers: for each level, the last line of that
level that still stands.  A line of a higher level ends the lower ones.  Levels
are resolved from the top down, so that a dropped orphan never becomes a parent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.rules import CLOSES
from lexmill.functions.staging import hint_if_small, shuffle_partitions, staged
from lexmill.functions.text import clean_content, clean_document, clean_law_name, nfc, slugify

# Forms of headings, in the order in which they are tried.
LINE_FORMS = [
    ("phan", r"^(?:Phần|PHẦN)\s+([IVXLCDM]+)\s*\n?\s*(.*)$"),
    ("chuong", r"(?iu)^chương\s+([IVXLCDM]+)\s*\n?\s*(.*)$"),
    ("muc", r"(?iu)^mục\s+(\d+)\s*\n?\s*(.*)$"),
    ("phu_luc", r"(?iu)^phụ\s+lục(?:\s+(\d+|[IVXLCDM]+))?\s*\n?\s*(.*)$"),
    ("dieu", r"^Điều\s+(\d+[a-zA-Z]*)\.\s+(.*)$"),
    ("khoan", r"^(\d+)\.\s+(.*)$"),
    ("diem", r"^([a-zđ])\)\s+(.*)$"),
    ("tiet", r"^([a-zđ]\.\d+)\)\s+(.*)$"),
]
# Lines that only look like a clause, and heads of form templates.
NO_CLAUSE = [
    r"(?iu)^\d+\s+(triệu|tỷ|nghìn|%|năm|tháng|ngày)",
    r"^\d{4}\s",
    r"^\d+\.\d+\s",
    r"(?iu)^\d+\s*VNĐ",
    r"^\d+/\d+",
    r"(?iu)^\d+\.\s+Ngành\s+nghề",
    r"^\d+\.\s+\S.*\.{4,}",
    r"(?iu)^\d+\.\s+Tổng\s+cộng",
]
FORM_LINE = r"(?iu)^(HỘ,?\s*CÁ\s*NHÂN\s*KINH\s*DOANH\s*:|Mẫu\s+số\s+S\d+[a-z]-HKD|SỔ\s+(?:DOANH\s+THU|CHI\s+TIẾT|THEO\s+DÕI|NHẬT\s+KÝ)|Địa\s+điểm\s+kinh\s+doanh\s*:|Kỳ\s+kê\s+khai\s*:|Đơn\s+vị\s+tính\s*:)"
STOP_LINE = r"(?iu)^\s*Nơi\s+nhận\s*:"
LABELS = {"phan": "Phần", "chuong": "Chương", "muc": "Mục", "phu_luc": "Phụ lục", "dieu": "Điều", "khoan": "Khoản", "diem": "Điểm", "tiet": "Tiết"}
#: Levels from the top, with what may stand above each; the root where None is listed.
PARENTS = {
    "phan": [None],
    "phu_luc": [None],
    "chuong": ["phan", None],
    "muc": ["chuong"],
    "dieu": ["muc", "chuong", "phan", None],
    "khoan": ["dieu"],
    "diem": ["khoan"],
    "tiet": ["diem"],
}
RANK = {"phan": 1, "phu_luc": 1, "chuong": 2, "muc": 3, "dieu": 4, "khoan": 5, "diem": 6, "tiet": 7}


def is_clause_line(line: Column) -> Column:
    """False for numbers, dates, table rows and placeholders that only look like a clause."""
    bad = F.lit(False)
    for p in NO_CLAUSE:
        bad = bad | line.rlike(p)
    return ~bad & (F.length(F.regexp_extract(line, r"^\d+\.\s*(.+)$", 1)) >= 4)


def line_type(line: Column) -> Column:
    """struct(kind, index, content) of a line: the first form that fits; text otherwise."""
    text = F.rtrim(F.ltrim(line))
    sign = F.ascii(text)
    letter = sign.between(97, 122) | (sign == 273)
    begins = {"phan": sign == 80, "chuong": sign.isin(67, 99), "muc": sign.isin(77, 109), "phu_luc": sign.isin(80, 112), "dieu": sign == 272, "khoan": sign.between(48, 57), "diem": letter, "tiet": letter}  # most lines are told apart by their first sign
    made = None
    for kind, pattern in LINE_FORMS:
        fits = begins[kind] & text.rlike(pattern)
        if kind == "phu_luc":
            fits = fits & ~text.rlike(r"(?iu)kèm\s+theo")
        if kind == "khoan":
            fits = fits & is_clause_line(text)
        value = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 1).alias("index"), F.regexp_extract(text, pattern, 2).alias("content"))
        made = F.when(fits, value) if made is None else made.when(fits, value)
    return made.otherwise(F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("index"), line.alias("content")))


def closes(kind: Column, level: Column) -> Column:
    """True if a line of a kind ends an open node of a level."""
    table = F.create_map(*[x for k, v in CLOSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, level), kind), F.lit(False))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select(doc_id, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def classified(lines: DataFrame) -> DataFrame:
    """Lines with their types, up to the list of recipients, without blank lines and without what stands in form templates."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("doc_id", "line_no", "line", F.inline(F.array(line_type(F.col("line")))))  # a generator: evaluated once for each line
    stop = F.contains("line", F.lit(":")) & F.col("line").rlike(STOP_LINE)
    mark = F.when((F.col("kind") == "text") & F.trim("line").rlike(FORM_LINE), 1).when(F.col("kind").isin("dieu", "chuong", "muc", "phan"), 0)
    rows = rows.withColumns({"stop": stop.cast("int"), "mark": mark}).where("trim(line) <> ''")
    rows = rows.withColumns({"stopped": F.max("stop").over(so_far), "in_form": F.coalesce(F.last("mark", ignorenulls=True).over(so_far), F.lit(0))}).where("stopped = 0")
    return rows.where(~((F.col("in_form") == 1) & F.col("kind").isin("khoan", "diem", "tiet", "text"))).drop("stop", "mark", "stopped", "in_form")


def build_nodes(docs: DataFrame) -> DataFrame:
    """Nodes of every document: doc_id, seq, parent_seq, depth, path, kind, index, node_id, title, lead_in, trailing, content, breadcrumb.

    Lines of a level that finds no parent are dropped, as is text before the
    first node.  Text goes to the last standing node: it leads in, or trails if it
    is set in less than the node.  Texts are shuffled once, whole; all that
    follows is windows over a document's lines and one grouping where they lie.
    """
    rows = classified(lines_of(docs.repartition(shuffle_partitions(docs.sparkSession), "doc_id")))  # by number: texts are small before their lines are told apart, so few bytes are much work
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # a node stands until a line of its own or a higher level; an orphan never does, as what it needs is not there until a line that ends it
    rows = rows.withColumns({f"r_{k}": F.last(F.when(F.col("kind") == k, F.col("line_no")), True).over(w) for k in ("phu_luc", *LEVELS)})
    ends = lambda *cols: F.greatest(*[F.coalesce(c, F.lit(-1)) for c in cols])
    stands = lambda kind, after: F.when(F.col(f"r_{kind}") > after, F.col(f"r_{kind}"))
    rows = rows.withColumnsRenamed({"r_phan": "p_phan", "r_phu_luc": "p_phu_luc"})
    top = ends(F.col("p_phan"), F.col("p_phu_luc"))
    rows = rows.withColumn("p_chuong", stands("chuong", top))
    rows = rows.withColumn("p_muc", stands("muc", F.col("p_chuong")))
    rows = rows.withColumn("p_dieu", stands("dieu", ends(top, F.col("p_chuong"), F.col("p_muc"))))
    for kind, parent in (("khoan", "dieu"), ("diem", "khoan"), ("tiet", "diem")):
        rows = rows.withColumn(f"p_{kind}", stands(kind, F.col(f"p_{parent}")))
    for kind in ("muc", "khoan", "diem", "tiet"):
        rows = rows.where((F.col("kind") != kind) | F.col(f"p_{kind}").isNotNull())
    is_node = F.col("kind") != "text"
    parent = F.lit(None).cast("int")
    for kind, options in PARENTS.items():
        held = [F.col(f"p_{o}") for o in options if o]
        parent = F.when(F.col("kind") == kind, F.coalesce(*held) if held else F.lit(None).cast("int")).otherwise(parent)
    pointers = [f"p_{k}" for k in LEVELS]
    deepest = F.coalesce(*map(F.col, reversed(pointers)))
    owner = F.when(F.col("p_phu_luc") > F.coalesce(deepest, F.lit(-1)), F.col("p_phu_luc")).otherwise(deepest)
    rows = rows.withColumn("parent_seq", F.when(is_node, parent)).withColumn("seq", F.when(is_node, F.col("line_no")).otherwise(owner)).where("seq is not null")
    # a node's row and its text lines meet in one group; text set in less than its node trails
    indent = F.length("line") - F.length(F.ltrim("line"))
    late = indent < F.when(F.col("seq") == F.col("p_tiet"), 6).when(F.col("seq") == F.col("p_diem"), 3).otherwise(0)
    rows = rows.withColumn("late", ~is_node & late)
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", "content")))), lambda x: x["content"]), "\n")
    own = lambda c: F.max(F.when(is_node, F.col(c))).alias(c)
    nodes = rows.groupBy("doc_id", "seq").agg(own("parent_seq"), own("kind"), own("index"), F.max(F.when(is_node, F.col("content"))).alias("own"), *map(own, pointers), joined(~is_node & ~F.col("late")).alias("lead_in"), joined(F.col("late")).alias("trailing"))
    # siblings of the same index get their count as a suffix
    twins = Window.partitionBy("doc_id", "parent_seq", "kind", "index").orderBy("seq")
    nodes = nodes.withColumn("nth", F.row_number().over(twins))
    segment = F.concat_ws("_", "kind", F.nullif("index", F.lit("")), F.when(F.col("nth") > 1, F.col("nth").cast("string")))
    return _with_ancestry(nodes.withColumn("segment", segment).drop("nth"))


#: Levels that nest, from the top.
LEVELS = ["phan", "chuong", "muc", "dieu", "khoan", "diem", "tiet"]


def _with_ancestry(nodes: DataFrame) -> DataFrame:
    """Path, depth, node_id and breadcrumb: of each level, the last node whose pointer still stands is the ancestor."""
    label = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    titled = F.col("kind").isin("phan", "chuong", "muc", "phu_luc", "dieu")
    nodes = nodes.withColumn("title", F.when(titled, F.nullif(F.trim("own"), F.lit("")))).withColumn("body", F.when(~titled, F.col("own")).otherwise(F.lit("")))
    crumb = F.concat(F.concat_ws(" ", F.try_element_at(label, F.col("kind")), F.nullif("index", F.lit(""))), F.coalesce(F.concat(F.lit(": "), "title"), F.lit("")))
    nodes = nodes.withColumn("here", F.struct("seq", "segment", crumb.alias("crumb")))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    above = [F.when(F.col(f"p_{k}").isNotNull(), F.last(F.when(F.col("kind") == k, F.col("here")), True).over(w)) for k in LEVELS]
    chain = F.when(F.col("kind") == "phu_luc", F.array("here")).otherwise(F.filter(F.array(*above), lambda x: x.isNotNull()))
    nodes = nodes.withColumn("depth", F.when(F.col("kind") == "phu_luc", 0).otherwise(sum(F.col(f"p_{k}").isNotNull().cast("int") for k in LEVELS) - 1))
    below = F.lead("depth").over(Window.partitionBy("doc_id").orderBy("seq"))  # a node's first child follows it
    nodes = nodes.withColumns({"chain": chain, "has_children": F.coalesce(below > F.col("depth"), F.lit(False))})
    part = lambda name: F.transform("chain", lambda x: x[name])
    return nodes.select(
        "doc_id", "seq", "parent_seq", "kind", "index", "lead_in", "trailing", "title", "body",
        F.concat_ws("_", F.concat(F.lit("doc_"), "doc_id"), F.array_join(part("segment"), "_")).alias("node_id"),
        F.array_join(part("crumb"), " > ").alias("breadcrumb"), part("seq").alias("path"), "depth", "has_children",
    )


def finish_nodes(nodes: DataFrame) -> DataFrame:
    """Second pass: titles that go on in the lead-in, texts of leaves joined, unfinished parents, cleaned content.

    Where an article's title goes on, its breadcrumb and those of all nodes below
    it get the whole title; a chapter's breadcrumb stays.
    """
    rows, lead = nodes, F.col("lead_in") != ""
    takes = F.col("kind").isin("chuong", "muc") & F.col("title").isNull() & lead
    goes_on = (F.col("kind") == "dieu") & F.col("has_children") & lead & ~F.rtrim("lead_in").endswith(":")
    one_line = F.trim(F.regexp_replace("lead_in", r"\s*\n\s*", " "))
    title = F.when(takes, one_line).when(goes_on, F.concat_ws(" ", F.trim("title"), one_line)).otherwise(F.col("title"))
    label = lambda t: F.concat(F.lit("Điều "), "index", F.coalesce(F.concat(F.lit(": "), t), F.lit("")))
    above = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    renamed = F.when(F.col("kind") == "dieu", F.struct("seq", F.when(goes_on, label(F.col("title"))).alias("old"), label(title).alias("new")))
    rows = rows.withColumn("article", F.last(renamed, ignorenulls=True).over(above))
    at = F.instr("breadcrumb", F.col("article.old"))
    crumb = F.concat(F.substring("breadcrumb", F.lit(1), at - 1), F.col("article.new"), F.substring("breadcrumb", at + F.length("article.old"), F.length("breadcrumb")))
    below_it = F.array_contains("path", F.col("article.seq")) & (at > 0)
    rows = rows.withColumn("breadcrumb", F.when(F.coalesce(below_it, F.lit(False)), crumb).otherwise(F.col("breadcrumb"))).drop("article")
    rows = rows.withColumn("new_title", title).withColumn("lead_in", F.when(takes | goes_on, F.lit("")).otherwise(F.col("lead_in"))).drop("title").withColumnRenamed("new_title", "title")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = F.concat_ws(" ", blank("body"), blank("lead_in"), blank("trailing"))
    unfinished = F.col("has_children") & (F.trim("body") != "") & ~F.trim("body").rlike(r"[.?!:;]$")
    content = F.when(~F.col("has_children"), joined).when(unfinished, F.lit("")).otherwise(F.col("body"))
    lead_in = F.when(~F.col("has_children"), F.lit("")).when(unfinished, F.concat_ws(" ", "body", blank("lead_in"))).otherwise(F.col("lead_in"))
    trailing = F.when(~F.col("has_children"), F.lit("")).otherwise(F.col("trailing"))
    kept = [c for c in rows.columns if c not in ("body", "lead_in", "trailing")]
    made = rows.select(*kept, F.inline(F.array(F.struct(content.alias("c__"), lead_in.alias("l__"), trailing.alias("trailing")))))
    return made.select(*kept, clean_content(F.col("c__")).alias("content"), clean_content(F.col("l__")).alias("lead_in"), "trailing")


# Forms of references.
INTERNAL = r"(?iu)(?:điểm\s+([a-zđ])\s+)?(?:khoản\s+(\d+)\s+)?điều\s+(\d+)"
SELF = r"(?iu)(?:điều|khoản|điểm)\s+này"
LAW = r"(?U)(Luật\s+[A-ZĐ](?:(?!\s+và\s+Luật\s+[A-ZĐ])[\w\s,]){2,120})(?=\s|;|\.|$)"
DECREE = r"(?iuU)((?:nghị\s+định|thông\s+tư|quyết\s+định|nghị\s+quyết)\s+(?:số\s+)?\d+/\d+/[\w\-]+)"
REACH = 120


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Matches with their places: the text before the n-th match is what the split leaves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            m.alias("match"),
            (F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, x: s + F.length(x))).alias("start"),
        ),
    )


def find_references(nodes: DataFrame, text: str = "text") -> DataFrame:
    """References in node texts: (doc_id, node_id, start, kind, match, target_id).

    An internal reference that an external document follows within 120 characters,
    with no end of sentence between, belongs to that document, which is then used
    up.  Of matches that start together the first kind stays.  Targets name an
    article of the same document only if it has one.
    """
    t = F.col(text)
    all_of = F.concat(_matches(t, "internal", INTERNAL), _matches(t, "self", SELF), _matches(t, "law", LAW), _matches(t, "decree", DECREE))
    # a node's matches are few: they are held against one another where they stand
    order = lambda m: F.struct(m["start"].alias("start"), F.when(m["kind"] == "internal", 0).when(m["kind"] == "self", 1).when(m["kind"] == "law", 2).otherwise(3).alias("o"), m["kind"].alias("kind"), m["match"].alias("match"))
    found = nodes.select("doc_id", "node_id", *(["kind", "index", "seq"] if "kind" in nodes.columns else []), F.col(text).alias("t__"), F.array_sort(F.transform(all_of, order)).alias("m__"))
    once = lambda m, i: (i == 0) | (F.get("m__", i - 1)["start"] != m["start"])
    found = found.withColumn("m__", F.filter("m__", once))
    external = F.filter("m__", lambda m: m["kind"].isin("law", "decree"))

    def owned(m: Column) -> Column:
        """A match with the nearest external one behind it, where that is near."""
        behind = F.get(F.filter(F.col("x__"), lambda x: x["start"] > m["start"]), F.lit(0))
        end = m["start"] + F.length(m["match"])
        gap = F.substring(F.col("t__"), end + 1, behind["start"] - end)
        near = (m["kind"] == "internal") & behind.isNotNull() & (behind["start"] - end <= REACH) & ~gap.rlike(r"[.\n]|này")
        return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["match"].alias("match"), F.when(near, behind["match"]).alias("of"), F.when(near, behind["start"]).alias("of_start"))

    found = found.withColumn("x__", external).withColumn("m__", F.transform("m__", owned))
    claimed = F.transform(F.filter("m__", lambda m: m["of_start"].isNotNull()), lambda m: m["of_start"])
    found = found.withColumn("c__", claimed).withColumn("m__", F.filter("m__", lambda m: ~F.array_contains(F.col("c__"), m["start"])))
    ask = F.transform("m__", lambda m: F.struct(F.when(m["kind"] == "internal", F.regexp_extract(m["match"], INTERNAL, 3)).alias("article"), F.lit(1).alias("asks"), *[m[c].alias(c) for c in ("start", "kind", "match", "of")], F.lit(None).cast("string").alias("def_id"), F.lit(None).cast(dict(found.dtypes).get("seq", "int")).alias("def_seq")))
    if "kind" in nodes.columns:  # articles and what refers to them meet by document and number, where the document lies
        none = [F.lit(None).cast(k).alias(c) for c, k in (("start", "int"), ("kind", "string"), ("match", "string"), ("of", "string"))]
        own = F.array(F.struct(F.col("index").alias("article"), F.lit(0).alias("asks"), *none, F.col("node_id").alias("def_id"), F.col("seq").alias("def_seq")))
        ask = F.when(F.col("kind") == "dieu", F.concat(own, ask)).otherwise(ask)
    each = found.select("doc_id", "node_id", F.inline(ask))
    w = Window.partitionBy("doc_id", "article").orderBy("asks", "def_seq").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("base", F.last("def_id", ignorenulls=True).over(w)).where("asks = 1")
    each = each.withColumn("base", F.when(F.col("kind") == "internal", F.col("base")))
    point, clause, article = (F.regexp_extract("match", INTERNAL, i) for i in (1, 2, 3))
    sub = F.concat_ws("_", F.concat(F.lit("dieu_"), article), F.when(clause != "", F.concat(F.lit("khoan_"), clause)), F.when(point != "", F.concat(F.lit("diem_"), F.lower(point))))
    tail = F.concat_ws("_", F.when(clause != "", F.concat(F.lit("khoan_"), clause)), F.when(point != "", F.concat(F.lit("diem_"), F.lower(point))))
    name = lambda c: slugify(clean_law_name(c))
    target = (
        F.when(F.col("kind").isin("law", "decree"), F.concat(F.lit("external_"), name(F.col("match"))))
        .when(F.col("kind") == "self", F.col("node_id"))
        .when(F.col("of").isNotNull(), F.concat_ws("_", F.lit("external"), name(F.col("of")), sub))
        .when(F.col("base").isNull(), F.concat(F.lit("external_"), sub))
        .otherwise(F.concat_ws("_", "base", F.nullif(tail, F.lit(""))))
    )
    out = each.select("doc_id", "node_id", "start", "kind", "match", target.alias("target_id"))
    once = Window.partitionBy("doc_id", "node_id", "match", "target_id").orderBy("start")
    return out.withColumn("n__", F.row_number().over(once)).where("n__ = 1 and target_id <> node_id").drop("n__")


# Fixed value: headings of guidance papers.
GUIDANCE = r"^\s*(?:[A-Z]\.|[IVXLCDM]+\.|\d+(?:\.\d+)*\.?)\s+\S"


def guidance_sections(lines: DataFrame, least: int = 30, first_title: str = "Nội dung", heading: str = GUIDANCE) -> DataFrame:
    """Sections of papers without a tree: (doc_id, section, title, body); short ones are left out, all headings count."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("s"))))), lambda x: x["s"]), " ")
    out = rows.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("head"), F.trim("line"))), F.lit(first_title)).alias("title"), body.alias("body"))
    return out.where(F.length("body") >= least)


def merge_split_tables(tables: DataFrame) -> DataFrame:
    """Tables that go on from page to page as one: (doc_id, table_index, page_number, headers, rows).

    A table goes on if it has as many columns and stands on the next page; its
    header is then a row.
    """
    w = Window.partitionBy("doc_id").orderBy("table_index")
    cols = F.size("headers")
    starts = ~F.coalesce((cols == F.lag(cols).over(w)) & (F.col("page_number") == F.lag("page_number").over(w) + 1), F.lit(False))
    rows = tables.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("starts"), F.col("rows")).otherwise(F.concat(F.array("headers"), F.col("rows")))
    merged = rows.groupBy("doc_id", "run").agg(
        F.min_by("headers", "table_index").alias("headers"), F.min("page_number").alias("page_number"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("table_index", own.alias("r")))), lambda x: x["r"])).alias("rows")
    )
    return merged.select("doc_id", (F.col("run") - 1).cast("int").alias("table_index"), "page_number", "headers", "rows", F.size("rows").alias("row_count"), F.size("headers").alias("col_count"))


PATCHED = ("title", "content", "lead_in")
#: Documents whose patches are replayed at a time.
DOCUMENTS = 512


def _replay(rows: list[dict]) -> list[dict]:
    """What a document's patches, one after the other, make of the nodes they name (rows of op ``base``).

    A node's ``place`` tells what it stands below: its own id, or for an added one
    that of the node behind which it stands.
    """
    nodes = {r["node_id"]: {**r, "alive": True, "origin": r["node_id"], "place": r["node_id"]} for r in rows if r["op"] == "base"}
    tops: list[str] = []
    for r in sorted((r for r in rows if r["op"] != "base"), key=lambda r: r["op_seq"]):
        own = nodes.get(r["node_id"])
        if r["op"] == "remove_node":
            top = r["node_id"]
            tops.append(top)
            for node_id, n in nodes.items():
                if node_id == top or node_id.startswith(f"{top}_") or n["place"].startswith(f"{top}_"):
                    n["alive"] = False
        elif own is None or not own["alive"]:
            continue  # what is not there, or not any more, is not changed
        elif r["op"] == "set_field" and r["field"] in PATCHED:
            own[r["field"]] = r["value"]
        elif r["op"] == "add_node" and r["field"] and not nodes.get(r["field"], {}).get("alive"):
            end = min((n["seq"] for n in nodes.values() if n["alive"] and own["seq"] < n["seq"]), default=float("inf"))
            seq = (own["seq"] + min(end, math.floor(own["seq"]) + 1)) / 2  # between it and what comes next
            nodes[r["field"]] = {**own, "node_id": r["field"], "content": r["value"], "seq": seq}
    kept = [{k: n[k] for k in ("node_id", "alive", "origin", "seq", *PATCHED)} for n in nodes.values()]
    return kept + [{"node_id": t, "alive": None, "origin": None, "seq": None, **dict.fromkeys(PATCHED)} for t in tops]


def apply_patches(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Nodes with corrections applied in the order of op_seq: patches (doc_id, op_seq, op, node_id, field, value).

    set_field sets title, content or lead_in; remove_node takes its subtree (ids
    that go on behind it); add_node puts a node behind another of the same parent
    (value: its content, field: its id), with that one's other columns and, where
    seq is a double, a seq between it and what follows.  Each sees what the ones
    before it left: a node added behind an added one, fields set on an added node,
    nothing done to a removed one.  Applying them again changes nothing.  Tables
    and references have functions of their own.

    Only a document's patches and the nodes they name meet in a task, never all
    its nodes; these are joined with the outcome.
    """
    node_type = lambda c: dict(nodes.dtypes)[c]
    patches = patches.where("op in ('set_field', 'remove_node', 'add_node')").select("doc_id", F.col("op_seq").cast("int").alias("op_seq"), "op", "node_id", "field", F.col("value").cast("string").alias("value"))
    named = patches.select("doc_id", "node_id").unionByName(patches.where("op = 'add_node'").select("doc_id", F.col("field").alias("node_id"))).distinct()
    named = hint_if_small(staged(named), 128)
    base = nodes.join(named, ["doc_id", "node_id"]).select("doc_id", F.lit(None).cast("int").alias("op_seq"), F.lit("base").alias("op"), "node_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.col("seq").cast("double").alias("seq"), *PATCHED)
    rows = base.unionByName(patches, allowMissingColumns=True)
    schema = f"doc_id {node_type('doc_id')}, node_id string, alive boolean, origin string, seq double, " + ", ".join(f"{c} string" for c in PATCHED)

    names = ["doc_id", "node_id", "alive", "origin", "seq", *PATCHED]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, DOCUMENTS):  # most documents have few patches, so a call for each would cost more than they do
                some = batch.slice(a, DOCUMENTS)
                out = [(d, r) for d, each in zip(range(some.num_rows), some.column(1).to_pylist(), strict=True) for r in _replay(each)]
                columns = [some.column(0).take(pa.array([d for d, _ in out], pa.int64())), pa.array([r["node_id"] for _, r in out], pa.string()), pa.array([r["alive"] for _, r in out], pa.bool_())]
                columns += [pa.array([r["origin"] for _, r in out], pa.string()), pa.array([r["seq"] for _, r in out], pa.float64()), *[pa.array([r[c] for _, r in out], pa.string()) for c in PATCHED]]
                yield pa.RecordBatch.from_arrays(columns, names)

    grouped = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*[x for x in rows.columns if x != "doc_id"])).alias("rows"))
    outcome = staged(grouped.mapInArrow(replay, schema))
    tops = hint_if_small(outcome.where("alive is null").select("doc_id", F.col("node_id").alias("top")).distinct(), 128)
    parts = F.split("node_id", "_")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    below = nodes.where(F.size(parts) > 1).select("doc_id", "node_id", F.explode(above).alias("top")).join(tops, ["doc_id", "top"], "left_semi").select("doc_id", "node_id").distinct()
    kept = nodes.join(named, ["doc_id", "node_id"], "left_anti").join(below, ["doc_id", "node_id"], "left_anti")
    found = outcome.where("alive").select("doc_id", F.col("origin").alias("node_id"), F.col("node_id").alias("as__"), *[F.col(c).alias(f"{c}__") for c in ("seq", *PATCHED)])
    seq = F.col("seq__") if node_type("seq") == "double" else F.col("seq")
    new = {"node_id": F.col("as__"), "seq": seq, **{c: F.col(f"{c}__") for c in PATCHED}}
    changed = nodes.join(hint_if_small(found, 512), ["doc_id", "node_id"]).select(*[new.get(c, F.col(c)).alias(c) for c in nodes.columns])
    return kept.unionByName(changed)


TABLE_VALUE = "table_index int, page_number int, headers array<string>, rows array<array<string>>"


def add_tables(tables: DataFrame, patches: DataFrame) -> DataFrame:
    """Tables (doc_id, table_index, page_number, headers, rows) with those that patches add, by their JSON value.

    A table of an index that is there already stays as it is, so applying patches
    again changes nothing; of two patches for one index the first holds.
    """
    asked = patches.where("op = 'add_table'").select("doc_id", "op_seq", F.from_json("value", TABLE_VALUE).alias("t")).where("t.table_index is not null")
    first = asked.groupBy("doc_id", "t.table_index").agg(F.min_by("t", "op_seq").alias("t")).select("doc_id", "t.*")
    return tables.unionByName(first.join(tables.select("doc_id", "table_index"), ["doc_id", "table_index"], "left_anti").select(*tables.columns))


def stale_patches(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (doc_id, op_seq, sha256) made for another text than the document has now: they are applied, with a warning."""
    now = docs.select("doc_id", F.sha2("text", 256).alias("now"))
    return patches.where("sha256 is not null").join(now, "doc_id").where("sha256 <> now").select("doc_id", "op_seq", "sha256", "now")


def add_references(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Edges (doc_id, node_id, match, target_id) with those that patches add, each once."""
    more = patches.where("op = 'add_reference'").select("doc_id", "node_id", F.col("field").alias("match"), F.col("value").alias("target_id"))
    return edges.unionByName(more).dropDuplicates(["doc_id", "node_id", "match", "target_id"])


@dataclass
class Parsed:
    """What parsing a corpus gives: nodes, the references between them, sections of papers without a tree, and issues."""

    nodes: DataFrame
    references: DataFrame
    sections: DataFrame
    issues: DataFrame


def parse_documents(docs: DataFrame, patches: DataFrame | None = None, stage: bool = True) -> Parsed:
    """Raw texts (doc_id, text) to trees: clean, classify, build, finish, patch, find references, check.

    Documents in which no node is found are cut into guidance sections.  Null and
    empty texts give nothing; texts are read whole.  Without ``stage`` nothing is
    written: for callers that read one of the tables, once.
    """
    from lexmill.operators.quality import stage_invariants

    held = staged if stage else lambda df: df
    clean = held(docs.select("doc_id", clean_document(nfc("text")).alias("text")))
    nodes = finish_nodes(build_nodes(clean))
    nodes = held(nodes if patches is None else apply_patches(nodes, patches))
    references = find_references(nodes.withColumn("text", F.concat_ws(" ", "content", "lead_in")))
    if patches is not None:
        found = add_references(references.select("doc_id", "node_id", "match", "target_id"), patches)
        references = found.join(references, ["doc_id", "node_id", "match", "target_id"], "left")
    bare = clean.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    return Parsed(nodes, references, guidance_sections(lines_of(bare)), stage_invariants(nodes))


# Document types by their heading, in order, and forms of dates of effect.
TYPES = [("Thông tư", r"(?m)^\s*THÔNG\s+TƯ\b"), ("Nghị định", r"(?m)^\s*NGHỊ\s+ĐỊNH\b"), ("Quyết định", r"(?m)^\s*QUYẾT\s+ĐỊNH\b"), ("Nghị quyết", r"(?m)^\s*NGHỊ\s+QUYẾT\b"), ("Luật", r"(?m)^\s*LUẬT\b")]


def document_metadata(text: Column, stem: Column, as_of: Column) -> Column:
    """Type, number, issue and effect of a document from its head and file name."""
    from lexmill.functions.numbers import document_number, parse_date

    at = F.regexp_instr(text, F.lit(r"(?U)\bCăn\s+cứ\b"))
    head = F.upper(F.substring(text, F.lit(1), F.least(F.when(at > 0, at - 1).otherwise(600), F.lit(400))))
    kind = F.lit("Luật")
    for name, pattern in reversed(TYPES):
        kind = F.when(head.rlike("(?U)" + pattern), name).otherwise(kind)
    said = F.regexp_extract(F.substring(text, 1, 300), r"(?iu)số\s*:\s*(\d+/\d{4}/[\p{L}\-0-9]+)", 1)
    effect = F.regexp_extract(text, r"(?isu)hiệu lực (?:thi hành )?(?:kể )?từ (ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}|ngày\s+\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.struct(
        kind.alias("document_type"),
        F.coalesce(F.nullif(said, F.lit("")), document_number(stem)).alias("document_number"),
        parse_date(F.substring(text, 1, 800)).alias("issue_date"),
        F.coalesce(parse_date(effect), as_of).alias("effective_date"),
    )
