"""Checks of answers: key facts, numbers, comparators, polarity, confidence, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import rules
from lexmill.functions.numbers import digits_only
from lexmill.functions.staging import hint_if_small, phrases_in, staged
from lexmill.operators.classify import holds_any


def key_facts(nodes: DataFrame, node_id: str = "node_id", text: str = "text", seq: str = "seq", families: list[tuple[str, str]] = rules.FACTS, per: list[str] | None = None) -> DataFrame:
    """Facts that patterns find, each value once, credited to its first node: (value, fact_type, evidence_node).

    ``per`` names columns within which values are told apart; by default the whole table.
    """
    per = per or []
    found = [F.struct(F.lit(i).alias("family"), F.lit(kind).alias("fact_type"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("values")) for i, (p, kind) in enumerate(families)]
    each = nodes.select(*per, node_id, seq, F.explode(F.array(*found)).alias("f")).select(*per, node_id, seq, "f.family", "f.fact_type", F.posexplode("f.values").alias("pos", "value"))
    each = each.withColumn("value", F.trim("value")).withColumn("key__", F.lower("value"))
    first = each.groupBy(*per, "key__").agg(F.min(F.struct(seq, "family", "pos", "value", "fact_type", F.col(node_id).alias("evidence_node"))).alias("b"))
    return first.select(*per, "b.value", "b.fact_type", "b.evidence_node")


def merge_facts(by_rule: DataFrame, by_model: DataFrame) -> DataFrame:
    """Both kinds of facts, those by rule first, each value once: (value, fact_type, source, seq)."""
    both = by_rule.withColumn("source", F.lit("regex")).withColumn("o", F.lit(0)).unionByName(by_model.withColumn("source", F.lit("llm")).withColumn("o", F.lit(1)))
    w = Window.partitionBy(F.lower(F.trim("value"))).orderBy("o", "seq")
    return both.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__", "o")


def verify_facts(facts: DataFrame, nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """Facts of a model that the nodes bear out, with the node that holds most of their terms.

    A fact needs that share of its terms of more than three letters; confidence is
    0.8 times the share.  Facts by rule pass.
    """
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) > 3))
    # facts go by number: what is counted is far more than there are facts
    asked = staged(facts.where("source = 'llm'").select("value", terms.alias("terms")).distinct().withColumn("fact", F.monotonically_increasing_id()))
    each = hint_if_small(asked.select("fact", F.explode("terms").alias("phrase")), 24 + F.octet_length("phrase"))
    held = staged(phrases_in(nodes.select("node_id", "seq", "text"), "text", asked.select(F.explode("terms").alias("phrase")), "phrase").select("node_id", "seq", "phrase"))
    every = held.select("phrase").distinct().join(each, "phrase").groupBy("fact").agg(F.count(F.lit(1)).alias("met"))
    own = held.join(each, "phrase").groupBy("fact", "node_id", "seq").agg(F.count(F.lit(1)).alias("own"))
    node = own.groupBy("fact").agg(F.max_by("node_id", F.struct("own", -F.col("seq"))).alias("node"))
    ratio = F.col("met") / F.greatest(F.size("terms"), F.lit(1))
    found = asked.join(every, "fact").join(node, "fact")
    good = found.where(ratio >= least).select("value", (F.bround(0.8 * ratio * 100) / 100).alias("confidence"), "node")
    ruled = facts.where("source = 'regex'").select("*", F.lit(1.0).alias("confidence"))
    return ruled.unionByName(facts.where("source = 'llm'").join(good, "value").withColumn("evidence_node", F.coalesce("node", "evidence_node")).drop("node"))


def order_facts(facts: DataFrame, *per: str) -> DataFrame:
    """Facts with their place: numbers, then conditions, then others, the surest first; within ``per`` columns."""
    kind = F.when(F.col("fact_type") == "numeric", 0).when(F.col("fact_type") == "condition", 1).otherwise(2)
    return facts.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(kind, F.desc("confidence"), "value")))


def fact_recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Recall and precision of found facts (case_id, value) against wanted ones (case_id, fact), and whether they pass."""
    pair = wanted.join(found, "case_id", "left").withColumn("hit", F.contains(F.lower("value"), F.lower("fact")) | F.contains(F.lower("fact"), F.lower("value")))
    recall = pair.groupBy("case_id", "fact").agg(F.max(F.coalesce("hit", F.lit(False)).cast("int")).alias("h")).groupBy("case_id").agg(F.avg("h").alias("recall"))
    precision = pair.where("value is not null").groupBy("case_id", "value").agg(F.max(F.col("hit").cast("int")).alias("h")).groupBy("case_id").agg(F.avg("h").alias("precision"))
    both = recall.join(precision, "case_id", "left").withColumn("precision", F.coalesce("precision", F.lit(1.0)))
    return both.withColumn("passes", (F.col("recall") >= 0.75))


# Facts whose absence is critical, and what a set of cases has to reach.
CRITICAL = r"(?iu)\d+(?:[.,]\d+)?\s*(?:%|triệu|tỷ|nghìn|ngày|tháng|năm)"
GATE_RECALL, GATE_MISSES = 0.75, 0.1


def critical_misses(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(case_id, critical_missed): how many wanted facts (case_id, fact) with a rate, an amount or a time no found one (case_id, value) covers."""
    grave = wanted.where(F.col("fact").rlike(CRITICAL)).select("case_id", "fact").distinct()
    pair = grave.join(found.select("case_id", "value"), "case_id", "left")
    hit = F.contains(F.lower("value"), F.lower("fact")) | F.contains(F.lower("fact"), F.lower("value"))
    missed = pair.groupBy("case_id", "fact").agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("h")).where("h = 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("critical_missed"))
    cases = wanted.select("case_id").distinct()
    return cases.join(missed, "case_id", "left").select("case_id", F.coalesce("critical_missed", F.lit(0)).alias("critical_missed"))


def recall_gate(cases: DataFrame, *by: str) -> DataFrame:
    """Means of recall and precision, the rate of cases with a critical miss, how many are good, fair or bad, and whether all pass: cases (recall, precision, critical_missed).

    For each value of the ``by`` columns; without them one row, also of no cases (which do not pass).
    """
    n, missed = F.count(F.lit(1)), F.count_if(F.col("critical_missed") > 0)
    recall, rate = F.avg("recall"), missed / F.nullif(n, F.lit(0))
    return cases.groupBy(*by).agg(
        n.alias("n"), recall.alias("recall"), F.avg("precision").alias("precision"), rate.alias("critical_rate"), F.count_if(F.col("recall") >= 0.75).alias("good"),
        F.count_if((F.col("recall") >= 0.5) & (F.col("recall") < 0.75)).alias("fair"), F.count_if(F.col("recall") < 0.5).alias("bad"),
        F.coalesce((recall >= GATE_RECALL) & (rate < GATE_MISSES), F.lit(False)).alias("passes"),
    )


# Fixed value: a number with its unit, as answers write it.
NUMBER = r"(?iu)(\d{1,3}(?:[.,]\d{3})*(?:\.\d+)?)\s*(tỷ|triệu|nghìn|ngàn|%|đồng|vnd)?"


def numbers_of(answer: Column) -> Column:
    """Numbers of at least two digits, without grouping signs."""
    return F.filter(F.transform(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(1)), digits_only), lambda n: (F.length(n) >= 2))


def comparator(text: Column, number: Column) -> Column:
    """The sign of comparison around the first place of a number: 40 characters before, 30 behind it."""
    at = F.instr(text, number)
    around = F.concat(F.substring(text, F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40))), F.lit(" "), F.substring(text, at, F.length(number) + 30))
    found = None
    for sign, words in rules.COMPARATORS:
        hit = holds_any(around, words)
        found = F.when(hit, sign) if found is None else found.when(hit, sign)
    return F.when(at > 0, found)


def check_facts(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hold answers (answer_id, answer) against what was retrieved for them (answer_id, text).

    Numbers of two or more digits must be found; a comparator opposite to the
    retrieved one, or a phrase that only its contrary stands for, fails.
    """
    joined = chunks.groupBy("answer_id").agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("corpus"))
    rows = answers.join(joined, "answer_id", "left").withColumn("low", F.lower("answer"))
    rows = rows.withColumn("nums", F.when(F.col("corpus").isNull(), F.array().cast("array<string>")).otherwise(F.filter(numbers_of(F.col("answer")), lambda n: n != "0")))
    rows = rows.withColumn("met", F.filter("nums", lambda n: F.contains(digits_only(F.col("corpus")), n)))
    opposite = F.create_map(*[x for k, v in rules.OPPOSITES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    flips = F.filter("met", lambda n: F.coalesce(F.array_contains(F.try_element_at(opposite, comparator(F.col("low"), n)), comparator(F.col("corpus"), n)), F.lit(False)))
    rows = rows.withColumn("flips", F.size(flips))
    polar = F.lit(0)
    for good, bad in rules.POLARITY:
        a, b, c, d = holds_any(F.col("low"), good), holds_any(F.col("low"), bad), holds_any(F.col("corpus"), good), holds_any(F.col("corpus"), bad)
        polar = polar + F.when((a & d & ~c) | (~(a & d & ~c) & b & c & ~d), 1).otherwise(0)
    rows = rows.withColumn("polarity", F.coalesce(F.when(F.col("corpus").isNull(), F.lit(0)).otherwise(polar), F.lit(0)))
    checked, matched = F.size("nums"), F.size("met")
    level = F.when((F.col("flips") > 0) | (F.col("polarity") > 0), "fail").when((checked > 0) & (matched == 0), "warning").otherwise("ok")
    return rows.select("answer_id", checked.alias("numeric_checked"), matched.alias("numeric_matched"), "flips", "polarity", level.alias("level"))


def numeric_alignment(answers: DataFrame, chunks: DataFrame, units: str = "triệu|tỷ|nghìn|đồng|ngày|tháng|năm") -> DataFrame:
    """Numbers with a unit in an answer that no retrieved text holds: (answer_id, number)."""
    corpus = chunks.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("corpus"))
    found = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(rf"(?iu)(\d+(?:[.,]\d+)*)\s*(?:{units})"), F.lit(1)))).alias("number"))
    return found.join(corpus, "answer_id").where(~F.contains("corpus", F.col("number"))).select("answer_id", "number")


def confidence_level(calls: Column, answer: Column) -> Column:
    """no_search, no_results, no_citation or ok; calls: array of (tool, n_results)."""
    searched = F.exists(calls, lambda c: c["tool"] == "search_legal_docs")
    calculated = F.exists(calls, lambda c: (c["tool"] == "calculate_tax_hkd") & (c["n_results"] > 0))
    results = F.exists(calls, lambda c: (c["tool"] == "search_legal_docs") & (c["n_results"] > 0))
    cited = answer.rlike(r"(?iu)(điều|khoản)\s+\d+|\d{1,4}/\d{4}/")
    return F.when(calculated, "ok").when(~searched, "no_search").when(~results, "no_results").when(~cited, "no_citation").otherwise("ok")


def dedup_sources(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Sources of several kinds, first of each key: each part has (answer_id, seq) and the key."""
    both = None
    for i, p in enumerate(parts):
        one = p.withColumn("kind", F.lit(i))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy("answer_id", *key).orderBy("kind", "seq")
    return both.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def context_budget(chunks: DataFrame, budget: int = 12_000, cap: int = 8, key: str = "query_id", losers: DataFrame | None = None) -> DataFrame:
    """Chunks, best first, as long as their number and total length hold: (query_id, chunk_id, rank, length)."""
    pool = chunks if losers is None else chunks.join(losers, [key, "chunk_id"], "left_anti")
    w = Window.partitionBy(key).orderBy("rank", "chunk_id")
    used = pool.withColumn("position", F.row_number().over(w)).withColumn("used", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where((F.col("position") <= cap) & (F.col("used") <= budget))


# Phrases of exceptions that a context keeps room for, and how many chunks it takes.
EXCEPTION_WORDS = [
    "trừ trường hợp", "ngoại lệ", "không phải khai", "không phải nộp",
    "miễn thuế", "được miễn", "không chịu thuế", "không bắt buộc",
    "không phải đăng ký", "không phải xuất", "trừ khi",
]
CONTEXT_CHUNKS = 8


def order_context(chunks: DataFrame, cap: int = CONTEXT_CHUNKS) -> DataFrame:
    """Chunks (query_id, chunk_id, doc_id, rank, text) that a context takes, with their position.

    Rules come first, then exceptions, which keep up to two places.  A document
    that has none of the places gets one for its best chunk: a free place, and
    beyond these the last one, where the last such document stays.
    """
    per = Window.partitionBy("query_id")
    is_exception = holds_any(F.lower(F.coalesce("text", F.lit(""))), EXCEPTION_WORDS)
    rows = chunks.withColumn("late", is_exception.cast("int"))
    rows = rows.withColumn("n_late", F.sum("late").over(per)).withColumn("n_rule", F.count(F.lit(1)).over(per) - F.col("n_late"))
    rules_kept = F.least("n_rule", F.greatest(F.lit(1), cap - F.least("n_late", F.lit(2))))
    nth = F.row_number().over(Window.partitionBy("query_id", "late").orderBy("rank", "chunk_id"))
    rows = rows.withColumn("kept", rules_kept).withColumn("nth", nth)
    place = F.when((F.col("late") == 0) & (F.col("nth") <= F.col("kept")), F.col("nth")).when((F.col("late") == 1) & (F.col("nth") <= cap - F.col("kept")), F.col("kept") + F.col("nth"))
    rows = rows.withColumn("place", F.when(place <= cap, place)).withColumn("taken", F.count("place").over(per))
    of_doc = Window.partitionBy("query_id", "doc_id")
    rows = rows.withColumn("has", F.max("place").over(of_doc)).withColumn("best", F.row_number().over(of_doc.orderBy("rank", "chunk_id")))
    lacking = rows.where("has is null and best = 1").withColumn("j", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).withColumn("m", F.count(F.lit(1)).over(per))
    room = cap - F.col("taken")
    swapped = F.when((F.col("m") > room) & (F.col("j") == F.col("m")), F.lit(cap)).when(F.col("j") <= room, F.col("taken") + F.col("j"))
    added = lacking.withColumn("position", swapped).where("position is not null").select("query_id", "chunk_id", "position", F.lit(1).alias("late_place"))
    own = rows.where("place is not null").select("query_id", "chunk_id", F.col("place").alias("position"), F.lit(0).alias("late_place"))
    # of two chunks for the last place, the one of the last lacking document
    both = own.unionByName(added.withColumn("late_place", F.lit(1) + F.when(F.col("position") == cap, 1).otherwise(0)))
    last = F.row_number().over(Window.partitionBy("query_id", "position").orderBy(F.desc("late_place"), F.desc("chunk_id")))
    return both.withColumn("n__", last).where("n__ = 1").select("query_id", "chunk_id", F.col("position").cast("int").alias("position"))


def top_score(scores: Column) -> Column:
    """The best score of what was retrieved; null where nothing was."""
    return F.array_max(scores)


def short_value(field: Column, value: Column) -> Column:
    """A result's field as it is logged: long texts cut at 200 characters."""
    long = field.isin("full_text", "content") & (F.length(value) > 200)
    return F.when(long, F.concat(F.substring(value, 1, 200), F.lit("..."))).otherwise(value)


def short_args(args: Column) -> Column:
    """Arguments (array of name, text, number) of a call as one line: numbers above a million in millions, texts cut at 30."""
    one = lambda a: F.concat(a["name"], F.lit("="), F.when(a["number"] > 1_000_000, F.concat(F.bround(a["number"] / 1e6).cast("long").cast("string"), F.lit("M"))).otherwise(F.substring(a["text"], 1, 30)))
    return F.array_join(F.transform(args, one), ", ")


def correction_text(issues: Column) -> Column:
    """What a draft with critical issues (array of key_fact, severity) is told to leave out; empty without any."""
    bad = F.transform(F.filter(issues, lambda i: i["severity"] == "critical"), lambda i: F.concat(F.lit("  - "), i["key_fact"]))
    # Fixed value: the wording of the instruction.
    head, tail = (
        "BẢN NHÁP TRƯỚC BỊ LOẠI DO VI PHẠM QUY TẮC.\nTUYỆT ĐỐI KHÔNG đề cập các thông tin sau:\n",
        "\nChỉ sử dụng dữ liệu có trong chunks được cung cấp.\nNếu không đủ cơ sở pháp lý → viết đúng câu: 'Không đủ cơ sở pháp lý để xác định [vấn đề].'",
    )
    return F.when(F.size(bad) == 0, F.lit("")).otherwise(F.concat(F.lit(head), F.array_join(bad, "\n"), F.lit(tail)))


def validate_citations(cited: DataFrame, retrieved: DataFrame, fallback: int = 2) -> DataFrame:
    """Citations (answer_id, doc_id, pos) of retrieved documents; where none holds, the first retrieved ones."""
    kept = cited.join(retrieved.select("answer_id", "doc_id").distinct(), ["answer_id", "doc_id"], "left_semi").select("answer_id", "doc_id", "pos", F.lit(False).alias("is_fallback"))
    bare = retrieved.join(kept.select("answer_id").distinct(), "answer_id", "left_anti").groupBy("answer_id", "doc_id").agg(F.min("rank").alias("rank"))
    first = bare.withColumn("pos", F.row_number().over(Window.partitionBy("answer_id").orderBy("rank", "doc_id"))).where(F.col("pos") <= fallback)
    return kept.unionByName(first.select("answer_id", "doc_id", "pos", F.lit(True).alias("is_fallback")))


def hierarchy_conflicts(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """Queries whose hits hold a document and the one that superseded it: (query_id, doc_id, superseded_by)."""
    old = hits.join(hint_if_small(manifest.where("superseded_by is not null").select("doc_id", "superseded_by"), 96), "doc_id").select("query_id", "doc_id", "superseded_by").distinct()
    new = hits.select("query_id", F.col("doc_id").alias("superseded_by")).distinct()
    return old.join(new, ["query_id", "superseded_by"], "left_semi").select("query_id", "doc_id", "superseded_by")


def source_label(kind: Column, index: Column, title: Column, status: Column) -> Column:
    """A source's place in words, and whether it needs a check: struct(label, needs_check)."""
    name = F.when(kind == "dieu", F.concat(F.lit("Điều "), index)).when(kind == "khoan", F.concat(F.lit("Khoản "), index)).when(kind == "diem", F.concat(F.lit("Điểm "), index))
    return F.struct(F.concat_ws(" › ", F.nullif(name, F.lit("")), F.nullif(title, F.lit(""))).alias("label"), (F.coalesce(status, F.lit("")) != "active").alias("needs_check"))


# Stages of the answering pipeline that may follow one another.
TRANSITIONS = {
    "ROUTER": ["RETRIEVAL", "CALC", "DONE"],
    "RETRIEVAL": ["CALC", "GENERATOR", "DONE"],
    "CALC": ["GENERATOR", "DONE"],
    "GENERATOR": ["FACT_CHECK", "DONE"],
    "FACT_CHECK": ["GENERATOR", "DONE"],
}


def bad_transitions(log: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Steps of a run's log (run_id, seq, stage) that may not follow the one before."""
    before = F.lag("stage").over(Window.partitionBy("run_id").orderBy("seq"))
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return log.withColumn("previous", before).where(F.col("previous").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(table, F.col("previous")), F.col("stage")), F.lit(False)))


def after_fact_check(passed: Column, issues: Column, regenerated: Column) -> Column:
    """What follows a fact check: struct(next, degrade_level).

    A check that passed, or that only warns, is done with the whole answer (level
    1).  Critical issues (array of key_fact, severity) ask for one new draft; after
    it the answer goes out with a caveat (level 2).  No check at all gives an
    explanation only (level 3).
    """
    grave = F.exists(F.coalesce(issues, F.array().cast("array<struct<key_fact: string, severity: string>>")), lambda i: i["severity"] == "critical")
    again = ~passed & grave & (F.coalesce(regenerated, F.lit(0)) == 0)
    level = F.when(passed.isNull(), 3).when(again, None).when(~passed & grave, 2).otherwise(1)
    return F.struct(F.when(passed.isNotNull() & again, "GENERATOR").otherwise("DONE").alias("next"), level.cast("int").alias("degrade_level"))


def event_frame(stage: Column, payload: Column) -> Column:
    """A server-sent event as text."""
    return F.concat(F.lit("event: "), stage, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def answer_sections(answer: Column, quote: str = "## Trích dẫn", reply: str = "## Trả lời") -> Column:
    """An answer with its two section marks, the first of each, as headings."""
    once = lambda c, pattern, new: F.regexp_replace(c, rf"(?isu)^(.*?){pattern}", "$1\n\n" + new + "\n\n")
    return once(once(answer, r"\*{0,2}\s*📌\s*Trích\s*dẫn\s*\*{0,2}[\s:>]*", quote), r"\*{0,2}\s*💬\s*Trả\s*lời\s*\*{0,2}[\s:]*", reply)
