"""Evaluation of answers: tiers, overall scores, reports, failure classes."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.functions import numbers
from lexmill.functions.staging import hint_if_small, phrases_in, running_counts, staged
from lexmill.functions.text import expand_abbreviations, plain_paraphrase, strip_markdown

# Thresholds of the tiers and the pass rule.
PASS, DEGRADE = 0.667, {1: 1.0, 2: 0.85, 3: 0.0}
NEGATED = r"(?U)không\s+\w*\s*$"


def tier1_numbers(wanted: Column, answer: Column) -> Column:
    """Share of wanted numbers that an answer gives: 1 from 0.8, 0.5 from 0.5, else 0.2; null without any."""
    given = numbers.amounts(answer)
    share = F.size(F.filter(wanted, lambda n: numbers.number_found(n, given))) / F.nullif(F.size(wanted), F.lit(0))
    return F.when(share >= 0.8, 1.0).when(share >= 0.5, 0.5).when(share.isNotNull(), 0.2)


# Fixed value: what an expected text is held to.
EXPECTED_TOKENS = r"\d+(?:[.,]\d+)?%|miễn thuế|không chịu"


def tier1(needs_calculation: Column, values: Column, expected: Column, used: Column, tool_numbers: Column, answer: Column) -> Column:
    """First tier: struct(score, compliance).

    Null where nothing is to be calculated.  Expected values (array of double) above
    ten thousand go by ``tier1_numbers``; else an expected text by its percentages
    and exemptions (1 from 0.6 of them in the answer, 0.5 from 0.3, else 0.2; a text
    without any: 1).  Without either, no calculator among the tools used gives 0, a
    calculator's number (array of long) in the answer 1, and none of them 0.5.
    Compliance: whether a calculator was used, where it was wanted.
    """
    of = lambda a, kind: F.coalesce(a, F.array().cast(kind))
    said = F.coalesce(answer, F.lit(""))
    wanted = F.transform(F.filter(of(values, "array<double>"), lambda v: v > 10_000), lambda v: F.bround(v).cast("long"))
    tokens = F.regexp_extract_all(F.lower(expected), F.lit(EXPECTED_TOKENS), F.lit(0))
    share = F.coalesce(F.size(F.filter(tokens, lambda t: F.contains(F.lower(said), t))) / F.nullif(F.size(tokens), F.lit(0)), F.lit(1.0))
    by_text = F.when(share >= 0.6, 1.0).when(share >= 0.3, 0.5).otherwise(0.2)
    calculated = F.arrays_overlap(of(used, "array<string>"), F.array(*map(F.lit, CALCULATORS)))
    given = numbers.amounts(said)
    by_tool = F.when(~calculated, 0.0).when(F.exists(of(tool_numbers, "array<bigint>"), lambda n: numbers.number_found(n, given)), 1.0).otherwise(0.5)
    has_numbers, has_text = F.size(wanted) > 0, F.coalesce(expected, F.lit("")) != ""
    score = F.when(has_numbers, tier1_numbers(wanted, said)).when(has_text, by_text).otherwise(by_tool)
    compliance = F.when(calculated, "compliant").when(has_numbers | has_text, "tool_skipped").otherwise("no_tool")
    applies = F.coalesce(needs_calculation, F.lit(False))
    return F.struct(F.when(applies, score).alias("score"), F.when(applies, compliance).alias("compliance"))


def tier2_citations(expected: Column, cited: Column) -> Column:
    """Recall of expected documents times what precision below a half leaves; null without expected ones."""
    e, c = F.array_distinct(expected), F.array_distinct(cited)
    met = F.size(F.array_intersect(e, c))
    recall, precision = met / F.nullif(F.size(e), F.lit(0)), met / F.nullif(F.size(c), F.lit(0))
    return F.round(recall * F.least(F.lit(1.0), F.coalesce(precision, F.lit(0.0)) / 0.5), 3)


# Tools that fit a topic, and those that calculate.
TOPIC_TOOLS = {
    "Thuế hộ kinh doanh": ["calculate_tax_hkd", "calculate_tax_hkd_profit", "evaluate_tax_obligation", "search_legal_docs", "get_article"],
    "Thuế thu nhập cá nhân": ["calculate_tncn_progressive", "calculate_deduction", "search_legal_docs", "get_article"],
    "Thuế thương mại điện tử": ["calculate_tax_hkd", "evaluate_tax_obligation", "search_legal_docs", "get_article", "get_guidance"],
    "Nghĩa vụ kê khai": ["evaluate_tax_obligation", "search_legal_docs", "get_article"],
    "Kế toán HKD": ["search_legal_docs", "get_guidance"],
    "Xử phạt vi phạm": ["search_legal_docs", "get_article"],
    "Thủ tục hành chính": ["search_legal_docs", "get_article", "get_guidance"],
    "Thủ tục hoàn thuế": ["search_legal_docs", "get_article"],
    "Hiệu lực pháp luật": ["check_doc_validity", "get_article_with_amendments", "search_legal_docs"],
    "Miễn giảm thuế": ["evaluate_tax_obligation", "search_legal_docs", "get_article"],
    "Thuế tài sản": ["search_legal_docs"],
    "Bất khả kháng": ["search_legal_docs"],
}
CALCULATORS = ["calculate_tax_hkd", "calculate_tax_hkd_profit", "calculate_tncn_progressive", "calculate_deduction", "evaluate_tax_obligation"]


def tier3_tools(used: Column, topic: Column, needs_calculation: Column, answer: Column, table: dict[str, list[str]] = TOPIC_TOOLS) -> Column:
    """How well the tools used fit a topic.

    No tool: 0.3 with an answer of some length, else 0.  A calculation without a
    calculator: 0.  A fitting tool: 1; only others: 0.5; a topic without a list: 0.8.
    """
    lists = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fitting = F.try_element_at(lists, topic)
    return (
        F.when(F.size(used) == 0, F.when(F.length(answer) > 50, 0.3).otherwise(0.0))
        .when(needs_calculation & ~F.arrays_overlap(used, F.array(*map(F.lit, CALCULATORS))), 0.0)
        .when(fitting.isNull(), 0.8)
        .when(F.arrays_overlap(used, fitting), 1.0)
        .otherwise(0.5)
    )


def _guarded(fact: Column, answer: Column) -> Column:
    at = F.instr(answer, fact)
    before = F.substring(answer, F.greatest(at - 15, F.lit(1)), F.least(at - 1, F.lit(15)))
    return (at > 0) & ~before.rlike(NEGATED)


# Other ways to say a fact.
FACT_SYNONYMS = {
    "miễn": ["miễn thuế", "không phải nộp", "không nộp thuế", "được miễn"],
    "0,5%": ["0.5%", "0,5 %", "0.5 %"],
    "0,03%": ["0.03%", "0,03 %"],
    "15,5 triệu": ["15.5 triệu", "15,500,000", "15.500.000"],
    "6,2 triệu": ["6.2 triệu", "6,200,000", "6.200.000"],
}


def fact_in_answer(fact: Column, answer: Column) -> Column:
    """True if an answer states a fact: as it is, unmarked, written out, paraphrased without negation, as another form of a number, or by a synonym.

    Amounts that are no whole millions or billions are looked for with two places
    of a million and one of a billion.
    """
    low_f, low_a = F.trim(F.lower(fact)), F.lower(answer)
    para_f, para_a = plain_paraphrase(low_f), plain_paraphrase(low_a)
    plain = F.regexp_extract(low_f, r"^([\d.]+)\s*(?:vnd|vnđ|đồng|₫)?$", 1)
    value = F.replace(plain, F.lit("."), F.lit("")).try_cast("long")
    scaled = lambda unit, by: F.regexp_replace(F.regexp_extract(low_f, rf"^([\d,.]+)\s*{unit}$", 1), "[,.]", "").try_cast("long") * by
    grouped = lambda n: F.contains(answer, n.cast("string")) | F.contains(answer, F.format_number(n, 0))


    def scaled_down(unit: int, places: int, name: str) -> Column:
        part = F.replace(F.format_string(f"%.{places}f", F.bround(value / unit, places)), F.lit("."), F.lit(","))
        return (value >= unit) & F.contains(low_a, F.concat(F.when(value % unit == 0, F.floor(value / unit).cast("string")).otherwise(part), F.lit(f" {name}")))

    said = F.try_element_at(F.create_map(*[x for k, v in FACT_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), low_f)
    cases = [
        F.contains(low_a, low_f),
        F.contains(strip_markdown(low_a), low_f),
        F.contains(expand_abbreviations(low_a), expand_abbreviations(low_f)),
        _guarded(para_f, para_a),
        _guarded(expand_abbreviations(para_f), expand_abbreviations(para_a)),
        F.contains(low_f, F.lit("%")) & (F.contains(low_a, F.replace(low_f, F.lit(" "), F.lit(""))) | F.contains(low_a, F.replace(low_f, F.lit("%"), F.lit(" %")))),
        grouped(scaled("triệu", 1_000_000)),
        grouped(scaled("tỷ", 1_000_000_000)),
        scaled_down(1_000_000, 2, "triệu"),
        scaled_down(1_000_000_000, 1, "tỷ"),
        F.contains(answer, F.format_number(value, 0)),
        F.exists(said, lambda x: F.contains(low_a, x)),
    ]
    out = F.lit(False)
    for c in cases:
        out = out | F.coalesce(c, F.lit(False))
    return out


def tier4_facts(share: Column) -> Column:
    return F.when(share >= 0.9, 1.0).when(share >= 0.5, 0.5).when(share.isNotNull(), 0.0)


def _mean(scores: list[Column]) -> Column:
    held = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(held), F.lit(0))


def overall_score(t1: Column, t2: Column, t4: Column, level: Column) -> Column:
    """Mean of the tiers that apply, lowered by how much the run was degraded."""
    table = F.create_map(*[F.lit(x) for p in DEGRADE.items() for x in p])
    return _mean([t1, t2, t4]) * F.coalesce(F.try_element_at(table, F.coalesce(level, F.lit(1))), F.lit(1.0))


def passed(score: Column, needs_calculation: Column, t1: Column) -> Column:
    """From two thirds on, unless a calculation failed."""
    return F.coalesce((score >= PASS) & ~(needs_calculation & (t1 == 0)), F.lit(False))


def passed_all_tiers(t1: Column, t2: Column, t3: Column, t4: Column, least: float = PASS) -> Column:
    """The batch rule: the mean of all four tiers that apply."""
    return F.coalesce(_mean([t1, t2, t3, t4]) >= least, F.lit(False))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation by group: the keys and a column for each name in ``shares``.

    Values are counted first, then the counts are added up in their order by
    ranges (``running_counts``); the values at the two ranks that a quantile lies
    between are picked out.  No task holds all values of a group.  Null values do
    not count; a group without others has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n__"))
    placed = staged(running_counts(counted, keys, value, "n__"))
    sizes = placed.groupBy(*keys).agg(F.sum("n__").alias("all__")).select(*[F.col(k).alias(f"{k}_s__") for k in keys], "all__")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_s__"))
    met = placed.join(hint_if_small(sizes, 96), same)
    picked = {}
    for name, share in shares.items():
        at = (F.col("all__") - 1) * F.lit(share)
        holds = lambda rank: (F.col("before__") <= rank) & (rank < F.col("before__") + F.col("n__"))
        picked |= {f"{name}_l__": F.max(F.when(holds(F.floor(at)), F.col(value))), f"{name}_u__": F.max(F.when(holds(F.ceil(at)), F.col(value))), f"{name}_s__": F.max(at - F.floor(at))}
    found = met.groupBy(*keys).agg(*[c.alias(n) for n, c in picked.items()])
    return found.select(*keys, *[(F.col(f"{n}_l__") + (F.col(f"{n}_u__") - F.col(f"{n}_l__")) * F.col(f"{n}_s__")).alias(n) for n in shares])


def report(results: DataFrame) -> DataFrame:
    """Over all, each topic and each difficulty: counts, pass rate, tier means and how many questions each applies to, errors,
    compliance with the tools asked for, latencies without errors.

    results (topic, difficulty, passed, score, t1, t2, latency_ms, error) and, where
    they are there, t3, t4 and tool_compliance (compliant, tool_skipped or no_tool,
    of questions that tier 1 applies to).
    """
    has = set(results.columns)
    none = F.lit(None).cast("string")
    one = lambda i, topic, difficulty: F.struct(F.lit(i).alias("set"), topic.alias("topic"), difficulty.alias("difficulty"))
    sets = F.array(one(0, none, none), one(1, F.col("topic"), none), one(2, none, F.col("difficulty")))
    rows = results.withColumn("fine", F.when(F.col("error").isNull(), F.col("latency_ms"))).withColumn("s", F.explode(sets)).drop("topic", "difficulty").select("*", "s.set", "s.topic", "s.difficulty")
    keys = ["set", "topic", "difficulty"]
    tiers = [t for t in ("t1", "t2", "t3", "t4") if t in has]
    aggregates = [F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("int")).alias("n_passed"), F.round(F.avg("score"), 6).alias("avg_score"), F.count("error").alias("n_errors")]
    aggregates += [F.round(F.avg(t), 6).alias(f"avg_{t}") for t in tiers] + [F.count(t).alias(f"n_{t}") for t in tiers]
    if "tool_compliance" in has:
        told = lambda kind: F.count(F.when((F.col("tool_compliance") == kind) & F.col("t1").isNotNull(), 1))
        aggregates += [told("compliant").alias("n_compliant"), told("tool_skipped").alias("n_tool_skipped"), told("no_tool").alias("n_no_tool"), F.round(told("compliant") / F.nullif(F.count("t1"), F.lit(0)), 3).alias("compliance_rate")]
    aggregates += [F.min("fine").alias("min_ms"), F.max("fine").alias("max_ms"), F.bround(F.avg("fine")).cast("long").alias("avg_ms")]
    found = rows.groupBy(*keys).agg(*aggregates)
    quantiles = exact_quantiles(rows, keys, "fine", {"p50_ms": 0.5, "p95_ms": 0.95}).select(*[F.col(k).alias(f"{k}_q") for k in keys], *[F.bround(p).cast("long").alias(p) for p in ("p50_ms", "p95_ms")])
    same = (F.col("set") == F.col("set_q")) & F.col("topic").eqNullSafe(F.col("topic_q")) & F.col("difficulty").eqNullSafe(F.col("difficulty_q"))
    return found.join(hint_if_small(quantiles, 128), same, "left").drop("set", *[f"{k}_q" for k in keys])


def failed_questions(results: DataFrame, k: int = 20) -> DataFrame:
    """The first k questions, by id, that did not pass."""
    return results.where(~F.coalesce("passed", F.lit(False))).orderBy("question_id").limit(k)


def merge_batches(batches: list[DataFrame], key: str = "question_id") -> DataFrame:
    """Rows of several batches, the first of each question."""
    both = None
    for i, b in enumerate(batches):
        one = b.withColumn("b__", F.lit(i))
        both = one if both is None else both.unionByName(one)
    w = Window.partitionBy(key).orderBy("b__", *[c for c in ("seq",) if c in both.columns])
    return both.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__", "b__")


def sum_maps(rows: DataFrame, column: str) -> DataFrame:
    """Sums of maps of counts: (key, total)."""
    return rows.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"))


def failure_class(expected: Column, retrieved: Column, cited: Column, corpus: Column, t2: Column, t4: Column) -> Column:
    """Why a question failed: by what was expected, is there, was retrieved and was cited."""
    absent, missed = F.array_except(expected, corpus), F.array_except(expected, retrieved)
    return (
        F.when((F.size(expected) > 0) & (F.size(absent) == F.size(expected)), "corpus_gap")
        .when((F.size(expected) > 0) & (F.size(missed) == F.size(expected)), "routing")
        .when(F.size(missed) > 0, "partial")
        .when((t2 >= 0.5) & (t4 < 0.5), "annotation")
        .when(F.size(F.array_intersect(expected, cited)) == 0, "citation")
        .otherwise("hard")
    )


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value with their percentage of all."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def missing_facts(facts: DataFrame, retrieved: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where a missing fact (question_id, fact) was lost: synthesis, retrieval_miss, chunk_missing or doc_missing."""
    has = lambda df, name: phrases_in(df.select("text"), "text", facts, "fact").select(F.col("phrase").alias("low")).distinct().withColumn(name, F.lit(True))
    got = retrieved.join(facts, "question_id").where(F.contains(F.lower("text"), F.lower("fact"))).select("question_id", "fact").distinct().withColumn("in_hits", F.lit(True))
    out = facts.join(got, ["question_id", "fact"], "left").withColumn("low", F.lower("fact")).join(has(chunks, "in_chunks"), "low", "left").join(has(nodes, "in_nodes"), "low", "left")
    kind = F.when(F.col("in_hits"), "synthesis").when(F.col("in_chunks"), "retrieval_miss").when(F.col("in_nodes"), "chunk_missing").otherwise("doc_missing")
    return out.select("question_id", "fact", kind.alias("lost_in"))


# What a refusal says, and the length from which an answer is none.
REFUSALS = [
    "không đủ cơ sở", "không có thông tin", "chưa thể xác định", "không tìm thấy quy định", "không có căn cứ",
    "ngoài phạm vi", "chưa có quy định", "không thể trả lời", "không có căn cứ pháp lý",
]
REFUSAL_LENGTH = 250


def false_refusal(answer: Column, expected: Column, retrieved: Column, tier4: Column) -> Column:
    """True if a short answer declines, no fact is in it (tier 4 is 0 or null), and an expected document was retrieved."""
    text = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), r"^\s+|\s+$", "")
    declines = F.exists(F.array(*map(F.lit, REFUSALS)), lambda x: F.contains(text, x))
    return (F.length(text) < REFUSAL_LENGTH) & declines & F.coalesce(F.arrays_overlap(expected, retrieved), F.lit(False)) & (tier4.isNull() | (tier4 == 0))


def select_questions(
    rows: DataFrame, ids: list[int] | None = None, topic: str | None = None, difficulty: str | None = None, needs_calculation: bool | None = None, annotated: list[str] | None = None, offset: int = 0, limit: int | None = None
) -> DataFrame:
    """Questions by id, topic (contained, whatever its case), difficulty, need of a calculation and state of annotation, then a page of them by id."""
    if ids:
        rows = rows.where(F.col("id").isin(ids))
    if topic:
        rows = rows.where(F.contains(F.lower("topic"), F.lit(topic.lower())))
    if difficulty:
        rows = rows.where(F.col("difficulty") == difficulty)
    if needs_calculation is not None:
        rows = rows.where(F.col("needs_calculation") == needs_calculation)
    if annotated:
        rows = rows.where(F.col("annotated").isin(annotated))
    rows = rows.orderBy("id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def document_texts(nodes: DataFrame) -> DataFrame:
    """All text of each document, its nodes' contents in order: (doc_id, text)."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("t")))), lambda x: x["t"])
    return nodes.groupBy("doc_id").agg(F.array_join(F.filter(own, lambda t: t != ""), "\n").alias("text"))


def document_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id").distinct()


def chunks_of(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """All chunks of the documents asked for: docs (doc_id)."""
    return chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def resume(questions: DataFrame, old: DataFrame) -> DataFrame:
    """Questions that an older run has not passed."""
    return questions.join(old.where("passed").select(F.col("question_id").alias("id")), "id", "left_anti")


def merge_resumed(new: DataFrame, old: DataFrame) -> DataFrame:
    """New results and the passed ones of an older run that were not run again."""
    return new.unionByName(old.where("passed").join(new.select("question_id"), "question_id", "left_anti").select(*new.columns))


def smoke_cases(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each check's outcome and whether all hold."""
    every = F.lit(True)
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    return rows.select("*", F.struct(*[c.alias(k) for k, c in checks.items()]).alias("checks"), every.alias("ok"))


def calculator_numbers(values: list[Column]) -> Column:
    """Positive results of calculators, as whole numbers."""
    return F.transform(F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x > 0), lambda x: F.bround(x).cast("long"))


def error_streaks(log: DataFrame, key: str, order: str, is_error: Column) -> DataFrame:
    """Runs of consecutive errors: (key, first, length)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = log.withColumn("e__", is_error.cast("int")).withColumn("island", F.sum(1 - F.col("e__")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("e__ = 1").groupBy(key, "island").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).drop("island")


def token_stats(rows: DataFrame) -> DataFrame:
    """Chunk statistics: counts, sizes, tokens (a third of the characters), references."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.round(F.avg("chars"), 1).alias("avg_chars"),
        F.round(F.avg(F.floor(F.col("chars") / 3)), 1).alias("avg_tokens"), F.count_if(F.col("n_refs") > 0).alias("with_references"),
    )


def type_stats(chunks: DataFrame) -> DataFrame:
    """``token_stats`` with the counts of articles, clauses and points: chunks (chunk_type, chars, n_refs)."""
    kinds = chunks.agg(*[F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in ("dieu", "khoan", "diem")])
    return token_stats(chunks).join(F.broadcast(kinds), F.lit(True))  # one row each


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best similarity, 0 to 100, of the shorter text with a window of the longer one of its length."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        s, t = sorted((x, y), key=len)
        if not s:
            return 100.0 if not t else 0.0
        blocks = difflib.SequenceMatcher(None, s, t, autojunk=False).get_matching_blocks()
        starts = {max(0, m.b - m.a) for m in blocks}
        return max(100 * difflib.SequenceMatcher(None, s, t[i : i + len(s)], autojunk=False).ratio() for i in starts)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)
