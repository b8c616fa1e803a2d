"""Understanding of questions: classification as projections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import rules, search_rules


def holds_any(text: Column, words: list[str]) -> Column:
    """True if a lower-case text holds one of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def alternation(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def scope_hits(text: Column, words: dict[str, list[str]] = rules.SCOPE_WORDS) -> Column:
    """How often each scope's words are met, as an array of (scope, n) in the table's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[F.struct(F.lit(s).alias("scope"), F.regexp_count(low, F.lit(alternation(w))).alias("n")) for s, w in words.items()])


def classify_scope(text: Column, intent: Column, words: dict[str, list[str]] = rules.SCOPE_WORDS, gate: float = rules.SCOPE_GATE, calc: tuple[str, str] = ("PIT", "HKD")) -> Column:
    """Scopes of a question and how clear they are: struct(scopes, confidence).

    Without any hit, or if the leading scope has less than ``gate`` of all hits,
    the scope is ALL; a calculation without hits means both scopes of ``calc``,
    and one whose hits hold neither of them has the first added.
    """
    hits = scope_hits(text, words)
    total = F.aggregate(hits, F.lit(0), lambda s, h: s + h["n"])
    confidence = F.array_max(F.transform(hits, lambda h: h["n"])) / F.nullif(total, F.lit(0))
    met = F.transform(F.filter(hits, lambda h: h["n"] > 0), lambda h: h["scope"])
    is_calc = F.coalesce(intent == "CALCULATION", F.lit(False))
    lacks = ~F.arrays_overlap(met, F.array(*map(F.lit, calc)))
    found = F.when(is_calc & lacks, F.array_append(met, F.lit(calc[0]))).otherwise(met)
    everything = F.array(F.lit("ALL"))
    scopes = F.when(total == 0, F.when(is_calc, F.array(*map(F.lit, calc))).otherwise(everything)).when(confidence < gate, everything).otherwise(found)
    sure = F.when(total == 0, F.when(is_calc, rules.SCOPE_CALC_CONFIDENCE).otherwise(0.0)).otherwise(confidence)
    return F.struct(scopes.alias("scopes"), F.round(sure, 6).alias("confidence"))


def classify_query(text: Column) -> Column:
    """What a question asks for: struct(intent, article_refs, doc_refs, needs_validity, needs_guidance, needs_cross_doc)."""
    articles = F.regexp_extract_all(text, F.lit(rules.ARTICLE), F.lit(0))
    validity, cross = text.rlike(rules.ASKS_VALIDITY), text.rlike(rules.ASKS_CROSS)
    short = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 8
    direct = F.trim(text).rlike(rules.ARTICLE_ONLY) | ((F.size(articles) > 0) & short & ~cross)
    intent = F.when(direct, "DIRECT_LOOKUP").when(validity, "VALIDITY_CHECK").when(cross, "CROSS_DOC").when(text.rlike(rules.ASKS_SUM), "CALCULATION").otherwise("GENERAL_QA")
    return F.struct(
        intent.alias("intent"),
        articles.alias("article_refs"),
        F.regexp_extract_all(text, F.lit(rules.DOC_NUMBER), F.lit(0)).alias("doc_refs"),
        (validity | (intent == "VALIDITY_CHECK")).alias("needs_validity"),
        (~intent.isin("DIRECT_LOOKUP", "CROSS_DOC")).alias("needs_guidance"),
        (cross | (intent == "CROSS_DOC")).alias("needs_cross_doc"),
    )


def pre_route(text: Column, anchor: str = rules.TAX_ANCHOR, off: str = rules.OFF_DOMAIN) -> Column:
    """pass or reject: a word of the domain wins over one from elsewhere; unclear questions pass."""
    return F.when(text.rlike(anchor), "pass").when(text.rlike(off), "reject").otherwise("pass")


def is_off_topic(text: Column, anchor: str = rules.TAX_ANCHOR) -> Column:
    return ~text.rlike(anchor)


def all_of(text: Column, groups: list[list[str]]) -> Column:
    """True if a text holds a word of each group: detectors of combined situations."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [holds_any(low, g) for g in groups])


def situations(text: Column) -> Column:
    """What a question speaks of: struct(multi_income, online, penalty, accounting, late_payment); a null text of nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(
        (holds_any(low, search_rules.SALARY_WORDS) & holds_any(low, search_rules.BUSINESS_WORDS)).alias("multi_income"), holds_any(low, search_rules.ONLINE_WORDS).alias("online"),
        holds_any(low, search_rules.PENALTY_WORDS).alias("penalty"), holds_any(low, search_rules.ACCOUNTING_WORDS).alias("accounting"), holds_any(low, search_rules.LATE_WORDS).alias("late_payment"),
    )


def first_label(text: Column, table: dict[str, list[str]]) -> Column:
    """The first label, by priority, with a word in the text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(holds_any(low, words), F.lit(label)) for label, words in table.items()])


# Weights of the complexity score.
COMPLEXITY_WEIGHTS, PREMIUM_FROM = {"query": 0.4, "context": 0.2, "history": 0.2, "tools": 0.1, "docs": 0.1}, 0.7


def complexity(text: Column, hard_words: list[str], easy_pattern: str) -> Column:
    """How hard a question is, 0 to 1: hard words, length and number of questions; an easy form is 0.2."""
    low = F.lower(text)
    hits = F.aggregate(F.array(*[F.contains(low, F.lit(w)).cast("int") for w in hard_words]), F.lit(0), lambda a, b: a + b)
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    score = hits / 3 + F.when(F.length(text) > 200, 0.2).otherwise(0.0) + F.when(marks > 2, 0.1).otherwise(0.0)
    return F.when(low.rlike(easy_pattern), F.lit(0.2)).otherwise(F.least(F.lit(1.0), score))


def route_model(query: Column, context: Column, history: Column, tools: Column, docs: Column, used_today: Column, budget: int) -> Column:
    """premium or fast, by the weighted score, as long as the day's budget lasts."""
    w = COMPLEXITY_WEIGHTS
    score = w["query"] * query + w["context"] * context + w["history"] * history + w["tools"] * tools + w["docs"] * docs
    return F.when((score > PREMIUM_FROM) & (used_today < budget), "premium").otherwise("fast")


def specialist(scopes: Column, order: list[str] = ["PENALTY", "TMDT", "HKD", "PIT"]) -> Column:
    """The first scope, by priority, that has a specialist; else the general one."""
    return F.coalesce(*[F.when(F.array_contains(scopes, s), F.lit(s)) for s in order], F.lit("GENERAL"))


def intent_slots(text: Column) -> Column:
    """Slots of a question: yearly or monthly amount, dependants, year."""
    from lexmill.functions import numbers

    amount = numbers.parse_number(F.regexp_extract(text, r"(?iu)\d+(?:[.,]\d+)*\s*(?:triệu|tỷ|nghìn)", 0))
    monthly = F.lower(text).rlike("tháng")
    return F.struct(
        amount.alias("amount"),
        F.when(monthly, F.lit("month")).when(F.lower(text).rlike("năm"), F.lit("year")).alias("period"),
        F.regexp_extract(text, r"(?iu)(\d+)\s*(?:người phụ thuộc|npt|con)", 1).try_cast("int").alias("dependents"),
        F.regexp_extract(text, r"(20\d\d)", 1).try_cast("int").alias("year"),
        F.lower(text).rlike("doanh thu|doanh số").alias("is_revenue"),
    )


# Evidence of a question's intent, by field and value: patterns (on the lower-cased text) with weights.  These rules are
# this library's own; the ten worked questions of the tests say what they have to give.
INTENT_EVIDENCE: dict[str, dict[str, list[tuple[str, float]]]] = {
    "who": {
        "HKD": [(r"hộ kinh doanh|\bhkd\b", 1.0), (r"bán hàng|kinh doanh|cửa hàng|tiệm|quán|nhà hàng|tạp hóa", 0.7), (r"doanh thu|doanh số", 0.4), (r"shopee|lazada|tiktok|sendo|tiki", 0.3)],
        "individual": [(r"lương|tiền công", 0.6), (r"trúng|xổ số|phụ thuộc|\bcon\b", 0.5), (r"cho thuê", 0.5), (r"\bcá nhân\b", 0.3)],
        "employer": [(r"công ty|doanh nghiệp|người sử dụng lao động", 1.0), (r"trả lương|chi trả|khấu trừ tại nguồn|nhân viên", 0.6)],
    },
    "activity": {
        "goods_distribution": [(r"bán hàng|tiệm|tạp hóa|cửa hàng|bán lẻ|bán buôn", 0.8)],
        "services": [(r"dịch vụ|tư vấn|sửa chữa|cắt tóc|gia công", 0.8)],
        "manufacturing_transport": [(r"quán|cà phê|nhà hàng|ăn uống|sản xuất|vận tải|vận chuyển", 0.8)],
        "salary_wages": [(r"lương|tiền công|tiền thưởng", 0.8)],
        "lottery_prizes": [(r"xổ số|trúng thưởng|trúng giải", 0.9)],
        "asset_rental": [(r"cho thuê", 0.9)],
        "e_commerce_platform": [(r"shopee|lazada|tiktok|sendo|tiki|sàn thương mại", 1.0), (r"online|trực tuyến|livestream", 0.5)],
    },
    "domain": {
        "HKD": [(r"hộ kinh doanh|\bhkd\b|thuế khoán", 1.0), (r"doanh thu|doanh số|bán hàng|kinh doanh|tiệm|quán", 0.8), (r"cho thuê", 0.3)],
        "PIT": [(r"\btncn\b|thu nhập cá nhân", 1.0), (r"lương|tiền công|phụ thuộc|xổ số|trúng|khấu trừ", 0.8), (r"cho thuê", 0.4)],
        "VAT": [(r"\bgtgt\b|\bvat\b|giá trị gia tăng", 1.0)],
    },
    "intent": {
        "calculate": [(r"bao nhiêu|\btính\b", 1.0), (r"nộp thuế gì|đóng thuế gì", 0.7), (r"thuế\s*\?\s*$", 0.6)],
        "explain": [(r"là gì|thế nào|tại sao|vì sao", 0.7), (r"điều kiện|thay đổi|quy định|có phải", 0.6)],
    },
}


def _weigh(low: Column, values: dict[str, list[tuple[str, float]]]) -> Column:
    """Values with the weight of what speaks for them, the heaviest first; of equals the one named first."""
    each = [F.struct(sum((F.when(low.rlike(p), w).otherwise(0.0) for p, w in rows), F.lit(0.0)).alias("weight"), F.lit(-i).alias("place"), F.lit(v).alias("value")) for i, (v, rows) in enumerate(values.items())]
    return F.filter(F.sort_array(F.array(*each), asc=False), lambda x: x["weight"] > 0)


def query_intent(text: Column, evidence: dict[str, dict[str, list[tuple[str, float]]]] = INTENT_EVIDENCE) -> Column:
    """What a question is about: who, activities, domains, intent, flags, amounts, and how sure that is.

    Rules speak for the values of a field with their weights; the heaviest value is
    taken (all that have weight for activities and domains, heaviest first), and
    the field's confidence is the lead over the next one as a share of it, times
    its weight up to 1.  The overall confidence is the mean of the four fields'.
    A field that nothing speaks for is null (or empty) with confidence 0, as is
    that of a null text.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    found = {f: _weigh(low, values) for f, values in evidence.items()}
    weight = lambda f, i: F.coalesce(F.get(found[f], F.lit(i))["weight"], F.lit(0.0))
    sure = {f: F.when(weight(f, 0) > 0, (weight(f, 0) - weight(f, 1)) / weight(f, 0) * F.least(weight(f, 0), F.lit(1.0))).otherwise(0.0) for f in evidence}
    first = lambda f: F.get(found[f], F.lit(0))["value"]
    slots = intent_slots(text)
    revenue = slots["is_revenue"]
    return F.struct(
        first("who").alias("who"),
        F.transform(found["activity"], lambda x: x["value"]).alias("activities"),
        F.transform(found["domain"], lambda x: x["value"]).alias("domains"),
        first("intent").alias("intent"),
        (F.coalesce(first("intent"), F.lit("")) == "calculate").alias("requires_calculation"),
        F.contains(low, F.lit("điều kiện")).alias("requires_conditions"),
        low.rlike(r"online|trực tuyến|shopee|lazada|tiktok|sendo|tiki").alias("online"),
        F.when(revenue, slots["amount"]).alias("revenue"),
        F.when(~revenue & low.rlike("lương|thu nhập|tiền công"), slots["amount"]).alias("income"),
        slots["dependents"].alias("dependents"),
        slots["year"].alias("year"),
        F.round(sum((sure[f] for f in evidence), F.lit(0.0)) / len(evidence), 4).alias("confidence"),
    )


def accept_rewrite(query: Column, rewritten: Column) -> Column:
    """A rewritten query if it is long enough and says something else; otherwise the query."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[?.\s]", "")
    return F.when((F.length(F.trim(rewritten)) >= 15) & (bare(rewritten) != bare(query)), F.trim(rewritten)).otherwise(query)
