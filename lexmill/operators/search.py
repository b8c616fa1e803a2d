"""Ranked retrieval: every step takes and gives tables keyed by query, so a batch of queries is one job."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import search_rules
from lexmill.functions.staging import BROADCAST_BYTES, byte_size, hint_if_small, met_in_blocks, phrases_in, shuffle_partitions, staged
from lexmill.functions.text import expand_synonyms, tokenize
from lexmill.operators.classify import classify_scope, holds_any

if TYPE_CHECKING:
    from lexmill.operators.postings import KeywordIndex

# Constants of the ranking.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 60, 0.7, 0.3
AUTHORITY = {1: 1.10, 2: 1.07, 3: 1.05, 4: 1.00, 5: 0.85}
RECENCY = 0.15
SUPERSEDED = 0.25
REF_FACTOR, REF_CAP, REF_CHARS, REF_MIN = 0.7, 3, 800, 0.005
EXC_FACTOR, EXC_CAP, EXC_CHARS = 0.65, 3, 800
AMEND_FACTOR, AMEND_CAP = 0.75, 3
SIBLING_FACTOR, SIBLING_REACH, SIBLING_CHARS = 0.60, 2, 1200
CHILD_FACTOR, CHILD_LAST, CHILD_CAP = 0.85, 6, 4
RERANK = {"domain": 0.05, "activity": 0.10, "who": 0.05, "rate": 0.15, "valid": 0.05}
RERANK_CAP = 0.15
ALLOW, SOFT, BLOCK = 1.0, 0.35, 0.05
DEFAULT_UPPER, DEFAULT_LOWER = 0.72, 0.50
OOD_FLOOR, OOD_GAP = 0.005, 0.0008
HIGH, MEDIUM = 0.018, 0.010
TOPIC_K, SCOPE_K = 3, 3
LEGACY_YEAR = 2026
LEGACY_WORDS = [
    "năm ngoái", "năm trước", "tháng trước", "kỳ trước", "trước đây", "trước khi luật mới", "theo luật cũ",
    "quy định cũ", "theo quy định cũ", "trước 01/01/2026", "trước 1/1/2026", "trước 2026",
    "hỗ trợ điện thoại", "phụ cấp điện thoại", "tiền điện thoại", "tiền ăn giữa ca", "phụ cấp ăn trưa", "trợ cấp ăn",
    "kỳ tính lương", "chu kỳ lương", "ngày 26 tháng", "26 tháng trước", "kỳ lương",
    "đóng thuế tncn thay", "đóng thuế thay", "đóng tiền thuế tncn cho người lao động", "công ty nộp thuế thay", "nộp thuế thay cho nhân viên",
]
CROSS_REFERENCE = r"(?iu)(quy\s+định\s+tại|theo\s+quy\s+định|trừ\s+trường\s+hợp|áp\s+dụng\s+(điểm|\s+khoản|\s+tiết|\s+điều))"


def top(rows: DataFrame, k: int, *order: Column, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of each query in a total order, ranked from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


# --- keyword search --------------------------------------------------------------------------


def term_weights(docs: DataFrame, terms: DataFrame, text: str = "text") -> tuple[DataFrame, float]:
    """(term, idf) of ``terms`` (term), and the mean length of a document.

    idf is ln(n - df + 0.5) - ln(df + 0.5); a negative one becomes epsilon times
    the mean over all terms.  Statistics are those of the whole corpus, taken in
    one pass: a term that no text can have counts the documents and their words.
    """
    words = docs.select(tokenize(F.coalesce(text, F.lit(""))).alias("w"))
    marks = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("dl")))
    whole = F.array(F.struct(F.lit("").alias("term"), F.size("w").alias("dl")))
    counted = staged(words.select(F.inline(F.concat(marks, whole))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words")))
    n, total = counted.where("term = ''").select("df", "words").first() or (0, 0)
    raw = counted.where("term <> ''").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    asked = raw.join(terms.select("term").distinct(), "term", "left_semi")
    return asked.select("term", F.when(F.col("raw") < 0, EPSILON * F.lit(mean)).otherwise(F.col("raw")).alias("idf")), total / n if n else 0.0


def query_terms(queries: DataFrame, widen: bool = True) -> DataFrame:
    """(query_id, term, times): a term counts as often as the query has it."""
    text = expand_synonyms(F.col("text")) if widen else F.col("text")
    return queries.select("query_id", F.explode(tokenize(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", keep: Column | None = None, widen: bool = True, within: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query by BM25, scores above 0: (query_id, doc_id, rank, score).

    Documents are cut down to the queries' terms before they are counted, so what
    is shuffled follows the queries and not the corpus.  The queries' terms, with
    their weights, are broadcast while their bytes are few; beyond, terms meet
    documents in as many shares as there are shuffle partitions, so that a frequent
    term does not fill a task.  ``keep`` filters what is ranked, not what the
    statistics are taken from; ``within`` (query_id, doc_id) names what each query
    may find.  Ties go to the smaller id.
    """
    asked = staged(query_terms(queries, widen))
    idf, average = term_weights(docs, asked)
    asked = staged(asked.join(idf, "term"))
    ranked = docs if keep is None else docs.where(keep)
    words = ranked.select(doc_id, tokenize(F.coalesce("text", F.lit(""))).alias("w"))
    terms = hint_if_small(asked.groupBy("term").agg(F.first("idf").alias("idf")), 24 + F.octet_length("term"))
    hits = words.select(doc_id, F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term")
    tf = hits.groupBy(doc_id, "dl", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (average or 1.0)))
    each, wanted = tf.select(doc_id, "term", weight.alias("w")), asked.select("query_id", "term", "times")
    if byte_size(wanted, 32 + F.octet_length("term")) <= BROADCAST_BYTES:
        met = each.join(F.broadcast(wanted), "term")
    else:
        shares = shuffle_partitions(docs.sparkSession)
        dealt = each.withColumn("share__", F.pmod(F.xxhash64(doc_id), F.lit(shares)))
        met = dealt.join(wanted.withColumn("share__", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>"))), ["term", "share__"])
    scored = met.groupBy("query_id", doc_id).agg(F.sum(F.col("w") * F.col("times")).alias("score")).where("score > 0")
    if within is not None:
        scored = scored.join(within, ["query_id", doc_id], "left_semi")
    return top(scored.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col(doc_id)).select("query_id", doc_id, "rank", "score")


# --- vector search ---------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Bytes of vectors that a task meets on either side, and lengths between which products neither vanish nor overflow.
SIDE_BYTES, SHORT, LONG = 16 << 20, 1e-150, 1e150


def measurable(length: Column) -> Column:
    """True of vectors whose products are numbers: not null, of length zero, or beyond what a double holds."""
    return F.coalesce((length > SHORT) & (length < LONG), F.lit(False))


def nearest_of(items: DataFrame, queries: DataFrame, keys: list[str], k: int, item_id: str) -> DataFrame:
    """(query_id, item, score) of items (keys, item_id, v, v_len) and queries (keys, query_id, q, q_len) that agree in ``keys``: at least the k nearest of each query and group, with scores as ``dot`` gives them.

    Both sides of a group meet in one task as matrices.  Their product tells which
    items can be among the k nearest when scores are rounded to six digits; only
    these are scored as ``dot`` does it, in the order of the components.  Of equal
    scores the k smallest ids stay.  All vectors are of one width and measurable.
    """
    types = dict(items.dtypes) | dict(queries.dtypes)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(item_id)
        ids, asked = left[item_id].combine_chunks(), right["query_id"].combine_chunks()
        out: list[pa.Table] = []
        if len(ids) and len(asked):
            matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
            v, q, v_len, q_len = matrix(left, "v"), matrix(right, "q"), left["v_len"].to_numpy(), right["q_len"].to_numpy()
            unit = (v / v_len[:, None]).T
            step = max(1, (4 << 20) // len(ids))
            for a in range(0, len(asked), step):
                near = (q[a : a + step] / q_len[a : a + step, None]) @ unit
                floor = np.partition(near, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(near), -2.0)
                row, item = np.nonzero(near >= floor[:, None] - 2e-6)
                total = np.zeros(len(row))
                for d in range(v.shape[1]):  # one component after the other, as ``dot`` adds them
                    total += q[a + row, d] * v[item, d]
                score = total / (q_len[a + row] * v_len[item])
                order = np.lexsort((item, -score, row))  # items lie by id
                row, item, score = row[order], item[order], score[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1])
                place = np.arange(len(row))
                keep = place - np.maximum.accumulate(np.where(fresh, place, 0)) < k
                out.append(pa.table({"query_id": asked.take(pa.array(a + row[keep])), item_id: ids.take(pa.array(item[keep])), "score": score[keep]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": asked.slice(0, 0), item_id: ids.slice(0, 0), "score": pa.array([], pa.float64())})

    schema = f"query_id {types['query_id']}, `{item_id}` {types[item_id]}, score double"
    return items.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, schema)


def vector_top(queries: DataFrame, items: DataFrame, k: int, item_id: str = "chunk_id", keep: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """The k nearest items of each query by cosine: queries (query_id, q), items (item_id, v).

    A stated set of queries meets all items: both are dealt into shares of bounded
    bytes, and each pair of shares is multiplied in one task, which gives the
    nearest of its share (``nearest_of``).  Vectors of another width than most
    queries, null, zero or beyond bounds are held against the others one by one.
    ``within`` (query_id, item_id) names what each query may find.
    """
    pool = (items if keep is None else items.where(keep)).select(item_id, "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("v_len"))
    asked = queries.select("query_id", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("q_len"))
    score = dot(F.col("q"), F.col("v")) / F.nullif(F.col("q_len") * F.col("v_len"), F.lit(0.0))
    one_by_one = lambda met: met.select("query_id", item_id, score.alias("score"))
    if within is not None:
        scored = one_by_one(pool.join(within.select("query_id", item_id), item_id).join(asked, "query_id"))
    else:
        width = asked.agg(F.mode(F.when(measurable(F.col("q_len")), F.size("q")))).first()[0] or 0
        fine_q, fine_v = measurable(F.col("q_len")) & (F.size("q") == width), measurable(F.col("v_len")) & (F.size("v") == width)
        n_q, odd_q = asked.agg(F.count_if(fine_q), F.count_if(~fine_q)).first()
        n_v, odd_v = pool.agg(F.count_if(fine_v), F.count_if(~fine_v)).first()
        wide = 16 + 8 * width
        blocks, shares = max(1, -(-n_q * wide // SIDE_BYTES)), max(shuffle_partitions(items.sparkSession), -(-n_v * wide // SIDE_BYTES))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = pool.where(fine_v).withColumn("share__", dealt(item_id, shares)).withColumn("block__", every(blocks))
        right = asked.where(fine_q).withColumn("block__", dealt("query_id", blocks)).withColumn("share__", every(shares))
        scored = nearest_of(left, right, ["share__", "block__"], k, item_id)
        by_one = lambda v, q: one_by_one(met_in_blocks(v, q, F.col(item_id), F.col("query_id"), 64 + 8 * F.size("q")))
        if odd_v:
            scored = scored.unionByName(by_one(pool.where(~fine_v), asked))
        if odd_q:
            scored = scored.unionByName(by_one(pool.where(fine_v), asked.where(~fine_q)))
    scored = scored.withColumn("score", F.round("score", 6))
    return top(scored, k, F.desc("score"), F.col(item_id)).select("query_id", item_id, "rank", "score")


# --- fusion and rescoring --------------------------------------------------------------------


def rrf(pools: list[tuple[DataFrame, float]], k: int, item: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked pools (query_id, item, rank from 1).

    An item that a pool holds twice gets both shares; equal scores keep the order
    of first appearance, pool by pool.
    """
    parts = [p.select("query_id", item, F.lit(i).alias("pool"), "rank", (F.lit(w) / (RRF_K + F.col("rank"))).alias("share")) for i, (p, w) in enumerate(pools)]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("query_id", item).agg(F.round(F.sum("share"), 6).alias("rrf_score"), F.min(F.struct("pool", "rank")).alias("first"))
    return top(fused, k, F.desc("rrf_score"), F.col("first"), F.col(item)).drop("first")


def prepend(pool: DataFrame, extra: DataFrame, item: str = "chunk_id") -> DataFrame:
    """A pool with extra ranked items before it; ranks are counted anew."""
    both = extra.select("query_id", item, F.lit(0).alias("late"), "rank").unionByName(pool.select("query_id", item, F.lit(1).alias("late"), "rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("late", "rank", item))).drop("late")


def rerank(hits: DataFrame, by: str = "rrf_score", item: str = "chunk_id") -> DataFrame:
    """Ranks counted anew by a score; equal scores keep their former order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "rank", item)))


def authority_factor(level: Column, effective: Column, as_of: Column) -> Column:
    """How much a document's rank and age lift it; one for unknown documents."""
    table = F.create_map(*[F.lit(x) for p in AUTHORITY.items() for x in p])
    age = F.greatest(F.datediff(as_of, effective), F.lit(0))
    recent = F.when(effective.isNull(), F.lit(1.0)).otherwise(1 + RECENCY / (1 + F.log1p(age / 365)))
    return F.when(level.isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(table, level), F.lit(1.0)) * recent)


def boost_authority(hits: DataFrame, registry: DataFrame, as_of: Column, doc: str = "doc_id") -> DataFrame:
    """Multiply scores by rank and recency of the hit's document (registry: doc_id, legal_level, effective_from)."""
    known = registry.select(F.col("doc_id").alias(doc), "legal_level", "effective_from")
    joined = hits.join(known, doc, "left")
    score = F.round(F.col("rrf_score") * authority_factor(F.col("legal_level"), F.col("effective_from"), as_of), 6)
    return rerank(joined.withColumn("rrf_score", score).drop("legal_level", "effective_from"))


def speaks_of_old_law(query: Column, intent_year: Column) -> Column:
    """True if a query means the law as it was."""
    low = F.lower(query)
    return F.coalesce(intent_year < LEGACY_YEAR, F.lit(False)) | F.exists(F.array(*map(F.lit, LEGACY_WORDS)), lambda w: F.contains(low, w))


def penalise_superseded(hits: DataFrame, old_law: Column) -> DataFrame:
    """A quarter of the score for superseded chunks, unless the query means the old law."""
    hit = F.coalesce("superseded", F.lit(False)) & ~old_law
    return rerank(hits.withColumn("rrf_score", F.when(hit, F.round(F.col("rrf_score") * SUPERSEDED, 6)).otherwise(F.col("rrf_score"))))


def intent_bonus(domains: Column, activities: Column, who: Column, content: Column, valid: Column, q_domains: Column, q_activities: Column, q_who: Column, wants_rate: Column) -> Column:
    """Bonus for what a chunk's annotation shares with a query's intent, up to a cap."""
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower)
    meets = lambda a, b: F.when(F.arrays_overlap(low(a), low(b)), 1.0).otherwise(0.0)
    rate = F.when(wants_rate & (content == "tax_rate"), RERANK["rate"]).when(wants_rate & (content == "threshold"), RERANK["rate"] / 2).otherwise(0.0)
    total = RERANK["domain"] * meets(domains, q_domains) + RERANK["activity"] * meets(activities, q_activities) + RERANK["who"] * meets(who, q_who)
    return F.least(F.lit(RERANK_CAP), total + F.coalesce(rate, F.lit(0.0)) + F.when(valid, RERANK["valid"]).otherwise(0.0))


def calibrate(similarities: DataFrame) -> DataFrame:
    """Thresholds per document from (doc_id, should_match, similarity); defaults where a side lacks or both overlap."""
    each = similarities.groupBy("doc_id").agg(F.min(F.when(F.col("should_match"), F.col("similarity"))).alias("pos"), F.max(F.when(~F.col("should_match"), F.col("similarity"))).alias("neg"))
    upper, lower = F.round(0.95 * F.col("pos"), 4), F.round(1.10 * F.col("neg"), 4)
    fine = F.coalesce(upper > lower, F.lit(False))
    return each.select("doc_id", F.when(fine, upper).otherwise(DEFAULT_UPPER).alias("upper"), F.when(fine, lower).otherwise(DEFAULT_LOWER).alias("lower"))


def exception_factor(similarity: Column, upper: Column, lower: Column) -> Column:
    """How far an exception lets a superseded document count."""
    return F.when(similarity >= upper, ALLOW).when(similarity <= lower, BLOCK).otherwise(SOFT)


def rerank_with_intent(hits: DataFrame, annotations: DataFrame, intents: DataFrame) -> DataFrame:
    """Hits with ``bonus`` and ``final_score``, ranked by the latter: rrf_score raised by what chunk and question share.

    annotations (chunk_id, domains, activities, who, content, effective_from,
    effective_to) are those of annotated chunks, the others get no bonus; intents
    (query_id, domains, activities, who, requires_calculation, as_of).  A chunk
    without dates counts as valid.
    """
    asked = intents.select("query_id", F.col("domains").alias("q_domains"), F.col("activities").alias("q_activities"), F.col("who").alias("q_who"), "requires_calculation", "as_of")
    met = hits.join(annotations.withColumn("annotated", F.lit(True)), "chunk_id", "left").join(asked, "query_id", "left")
    valid = F.coalesce(F.col("effective_from") <= F.col("as_of"), F.lit(True)) & F.coalesce(F.col("effective_to") >= F.col("as_of"), F.lit(True))
    bonus = intent_bonus(F.col("domains"), F.col("activities"), F.col("who"), F.col("content"), valid, F.col("q_domains"), F.col("q_activities"), F.array("q_who"), F.coalesce("requires_calculation", F.lit(False)))
    out = met.withColumn("bonus", F.when(F.col("annotated"), F.round(bonus, 3)).otherwise(0.0)).withColumn("final_score", F.round(F.col("rrf_score") * (1 + F.when(F.col("annotated"), bonus).otherwise(0.0)), 6))
    return rerank(out.select(*hits.columns, "bonus", "final_score"), "final_score")


def route_exceptions(hits: DataFrame, queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with ``exception_tier``, ``exception_score`` and ``final_score``, ranked by the latter.

    A superseded document that may be used by way of exception has an entry
    (doc_id, description, upper, lower): the vector of what it is for, and
    thresholds (see ``calibrate``).  A question (query_id, q) as near to it as
    ``upper`` lets its chunks count in full, one no nearer than ``lower`` hardly,
    one between them in part.  Hits of other documents, and of questions without a
    vector, keep their score; rrf_score stays as it is.
    """
    had = F.col("final_score") if "final_score" in hits.columns else F.col("rrf_score")
    wide = F.lit(64) + 8 * F.size("description")
    met = hits.join(hint_if_small(entries, wide), "doc_id", "left").join(queries.select("query_id", "q"), "query_id", "left")
    near = F.when(F.col("description").isNotNull() & F.col("q").isNotNull(), cosine(F.col("q"), F.col("description")))
    met = met.withColumn("near__", near)
    factor = F.when(F.col("near__").isNull(), 1.0).otherwise(exception_factor(F.col("near__"), F.col("upper"), F.col("lower")))
    tier = F.when(F.col("near__").isNotNull(), F.when(F.col("near__") >= F.col("upper"), "allow").when(F.col("near__") <= F.col("lower"), "block").otherwise("soft"))
    columns = [c for c in hits.columns if c != "final_score"]
    out = met.select(*columns, F.round(had * factor, 6).alias("final_score"), tier.alias("exception_tier"), F.round("near__", 4).alias("exception_score"))
    return rerank(out, "final_score")


def boost_scope(hits: DataFrame, scopes: DataFrame, scope_docs: DataFrame, boost: float = 1.3, double: float = 1.5) -> DataFrame:
    """Lift hits of documents of a query's scopes: hits, (query_id, scopes), (scope, doc_id)."""
    each = scopes.select("query_id", F.explode("scopes").alias("scope"), (F.array_contains("scopes", "TMDT") & F.array_contains("scopes", "HKD")).alias("both"))
    lifted = each.join(hint_if_small(scope_docs, 48), "scope").groupBy("query_id", "doc_id").agg(F.max("both").alias("both"))
    factor = F.when(F.col("both").isNull(), 1.0).when(F.col("both"), double).otherwise(boost)
    return rerank(hits.join(lifted, ["query_id", "doc_id"], "left").withColumn("rrf_score", F.round(F.col("rrf_score") * factor, 6)).drop("both"))


# --- expansion -------------------------------------------------------------------------------


def _first_only(found: DataFrame, hits: DataFrame, item: str = "chunk_id") -> DataFrame:
    """Found items that are no hits yet, each credited to the first source."""
    fresh = found.join(hits.select("query_id", item), ["query_id", item], "left_anti")
    w = Window.partitionBy("query_id", item).orderBy("src_rank", "pos")
    return fresh.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def expand_references(hits: DataFrame, chunks: DataFrame, factor: float = REF_FACTOR, cap: int = REF_CAP, least: float = REF_MIN) -> DataFrame:
    """Chunks that good hits refer to: hits (query_id, chunk_id, rank, rrf_score), chunks (chunk_id, refs)."""
    good = hits.where(F.col("rrf_score") >= least).join(chunks.select("chunk_id", "refs"), "chunk_id")
    out = good.select("query_id", F.col("rank").alias("src_rank"), F.col("chunk_id").alias("expanded_from"), F.round(F.col("rrf_score") * factor, 6).alias("rrf_score"), F.posexplode(F.slice("refs", 1, cap)).alias("pos", "chunk_id"))
    return _first_only(out.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), hits)


def expand_exceptions(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Exceptions of a hit, or of the article above it: index (rule_chunk_id, exception_chunk_ids)."""
    article = F.concat(F.regexp_extract("chunk_id", r"^(.*?_dieu_[^_]+)", 1), F.lit("_chunk"))
    keys = F.array_distinct(F.filter(F.array(F.col("chunk_id"), article), lambda x: x != "_chunk"))
    asked = hits.select("query_id", F.col("rank").alias("src_rank"), F.col("chunk_id").alias("exception_of"), F.round(F.col("rrf_score") * EXC_FACTOR, 6).alias("rrf_score"), F.posexplode(keys).alias("which", "rule_chunk_id"))
    all_of = asked.join(index, "rule_chunk_id").select("query_id", "src_rank", "exception_of", "rrf_score", "which", F.posexplode("exception_chunk_ids").alias("at", "chunk_id"))
    w = Window.partitionBy("query_id", "exception_of").orderBy("which", "at")
    return _first_only(all_of.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= EXC_CAP).drop("which", "at"), hits)


def expand_siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours of numbered sub-points whose text refers around: hits and chunks hold (parent, number)."""
    near = chunks.select(F.col("parent"), F.col("number").alias("n2"), F.col("chunk_id").alias("sibling"))
    off = F.abs(F.col("n2") - F.col("number"))
    out = hits.where(F.col("text").rlike(CROSS_REFERENCE)).join(near, "parent").where((off >= 1) & (off <= SIBLING_REACH) & (F.col("n2") >= 1))
    best = out.groupBy("query_id", F.col("sibling").alias("chunk_id")).agg(F.round(F.max(F.col("rrf_score") * SIBLING_FACTOR), 6).alias("rrf_score"))
    return best.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def expand_children(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first sub-points of a point that ends in a colon, few for each query: chunks (chunk_id, parent_id, number)."""
    kids = chunks.where(F.col("number").between(1, CHILD_LAST)).select("chunk_id", F.col("parent_id").alias("child_expansion_of"), "number")
    opens = hits.where(F.rtrim("text").endswith(":")).select("query_id", F.col("chunk_id").alias("child_expansion_of"), F.round(F.col("rrf_score") * CHILD_FACTOR, 6).alias("rrf_score"), F.col("rank").alias("src_rank"))
    out = opens.join(kids, "child_expansion_of").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top(out, CHILD_CAP, F.desc("rrf_score"), F.col("src_rank"), F.col("number"), F.col("chunk_id"), rank="pos")


def expand_amendments(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Leading chunks of documents that amend a hit's: hits hold amended_by, chunks (chunk_id, doc_id, seq)."""
    lead = chunks.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "chunk_id"))).where(F.col("pos") <= AMEND_CAP)
    asked = hits.select("query_id", F.col("rank").alias("src_rank"), F.col("chunk_id").alias("amendment_of"), F.round(F.col("rrf_score") * AMEND_FACTOR, 6).alias("rrf_score"), F.explode("amended_by").alias("doc_id"))
    once = top(asked.withColumn("q_doc", F.concat_ws("|", "query_id", "doc_id")), 1, F.col("src_rank"), key="q_doc", rank="n__").drop("n__", "q_doc")
    return _first_only(once.join(lead.select("chunk_id", "doc_id", "pos"), "doc_id"), hits)


# --- filters and signals ---------------------------------------------------------------------


def drop_expired(hits: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Without hits of documents whose validity has ended; unknown documents stay."""
    ended = registry.where(F.col("effective_to") < as_of).select("doc_id")
    return hits.join(hint_if_small(ended, 32), "doc_id", "left_anti")


def exclude(hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the documents that each query excludes: (query_id, doc_id)."""
    return hits.join(excluded, ["query_id", "doc_id"], "left_anti")


def drop_specific(hits: DataFrame, general: Column) -> DataFrame:
    """Without chunks about one entity where the question is a general one."""
    return hits.where(~(general & F.coalesce("specific_entity", F.lit(False))))


def ood_signal(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether what was found is too weak or too even: (query_id, top1, gap, is_ood)."""
    two = hits.groupBy("query_id").agg(F.max("rrf_score").alias("top1"), F.max_by("rrf_score", F.when(F.col("rank") == 2, F.lit(1))).alias("top2"))
    all_of = queries.select("query_id").join(two, "query_id", "left").withColumn("gap", F.round(F.col("top1") - F.col("top2"), 6))
    return all_of.select("query_id", "top1", "gap", (F.col("top1").isNull() | (F.col("top1") < OOD_FLOOR) | F.coalesce(F.col("gap") < OOD_GAP, F.lit(False))).alias("is_ood"))


def confidence_label(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


# --- rule-driven injection -------------------------------------------------------------------


def triggered(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, rule, doc_id) of rules (rule, keyword, doc_id) with a keyword that the query holds."""
    met = phrases_in(queries.select("query_id", "text"), "text", rules, "keyword").select("query_id", F.col("phrase").alias("keyword"))
    return met.join(hint_if_small(rules.select(F.lower("keyword").alias("keyword"), "rule", "doc_id"), 96), "keyword").select("query_id", "rule", "doc_id").distinct()


def inject(queries: DataFrame, items: DataFrame, docs_of: DataFrame, pool: DataFrame, k: int = TOPIC_K) -> DataFrame:
    """The k nearest items of each triggered document that are not in the pool, ranked: ready to prepend."""
    wanted = docs_of.select("query_id", "doc_id").distinct()
    met = items.join(wanted, "doc_id").join(queries, "query_id").select("query_id", "doc_id", "chunk_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
    per = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id")
    near = met.withColumn("n__", F.row_number().over(per)).where(F.col("n__") <= k).join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "n__", "chunk_id"))).drop("n__")


def scope_injection(queries: DataFrame, scopes: DataFrame, scope_docs: DataFrame, have: DataFrame, gate: str) -> DataFrame:
    """(query_id, doc_id) of household-business documents to add: only behind the gate, not for online trade, not twice.

    scopes (query_id, scopes), have (query_id, doc_id): what other rules have added.
    """
    fits = F.array_contains("scopes", "HKD") & ~F.array_contains("scopes", "TMDT")
    asked = queries.where(F.col("text").rlike(gate)).join(scopes, "query_id").where(fits).select("query_id")
    documents = scope_docs.where("scope = 'HKD'").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_id"))  # one row: the documents of a scope
    wanted = asked.join(F.broadcast(documents), F.lit(True)).withColumn("doc_id", F.explode("doc_id"))
    return wanted.join(have, ["query_id", "doc_id"], "left_anti")


#: What a hit is: found, or added by one of the expansions.
FOUND, REFERENCE, EXCEPTION, SIBLING, CHILD, AMENDMENT = "hit", "reference", "exception", "sibling", "child", "amendment"


def _appended(results: DataFrame, more: DataFrame, kind: str, source: str | None, *order: Column) -> DataFrame:
    """Results with what an expansion found behind them, ranks counted on."""
    extra = more.select("query_id", "chunk_id", "rrf_score", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "chunk_id")).alias("n__"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"))
    last = results.groupBy("query_id").agg(F.max("rank").alias("last__"))
    ranked = extra.join(last, "query_id").select("query_id", "chunk_id", "rrf_score", (F.col("last__") + F.col("n__")).cast("int").alias("rank"), F.lit(kind).alias("kind"), "source")
    return staged(results.unionByName(ranked))


def search(
    queries: DataFrame, chunks: DataFrame, registry: DataFrame, as_of: Column, n: int = 5, rules: DataFrame | None = None, scope_docs: DataFrame | None = None, gate: str = "(?s).*",
    exceptions: DataFrame | None = None, excluded: DataFrame | None = None, general: bool = True, vectors: DataFrame | None = None, within: DataFrame | None = None, keywords: KeywordIndex | None = None,
    annotations: DataFrame | None = None, intents: DataFrame | None = None, entries: DataFrame | None = None,
) -> DataFrame:
    """The whole ranked query for a batch: (query_id, chunk_id, doc_id, rrf_score, rank, kind, source).

    queries (query_id, text, q); chunks (chunk_id, doc_id, text) and, where the
    steps are wanted, v, refs, superseded, parent and number, parent_id, seq and
    amended_by, specific_entity; registry (doc_id, legal_level, effective_from,
    effective_to); rules (rule, keyword, doc_id); scope_docs (scope, doc_id);
    exceptions (rule_chunk_id, exception_chunk_ids); excluded (query_id, doc_id).

    In this order: vector and keyword pool; documents that rules, then scopes, ask
    for before both; fusion to n; authority and recency; supersession; scope;
    then references, exceptions, siblings, children and amendments, each of all
    that is there; exclusions; validity; documents of single entities where the
    question is general.  May give more than n rows.  ``within`` (query_id, doc_id)
    restricts a query to documents: then neither rules, scopes, authority nor
    supersession apply.

    Queries and chunks without a vector take part in the keyword pool alone;
    ``vectors`` (chunk_id, v) are those of the chunks where a table holds them;
    ``keywords`` is a stored index of the chunks' texts, if there is one.

    With annotations and intents (see ``rerank_with_intent``), or with entries (see
    ``route_exceptions``), hits also get a ``final_score`` behind supersession.
    Scope and expansion go by rrf_score again, so it decides between equals only
    and is given as a column of its own (null for what is expanded).
    """
    from lexmill.operators import postings  # which ranks by this module's weights

    has = set(chunks.columns)
    vectors = chunks.select("chunk_id", "doc_id", "v") if vectors is None else vectors.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    able = None if within is None else within.join(chunks.select("chunk_id", "doc_id"), "doc_id").select("query_id", "chunk_id")
    vector = vector_top(queries.where("q is not null").select("query_id", "q"), vectors.where("v is not null").select("chunk_id", "v"), min(3 * n, 50), within=able)
    asked = queries.select("query_id", "text")
    if keywords is None:
        words = bm25(asked, chunks.select("chunk_id", "text"), 3 * n, doc_id="chunk_id", within=able)
    else:
        words = postings.bm25_indexed(keywords, asked, 3 * n, within=able, doc_id="chunk_id")
    vector, words = staged(vector), staged(words)  # 3n rows a query
    scopes = None
    if within is None and rules is not None:
        extra = inject(queries, vectors, triggered(queries, rules), vector.unionByName(words))
        vector, words = staged(prepend(vector, extra)), staged(prepend(words, extra))
    if within is None and scope_docs is not None:
        scopes = queries.select("query_id", classify_scope(F.col("text"), F.lit(None).cast("string"))["scopes"].alias("scopes")).where(~F.array_contains("scopes", "ALL"))
        have = vector.unionByName(words, allowMissingColumns=True).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("query_id", "doc_id").distinct() if rules is None else triggered(queries, rules).select("query_id", "doc_id").distinct()
        extra = inject(queries, vectors, scope_injection(queries, scopes, scope_docs, have, gate), vector.select("query_id", "chunk_id").limit(0))
        vector, words = prepend(vector, extra), prepend(words, extra)
    fused = staged(rrf([(vector, VECTOR_WEIGHT), (words, BM25_WEIGHT)], n))  # n rows a query, read by rescoring and expansion
    about = chunks.select("chunk_id", "doc_id", (F.col("superseded") if "superseded" in has else F.lit(False)).alias("superseded"))
    hits = fused.join(about, "chunk_id")
    if within is None:
        hits = boost_authority(hits, registry, as_of)
        old = queries.select("query_id", speaks_of_old_law(F.col("text"), F.lit(None).cast("int")).alias("old"))
        hits = penalise_superseded(hits.join(old, "query_id"), F.col("old")).drop("old")
    finals = None
    if within is None and annotations is not None and intents is not None:
        hits = finals = staged(rerank_with_intent(hits, annotations, intents))
    if within is None and entries is not None:
        hits = finals = staged(route_exceptions(hits, queries, entries))
    if scopes is not None:
        hits = boost_scope(hits, scopes, scope_docs)
    results = staged(hits.select("query_id", "chunk_id", "rrf_score", "rank", F.lit(FOUND).alias("kind"), F.lit(None).cast("string").alias("source")))
    by_rank = (F.col("src_rank"), F.col("pos"))
    with_chunks = lambda *columns: results.join(chunks.select("chunk_id", *columns), "chunk_id")
    if "refs" in has:
        results = _appended(results, expand_references(results, chunks), REFERENCE, "expanded_from", *by_rank)
    if exceptions is not None:
        found = expand_exceptions(results, exceptions).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        results = _appended(results, found, EXCEPTION, "exception_of", *by_rank)
    if {"parent", "number"} <= has:
        results = _appended(results, expand_siblings(with_chunks("text", "parent", "number"), chunks), SIBLING, None, F.desc("rrf_score"))
    if {"parent_id", "number"} <= has:
        results = _appended(results, expand_children(with_chunks("text"), chunks), CHILD, "child_expansion_of", F.col("pos"))
    if {"amended_by", "seq"} <= has:
        results = _appended(results, expand_amendments(with_chunks("amended_by"), chunks), AMENDMENT, "amendment_of", *by_rank)
    out = results.join(chunks.select("chunk_id", "doc_id", *(["specific_entity"] if "specific_entity" in has else [])), "chunk_id")
    if excluded is not None:
        out = exclude(out, excluded)
    out = drop_expired(out, registry, as_of)
    if "specific_entity" in has and within is None:
        out = drop_specific(out, F.lit(general))
    columns = ["query_id", "chunk_id", "doc_id", "rrf_score", "rank", "kind", "source"]
    if finals is None:
        return out.select(*columns)
    scores = finals.select("query_id", "chunk_id", "final_score", F.lit(FOUND).alias("kind"))
    return out.join(scores, ["query_id", "chunk_id", "kind"], "left").select(*columns, "final_score")


def with_co_retrieval(results: DataFrame, queries: DataFrame, chunks: DataFrame, registry: DataFrame, as_of: Column, rules: DataFrame, n: int = 5, **options: object) -> DataFrame:
    """Results with what co-retrieval rules add: for each rule that fires, the k best of its target, before or behind the others.

    queries hold doc_filter as well; rules as ``co_retrieve`` takes them.  What is put
    before or behind goes by the rules' turn.
    """
    found = results.groupBy("query_id").agg(F.collect_set("doc_id").alias("found_docs"))
    base = queries.select("query_id", "text", "doc_filter").join(found, "query_id", "left").withColumn("found_docs", F.coalesce("found_docs", F.array().cast("array<string>")))
    asked = staged(co_retrieve(base, rules))
    more = search(queries, chunks, registry, as_of, n, within=asked.select("query_id", F.col("target").alias("doc_id")).distinct(), **options).where(F.col("kind") == FOUND)
    best = more.join(asked.select("query_id", F.col("target").alias("doc_id"), "k", "place", "turn").distinct(), ["query_id", "doc_id"]).withColumn("n__", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).where("n__ <= k")
    both = results.select("*", F.lit(1).alias("o__"), F.lit(0).alias("turn__"), F.lit(0).alias("n__")).unionByName(best.select(*results.columns, F.when(F.col("place") == "prepend", 0).otherwise(2).alias("o__"), F.col("turn").alias("turn__"), "n__"))
    order = Window.partitionBy("query_id").orderBy("o__", "turn__", "n__", "rank", "doc_id", "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).drop("o__", "turn__", "n__")


def co_retrieve(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Sub-searches that co-retrieval rules ask for: base (query_id, text, doc_filter, found_docs), rules (when_filter, keywords, target, k, place and, where they have an order, turn).

    A rule fires if its filter is the query's (a rule without one: if the query has
    none), a keyword (if it has any) is in the text and its target was not found.
    """
    low = F.lower(F.col("text"))
    fires = (F.size("keywords") == 0) | F.exists("keywords", lambda w: F.contains(low, w))
    met = base.join(hint_if_small(rules, 256), F.col("doc_filter").eqNullSafe(F.col("when_filter"))).where(fires & ~F.array_contains("found_docs", F.col("target")))
    turn = F.col("turn") if "turn" in rules.columns else F.lit(0)
    return met.select("query_id", "text", "target", "k", "place", turn.alias("turn"))


def search_terms(text: Column, top_k: Column, doc_filter: Column, excluded: Column) -> Column:
    """How a question is searched: struct(top_k, doc_filter, excluded, is_empty).

    One to ten results are asked for.  The decree on penalties is left out of every
    search but one within it, and that one gives nothing unless the question speaks
    of penalties.  Without a text, filter or exclusions: nothing is taken from these.
    """
    own = F.coalesce(F.upper(doc_filter) == search_rules.PENALTY_ONLY, F.lit(False))
    given = F.coalesce(excluded, F.array().cast("array<string>"))
    kept_out = F.when(own | F.array_contains(given, search_rules.PENALTY_ONLY), given).otherwise(F.concat(given, F.array(F.lit(search_rules.PENALTY_ONLY))))
    asked = F.greatest(F.lit(search_rules.FEWEST), F.least(F.coalesce(top_k, F.lit(5)), F.lit(search_rules.MOST)))
    speaks = holds_any(F.lower(F.coalesce(text, F.lit(""))), search_rules.PENALTY_WORDS)
    return F.struct(asked.cast("int").alias("top_k"), F.nullif(doc_filter, F.lit("")).alias("doc_filter"), kept_out.alias("excluded"), (own & ~speaks).alias("is_empty"))


def resolve_filter(asked: Column, known: list[str]) -> Column:
    """A document filter, whatever its case; unknown ones filter nothing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for d in known for x in (d.lower(), d)]), F.lower(F.trim(asked)))
