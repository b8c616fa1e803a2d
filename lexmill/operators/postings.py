"""A stored inverted index: postings in Parquet by term bucket, with block maxima, and top-k by block-max pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.staging import BROADCAST_BYTES, byte_size, hint_if_small, new_table, shuffle_partitions, staged
from lexmill.functions.text import tokenize
from lexmill.operators import search

#: Documents of a segment (a block holds the postings of one term in one segment), and term buckets (folders).
SEGMENT_DOCS, BUCKETS = 128, 64
#: Segments of each query that are scored before the others are held against its k-th best score.
FIRST = 8


@dataclass(frozen=True)
class KeywordIndex:
    """Where an index lies, and what it counts: documents, their mean length, buckets."""

    path: str
    n: int
    average: float
    buckets: int
    id_type: str

    def postings(self, spark: SparkSession) -> DataFrame:
        """(bucket, term, segment, most, ids, tfs, gains): a posting adds its gain for each unit of idf, and none of the block adds more than ``most``."""
        return spark.read.schema(f"term string, segment int, most double, ids array<{self.id_type}>, tfs array<int>, gains array<double>, bucket int").parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        """(bucket, term, df, idf)."""
        return spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{self.path}/terms")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _gain(tf: Column, dl: Column, average: float) -> Column:
    """What tf occurrences in a document of dl words add for each unit of idf."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl / (average or 1.0)))


def build_index(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", segment_docs: int = SEGMENT_DOCS, buckets: int = BUCKETS) -> KeywordIndex:
    """Write the index of ``docs`` to ``path`` (by default a table of this session).

    Documents are dealt into segments by their id.  That is the one shuffle of
    texts: words are counted and gathered into blocks where their segment lies.
    A frequent term is as many blocks as there are segments, so no task holds all
    of it.  Blocks are then sorted by bucket, term and segment, so that a reader
    opens the folders of its buckets and, by their statistics, the row groups of
    its terms only.  Null texts count as empty; documents without words have no
    postings but count for the mean length; rows of one id and length are one
    document; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    path = path or new_table(spark, "keywords")
    total = docs.count()
    segments, parts = max(1, -(-total // segment_docs)), shuffle_partitions(spark)
    dealt = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(segments)).cast("int").alias("segment"))
    words = dealt.repartition(min(segments, 4 * parts), "segment").select("segment", "id", tokenize(F.col("text")).alias("w"))
    each = words.select("segment", "id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    tf = each.groupBy("segment", "id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = staged(tf.groupBy("segment", "term").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("p")))
    counts = blocks.groupBy("term").agg(F.sum(F.size("p")).alias("df"), F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["tf"])).alias("words"))
    counts = staged(counts.withColumn("raw", F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean, length = counts.agg(F.avg("raw"), F.coalesce(F.sum("words"), F.lit(0))).first()
    average = length / total if total else 0.0
    idf = F.when(F.col("raw") < 0, search.EPSILON * F.lit(mean)).otherwise(F.col("raw"))
    counts.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "df", idf.alias("idf")).repartitionByRange(parts, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    gains = F.transform("p", lambda x: _gain(x["tf"], x["dl"], average))
    rows = blocks.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "segment", F.array_max(gains).alias("most"), F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), gains.alias("gains"))
    rows.repartitionByRange(parts, "bucket", "term", "segment").sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").parquet(f"{path}/postings")
    return KeywordIndex(path, total, average, buckets, docs.schema[doc_id].dataType.simpleString())


def bm25_indexed(index: KeywordIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, within: DataFrame | None = None, widen: bool = True, doc_id: str = "doc_id", first: int = FIRST) -> DataFrame:
    """The k best documents of each query by BM25, scores above 0, from a stored index: (query_id, doc_id, rank, score).

    Exact.  From the block maxima alone every query gets an upper bound for each
    segment.  Its ``first`` segments by that bound are scored; the k-th best score
    found there is a floor, and of the other segments only those whose bound
    reaches it are scored.  ``keep`` (doc_id) restricts what is ranked, ``within``
    (query_id, doc_id) what each query may find; neither changes the statistics.
    Ties go to the smaller id.  Only the queries' bucket numbers, at most as many
    as there are buckets, come to the driver.
    """
    spark = queries.sparkSession
    terms = staged(search.query_terms(queries, widen).withColumn("bucket", _bucket(F.col("term"), index.buckets)))
    wanted = [r.bucket for r in terms.select("bucket").distinct().collect()]
    idf = index.terms(spark).where(F.col("bucket").isin(wanted)).select("term", "idf")
    weights = idf.join(hint_if_small(terms, 40 + F.octet_length("term")), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    asked = staged(weights)
    small = byte_size(asked, 32 + F.octet_length("term")) <= BROADCAST_BYTES
    told = F.broadcast(asked) if small else asked
    blocks = index.postings(spark).where(F.col("bucket").isin(wanted))
    bound = F.sum(F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)))
    of_terms = hint_if_small(asked.select("term").distinct(), 16 + F.octet_length("term"))
    near = staged(blocks.select("term", "segment", "most", "ids", "gains").join(of_terms, "term", "left_semi"))
    bounds = staged(near.select("term", "segment", "most").join(told, "term").groupBy("segment", "query_id").agg(bound.alias("bound")))
    ranked = bounds.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")))

    def scored(pairs: DataFrame) -> DataFrame:
        # blocks are shuffled as they are; all that adds up to a document's score then lies where its segment does
        met = near.repartition(4 * shuffle_partitions(spark), "segment").join(told, "term").join(hint_if_small(pairs.select("query_id", "segment"), 16), ["query_id", "segment"])
        each = met.select("segment", "query_id", "weight", F.explode(F.arrays_zip("ids", "gains")).alias("p"))
        rows = each.groupBy("segment", "query_id", F.col("p.ids").alias(doc_id)).agg(F.sum(F.col("weight") * F.col("p.gains")).alias("score"))
        rows = rows.where("score > 0").drop("segment")
        if keep is not None:
            rows = rows.join(keep, doc_id, "left_semi")
        if within is not None:
            rows = rows.join(within, ["query_id", doc_id], "left_semi")
        return search.top(rows.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col(doc_id))

    best = staged(scored(ranked.where(F.col("n") <= first)))
    floors = best.where(F.col("rank") == k).select("query_id", (F.col("score") - 1e-6).alias("floor"))
    more = ranked.where(F.col("n") > first).join(hint_if_small(floors, 16), "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)))
    more = staged(more.select("query_id", "segment"))
    both = best.drop("rank").unionByName(scored(more).drop("rank"))
    return search.top(both, k, F.desc("score"), F.col(doc_id)).select("query_id", doc_id, "rank", "score")


def segments_scored(index: KeywordIndex, queries: DataFrame, k: int) -> tuple[int, int]:
    """How many (query, segment) pairs hold a query's terms, and how many postings lie in them: what a search without bounds would score."""
    spark = queries.sparkSession
    terms = search.query_terms(queries).select("query_id", "term")
    met = index.postings(spark).select("term", "segment", F.size("ids").alias("n")).join(hint_if_small(terms, 40), "term")
    row = met.agg(F.count_distinct("query_id", "segment"), F.sum("n")).first()
    return row[0], row[1] or 0
