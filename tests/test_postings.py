"""The stored keyword index against the ranking without one."""

import random

from pyspark.sql import functions as F

from lexmill.operators import postings, search

DOCS = "doc_id long, text string"


def corpus(spark, n=120, seed=1):
    dice = random.Random(seed)
    bag = [f"w{int(dice.paretovariate(0.6))}" for _ in range(400)]
    rows = [(i, " ".join(dice.choice(bag) for _ in range(dice.randrange(1, 60)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "?!"), (903, "W1 w1 w1"), (904, "w1 " * 5000)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def asked(spark):
    return spark.createDataFrame([(1, "w1"), (2, "w1 w2 w3 w40"), (3, "nothing here"), (4, ""), (5, "w7 w7 w11"), (6, None)], "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index_gives_the_rows_of_the_scan(spark):
    docs, queries = corpus(spark), asked(spark)
    for size, first in ((16, 1), (1000, 2)):
        index = postings.build_index(docs, segment_docs=size, buckets=8)
        for k in (3, 400):
            assert rows(postings.bm25_indexed(index, queries, k, first=first)) == rows(search.bm25(queries, docs, k))
    keep, within = docs.where("doc_id % 3 = 0"), queries.join(docs.where("doc_id % 2 = 0"), how="cross").select("query_id", "doc_id")
    assert rows(postings.bm25_indexed(index, queries, 4, keep=keep.select("doc_id"))) == rows(search.bm25(queries, docs, 4, keep=F.col("doc_id") % 3 == 0))
    assert rows(postings.bm25_indexed(index, queries, 4, within=within)) == rows(search.bm25(queries, docs, 4, within=within))


def test_index_is_read_by_bucket(spark):
    index = postings.build_index(corpus(spark), buckets=16)
    plan = index.postings(spark).where(F.col("bucket").isin([3])).select("term", "segment", "most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_bounds_spare_segments(spark):
    """A rare word's documents rank first; segments without it are not scored."""
    rows_ = [(i, "common filler words" + (" rare" if i in (5, 50) else "")) for i in range(200)]
    docs = spark.createDataFrame(rows_, DOCS)
    index = postings.build_index(docs, segment_docs=10)
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert rows(postings.bm25_indexed(index, queries, 2, first=2)) == rows(search.bm25(queries, docs, 2))
    pairs, count = postings.segments_scored(index, queries, 2)
    assert pairs > 10 and count == 202


def test_empty_index(spark):
    index = postings.build_index(spark.createDataFrame([], DOCS))
    assert index.n == 0 and postings.bm25_indexed(index, asked(spark), 3).collect() == []
    assert postings.bm25_indexed(postings.build_index(corpus(spark)), asked(spark).where("false"), 3).collect() == []
