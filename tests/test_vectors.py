"""The stored vector index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import search, vectors


@pytest.fixture(scope="module")
def tables(spark):
    dice = np.random.default_rng(4)
    centres = dice.standard_normal((12, 8)) * 3
    rows = [(f"c{i}", [float(x) for x in centres[i % 12] + dice.standard_normal(8)], i % 3) for i in range(600)]
    rows += [(f"copy{i}", rows[0][1], 1) for i in range(200)] + [("null", None, 0), ("gap", [None] * 8, 0), ("short", [1.0], 0), ("empty", [], 0), ("zero", [0.0] * 8, 1)]
    items = spark.createDataFrame(rows, "chunk_id string, v array<double>, kind int").repartition(4)
    queries = spark.createDataFrame([(i, rows[7 * i][1]) for i in range(20)] + [(90, [1.0]), (91, None)], "query_id int, q array<double>")
    return items, queries


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_exact_search(spark, tables):
    items, queries = tables
    index = vectors.build_vector_index(items)
    fine, asked = items.where("chunk_id not in ('null', 'gap', 'short', 'empty', 'zero')"), queries.where("query_id < 90")
    for k in (1, 10):
        assert rows(vectors.vector_top_indexed(index, queries, k, exact=True, probes=1)) == rows(search.vector_top(asked, fine, k))
    kept = rows(search.vector_top(asked, fine, 5, keep=F.col("kind") == 2))
    assert rows(vectors.vector_top_indexed(index, queries, 5, keep=F.col("kind") == 2, exact=True)) == kept


def test_recall_of_partial_search(spark, tables):
    items, queries = tables
    index = vectors.build_vector_index(items.where("chunk_id like 'c%' and chunk_id not like 'copy%'"))
    assert index.probes < len(index.centroids)
    want = {r[:2] for r in rows(search.vector_top(queries.where("query_id < 90"), items.where("chunk_id like 'c%' and chunk_id not like 'copy%'"), 10).select("query_id", "chunk_id"))}
    got = {r[:2] for r in rows(vectors.vector_top_indexed(index, queries, 10).select("query_id", "chunk_id"))}
    assert len(want & got) >= 0.9 * len(want)


def test_empty_vector_index(spark, tables):
    items, queries = tables
    index = vectors.build_vector_index(items.where("false"))
    assert vectors.vector_top_indexed(index, queries, 3, exact=True).collect() == []


def test_nearest_are_scored_as_dot_scores_them(spark):
    """Scores of the matrix search are those of ``dot`` to the last bit; copies, vectors that cannot be measured and few items keep their order."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0]), (2003, [1.0, None] + [0.0] * 6), (2004, [1e200] * 8)]
    items = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    queries = items.where("chunk_id % 10 = 7 or chunk_id > 1999").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    for k in (3, 400):
        score = F.round(search.cosine(F.col("q"), F.col("v")), 6)
        every = queries.crossJoin(items).select("query_id", "chunk_id", score.alias("score"))
        want = search.top(every, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score")
        found = search.vector_top(queries, items, k)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
