"""A stored vector index: an inverted file of lists around centroids, searched in part or exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.staging import hint_if_small, new_table, staged
from lexmill.operators import search

#: Rows on which centroids are fitted, lists at most, rounds of the fit, and what share of the nearest rows a partial search has to find on the sample.
SAMPLE, LISTS, ROUNDS, RECALL = 4096, 1024, 12, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, its unit centroids, the widest angle of each list, the lists that a partial search reads, and the column of ids."""

    path: str
    schema: str
    centroids: np.ndarray
    angles: np.ndarray
    probes: int
    item_id: str

    def items(self, spark: SparkSession) -> DataFrame:
        """The items with ``v_len`` and, as folder, ``list``."""
        return spark.read.schema(self.schema).parquet(self.path)


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _table(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by k-means on directions; a list that loses all its rows takes the row that lies worst."""
    rows = _unit(sample.astype(np.float64))
    chosen = rows[np.linspace(0, len(rows) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = rows @ chosen.T
        own = near.argmax(1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = rows[near.max(1).argsort()[: len(empty)]]
        chosen = _unit(sums)
    return chosen


def _probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists with which a search among the sample finds that share of the k nearest rows."""
    rows = _unit(sample.astype(np.float64))
    asked = np.arange(0, len(rows), max(1, len(rows) // 256))
    near = rows[asked] @ rows.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    order = np.argsort(-(rows[asked] @ centroids.T), axis=1).argsort(1)  # the place of each list among a row's nearest
    own = (rows @ centroids.T).argmax(1)
    places = np.sort(order[np.arange(len(asked))[:, None], own[best]].ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1


def build_vector_index(items: DataFrame, path: str | None = None, item_id: str = "chunk_id", k: int = 10, recall: float = RECALL) -> VectorIndex:
    """Write an index of ``items`` (item_id, v and any attributes to filter by) to ``path``, by default a table of this session.

    About the square root of the number of items, LISTS at most, is the number of
    lists.  Centroids are fitted on at most SAMPLE items, the first by the hash of
    their id; every item is assigned to its nearest centroid and written to that
    list's folder.  The sample also tells how many lists a partial search has to
    read.  Items whose vector is null, empty, of another length than most, or
    holds nulls are left out; vectors of length zero are in the first list.
    """
    spark = items.sparkSession
    path = path or new_table(spark, "vectors")
    whole = items.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("v", F.col("v").cast("array<double>"))
    width = (whole.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first() or [1])[0]
    whole = whole.where(F.size("v") == width)
    n = whole.count()
    sample = np.array([r.v for r in whole.orderBy(F.xxhash64(item_id), item_id).limit(SAMPLE).select("v").collect()]).reshape(-1, width)  # SAMPLE rows at most
    lists = max(1, min(LISTS, len(sample), int(np.ceil(np.sqrt(n)))))
    centroids = fit_centroids(sample, lists) if len(sample) else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centroids)  # LISTS vectors at most
    columns = [c for c in items.columns if c != "v"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*columns, "v").schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _table(batch.column(len(columns)), width)
            near = _unit(rows) @ shared.value.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.linalg.norm(rows, axis=1)), pa.array(near.argmax(1), pa.int32()), pa.array(near.max(1) if len(rows) else [], pa.float64())], [*columns, "v", "v_len", "list", "near"])

    placed = staged(whole.select(*columns, "v").mapInArrow(assign, f"{schema}, v_len double, list int, near double"))
    widest = {r.list: r.near for r in placed.where("v_len > 0").groupBy("list").agg(F.min("near").alias("near")).collect()}  # a row for each list
    placed.drop("near").write.partitionBy("list").parquet(path)
    angles = np.array([np.arccos(np.clip(widest.get(i, 1.0), -1, 1)) for i in range(lists)])
    return VectorIndex(path, f"{schema}, v_len double, list int", centroids, angles, _probes_for(sample, centroids, k, recall), item_id)


def vector_top_indexed(index: VectorIndex, queries: DataFrame, k: int, keep: Column | None = None, exact: bool = False, probes: int | None = None) -> DataFrame:
    """The k nearest items of each query (query_id, q) by cosine: (query_id, item, rank, score).

    A query reads the lists of its ``probes`` nearest centroids.  ``exact`` then
    also reads every list that can hold something as near as its k-th item: no item
    is nearer to the query than the angle to the centroid less the list's widest
    angle allows.  ``keep`` filters by the items' attributes before anything is
    ranked.  Queries are met by broadcast while their measured bytes are few, so
    items, and lists of any size, stay where they are.
    """
    spark = queries.sparkSession
    centroids, angles, first = index.centroids, index.angles, probes or index.probes
    width = centroids.shape[1]
    asked = queries.where((F.size("q") == width) & ~F.exists("q", lambda x: x.isNull())).select("query_id", F.col("q").cast("array<double>").alias("q"))
    id_type = asked.schema["query_id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(_table(batch.column(1), width)) @ centroids.T
            m, lists = near.shape
            place = np.argsort(-near, axis=1, kind="stable").argsort(1)
            bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - angles, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(m), lists))), pa.array(np.tile(np.arange(lists), m), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(bound.ravel())], ["query_id", "list", "place", "bound"])

    pairs = staged(asked.mapInArrow(nearest, f"query_id {id_type}, list int, place int, bound double"))
    asked = staged(asked.withColumn("q_len", F.sqrt(search.dot(F.col("q"), F.col("q")))))
    n_q, odd_q = asked.agg(F.count(F.lit(1)), F.count_if(~search.measurable(F.col("q_len")))).first()

    def scored(some: DataFrame) -> DataFrame:
        lists = [r.list for r in some.select("list").distinct().collect()]  # LISTS numbers at most: folders to open
        pool = index.items(spark).where(F.col("list").isin(lists))
        pool = (pool if keep is None else pool.where(keep)).select(index.item_id, "v", "v_len", "list")
        wanted = some.select("query_id", "list").join(asked, "query_id")
        fine_v, fine_q = search.measurable(F.col("v_len")), search.measurable(F.col("q_len"))
        # lists and queries that are many are dealt into shares; a task meets one share of one list and one of the queries that read it
        sizes = pool.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(~fine_v).alias("odd")).agg(F.max("n"), F.sum("odd")).first()
        shares = max(1, -(-(sizes[0] or 0) * (16 + 8 * width) // search.SIDE_BYTES))
        blocks = max(1, -(-n_q * (16 + 8 * width) // search.SIDE_BYTES))
        dealt, every = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = pool.where(fine_v).withColumn("share__", dealt(index.item_id, shares)).withColumn("block__", every(blocks))
        right = wanted.where(fine_q).withColumn("block__", dealt("query_id", blocks)).withColumn("share__", every(shares))
        found = search.nearest_of(left, right, ["list", "share__", "block__"], k, index.item_id)
        score = search.dot(F.col("q"), F.col("v")) / F.nullif(F.col("q_len") * F.col("v_len"), F.lit(0.0))
        one_by_one = lambda v, q: v.join(hint_if_small(q, 64 + 8 * F.size("q")), "list").select("query_id", index.item_id, score.alias("score"))
        if sizes[1]:
            found = found.unionByName(one_by_one(pool.where(~fine_v), wanted))
        if odd_q:
            found = found.unionByName(one_by_one(pool.where(fine_v), wanted.where(~fine_q)))
        return search.top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col(index.item_id))

    best = scored(pairs.where(F.col("place") < first))
    if exact:
        best = staged(best)
        floors = best.where(F.col("rank") == k).select("query_id", (F.col("score") - 1e-6).alias("floor"))
        more = staged(pairs.where(F.col("place") >= first).join(hint_if_small(floors, 16), "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(-2.0))))
        best = search.top(best.drop("rank").unionByName(scored(more).drop("rank")), k, F.desc("score"), F.col(index.item_id))
    return best.select("query_id", index.item_id, "rank", "score")
