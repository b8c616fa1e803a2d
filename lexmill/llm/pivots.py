"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, shuffle_partitions

#: Pivots, and the rows among which they are chosen.
PIVOTS, SAMPLE = 64, 2048
#: Bytes of candidates that a group may hold, and candidates from which on a group is worth a task.
GROUP_BYTES, GROUP_ROWS = 64 << 20, 4096
#: Queries and candidates that are bounded at once, and candidates evaluated between two checks of the stop.
QUERIES, SLAB, STEP = 128, 8192, 64
SCALE = 256


class PivotTable:
    """Pivots, and what the distances to them say about two vectors.

    Pivots are chosen one by one, each the sampled vector that lies farthest from
    the flat through those before it.  The distances of a vector to the pivots fix
    its foot on that flat and its height above it; two vectors are then at least
    as far from one another as their feet and heights are.  This is the largest
    lower bound that the distances allow, never below the largest difference of
    the distances to one pivot.
    """

    def __init__(self, ids: np.ndarray, sample: np.ndarray, pivots: int) -> None:
        rows = sample.astype(np.float64)
        norms = (rows * rows).sum(1)
        at = int(norms.argmax()) if len(rows) else 0
        chosen, left = [at], ((rows - rows[at]) ** 2).sum(1) if len(rows) else norms
        base, first = [], rows[at] if len(rows) else None
        least = 1e-9 * float(left.max()) if len(rows) else 0.0
        while len(chosen) < min(pivots, len(rows)):
            at = int(left.argmax())
            if left[at] <= least:
                break
            chosen.append(at)
            off = rows[at] - first
            for b in base:
                off = off - (off @ b) * b
            base.append(off / np.sqrt(off @ off))
            left = np.maximum(left - ((rows - first) @ base[-1]) ** 2, 0)
        self.ids, self.whole = ids[chosen], sample[chosen]
        self.pivots = rows[chosen]
        self.norms = (self.pivots * self.pivots).sum(1)
        edges = self.pivots[1:] - self.pivots[:1]
        self.edges = (edges * edges).sum(1)
        turn = np.array(base).reshape(len(base), rows.shape[1] if rows.ndim == 2 else 0)
        self.solve = np.linalg.inv(edges @ turn.T) if len(base) else np.zeros((0, 0))

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Squared distances of whole vectors to the pivots."""
        f = v.astype(np.float64)
        return np.maximum((f * f).sum(1)[:, None] + self.norms - 2 * f @ self.pivots.T, 0)

    def places(self, d: np.ndarray) -> np.ndarray:
        """Foot and height, from squared distances alone."""
        foot = ((d[:, :1] - d[:, 1:] + self.edges) / 2) @ self.solve.T
        height = np.sqrt(np.maximum(d[:, 0] - (foot * foot).sum(1), 0))
        return np.hstack([foot, height[:, None]])

    def ceilings(self, q: np.ndarray, qd: np.ndarray, c: np.ndarray, cd: np.ndarray) -> np.ndarray:
        """What the inner products of queries and candidates cannot exceed, with room for rounding."""
        nq, nc = (q.astype(np.float64) ** 2).sum(1), (c.astype(np.float64) ** 2).sum(1)
        far = qd[:, :1] + cd[:, 0] - 2 * self.places(qd) @ self.places(cd).T
        both = nq[:, None] + nc
        return (both - far) / 2 + 1 + 1e-7 * (both + qd[:, :1] + cd[:, 0])


def search_group(table: PivotTable, q_ids: np.ndarray, q: np.ndarray, qd: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, cd: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """The k best of a group of candidates for each query, as far as they reach its floor: (query, candidate, score), and how many were evaluated.

    Candidates are evaluated in the order of their ceilings until the k-th best
    score is above every ceiling that is left.  Equal scores go to the smaller id.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    done = 0
    for at in range(0, len(q), QUERIES):
        part = slice(at, at + QUERIES)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids[part]]
        for lo in range(0, len(c), SLAB):
            ids, vectors = c_ids[lo : lo + SLAB], c[lo : lo + SLAB]
            top = table.ceilings(q[part], qd[part], vectors, cd[lo : lo + SLAB])
            for i, own in enumerate(q_ids[part]):
                b_ids, b_vals = best[i]
                least = max(float(floor[at + i]), b_vals[k - 1] if len(b_vals) >= k else -np.inf)
                able = np.flatnonzero(top[i] >= least)
                able = able[np.argsort(-top[i][able], kind="stable")]
                able = able[ids[able] != own]
                step, x = STEP, 0
                while x < len(able):
                    if len(b_vals) >= k and b_vals[k - 1] > top[i][able[x]]:
                        break
                    some = able[x : x + step]
                    x, step = x + step, min(2 * step, 4096)
                    done += len(some)
                    b_ids, b_vals = np.concatenate([b_ids, ids[some]]), np.concatenate([b_vals, vectors[some] @ q[at + i]])
                    order = np.lexsort((b_ids, -b_vals))[:k]
                    b_ids, b_vals = b_ids[order], b_vals[order]
                best[i] = b_ids, b_vals
        for own, (b_ids, b_vals) in zip(q_ids[part], best):
            for column, values in zip(out, (np.full(len(b_ids), own, np.int64), b_ids, b_vals)):
                column.append(values)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out], done


def _whole(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of floor(256 * x), shorter ones padded with zeros."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    table = np.zeros((len(sizes), width), np.int64)
    table[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return table


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _table(column: pa.Array, dtype: str) -> np.ndarray:
    """The rows of a binary column, all of one length, as a table."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """Exact k best inner products of every query row with every other row.

    Components become floor(256 * x).  Vectors that are null, or that hold a null
    or a component that is not finite, take no part, nor do rows without an id;
    shorter vectors count as padded with zeros.  A query meets every row whose id
    is not its own; rows that repeat an id count one by one.  Scores are exact
    while they and the squared lengths stay below 2^53.  Fewer candidates than k
    give fewer rows; an empty table gives none.  Other columns are not read.

    Pivots are chosen once, among at most SAMPLE rows.  Every row's distances to
    them are computed once and stored beside the row; each query also gets its
    k-th best score among the pivots, a floor that no result can be below.
    Candidates are dealt by their number into groups of bounded bytes, the
    queries go to each group, and a group gives at most k rows for each query.

    Returns query_id, rank (from 1), vec_id, score.
    """
    return _ranked(_met(vectors, is_query, k, vec_id, embedding, pivots), k)


def evaluated(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """How many candidates a search evaluates, of how many: (evaluated, pairs)."""
    met = _met(vectors, is_query, k, vec_id, embedding, pivots, counts=True)
    return met.agg(F.sum("score").alias("evaluated"), F.sum("vec_id").alias("pairs"))


def _ranked(best: DataFrame, k: int) -> DataFrame:
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(vectors: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str, pivots: int, counts: bool = False) -> DataFrame:
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, vec_id long, score long")
    fine = F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if not n:
        return none
    width, dtype = width or 0, "<i2" if (most or 0) < 100 else "<i4" if (most or 0) < 1 << 22 else "<i8"
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("id", "v").collect()  # SAMPLE rows at most
    whole = np.array([np.floor(SCALE * np.array(list(r[1]) + [0.0] * (width - len(r[1])))) for r in sample], np.int64).reshape(len(sample), width)
    table = PivotTable(np.array([r[0] for r in sample], np.int64), whole, pivots)
    shared = spark.sparkContext.broadcast(table)  # PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            v = _whole(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(v.astype(dtype)), _bytes(table.distances(v)), batch.column(2)], ["id", "v", "d", "q"])

    placed = cut(rows.mapInArrow(place, "id long, v binary, d binary, q boolean"))
    asked = placed.where("q")
    row_bytes = width * 8 + 8 * len(table.pivots)  # of a candidate, as a task holds it
    groups = max(1, -(-n * row_bytes // GROUP_BYTES), min(shuffle_partitions(spark), n // GROUP_ROWS))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    candidates = placed.select(dealt.alias("grp"), F.lit(0).alias("kind"), "id", "v", "d")
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "id", "v", "d")
    parts = min(groups, 32 * shuffle_partitions(spark))
    met = candidates.unionByName(copies).repartitionById(parts, F.pmod("grp", F.lit(parts)).cast("int")).sortWithinPartitions("grp", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, now, group = shared.value, [], -1, None
        for batch in batches:
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(grp)]):
                if hi == lo:
                    continue
                if grp[lo] != now:
                    now, held, group = grp[lo], [], None
                part = batch.slice(lo, hi - lo)
                own = part.column(2).to_numpy(zero_copy_only=False), _table(part.column(3), dtype).astype(np.int64).reshape(hi - lo, width), _table(part.column(4), "<f8")
                if kind[lo] == 0:
                    held.append(own)
                    continue
                if group is None:
                    group = tuple(np.concatenate([h[i] for h in held]) for i in range(3)) if held else None
                    held = []
                if group is None:
                    continue
                floor = _floors(table, own[0], own[1], k)
                found, done = search_group(table, *own, floor, *group, k)
                if counts:
                    found = [np.zeros(1, np.int64), np.array([len(own[0]) * len(group[0])]), np.array([done])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _floors(table: PivotTable, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th best score cannot be below, as the pivots are rows too; those with the query's id do not count."""
    least = np.iinfo(np.int64).min
    if len(table.ids) < k:
        return np.full(len(q), least)
    scores = np.where(ids[:, None] == table.ids, least, q @ table.whole.T)
    return np.partition(scores, -k, axis=1)[:, -k]
