"""SimHash near-duplicate detection by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.llm.common import cut, fresh, hint_if_small, join_counted, shuffle_partitions

SEED = 42
#: The 64 bits in three blocks; of 4 differing bits at most 1 is in one of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
THRESHOLD, BLOCK_THRESHOLD = 4, 1
#: The first 15 bits of a block are covered by the Hamming code of that length, the others are kept.
CODE_BITS, RADIUS = 15, 1
#: Pairs that are compared at once, and members of an anchor from which it is cut into tiles.
PAIRS, TILE = 1 << 21, 20_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII only, as asked for
    n = len(parts) - words + 1
    if not parts:
        return 0
    joined = b" ".join(parts)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.empty(len(parts), np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        spans = zip(starts[lo:hi].tolist(), ends[lo + words - 1 : hi + words - 1].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    out = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(out.view(np.int64))


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Of the Hamming code whose check matrix has column i + 1 for bit i: 0 for code words."""
    s = np.zeros_like(v)
    for i in range(CODE_BITS):
        s ^= np.where((v >> i) & 1 == 1, i + 1, 0)
    return s


def _steps(width: int) -> list[np.ndarray]:
    """For each syndrome, the changes of up to RADIUS + BLOCK_THRESHOLD bits that lead to an anchor."""
    one = [1 << i for i in range(width)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    change = np.array([0, *one, *two], np.int64)
    of = _syndrome(change)
    return [change[of == s] for s in range(CODE_BITS + 1)]


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at every anchor within covering radius plus threshold; home is the nearest."""
    steps = [_steps(width) for _, width in BLOCKS]
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(prints), 8192):
            own, keys, whose, home = prints[lo : lo + 8192], [], [], []
            for b, (start, width) in enumerate(BLOCKS):
                v = (own.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
                s = _syndrome(v)
                nearest = v ^ np.where(s > 0, np.left_shift(1, np.maximum(s - 1, 0)), 0)
                for k, change in enumerate(steps[b]):
                    at = np.flatnonzero(s == k)
                    anchor = (v[at, None] ^ change[None, :]).ravel()
                    keys.append(anchor | (b << 22))
                    whose.append(np.repeat(own[at], len(change)))
                    home.append(anchor == np.repeat(nearest[at], len(change)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(whose)), pa.array(np.concatenate(home))], ["anchor", "print", "home"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the links (a, b) join: each node to the smallest it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        ra, rb = root[ia], root[ib]
        if (ra == rb).all():
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links_of(group: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows sorted by group: pairs of a home row and a larger print, at most THRESHOLD apart."""
    _, first, count = np.unique(group, return_index=True, return_counts=True)
    which = np.searchsorted(first, np.arange(len(group)), side="right") - 1
    at = np.flatnonzero(home)
    starts, sizes = first[which[at]], count[which[at]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    cum = np.concatenate([[0], np.cumsum(sizes)])
    total, lo = int(cum[-1]), 0
    while lo < total:
        hi = min(total, lo + PAIRS)
        i, j = np.searchsorted(cum, lo, side="right") - 1, np.searchsorted(cum, hi, side="left")
        length = np.minimum(cum[i + 1 : j + 1], hi) - np.maximum(cum[i:j], lo)
        row = np.repeat(np.arange(i, j), length)
        other = starts[row] + (np.arange(lo, hi) - cum[row])
        x, y = prints[at[row]], prints[other]
        near = (x < y) & (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= THRESHOLD)
        if near.any():
            found.append(_spanning(x[near], y[near]))
        lo = hi
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _spanning(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare per anchor; rows come sorted by group, a group of bounded size can span batches."""
    held: list[tuple[np.ndarray, ...]] = []
    seen = 0

    def links(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b = _links_of(*(np.concatenate([r[k] for r in rows]) for k in range(3)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(rows[0]):
            continue
        held.append(rows)
        seen += len(rows[0])
        if seen >= 4 * TILE:
            whole = tuple(np.concatenate([r[k] for r in held]) for k in range(3))
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            if last:
                yield links([tuple(c[:last] for c in whole)])
            held, seen = [tuple(c[last:] for c in whole)], len(whole[0]) - last
    if held:
        yield links(held)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints differing in at most four bits.

    ``prints`` has one long column ``print`` of distinct values.  Links come as
    spanning stars for each part of an anchor, not as all pairs; what is joined is
    the same.  An anchor with more than TILE members is cut into tiles of home
    rows by visiting rows, so that no task holds an unbounded anchor.
    """
    n = shuffle_partitions(prints.sparkSession)
    members = cut(prints.mapInArrow(_to_anchors, "anchor int, print long, home boolean"))  # read to count and to compare
    hot = members.groupBy("anchor").count().where(F.col("count") > TILE)
    hot = cut(hot.select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("cuts")))
    plain = members.withColumn("tile", F.lit(0).cast("long"))
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("print"), F.col("cuts"))
        cuts = members.join(hint_if_small(hot, 16), "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        spread = cuts.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
        as_home = spread.where("home").withColumn("tile", own * F.col("cuts") + F.col("other"))
        as_visitor = spread.where("cuts > 1 or not home").withColumn("tile", F.col("other") * F.col("cuts") + own).withColumn("home", F.lit(False))
        plain = as_home.unionByName(as_visitor).select("anchor", "print", "home", "tile")
    group = (F.col("tile") * (1 << 24) + F.col("anchor")).alias("grp")
    dealt = plain.select(group, "print", "home").repartition(n, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) for every node that has a link, root its smallest node.

    Alternates large-star and small-star steps (each: the smallest neighbour by a
    pre-aggregated minimum, then one join) until nothing changes; every round is
    cut, so a lost executor costs one round.  Nodes with very many neighbours are
    joined by broadcast, so no task holds a whole star.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = (edges.count(), None)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, low, "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and hashed
    by four-word shingles with repeats; fingerprints that differ in at most four
    bits are linked, and a component is everything linked directly or by others.

    Anchors: a block of the fingerprint has as anchors all values whose first 15
    bits are a Hamming code word.  Of two fingerprints at most four bits apart,
    one block differs in at most one bit, so the anchor nearest to the first one
    (covering radius 1) is within two bits of the second; each is replicated to
    every anchor within that distance.  No link is lost.

    Nulls and texts without words have fingerprint 0 and are linked like others.
    A null ``doc_id`` never names a component unless it has no other document.
    An empty table gives no rows; other columns are not read.

    Returns doc_id, print (long), component_id (smallest doc_id of the component).
    """
    own = cut(docs.select("doc_id", _fingerprints("text").alias("print")))
    distinct = cut(own.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    joined = components(near_links(distinct.select("print")))
    rooted = cut(distinct.join(joined.withColumnRenamed("node", "print"), "print", "left").select("print", "n", "least_id", F.coalesce("root", "print").alias("root")))
    prints, rows = rooted.agg(F.count(F.lit(1)), F.sum("n")).first()
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_print = join_counted(rooted.select("print", "root", F.col("n").alias("copies")), named, "root", prints)
    return join_counted(own, of_print.select("print", "component_id", F.col("copies").alias("n")), "print", rows or 0).select("doc_id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: of smallest ``doc_id``, then of smallest text hash; all columns stay.

    A row without ``doc_id`` stays only where its component has no other; rows
    that agree in doc_id and text are one document and give one row.  Null and
    empty texts are near duplicates of one another.  Very long texts are read
    whole; an empty table gives an empty one.
    """
    key, row = fresh(docs, "text_key__"), fresh(docs, "doc_key__")
    marked = near_duplicates(docs.select(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("c")).alias("doc_id"), "text"))
    marked = cut(marked.select(F.col("doc_id.b").alias(row), F.col("doc_id.c").alias(key), (F.col("doc_id") == F.col("component_id")).alias("head")))
    gone = cut(marked.where("not head").select(row, key).distinct())  # far fewer than what stays
    same = F.col("doc_id").eqNullSafe(F.col(row)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    kept = docs.join(hint_if_small(gone, 32), same, "left_anti")
    repeated = marked.where("head").groupBy(row, key).count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    return kept.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", key]).drop(key)
