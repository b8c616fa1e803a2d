"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, cut, fresh, global_prefix

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Passes over open gaps in seeded order, before the largest documents go first.
SEEDED_PASSES = 3
#: Extra cost of a word's first, second and third use: convex, so repeats come last.
REPEAT_COST = (0, 1, 3)
#: Marks a source name; the mark of the null source sorts behind it.
NAMED, NULL_SOURCE = "s", "t"


def fill_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share ``sum(sizes)`` by weight; a target stops at ``cap`` times its size.

    What is above a stop is shared again, by weight, among the others until none
    is above.
    """
    left, targets, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = weights[i] * unit
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        free = [i for i in free if i not in over]
    return targets


def whole_quotas(targets: list[float]) -> list[int]:
    """Targets as whole words with the same sum, the largest fractions rounded up."""
    quotas = [int(t) for t in targets]
    short = round(sum(targets)) - sum(quotas)
    for i in sorted(range(len(targets)), key=lambda i: (quotas[i] - targets[i], i))[: max(short, 0)]:
        quotas[i] += 1
    return quotas


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximum flow.

    Successive shortest paths with node potentials; costs must not be negative.
    """
    head, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        out[a].append(len(head))
        head.append(b), cap.append(c), cost.append(w)
        out[b].append(len(head))
        head.append(a), cap.append(0), cost.append(-w)
    lift = [0] * nodes
    while True:
        far, via, heap = [None] * nodes, [-1] * nodes, [(0, source)]
        far[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e] > 0:
                    v, nd = head[e], d + cost[e] + lift[u] - lift[head[e]]
                    if far[v] is None or nd < far[v]:
                        far[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        lift = [x + (f if f is not None else far[sink]) for x, f in zip(lift, far)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], max_uses: int) -> list[int]:
    """Words to take from each pattern so that the sources' quotas are met most cheaply."""
    names = sorted(quotas)
    at = {s: len(patterns) + i for i, s in enumerate(names)}
    source, sink = len(patterns) + len(names), len(patterns) + len(names) + 1
    arcs = []
    for p, (_, size) in enumerate(patterns):
        for use in range(max_uses):
            arcs.append((source, p, size, REPEAT_COST[use] if use < len(REPEAT_COST) else use * use))
    arcs += [(p, at[s], max_uses * size, 0) for p, (members, size) in enumerate(patterns) for s in members]
    arcs += [(at[s], sink, quotas[s], 0) for s in names]
    flow = min_cost_flow(arcs, sink + 1, source, sink)
    return [sum(flow[p * max_uses : (p + 1) * max_uses]) for p in range(len(patterns))]


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_uses: int = 3, seed: int = 42, members: str | None = None, max_patterns: int = 20_000
) -> DataFrame:
    """Choose how often each document enters a mix whose sources meet target weights.

    Size is the number of words of ``text``.  ``members`` may name an array column
    with all sources a document belongs to; without it ``source`` is the only one.
    Documents are summed up by membership pattern, and a min-cost flow routes each
    pattern's words, the second and third use at rising cost, to the sources'
    quotas.  A pattern then gives all its documents as many whole times as its
    flow holds, and for the rest documents in seeded order: as far as they fit,
    then, while more than a hundredth of the target is open, those that fit what
    is open (after SEEDED_PASSES the largest first, so that each pass at least
    halves what is open), and at last the one document that comes nearest to what
    is missing.

    The flow is solved on the driver over one row for each pattern; more than
    ``max_patterns`` of them raise an error, none are dropped.

    Nulls: a null source is a source of its own, ranked last; null text has size 0
    and is never taken.  Equal documents may be taken unequally often.  Very long
    texts are counted whole.  An empty table gives no rows.  Other columns are not
    read.  Reruns agree.

    Returns doc_id, source, text_crc32, size, source_size and target (of the
    document's sources, summed where it has several), taken (words, repeats
    counted) and uses (times the whole document is taken).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = lambda c: F.when(c.isNull(), F.lit(NULL_SOURCE)).otherwise(F.concat(F.lit(NAMED), c))
    pattern = F.array(mark(F.col("source"))) if members is None else F.array_sort(F.array_distinct(F.transform(F.col(members), mark)))
    narrow = cut(
        docs.select(
            "doc_id",
            "source",
            pattern.alias("pattern"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row_no"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    )
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted((tuple(r["pattern"] or ()), r["size"]) for r in found)
    names = sorted({s for p, _ in patterns for s in p})
    sizes = [sum(n for p, n in patterns if s in p) for s in names]
    whole = sum(n for _, n in patterns)
    shares = [weights[i % len(weights)] for i in range(len(names))]
    targets = dict(zip(names, fill_targets(sizes, shares, max_uses) if sum(sizes) == whole else _overlap_targets(sizes, shares, max_uses, whole)))
    quotas = dict(zip(names, whole_quotas([targets[s] for s in names])))
    flows = route(patterns, quotas, max_uses)
    source_size, plan = dict(zip(names, sizes)), []
    for i, ((p, n), f) in enumerate(zip(patterns, flows)):
        plan.append((list(p), i, f // n if n else 0, f % n if n else 0, sum(source_size[s] for s in p), float(sum(targets[s] for s in p))))
    spark = docs.sparkSession
    schema = "pattern array<string>, p long, rounds long, gap long, source_size long, target double"
    table = F.broadcast(spark.createDataFrame(plan, schema).coalesce(1))  # at most max_patterns rows
    rows = narrow.join(table, "pattern").drop("pattern").withColumn("more", F.lit(0))
    gaps, seeded, settled = {p[1]: p[3] for p in plan}, SEEDED_PASSES, False
    while not settled:
        rows, gaps, settled = _take_in_order(rows, gaps, {p[1]: p[5] for p in plan}, largest_first=seeded <= 0)
        seeded -= 1
    miss = F.abs(F.col("gap") - F.col("size"))
    last = (
        rows.where((F.col("more") == 0) & (miss < F.col("gap")))
        .groupBy("p")
        .agg(F.min(F.struct(miss.alias("miss"), F.col("draw"), F.col("row_no"))).getField("row_no").alias("last"))
    )
    taken = rows.join(F.broadcast(last), "p", "left")  # a row for each pattern
    uses = (F.col("rounds") + F.when((F.col("more") == 1) | (F.col("row_no") == F.col("last")), 1).otherwise(0)).cast("int")
    return taken.select("doc_id", "source", "text_crc32", "size", "source_size", "target", (F.col("size") * uses).alias("taken"), uses.alias("uses"))


def _take_in_order(rows: DataFrame, gaps: dict[int, int], targets: dict[int, float], largest_first: bool) -> tuple[DataFrame, dict[int, int], bool]:
    """Take untaken documents that fit their pattern's gap, in seeded order or the largest first, as far as they fill it.

    Returns the rows, marked in ``more``, with their new ``gap``; the gaps; and
    whether another pass has nothing to do: every gap is below a hundredth of its
    target, or nothing was taken.
    """
    spark = rows.sparkSession
    able = (F.col("more") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    fits = rows.where(able).withColumn("turn", -F.col("size") if largest_first else F.lit(0))
    placed = global_prefix(fits, ["p", "turn", "draw", "doc_id", "text_crc32", "row_no"], "size").drop("g_seq", "turn")
    placed = cut(placed)
    first = placed.groupBy("p").agg(F.min("g_before").alias("first"))  # a row for each pattern
    end = F.col("g_before") - F.col("first") + F.col("size")
    placed = placed.join(F.broadcast(first), "p").withColumn("more", (end <= F.col("gap")).cast("int")).drop("g_before", "first")
    rows = cut(placed.unionByName(rows.where(~able)))
    done = {r["p"]: r["done"] for r in placed.where("more = 1").groupBy("p").agg(F.sum("size").alias("done")).collect()}
    left = {p: g - done.get(p, 0) for p, g in gaps.items()}
    table = spark.createDataFrame(list(left.items()) or [(-1, 0)], "p long, gap long").coalesce(1)
    rows = rows.drop("gap").join(F.broadcast(table), "p")
    return rows, left, not done or all(g <= 0.01 * targets[p] for p, g in left.items())


def _overlap_targets(sizes: list[int], shares: list[float], cap: float, whole: int) -> list[float]:
    """Targets where documents have several sources: the words to share are those of the documents."""
    scale = sum(sizes) / whole if whole else 1.0
    return [t / scale for t in fill_targets(sizes, shares, cap)]


def apply_mix(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns stay as they are.

    Rows that agree in doc_id, source and text are one document that is taken as
    often as all of them together.  Nulls, empty and very long texts and empty
    tables are as in ``mix_documents``; columns of any name are kept.
    """
    mixed = cut(mix_documents(docs, **options).select("doc_id", "source", "text_crc32", "uses"))
    keys = mixed.groupBy("doc_id", "source", "text_crc32").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("rows"))
    repeated = bool(keys.where("rows > 1").limit(1).count())
    crc, uses, copy = fresh(docs, "m_crc"), fresh(docs, "m_uses"), fresh(docs, "m_copy")
    m_id, m_source, m_text = fresh(docs, "m_id"), fresh(docs, "m_source"), fresh(docs, "m_text")
    rows = docs.withColumn(crc, F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    if repeated:
        rows = rows.dropDuplicates(["doc_id", "source", crc])
    keys = keys.where("uses > 0").select(F.col("doc_id").alias(m_id), F.col("source").alias(m_source), F.col("text_crc32").alias(m_text), F.col("uses").alias(uses))
    same = F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("source").eqNullSafe(F.col(m_source)) & (F.col(crc) == F.col(m_text))
    joined = rows.join(keys, same).select(*docs.columns, uses)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(uses).cast("int")))).drop(uses, copy)
