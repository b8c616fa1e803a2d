"""Merkle manifest of a dataset: trees of eight-fold runs, and an authentication path for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.types import StructField, StructType

from lexmill.functions.staging import BROADCAST_BYTES, byte_size
from lexmill.llm.common import cut, global_prefix, join_counted

#: Nodes that a run holds, levels that a block spans, and leaves of a block.
ARITY, SPAN = 8, 3
BLOCK = ARITY**SPAN

#: One level of a path: the digests left and right of the own one in its run, joined.
STEP = "array<struct<left: binary, right: binary>>"
_ARROW_STEP = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def digest(joined: bytes) -> bytes:
    """H of digests (or text) joined, as hex text."""
    return hashlib.sha256(joined).hexdigest().encode()


def height(n: int) -> int:
    """Levels between n nodes and the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def fold(leaf: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


@dataclass
class Treehash:
    """A stack that turns leaves, taken one at a time from ``at`` to ``end``, into the nodes of one level in order.

    Below that level it holds the open runs only: fewer than ARITY nodes for each level.
    """

    level: int
    at: int
    end: int
    open: list[list[bytes]] = field(default_factory=list)
    done: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.open = [[] for _ in range(self.level)]

    @property
    def low(self) -> int:
        """The lowest level with an open node; that of the stack if it has none."""
        return next((h for h, run in enumerate(self.open) if run), self.level)

    def _put(self, node: bytes, h: int) -> None:
        while h < self.level:
            self.open[h].append(node)
            if len(self.open[h]) < ARITY:
                return
            node, self.open[h] = digest(b"".join(self.open[h])), []
            h += 1
        self.done.append(node)

    def advance(self, leaves: Sequence[bytes]) -> None:
        """Take one leaf; at the last one of all, close the runs that are short."""
        self._put(leaves[self.at], 0)
        self.at += 1
        if self.at == self.end == len(leaves):
            for h in range(self.level):
                if self.open[h]:
                    node, self.open[h] = digest(b"".join(self.open[h])), []
                    self._put(node, h + 1)


def root_of(leaves: Sequence[bytes], levels: int) -> bytes:
    """The node that ``levels`` levels of runs make of all leaves."""
    stack = Treehash(levels, 0, len(leaves))
    while stack.at < stack.end:
        stack.advance(leaves)
    return stack.done[0]


class Traversal:
    """Authentication paths of a block's leaves, one after the other.

    At hand are, for each level, the run that holds the current leaf's ancestor,
    and a treehash stack that prepares the next run of that level while this one
    is used.  For each leaf that is passed as many single leaves are taken as
    there are stacks, each by the unfinished one whose lowest open node is lowest:
    so every run is ready when it is needed, and open nodes are those of a few
    stacks, not of all.  Nodes held grow with the levels, not with the leaves.
    """

    def __init__(self, leaves: Sequence[bytes], levels: int) -> None:
        self.leaves, self.levels = leaves, levels
        self.held = 0
        self.runs: list[list[bytes]] = []
        self.stacks: list[Treehash | None] = []
        for h in range(levels):
            reach = ARITY ** (h + 1)
            first = Treehash(h, 0, min(reach, len(leaves)))
            while first.at < first.end:
                first.advance(leaves)
            self.runs.append(first.done)
            self.stacks.append(self._next(h, reach))

    def _next(self, h: int, start: int) -> Treehash | None:
        return Treehash(h, start, min(start + ARITY ** (h + 1), len(self.leaves))) if start < len(self.leaves) else None

    def __iter__(self) -> Iterator[list[tuple[bytes, bytes]]]:
        path: list[tuple[bytes, bytes]] = [(b"", b"")] * self.levels
        for i in range(len(self.leaves)):
            for h in range(self.levels):
                if i % ARITY**h:
                    break
                if i and i % ARITY ** (h + 1) == 0:
                    stack = self.stacks[h]
                    if stack is None or stack.at < stack.end:
                        raise RuntimeError("a run is not ready")
                    self.runs[h] = stack.done
                    self.stacks[h] = self._next(h, i + ARITY ** (h + 1))
                own = i // ARITY**h % ARITY
                path[h] = b"".join(self.runs[h][:own]), b"".join(self.runs[h][own + 1 :])
            yield path
            self._work()

    def _work(self) -> None:
        kept = [s for s in self.stacks if s is not None]
        busy = [s for s in kept if s.at < s.end]
        for _ in kept if busy else ():
            stack = min(busy, key=lambda s: s.low)
            stack.advance(self.leaves)
            if stack.at == stack.end:
                busy.remove(stack)
                if not busy:
                    break

    def nodes(self) -> int:
        """Nodes that are held now."""
        return sum(map(len, self.runs)) + sum(len(s.done) + sum(map(len, s.open)) for s in self.stacks if s is not None)


def field_text(column: Column) -> Column:
    """``-`` if null, else the value's UTF-8 bytes, a colon, and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """The binary digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """The root of every aligned block of nodes: (grp, pos, n, node), pos and n as of the level above."""

    def climb(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block.column("n")[0].as_py()
        leaves = [x.hex().encode() for x in block.column("node").to_pylist()]
        top = root_of(leaves, min(SPAN, height(n)))
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int64()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": pa.array([bytes.fromhex(top.decode())], pa.binary())})

    blocked = nodes.select("grp", (F.col("pos") / BLOCK).cast("long").alias("block"), "pos", "n", "node")
    return blocked.groupBy("grp", "block").applyInArrow(climb, "grp long, pos long, n long, node binary")


def _paths(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(grp, pos, path) of nodes: the path within the block, then that of the block (``shared``), which all its nodes have in common."""

    def walk(key: tuple[pa.Scalar, ...], block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        upper = above.column("path")[0].as_py() if len(above) else []
        paths = [[{"left": a, "right": b} for a, b in path] + upper for path in _traversal(block)]
        return pa.table({"grp": block.column("grp"), "pos": block.column("pos"), "path": pa.array(paths, _ARROW_STEP)})

    return _with_shared(nodes, shared).applyInArrow(walk, f"grp long, pos long, path {STEP}")


def _traversal(block: pa.Table) -> Traversal:
    return Traversal([x.hex().encode() for x in block.column("node").to_pylist()], min(SPAN, height(block.column("n")[0].as_py())))


def _with_shared(nodes: DataFrame, shared: DataFrame) -> PandasCogroupedOps:
    """Each block of nodes with the one path from its root on; (grp, pos, path) of ``shared`` are those of block roots."""
    block = (F.col("pos") / BLOCK).cast("long").alias("block")
    above = shared.select("grp", F.col("pos").alias("block"), "path")
    return nodes.select("*", block).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of these, and so on, until each group has one block."""
    out = [nodes]
    while most > BLOCK:
        out.append(cut(_blocks(out[-1])))
        most = -(-most // BLOCK)
    return out


def manifest(
    docs: DataFrame,
    tampered: dict[str, Column] | None = None,
    when: Column | None = None,
    doc_id: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """A leaf for every row, the roots above it, its proof, and whether a changed row is found out.

    Leaves of a group ascend by doc_id (null first; rows of one doc_id by their
    digest, so that only equal rows may change places); while several nodes remain,
    every eight in a row become one.  Groups' roots, null first and then by their
    bytes, are joined likewise.  ``tampered`` names columns that are replaced
    where ``when`` holds (where it is null nothing is); folding up the changed leaf
    with the original siblings then gives another root.  Null fields and empty and
    very long texts are digested as they are, each with its length; an empty table
    gives no rows; other columns are not read.

    Rows become digests in one pass; only these are sorted.  A group of any size is
    cut into aligned blocks of BLOCK leaves, and a task holds one block at a time.
    The roots of blocks are nodes of the same tree and are cut into blocks again.
    Going down, every block gets the path from its root on once, and a traversal
    puts its leaves' own siblings before it.

    Returns doc_id, lang (the group), leaf, subroot, root, proof_sha256,
    folded_root and verified.
    """
    spark = docs.sparkSession
    same = {c: F.col(c) for c in fields}
    name = F.col(group).cast("string")
    leaves = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("key"),  # null sorts first
        leaf_of(list(same.values())).alias("node"),
        F.when(F.lit(False) if when is None else when, leaf_of(list((same | (tampered or {})).values()))).alias("forged"),
    )
    leaves = cut(leaves)  # digests: what follows reads no texts
    salted = leaves.withColumns({"one": F.lit(0).cast("long"), "salt": F.monotonically_increasing_id()})  # equal rows may be parted
    placed = cut(global_prefix(salted, ["key", "id", "node", "salt"], "one").select("key", "id", "node", "forged", "g_seq"))
    counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("g_seq").alias("first"))
    groups = cut(global_prefix(cut(counts.withColumn("one", F.lit(0).cast("long"))), ["key"], "one").select("key", "n", F.col("n").alias("leaves"), "first", F.col("g_seq").alias("grp")))
    n_groups, most, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if byte_size(groups, F.octet_length("key") + 64) <= BROADCAST_BYTES:
        told = placed.join(F.broadcast(groups.drop("n")), "key")
    else:
        told = join_counted(placed, groups, "key", total)
    nodes = cut(told.select("grp", (F.col("g_seq") - F.col("first")).alias("pos"), F.col("leaves").alias("n"), "node", "forged", "id", "key"))

    levels = _levels(nodes.select("grp", "pos", "n", "node"), most)
    subroots = _blocks(levels[-1])
    tops = _levels(cut(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(n_groups).cast("long").alias("n"), "node")), n_groups)
    shared = spark.createDataFrame([], f"grp long, pos long, path {STEP}")
    root = next((r.node.hex() for r in _blocks(tops[-1]).collect()), "")  # one row
    for level in reversed(tops):
        shared = cut(_paths(level, shared))
    shared = shared.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
    for level in reversed(levels[1:]):
        shared = cut(_paths(level, shared))

    schema = StructType([StructField("id", docs.schema[doc_id].dataType), *StructType.fromDDL("key string, leaf string, subroot string, proof_sha256 string, folded_root string")])

    def prove(key: tuple[pa.Scalar, ...], block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        upper = [(s["left"], s["right"]) for s in (above.column("path")[0].as_py() if len(above) else [])]
        tail = b"".join(a + b for a, b in upper)
        forged = block.column("forged").to_pylist()
        walk = _traversal(block)
        inner = height(block.column("n")[0].as_py()) - walk.levels  # levels of the group's tree above the block
        subroot, proofs, folded = "", [], []
        for leaf, other, path in zip(walk.leaves, forged, walk):
            if not proofs:
                subroot = fold(leaf, [*path, *upper[:inner]]).decode()
            proofs.append(digest(b"".join(a + b for a, b in path) + tail).decode())
            folded.append(fold(fold(leaf if other is None else other.hex().encode(), path), upper).decode())
        texts = [[x.decode() for x in walk.leaves], [subroot] * len(folded), proofs, folded]
        return pa.Table.from_arrays([block.column("id"), block.column("key"), *[pa.array(t, pa.string()) for t in texts]], schema.names)

    proved = _with_shared(nodes, shared).applyInArrow(prove, schema)
    group_name = F.when(F.col("key") != "", F.substr(F.col("key"), F.lit(2))).cast(docs.schema[group].dataType)
    return proved.select(
        F.col("id").alias("doc_id"), group_name.alias("lang"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
