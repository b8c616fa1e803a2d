"""Sharding by global byte-size prefix sums [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut, fresh, global_prefix


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Cut the documents, in ``doc_id`` order, into contiguous shards of near equal bytes.

    Size is the UTF-8 byte count of ``text`` plus ``overhead``.  A row goes to the
    shard in which the middle of its bytes falls when all bytes are laid in a row
    and cut at equal targets.  A shard is therefore off its target by at most one
    document on each side; a document larger than a target fills a shard alone
    and can leave a neighbouring shard empty.  A hot group of equal rows is split
    like any other rows.

    Very long texts are measured whole.  Nulls: a null text counts as empty, a null ``doc_id`` sorts first.  Equal rows
    are in arbitrary order among themselves, which does not show in the result.
    An empty table gives no rows.  Other columns of ``docs`` are not read.

    Returns doc_id, size, text_crc32 (of the UTF-8 text), shard, slot (gapless
    from 0 in each shard) and start_byte (global offset).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )
    placed = global_prefix(narrow, ["doc_id", "text_crc32", "size", "row_no"], "size")
    total = max(1, narrow.agg(F.sum("size")).first()[0] or 0)
    middle = F.expr(f"((2 * g_before + size) * {shards}) div {2 * total}")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))
    first = placed.groupBy("shard").agg(F.min("g_seq").alias("first_seq"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("g_seq") - F.col("first_seq")).alias("slot"), F.col("g_before").alias("start_byte")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> str:
    """Write ``docs`` as Parquet partitioned by shard; gives the name of the partition column.

    That is ``shard``, or ``shard_2`` and so on where ``docs`` has a column of that
    name, which is kept.  Rows are tied to their shard by doc_id and text checksum,
    nulls included; rows that are equal in both stay together in the shard of the
    first of them.  An empty table writes no shard.
    """
    keys = shard_documents(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"))
    own_id, own_crc, name = fresh(docs, "s_id"), fresh(docs, "s_crc"), fresh(docs, "shard")
    keys = keys.select(F.col("doc_id").alias(own_id), F.col("text_crc32").alias(own_crc), F.col("shard").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.crc32(F.coalesce(F.col("text"), F.lit(""))) == F.col(own_crc))
    docs.join(keys, same).drop(own_id, own_crc).write.partitionBy(name).parquet(path)
    return name
