"""Helpers that the corpus operators share: staged tables and global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.staging import hint_if_small, new_table, shared_dir, shuffle_partitions
from lexmill.functions.staging import staged as cut

__all__ = ["WORD", "cut", "fresh", "global_prefix", "hint_if_small", "join_counted", "new_table", "shared_dir", "shuffle_partitions"]

#: What counts as white space in the word-based operators; Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which holds each key once with the number ``n`` of its rows; ``n`` is dropped.

    Keys with more than a HOT-th of all ``total`` rows are broadcast: there are
    fewer than HOT of them, whatever the size, and their rows stay where they are.
    Only the rows of the other keys are shuffled, none of which can fill a task.
    """
    often = F.col("n") > max(1, total // HOT)
    hot, cold = table.where(often).drop("n"), table.where(~often).drop("n")
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(apart.join(cold, key))


#: Share of all rows, as one in HOT, from which on a key is hot.
HOT = 1000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that ``df`` does not have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))) if n.lower() not in taken)


def global_prefix(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``g_seq`` (gapless from 0) and ``g_before`` (sum of ``size`` before the row).

    ``rows`` must be a narrow, already cut table and ``order`` a total order on it.
    Rows are dealt into ranges of that order; each range gives one total, the
    totals are summed up (as many rows as there are ranges), and every range
    finishes its own rows, sorted by themselves: a task may finish several ranges,
    one after the other.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("g_part", F.spark_partition_id()))
    before = Window.orderBy("g_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("g_part")
        .agg(F.sum(size).alias("g_sum"), F.count(F.lit(1)).alias("g_count"))
        .select(
            "g_part",
            F.coalesce(F.sum("g_sum").over(before), F.lit(0)).alias("g_base"),
            F.coalesce(F.sum("g_count").over(before), F.lit(0)).alias("g_first"),
        )
    )
    inside = Window.partitionBy("g_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("g_seq", F.row_number().over(inside).cast("long") - 1)
        .withColumn("g_before", F.sum(size).over(running) - F.col(size))
        .join(F.broadcast(totals), "g_part")  # one row for each range
        .withColumn("g_seq", F.col("g_seq") + F.col("g_first"))
        .withColumn("g_before", F.col("g_before") + F.col("g_base"))
        .drop("g_part", "g_base", "g_first")
    )
