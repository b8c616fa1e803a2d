"""The corpus pipeline: language filter, near duplicates, decontamination, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontam, langid, mixing, sharding, simhash
from lexmill.llm.common import new_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learnt language, predicted with a score of 0.65 or more and as likely as is usual in it; ``lang`` is filled where null.

    Null and empty texts and those without letters go; very long texts are read
    whole; repeated rows stay; an empty table stays empty; other columns stay.
    """
    return langid.keep_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of smallest doc_id.

    A row without doc_id stays only where its group has no other; repeated rows
    give one; null and empty texts are near duplicates of one another; very long
    texts are read whole; an empty table stays empty; other columns stay, whatever
    their names.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, nor does anything if the benchmark is empty;
    very long texts are read whole; rows are judged by their own text, repeated
    ones alike; an empty table stays empty; other columns stay, whatever their
    names.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it does not take, and texts without words, go.

    A null source is a source of its own, ranked last.  Null and empty texts have
    no words and go; very long texts are counted whole, and one that exceeds what
    is open of its source's target may not be taken.  Repeated rows are one
    document, taken as often as all of them together; ties in the seeded order go
    by doc_id and text.  An empty table stays empty; other columns stay, whatever
    their names.
    """
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in contiguous shards of near equal bytes, in doc_id order, null first; equal rows may be parted.

    A null or empty text has its row's overhead as size; a very long one may fill
    a shard by itself; an empty table gives no rows; the columns are those of
    ``shard_documents``, so other columns end here.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

#: Fingerprints and seeded draws have no counterpart in SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
