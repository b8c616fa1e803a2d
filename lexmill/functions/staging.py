"""Tables that several later steps read are written once to the shared folder; sides of joins are broadcast by measured bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 16 << 20
#: Contexts whose checkpoint folder is removed when the driver ends.
_HELD: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Where that is unset, a folder of
    this machine is taken, but only in local mode.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    own = sc.getCheckpointDir()  # a folder of this context alone, below the named one
    if own not in _HELD:
        _HELD.add(own)
        atexit.register(drop_table, spark, own)
    return named


def staged(df: DataFrame) -> DataFrame:
    """``df`` as written to the session's checkpoint folder, so that a lost executor costs a reread; removed when the driver ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{kind}-{uuid.uuid4().hex}"
    atexit.register(drop_table, spark, path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a path from the shared folder; a session that has ended leaves it."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def byte_size(df: DataFrame, width: Column | int = 64) -> int:
    """Bytes of a table: ``width`` is those of a row, a number or a column that adds up its texts and arrays."""
    return df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0


def hint_if_small(df: DataFrame, width: Column | int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes allow one; otherwise as it is."""
    return F.broadcast(df) if byte_size(df, width) <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met_in_blocks(rows: DataFrame, asked: DataFrame, row_key: Column, asked_key: Column, asked_width: Column | int) -> DataFrame:
    """Every row with every one of a stated set of asked rows.

    While the asked rows' measured bytes are few they are broadcast.  Beyond, they
    are cut into blocks by key and met block by block: rows are dealt by key too,
    so a task holds one share of the rows and one block.  Both keys must be unique
    enough to spread; the columns of both sides must have different names.
    """
    size = byte_size(asked, asked_width)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(asked), F.lit(True))
    spark = rows.sparkSession
    blocks, shares = -(-size // BROADCAST_BYTES), shuffle_partitions(spark)
    left = rows.withColumn("share__", F.pmod(F.xxhash64(row_key), F.lit(shares))).withColumn("block__", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = asked.withColumn("block__", F.pmod(F.xxhash64(asked_key), F.lit(blocks))).withColumn("share__", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    return left.join(right, ["block__", "share__"]).drop("block__", "share__")


def running_counts(rows: DataFrame, keys: list[str], by: str, n: str) -> DataFrame:
    """Rows with ``before__``: the sum of ``n`` over the rows of the same keys with a smaller ``by``.

    Rows are dealt into ranges of keys and ``by``; each range gives one total for
    each of its keys, these are summed up, and every range finishes its own rows.
    So a key of any size is spread over tasks.  Keys may be null; no two rows may
    agree in keys and ``by``.
    """
    ranged = staged(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys, by).withColumn("part__", F.spark_partition_id()))
    totals = ranged.groupBy("part__", *keys).agg(F.sum(n).alias("sum__"))
    earlier = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a key
    totals = totals.select(*[F.col(k).alias(f"{k}_k__") for k in keys], F.col("part__").alias("part_k__"), F.coalesce(F.sum("sum__").over(earlier), F.lit(0)).alias("base__"))
    same = F.col("part__") == F.col("part_k__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k__"))
    inside = Window.partitionBy("part__", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("own__", F.sum(n).over(inside) - F.col(n))
    return own.join(hint_if_small(totals, 96), same).withColumn("before__", F.col("own__") + F.col("base__")).select(*rows.columns, "before__")


#: Phrases that a block of them holds at most, and signs of a gram.
PHRASES, GRAM = 512, 4
_WORD = r"[\p{L}\p{N}_]+"


def _words(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)))


def _grams(word: Column) -> Column:
    """The distinct runs of GRAM signs in a word."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _by_blocks(texts: DataFrame, text: str, parts: DataFrame) -> DataFrame:
    """(columns of ``texts``, part): the parts (part) that texts hold, every text held against every block of them."""
    n = parts.count()
    packed = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(max(1, -(-n // PHRASES)))).alias("b__")).agg(F.collect_list("part").alias("ps__"))
    wide = F.aggregate("ps__", F.lit(0), lambda s, p: s + F.octet_length(p) + 24)
    met = met_in_blocks(texts, packed, F.xxhash64(text), F.col("b__"), wide)
    return met.select(*texts.columns, F.explode(F.filter("ps__", lambda p: F.contains(F.col(text), p))).alias("part"))


def words_with(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part): which words hold which parts of words.

    A part stands at its rarest gram; words' grams are joined with these on
    equality, and the whole part is looked for in what meets.  Parts shorter than
    a gram are held against all words.
    """
    long = F.char_length("part") >= GRAM
    grams = staged(vocabulary.where(F.char_length("word") >= GRAM).select("word", F.explode(_grams(F.col("word"))).alias("gram")))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    places = parts.where(long).select("part", F.explode(_grams(F.col("part"))).alias("gram")).join(often, "gram")
    at = places.groupBy("part").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    found = grams.join(at, "gram").where(F.contains(F.col("word"), F.col("part"))).select("word", "part")
    short = parts.where(~long)
    return found if short.isEmpty() else found.unionByName(_by_blocks(vocabulary.select("word"), "word", short))


def phrases_in(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(columns of ``texts`` but the text, phrase): which distinct phrases each text holds, whatever the case.

    A phrase stands at its longest word: where it occurs, that word is part of a
    word of the text.  Which words of the whole vocabulary hold which of these is
    found by the words' grams; texts' words are then joined on equality, and what
    meets is held against the whole phrase.  The words are broadcast, in as many
    blocks as their measured bytes ask for, and texts are not shuffled.  Phrases
    without a word are held against every text; empty and null ones are in none.
    """
    wide = texts.withColumns({"low__": F.lower(text), "row__": F.monotonically_increasing_id()})
    own = [x for x in texts.columns if x != text]
    low = phrases.select(F.lower(phrase).alias("p")).where("p <> ''").distinct()
    longest = F.array_max(F.transform(_words(F.col("p")), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    low = staged(low.select("p", longest.alias("part")))
    vocabulary = staged(texts.select(F.explode(_words(F.lower(text))).alias("word")).distinct())
    held = words_with(vocabulary, low.where("part is not null").select("part").distinct())
    at = staged(held.join(hint_if_small(low, 48 + F.octet_length("p")), "part").groupBy("word").agg(F.collect_list("p").alias("ps__")))
    size = byte_size(at, 64 + F.aggregate("ps__", F.lit(0), lambda s, p: s + F.octet_length(p) + 24))
    blocks = max(1, -(-size // BROADCAST_BYTES))
    each = wide.withColumn("word", F.explode(_words(F.col("low__"))))
    hits = []
    for b in range(blocks):
        met = each.join(F.broadcast(at.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)), "word")
        # a phrase that is one word, or a part of one, is there; longer ones are looked for
        fits = F.filter("ps__", lambda p: F.contains(F.col("word"), p) | F.contains(F.col("low__"), p))
        hits.append(met.select("row__", *own, F.explode(fits).alias("phrase")))
    bare = low.where("part is null").select(F.col("p").alias("part"))
    if not bare.isEmpty():
        hits.append(_by_blocks(wide, "low__", bare).select("row__", *own, F.col("part").alias("phrase")))
    return reduce(DataFrame.unionByName, hits).dropDuplicates(["row__", "phrase"]).drop("row__")
