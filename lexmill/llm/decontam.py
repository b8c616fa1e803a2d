"""Benchmark decontamination: size-partitioned MinHash containment search [native].

Items are partitioned by size, that is by their number of distinct shingles, in
powers of two.  An item's sketch is its smallest shingle hashes; the largest hash
in the sketches of a partition is the partition's cut-off.  Documents are
partitioned by size too: a document can only hold items of the partitions that
need no more shingles than it has, and its sketch is what it has of hashes below
the highest cut-off among those.  Long documents are thus met by a share of their
shingles that follows the similarity, short ones are not searched for large items.
With many items a cut-off nears the top of the hash range, so what is below it
also has to pass a sieve: one bit for each value that a sketch hash has modulo
SIEVE.  It holds every sketch hash, so nothing is lost, and its size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut, fresh, hint_if_small

WORDS, SIMILARITY = 5, 0.8
#: Hashes that an item's sketch holds beyond those that a text may lack: so many hits, and one more, make a candidate.
SPARE = 1
#: Bits of the sieve (2 MB), a power of two.
SIEVE = 1 << 24


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _for(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column, length: int, of) -> Column:
    """``of(words, i)`` for each start i (from 1) of a window of that many words."""
    n = F.size(words) - length + 1
    none = F.slice(F.transform(F.array(F.lit(1)), lambda i: of(words, i)), 1, 0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: of(words, i))).otherwise(none)


def _shingles(text_words: Column, length: int, of) -> Column:
    return _for(text_words, lambda w: _windows(w, length, of))


def _hash(length: int):
    return lambda w, i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(length)])


def _string(length: int):
    return lambda w, i: F.array_join(F.slice(w, i, length), " ")


def item_sketches(items: DataFrame, similarity: float = SIMILARITY, spare: int = SPARE) -> DataFrame:
    """Per item: shingles, their number, the size class, the MinHash sketch and the hits that it asks for.

    An item of fewer than five words has one shingle, all its words; items without
    words are left out.  A text that contains at least the given share of an item's
    n shingles lacks at most n - ceil(similarity * n) of them.  The sketch holds
    1 + ``spare`` hashes more than that, the smallest ones, so such a text holds at
    least 1 + ``spare`` of the sketch (fewer where the item has no more).
    """
    shaped = items.select("item_id", words_of(F.col("text")).alias("w")).withColumn("len", F.least(F.lit(WORDS), F.size("w"))).where("len > 0")
    shingles, hashes = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    for length in range(1, WORDS + 1):
        own = F.col("len") == length
        shingles = F.when(own, _shingles(F.col("w"), length, _string(length))).otherwise(shingles)
        hashes = F.when(own, _shingles(F.col("w"), length, _hash(length))).otherwise(hashes)
    parts = shaped.select("item_id", "len", F.array_distinct(shingles).alias("shingles"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))
    parts = parts.withColumn("n", F.size("shingles")).withColumn("need", F.ceil(F.col("n") * similarity - 1e-9).cast("int"))
    parts = parts.withColumn("class", F.floor(F.log2("n")).cast("int"))
    size = F.least(F.size("hashes"), F.col("n") - F.col("need") + 1 + spare)
    # hashes that fall together are counted once on both sides, so the hits asked for fall by as many
    hits = F.greatest(F.lit(1), size - (F.col("n") - F.col("need")))
    return parts.withColumn("hits", hits).withColumn("sketch", F.slice("hashes", 1, size)).drop("hashes")


def size_partitions(sketches: DataFrame) -> list[tuple[int, int, int, int]]:
    """(shingle length, size class, fewest shingles needed, cut-off) of each partition of items: at most WORDS times 31 rows."""
    rows = sketches.groupBy("len", "class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("cutoff")).collect()
    return sorted(tuple(r) for r in rows)


def sieve_of(sketches: DataFrame) -> DataFrame:
    """One row (bits): the sieve of all sketch hashes, SIEVE / 64 longs in order."""
    hashes = sketches.select(F.explode("sketch").alias("h"))
    met = hashes.groupBy(_sieve_word(F.col("h")).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("word"))
    words = sketches.sparkSession.range(SIEVE // 64).select(F.col("id").cast("int").alias("id")).join(met, "id", "left")
    return words.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))).getField("word").alias("bits"))


def _sieve_word(h: Column) -> Column:
    return F.shiftright(h.bitwiseAND(SIEVE - 1), 6).cast("int")


def _sieved(bits: Column, h: Column) -> Column:
    return F.getbit(F.get(bits, _sieve_word(h)), h.bitwiseAND(63).cast("int")) == 1


def document_sketches(docs: DataFrame, partitions: list[tuple[int, int, int, int]], sieve: DataFrame) -> DataFrame:
    """(text_key, len, windows, hash): of each text, per shingle length, the distinct hashes up to the cut-off of its size that pass the sieve.

    One pass over the texts: words are found once, and all lengths come from them.
    """

    def of(words: Column, bits: Column) -> Column:
        all_of = []
        for length in sorted({p[0] for p in partitions}):
            windows = F.size(words) - length + 1
            cutoff = F.lit(None).cast("long")
            for _, _, need, value in (p for p in partitions if p[0] == length):
                cutoff = F.greatest(cutoff, F.when(windows >= need, F.lit(value)))  # greatest skips nulls
            low = F.array_distinct(F.filter(_windows(words, length, _hash(length)), lambda h: (h <= cutoff) & _sieved(bits, h)))
            own = F.when(cutoff.isNotNull(), low)
            all_of.append(F.struct(F.lit(length).alias("len"), windows.alias("windows"), own.alias("low")))
        return F.array(*all_of)

    # the sieve's column falls together with its only use, so no row carries it
    sieved = docs.select("text", sieve.scalar().alias("bits"))
    found = _for(F.col("bits"), lambda b: _for(words_of(F.col("text")), lambda w: of(w, b)))
    rows = sieved.select(F.xxhash64("text").alias("text_key"), found.alias("all"))
    rows = rows.select("text_key", F.explode_outer("all").alias("s"))  # never empty; a plain explode tests that first, at the price of a second pass
    return rows.select("text_key", "s.len", "s.windows", F.explode("s.low").alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs of a document and a test item whose shingles it holds to at least ``similarity``.

    Search: documents' sketches, cut at the cut-off of their size and sieved, meet the
    items' sketches; pairs with as many common hashes as the item asks for are candidates.
    Candidates are then verified on the shingles themselves.  The sketch bounds
    make the search lossless: every document is hashed whole.

    Words are lower-case runs of letters and digits, shingles have five of them; a
    text of fewer holds no five-word shingle.  Null and empty texts hold nothing.
    Candidates are kept by text hash, so copies are searched like others and all
    returned; repeated rows give repeated pairs.  Items are told apart by id and
    shingles, so those without item_id are searched too and reported with none;
    repeated items count once.  Very long texts are searched whole.  An empty table
    on either side gives no pairs.  Extra columns are not read.  A side is broadcast
    only where its measured bytes are few; else both sides are shuffled by hash.

    Returns doc_id, item_id, n_shingles (of the item, distinct), matched, containment.
    """
    sketches = item_sketches(items.select("item_id", "text"), similarity).dropDuplicates(["item_id", "shingles"])
    sketches = cut(sketches.withColumn("item_key", F.xxhash64("item_id", "shingles")))
    partitions = size_partitions(sketches)
    if not partitions:
        return docs.select("doc_id").withColumns({"item_id": F.lit(None).cast("long"), "n_shingles": F.lit(0), "matched": F.lit(0), "containment": F.lit(0.0)}).where("false")
    keyed = hint_if_small(sketches.select("item_key", "len", "need", "hits", F.explode("sketch").alias("hash")))
    met = document_sketches(docs, partitions, sieve_of(sketches)).join(keyed, ["len", "hash"]).where("windows >= need")
    common = met.select("text_key", "item_key", "hits", "hash").distinct().groupBy("text_key", "item_key", "hits").agg(F.count(F.lit(1)).alias("n"))
    candidates = cut(common.where("n >= hits").select("text_key", "item_key"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    wide = 64 + F.aggregate("shingles", F.lit(0), lambda s, x: s + F.octet_length(x) + 32)
    wanted = hint_if_small(sketches.select("item_key", "item_id", "len", "n", "need", "shingles"), wide)
    pairs = texts.join(hint_if_small(candidates), "text_key").join(wanted, "item_key")
    own = F.lit(None).cast("array<string>")
    for length in sorted({p[0] for p in partitions}):
        own = F.when(F.col("len") == length, _shingles(words_of(F.col("text")), length, _string(length))).otherwise(own)
    matched = F.size(F.array_intersect("shingles", own))
    checked = pairs.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "need", matched.alias("matched"))
    return checked.where("matched >= need").select("doc_id", "item_id", "n_shingles", "matched", (F.col("matched") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that hold a test item; all columns stay.

    Texts are told apart by their hash, so a row without doc_id, or one that
    shares its doc_id with another text, is judged by its own text.  Null, empty and repeated texts, very long ones and empty tables
    are as in ``contained_items``.
    """
    key, own = fresh(docs, "doc_id__"), F.xxhash64("text")
    bad = cut(contained_items(docs.select(own.alias("doc_id"), "text"), items, similarity).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(hint_if_small(bad), own == F.col(key), "left_anti")
