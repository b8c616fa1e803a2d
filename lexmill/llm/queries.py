"""Queries of the corpus operators, whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontam, htmltext, langid, merkle, mixing, pivots, secrets, sharding, simhash, tokenfile, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_documents(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_uses=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), path="source")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), k=16)
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower_case = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), {"text": lower_case}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sharding, op2_mixing, op3_simhash, op4_token_file, op5_secrets, op6_warc, op7_language_id, op8_decontamination, op9_exact_top_k, op10_toxicity,
        op11_whitening, op12_merkle, op13_html_text,
    )
    return {f.__name__: f for f in own}


#: Pairs of document and test item by plain shingle sets.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) >= 5),
i AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gs FROM iw WHERE len(w) >= 5),
e AS (SELECT item_id, len(gs) AS n, unnest(gs) AS g FROM i)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS matched, count(*) / n AS containment
FROM e JOIN s USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hx[i])]), '') AS bits FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CASE WHEN bits[5 * i + j] = '1' THEN CAST(pow(2, 5 - j) AS BIGINT) ELSE 0 END)) AS BIGINT)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


#: Levels of a group's tree and of the tree over groups that the SQL below spells out: 8^8 rows of a group, 8^3 groups.
OP12_LEVELS = {"n": 8, "t": 3}


def _op12_levels(kind: str) -> str:
    """Levels of trees as common tables: a node's place, digest, count of its level, and what is left and right of it in its run."""
    inside = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
    around = (
        f"CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({inside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, "
        f"CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({inside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r"
    )
    out = []
    for h in range(OP12_LEVELS[kind] + 1):
        if h:
            out.append(f"{kind}{h}_ AS (SELECT g, pos // 8 AS pos, CASE WHEN max(c) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d, (max(c) + 7) // 8 AS c FROM {kind}{h - 1} GROUP BY g, pos // 8)")
        out.append(f"{kind}{h} AS (SELECT *, {around} FROM {kind}{h}_)")
    return ",\n".join(out)


def _op12_sql() -> str:
    def h(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(strpos('0123456789', s) AS BIGINT) + 47), lambda a, b: " + _crc_step("xor(a, b)") + ", CAST(4294967295 AS BIGINT)), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [("n", i) for i in range(OP12_LEVELS["n"])] + [("t", i) for i in range(OP12_LEVELS["t"])]
    joins = " ".join(f"JOIN {k}{i} AS {k}{i} ON {k}{i}.g = {'x.g' if k == 'n' else '0'} AND {k}{i}.pos = {'x.pos' if k == 'n' else 'x.g'} // {8**i}" for k, i in steps)
    folds = ", ".join(f"f{at} AS (SELECT *, CASE WHEN l{at - 1} <> '' OR r{at - 1} <> '' OR one{at - 1} THEN sha256(l{at - 1} || y{at - 1} || r{at - 1}) ELSE y{at - 1} END AS y{at} FROM f{at - 1})" for at in range(1, len(steps) + 1))
    paths = ", ".join(f"{k}{i}.l AS l{at}, {k}{i}.r AS r{at}, {k}{i}.c > 1 AS one{at}" for at, (k, i) in enumerate(steps))
    proof = " || ".join(f"l{at} || r{at}" for at in range(len(steps)))
    return f"""
WITH h AS (SELECT doc_id, lang, {h("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {h(lower)} END AS forged FROM documents),
x AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
n0_ AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS c FROM x),
{_op12_levels("n")},
t0_ AS (SELECT 0 AS g, g AS pos, d, count(*) OVER () AS c FROM n{OP12_LEVELS["n"]}),
{_op12_levels("t")},
f0 AS (SELECT doc_id, leaf, coalesce(forged, leaf) AS y0, s.d AS subroot, e.d AS root, {paths} FROM x {joins} JOIN n{OP12_LEVELS["n"]} AS s ON s.g = x.g CROSS JOIN t{OP12_LEVELS["t"]} AS e),
{folds}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, y{len(steps)} AS folded_root, y{len(steps)} = root AS verified FROM f{len(steps)}
"""


def _crc_step(first: str) -> str:
    """CRC-32 of one more byte: eight shifts."""
    out = first
    for _ in range(8):
        out = f"list_transform([{out}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)[1]"
    return out


OP12_SQL = _op12_sql()


#: What an article element holds, for pages that mark their text by one; other pages are held against the tests' expected texts.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|br|h1)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
u AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM u
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_exact_top_k": OP9_SQL, "op12_merkle": OP12_SQL, "op13_html_text": OP13_SQL}
