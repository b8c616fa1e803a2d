"""Secret scans: candidates filtered by a random forest [native]."""

from __future__ import annotations

import math
import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, fresh, hint_if_small, join_counted

#: A candidate: a whole run of these signs, from SHORTEST on; how much is read before and behind it.
SHORTEST, BEFORE, BEHIND = 16, 96, 48
TOKEN = rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}={{0,2}}"
#: The context at the end of what stands before: a word with its sign of assignment and quote.
CONTEXT = r"""(?:(?<!\S)\S{1,40}[ \t]*)?(?:(?<=[\s\w"'])(?:=|:|:=|=>)[ \t]*)?["']?\z"""
#: Words next to secrets, words next to what only looks like one. Fixed values.
NEAR = r"(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private|access|key)"
HARMLESS = r"(?i)(sha\d*|md5|digest|checksum|commit|uuid|guid|hash|etag|version|order|isbn|phone|card)"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your|here|xxx|foo|bar)"
PATHS = r"(?i)(test|spec|mock|fixture|example|sample|docs?)(/|_|\.|$)"
#: The dictionary: words of letters alone, at least so long, in at least so many documents.
WORD_LETTERS, WORD_DOCS = 3, 3
#: Words of the dictionary that labelled findings made by rule are drawn from.
MADE_WORDS = 2_000
ALPHABET = string.ascii_lowercase
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "changes", "surprise", "distinct", "hexadecimal", "decimal", "coverage", "placeholder", "near", "harmless", "near_behind", "harmless_behind", "assigned", "quoted", "path_test")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every candidate of every whole text: doc_id, text_key, candidate, context, behind, path.

    A candidate is a run of letters, digits and ``+ / _ -`` of SHORTEST signs or
    more, with up to two ``=`` behind it; shorter secrets are not looked for.  The
    text is cut at its candidates once, and what stands around one is found by its
    place: the context is the word, sign and quote at the end of the BEFORE
    characters before it, and may hold the end of the candidate before.
    """
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    cut_up = F.struct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("found"), F.split(text, TOKEN).alias("between"))

    def around(s: Column) -> Column:
        before = lambda i: F.concat(F.right(F.coalesce(F.get(s["found"], i - 1), F.lit("")), F.lit(BEFORE)), F.right(F.get(s["between"], i), F.lit(BEFORE)))
        behind = lambda i: F.concat(F.left(F.get(s["between"], i + 1), F.lit(BEHIND)), F.left(F.coalesce(F.get(s["found"], i + 1), F.lit("")), F.lit(BEHIND)))
        return F.transform(s["found"], lambda t, i: F.struct(t.alias("candidate"), F.right(before(i), F.lit(BEFORE)).alias("before"), F.left(behind(i), F.lit(BEHIND)).alias("behind")))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), where.alias("path"), F.inline(F.flatten(F.transform(F.array(cut_up), around))))
    return rows.select("doc_id", "text_key", "candidate", F.regexp_extract("before", CONTEXT, 0).alias("context"), "behind", "path")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, docs): the words of letters alone in at least WORD_DOCS documents; counted over all texts, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}+/_\-=]+"), lambda w: w.rlike(rf"^\p{{L}}{{{WORD_LETTERS},}}$"))
    each = docs.select(F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= WORD_DOCS)


def transitions(words: DataFrame) -> list[float]:
    """-log of how likely each letter a-z follows another in the dictionary's words, by 26 times the first plus the second."""
    lower = words.where(F.col("word").rlike("^[a-z]+$"))
    pairs = lower.select("docs", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    seen = {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("docs")).collect()}  # at most 26 times 26 rows
    table = []
    for a in ALPHABET:
        counts = [seen.get(a + b, 0) + 0.5 for b in ALPHABET]
        table += [-math.log(c / sum(counts)) for c in counts]
    return table


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def _pieces(candidate: Column) -> Column:
    """The words that a candidate may be made of: its letter runs, cut where a capital follows a small letter."""
    return F.filter(F.transform(F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower), lambda w: F.length(w) >= WORD_LETTERS)


def _letter(c: Column) -> Column:
    """1 to 26 for a to z, else 0."""
    code = F.ascii(c) - 96
    return F.when(code.between(1, 26), code).otherwise(0)


def _surprise(candidate: Column, table: list[float]) -> Column:
    """Mean of the transitions' surprise over the candidate's pairs of letters; that of even chances without any."""
    codes = F.transform(F.split(F.lower(candidate), ""), lambda c: _letter(c))
    costs = F.array(*map(F.lit, table))

    def mean(s: Column) -> Column:
        pairs = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.when((F.get(s, i) > 0) & (F.get(s, i + 1) > 0), (F.get(s, i) - 1) * 26 + F.get(s, i + 1) - 1)), lambda p: p.isNotNull())
        total = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.get(costs, p))
        return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(math.log(26)))

    return F.element_at(F.transform(F.array(codes), mean), 1)


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found``, a cut table, with ``coverage``: the share of a candidate's signs that words of the dictionary cover.

    Found once for each distinct candidate; candidates met very often are joined
    by broadcast.
    """
    each = found.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    parts = each.select("candidate", "n", F.explode_outer(_pieces(F.col("candidate"))).alias("word"))
    known = parts.join(words.select("word", F.lit(1).alias("known")), "word", "left")
    covered = known.groupBy("candidate", "n").agg(F.sum(F.when(F.col("known") == 1, F.length("word")).otherwise(0)).alias("letters"))
    table = covered.select("candidate", "n", (F.col("letters") / F.length("candidate")).alias("coverage"))
    return join_counted(found, cut(table), "candidate", found.count())


def with_features(found: DataFrame, table: list[float]) -> DataFrame:
    """Features of findings (candidate, context, behind, path, coverage).

    Length, character classes and transitions, dictionary coverage, path, words on
    both sides.  ``table`` holds the transitions of the dictionary.
    """
    c, around, behind = F.col("candidate"), F.coalesce("context", F.lit("")), F.coalesce("behind", F.lit(""))
    values = {
        "length": F.length(c).cast("double"),
        "digits": _share(c, "[0-9]"),
        "uppers": _share(c, "[A-Z]"),
        "lowers": _share(c, "[a-z]"),
        "marks": _share(c, r"[+/_=\-]"),
        "changes": _share(c, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "surprise": _surprise(c, table),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "hexadecimal": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "decimal": c.rlike(r"^[0-9\-]+$").cast("double"),
        "coverage": F.col("coverage"),
        "placeholder": c.rlike(PLACEHOLDER).cast("double"),
        "near": around.rlike(NEAR).cast("double"),
        "harmless": around.rlike(HARMLESS).cast("double"),
        "near_behind": behind.rlike(NEAR).cast("double"),
        "harmless_behind": behind.rlike(HARMLESS).cast("double"),
        "assigned": around.rlike(r"(=|:)\s*[\"']?$").cast("double"),
        "quoted": (around.rlike(r"[\"']$") & behind.rlike(r"^[\"']")).cast("double"),
        "path_test": F.coalesce("path", F.lit("")).rlike(PATHS).cast("double"),
    }
    return found.select("*", *[values[k].alias(f"f_{k}") for k in FEATURES])


def labelled_findings(words: list[str], n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Findings with labels (candidate, context, behind, path, secret), made by rule from formats of both kinds and the corpus's own words."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    words = [w for w in words if w.isascii()] or ["the", "and", "number", "value"]
    alnum, base64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    names = ["token", "api_key", "secret", "password", "auth", "access_key", "client_secret", "Authorization: Bearer", "private_key"]
    harmless = ["commit", "sha256", "md5", "order", "uuid", "card", "etag", "digest", "checksum", "version", "phone"]
    paths = ["src/app.py", "config/prod.yml", "src3", "deploy/env", "tests/mock.py", "docs/example.md"]

    def made() -> str:
        """A run of the corpus's words: a compound, a path, a name with its parts marked by case or sign."""
        sign, case, parts = r.choice(["", "", "", "_", "-", "/"]), r.choice([str.lower, str.lower, str.capitalize, str.capitalize, str.upper, str.title]), []
        while len(sign.join(parts)) < SHORTEST:
            parts.append(r.choice(words))
        whole = sign.join(p.capitalize() for p in parts) if case == str.title else case(sign.join(parts))
        return whole[: r.choice([SHORTEST, SHORTEST + 4, 60])]

    out = []
    for _ in range(n):
        path, sign, behind = r.choice(paths), r.choice([' = "', "=", ": ", " = ", ':"', '="']), " " + " ".join(r.choice(words) for _ in range(4))
        name, plain, kind = r.choice(names), r.choice(words), r.randrange(10)
        if kind == 0:
            row = (pick(hexa, r.choice([32, 40, 64])), name + sign, 1)
        elif kind == 1:
            row = (pick(r.choice([alnum, base64]), r.randrange(20, 64)), name + sign, 1)
        elif kind == 2:
            row = (r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), r.choice([name, plain]) + r.choice([" ", sign]), 1)
        elif kind == 3:
            row = (r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(alnum, r.randrange(24, 40)), r.choice([name, plain]) + r.choice([" ", sign]), 1)
        elif kind == 4:
            row = (pick(string.digits, r.randrange(16, 20)), r.choice([plain, r.choice(harmless)]) + " ", 0)
        elif kind in (5, 9):
            row = (made(), r.choice([plain, plain, plain + ".", "|", name]) + r.choice([" ", " ", " ", sign]), 0)
        elif kind == 6:
            row = (pick(hexa, r.choice([32, 40, 64])), r.choice(harmless) + r.choice([" ", ": ", ":"]), 0)
        elif kind == 7:
            row = (r.choice(["your_", "example-", "changeme_", "dummy_"]) + r.choice(["token_here", "secret_value", "api-key-example", "password_placeholder"]), name + sign, 0)
        else:
            h = pick(hexa, 32)
            row = (f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", r.choice([plain, r.choice(harmless)]) + " ", 0)
        if row[1][-1] in "\"'":
            behind = row[1][-1] + behind
        out.append((row[0], r.choice(["", "export ", "{"]) + row[1], behind, path, row[2]))
    return out


def train(spark: SparkSession, words: DataFrame, table: list[float], findings: DataFrame | None = None, trees: int = 24, depth: int = 8, seed: int = 42) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings (candidate, context, behind, path, secret).

    ``findings`` is a table of findings that people have judged; without one, they
    are made by rule, with at most MADE_WORDS words of the dictionary in them.
    """
    if findings is None:
        some = [r[0] for r in words.orderBy(F.xxhash64("word"), "word").limit(MADE_WORDS).collect()]
        findings = spark.createDataFrame(labelled_findings(some), "candidate string, context string, behind string, path string, secret int").coalesce(1)
    rows = _assembled(with_features(with_coverage(cut(findings), words), table)).select("features", F.col("secret").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(cut(rows))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)


def scan(docs: DataFrame, path: str | None = None, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Candidates of all documents with the forest's probability and its verdict.

    The dictionary and its letter transitions are counted over all documents.  The
    forest learns from ``findings`` (candidate, context, behind, path, secret), or
    from findings made by rule.

    Null and empty texts have no candidates; very long texts are read whole; a
    candidate met twice in a text counts twice, in repeated rows once for each row;
    an empty table gives no rows.  Other columns are not read, save the one
    ``path`` names.  A score that equals the threshold is a secret.

    Returns doc_id, text_key (hash of the text), candidate, context, score, is_secret.
    """
    words = cut(dictionary(docs))
    table = transitions(words)
    model = train(docs.sparkSession, words, table, findings)
    found = cut(candidates(docs, path))
    judged = model.transform(_assembled(with_features(with_coverage(found, words), table)))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "text_key", "candidate", "context", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets that ``found`` names (text_key, candidate, is_secret) replaced by ``mark``; the other columns stay.

    Rows meet their secrets by the hash of their text, so those without doc_id are
    cleaned too.  The longest secret goes first, so that one inside another leaves
    no rest of it.  Null texts stay null.
    """
    key, secrets = fresh(docs, "text_key__"), fresh(docs, "secrets__")
    each = found.where("is_secret").groupBy("text_key", "candidate").agg(F.first("is_secret")).select("text_key", F.struct((-F.length("candidate")).alias("n"), "candidate").alias("s"))
    bad = cut(each.groupBy("text_key").agg(F.array_sort(F.collect_list("s")).alias(secrets)).withColumnRenamed("text_key", key))
    wide = 64 + F.aggregate(secrets, F.lit(0), lambda t, s: t + F.length(s["candidate"]) + 32)
    joined = docs.join(hint_if_small(bad, wide), F.xxhash64("text") == F.col(key), "left")
    clean = F.when(F.col(secrets).isNull(), F.col("text")).otherwise(F.aggregate(secrets, F.col("text"), lambda t, s: F.replace(t, s["candidate"], F.lit(mark))))
    return joined.withColumn("text", clean).select(*docs.columns)
