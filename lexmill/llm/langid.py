"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import fresh

#: Hash slots, n-gram lengths, characters that are worked on at once.
SLOTS, ORDERS, CHUNK = 1 << 15, (1, 2, 3), 1 << 20
#: Bounds on the labelled rows from which the counts are taken, and of those, on the ones that tell what is usual.
MAX_TRAIN, MAX_USUAL = 20_000, 4_000
UNKNOWN = "und"
#: Spread of the log probability of single n-grams (three n-grams share a letter), and the least spread between texts.
GRAM_SPREAD, LEAST_SPREAD = 6.0, 0.25
#: A document is kept from this posterior on, unless its fit is so many standard deviations below what is usual.
LEAST_SCORE, LEAST_FIT = 0.65, -8.0


_BMP: list[np.ndarray] = []


def _letters(raw: np.ndarray) -> np.ndarray:
    """Code points, with 0 (a gap) for those that are no letters."""
    if not _BMP:
        _BMP.append(np.fromiter((c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 0 for c in range(0x10000)), np.uint32, 0x10000))
    out = _BMP[0][np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]).tolist():
        out[raw == c] = c if chr(c).isalpha() else 0
    return out


def _codes(text: str | None) -> np.ndarray:
    """Lower-case letters as numbers with one gap (0) before, after and between words."""
    raw = np.frombuffer(("\n" + (text or "").lower() + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    code = _letters(raw)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    return code[keep]


def _slots(code: np.ndarray, order: int) -> np.ndarray:
    """Slot of each n-gram; code must hold at least ``order`` numbers."""
    n = len(code) - order + 1
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ code[i : i + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h % np.uint32(SLOTS)


def _pieces(code: np.ndarray) -> Iterator[np.ndarray]:
    """Very long texts in parts: each with the CHUNK places at which its n-grams start, and what these reach beyond."""
    for lo in range(0, len(code), CHUNK):
        yield code[lo : lo + CHUNK + max(ORDERS) - 1]


def ngram_counts(text: str | None) -> np.ndarray:
    """How often each slot is hit by the text's n-grams (all orders together)."""
    out, code = np.zeros(SLOTS, np.int64), _codes(text)
    for piece in _pieces(code):
        for order in ORDERS:
            if len(piece) >= order:
                out += np.bincount(_slots(piece[: CHUNK + order - 1], order), minlength=SLOTS)
    return out


@dataclass
class LanguageModel:
    """Languages, their log priors and the log-probability matrix (slots by languages)."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray
    #: Mean and spread of the log probability of an n-gram over the texts of each language; None if not learnt.
    typical: np.ndarray | None = None
    spread: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior, and how its n-grams fit that language; und and 0 without letters or languages.

        Texts are scored together: each n-gram's row of the matrix is added to its
        text.  The posterior only tells the known languages apart; the fit tells,
        in standard deviations, whether n-grams are as likely as is usual in the
        language, and is far below 0 for what is none of them.
        """
        names, scores, fits, grams = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.langs:
            return names, scores, fits
        total = np.zeros((len(texts), len(self.langs)))
        has, batch, size = np.zeros(len(texts), bool), [], 0

        def flush() -> None:
            nonlocal batch, size
            if batch:
                code = np.concatenate([c for _, c in batch])
                starts = np.cumsum([0, *(len(c) for _, c in batch)])
                for order in ORDERS:
                    if len(code) < order:
                        continue
                    slots = _slots(code, order)
                    for k, (i, c) in enumerate(batch):  # n-grams across two texts are left out
                        own = slots[starts[k] : max(starts[k], min(starts[k] + CHUNK, starts[k + 1] - order + 1))]
                        grams[i] += len(own)
                        if len(own):
                            total[i] += self.logp.take(own, axis=0).sum(axis=0, dtype=np.float64)
            batch, size = [], 0

        for i, text in enumerate(texts):
            code = _codes(text)
            has[i] = bool((code > 0).any())
            if has[i]:
                for piece in _pieces(code):
                    batch.append((i, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        flush()
        flush()
        mean = total / np.maximum(grams, 1)[:, None]
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        for i in np.flatnonzero(has):
            names[i], scores[i] = self.langs[best[i]], share[i, best[i]]
            if self.typical is not None:
                fits[i] = (mean[i, best[i]] - self.typical[best[i]]) / math.sqrt(self.spread[best[i]] ** 2 + GRAM_SPREAD**2 / grams[i])
        return names, scores, fits


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = ngram_counts(text)
            if lang in sums:
                sums[lang] += counts
            else:
                sums[lang] = counts
            docs[lang] = docs.get(lang, 0) + 1
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        slot, n = np.append(at, -1), np.append(counts[at], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])


def train(rows: DataFrame, lang: str = "lang", text: str = "text", max_train: int = MAX_TRAIN, key: Column | None = None, with_fit: bool = False) -> LanguageModel:
    """Fit the model on labelled rows.

    At most about ``max_train`` rows are read, chosen by the hash of ``key``
    (default: the text), so that reruns take the same.  Rows whose label or text
    is null are left out; without rows the model knows no language.  Counts are
    summed up on the executors; the driver gets at most slots times languages.
    ``with_fit`` reads at most about MAX_USUAL of them once more, to learn how
    likely the n-grams of a text of each language are.
    """
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.xxhash64(text) if key is None else F.xxhash64(key)).alias("draw"))
    n = rows.where(F.col(lang).isNotNull()).count()
    drawn = lambda most: labelled.where(F.pmod("draw", F.lit(1_000_000)) < int(1_000_000 * most / n) + 1) if n > most else labelled
    labelled, usual_rows = drawn(max_train), drawn(min(max_train, MAX_USUAL))
    counts = labelled.select("lang", "text").mapInArrow(_count_batches, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    at = {name: i for i, name in enumerate(langs)}
    table, docs = np.full((SLOTS, len(langs)), 0.5), np.ones(len(langs))
    for r in counts:
        if r["slot"] < 0:
            docs[at[r["lang"]]] += r["n"]
        else:
            table[r["slot"], at[r["lang"]]] += r["n"]
    model = LanguageModel(langs, np.log(docs / docs.sum()) if langs else docs, np.log(table / table.sum(axis=0)).astype(np.float32))
    if with_fit and langs:
        shared = rows.sparkSession.sparkContext.broadcast((model.prior * 0, model.logp))  # slots by languages

        def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, means = batch.column(0).to_pylist(), []
                for name, t in zip(names, batch.column(1).to_pylist()):
                    counts = ngram_counts(t)
                    means.append(float(counts @ shared.value[1][:, at[name]].astype(np.float64)) / counts.sum() if counts.sum() else None)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(means, pa.float64())], ["lang", "mean"])

        usual = usual_rows.select("lang", "text").mapInArrow(likelihoods, "lang string, mean double").groupBy("lang").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s")).collect()
        found = {r["lang"]: (r["m"], r["s"]) for r in usual}
        model.typical = np.array([found.get(n, (None, None))[0] or 0.0 for n in langs])
        model.spread = np.array([max(LEAST_SPREAD, found.get(n, (None, None))[1] or 0.0) for n in langs])
    return model


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "lang_score", fit: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its posterior and, if ``fit`` names a column, its fit; only ``text`` is an input.

    A null text and one without any letter get ``und`` and 0.  All columns stay;
    existing columns of these names are replaced.  Whole texts are scored, very
    long ones piece by piece; repeated rows alike; languages that tie go to the
    first name.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.logp, model.typical, model.spread))  # slots by languages: a fixed bound

    @F.pandas_udf("lang string, score double, fit double")
    def score_texts(texts: pd.Series) -> pd.DataFrame:
        names, scores, fits = LanguageModel(*shared.value).predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": names, "score": scores, "fit": fits})

    predict = score_texts.asNondeterministic()  # so that a filter on what it gives does not score the texts once more
    names = {"lang": lang, "score": score, **({"fit": fit} if fit else {})}
    kept = [c for c in docs.columns if c not in names.values()]
    found = fresh(docs, "p__")
    marked = docs.select(*kept, predict(text).alias(found))
    return marked.select(*kept, *[F.col(found)[k].alias(name) for k, name in names.items()])


def held_out() -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Learn from the labelled part of ``docs`` and predict all of it: doc_id, held_out, lang_pred, score.

    Nulls, empty and very long texts, ties and repeated rows as in
    ``with_language``; a null doc_id is not held out; an empty table gives no rows;
    without labels every language is ``und``.  Other columns are not read.
    """
    model = train(docs.where(~held_out()), max_train=max_train)
    return with_language(docs.select("doc_id", "text", held_out().alias("held_out")), model, score="score").drop("text")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, least_score: float = LEAST_SCORE, least_fit: float = LEAST_FIT, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` whose language is known, one of ``languages`` (default: all learnt ones), and predicted surely enough.

    Dropped are documents without letters, those below ``least_score``, those whose
    n-grams are too unlikely in the language they are nearest to (text of another
    language, or of none), and those of other languages than asked for.  The
    prediction fills ``lang`` where that is null; columns stay as they are.  Nulls,
    ties, repeated rows and empty tables as in ``with_language``.
    """
    model = train(docs.where(~held_out()), max_train=max_train, with_fit=True)
    lang, score, fit = fresh(docs, "lang__"), fresh(docs, "score__"), fresh(docs, "fit__")
    marked = with_language(docs, model, lang=lang, score=score, fit=fit)
    known = (F.col(lang) != UNKNOWN) & (F.col(score) >= least_score) & (F.col(fit) >= least_fit)
    kept = marked.where(known if languages is None else known & F.col(lang).isin(languages))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def save(model: LanguageModel, spark: SparkSession, path: str) -> None:
    """Write a model as a table (lang, prior, typical, spread, logp)."""
    usual = lambda values, i: None if values is None else float(values[i])
    rows = [(n, float(model.prior[i]), usual(model.typical, i), usual(model.spread, i), model.logp[:, i].tolist()) for i, n in enumerate(model.langs)]
    spark.createDataFrame(rows, "lang string, prior double, typical double, spread double, logp array<float>").write.parquet(path)


def load(spark: SparkSession, path: str) -> LanguageModel:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["lang"])  # a row for each language
    fitted = bool(rows) and all(r["typical"] is not None for r in rows)
    column = lambda name: np.array([r[name] for r in rows])
    logp = np.array([r["logp"] for r in rows], np.float32).T.reshape(SLOTS, len(rows))
    return LanguageModel([r["lang"] for r in rows], column("prior"), logp, column("typical") if fitted else None, column("spread") if fitted else None)
