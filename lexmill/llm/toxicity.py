"""Toxicity scoring behind a noisy-channel deobfuscation of the text.

Spans that may be disguised are decoded by Viterbi over a lattice of what each
character may have been written for, under a character model of the corpus; the
restored text is scored.  Found are look-alikes before, inside and behind words
(LEET, but for ``! ( # +`` behind a word, which are punctuation there), single
characters set apart, separators inside words, letters repeated three times or
more, and a letter doubled once in a word that tells.  Not found are words written
backwards, look-alikes that LEET does not list, words cut by more than two signs
between letters, and disguises of words that no labelled row has plainly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut

#: Symbols of the character model: 0 a gap, 1-26 the letters a-z, the others share the rest.
SYMBOLS = 64
#: Letters that a character may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ø": "o", "#": "h",
}
#: Log chances of the channel: a letter (or a blank) stands for itself, for another, is repeated, is a separator, is noise.
SAME, LEETED, REPEATED, SEPARATOR, NOISE = -0.05, -0.7, -0.9, -0.3, -12.0
#: Longest span that is decoded as one lattice; longer ones are decoded in windows that follow one another.
SPAN = 64
#: Bounds: labelled rows, words of the vocabulary.
MAX_TRAIN, VOCABULARY = 8_000, 2_048
#: Documents with a word from which on its share of toxic ones is believed, if nine in ten are: a word that has nothing to
#: do with it, where one document in ten is toxic, has such a share in eight by less than one chance in ten million.
SURE = 8
#: Lengths of the word beginnings that are features beside the whole words.
PREFIXES = (5, 7)

_WORDS = re.compile(r"[^\W\d_]+")
_MARKS, _ENDS = r"0-9@$!|+(€£¡ø#", r"0-9@$|€£¡ø"
#: What may be disguised: letters mixed with look-alikes, runs of one letter, single letters set apart.
_SUSPECT = re.compile(
    rf"(?<![^\s])(?:[^\W\d_{_MARKS}]|[{_MARKS}])(?:[ .\-_*]{{1,2}}(?:[^\W\d_]|[{_MARKS}])(?![^\W_])){{2,}}"  # s t u p i d
    rf"|[^\W_]*[^\W\d_]+[{_MARKS}]+[^\W\d_][^\s]*"  # st0pid
    rf"|[{_MARKS}]+[^\W\d_]{{2,}}[^\s]*"  # $tupid
    r"|[^\W\d_]*([^\W\d_])\1{2,}[^\W\d_]*"  # stuuupid
    r"|[^\W\d_]{1,3}(?:[.\-_*][^\W\d_]{1,3}){2,}"  # st-up-id
    r"|[^\W\d_]+[*_][^\W\d_]+"  # stu*pid
    rf"|[^\W\d_]+[{_ENDS}]+(?![^\W_])"  # idio7
)
_DOUBLE = re.compile(r"([^\W\d_])\1")


def symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % (SYMBOLS - 27) if char.isalpha() else 0


_BMP: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    if not _BMP:
        _BMP.append(np.fromiter((0 if 0xD800 <= c < 0xE000 else symbol(chr(c)) for c in range(0x10000)), np.uint8, 0x10000))
    raw = np.frombuffer(("  " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    out = _BMP[0][np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]).tolist():
        out[raw == c] = symbol(chr(c))
    return out.astype(np.int64)


#: Kinds of characters: letters, white space, marks that may stand for letters, separators inside words.
LETTER, SPACE, MARK, BETWEEN, ENDING = 1, 2, 4, 8, 16
_KINDS: list[np.ndarray] = []


def _kind(c: int) -> int:
    char = chr(c)
    return LETTER * char.isalpha() | SPACE * char.isspace() | MARK * (char.isdigit() or char in "@$!|+(€£¡ø#") | BETWEEN * (char in ".-_*") | ENDING * (char.isdigit() or char in "@$|€£¡ø")


def suspect_windows(low: str) -> list[tuple[int, int]]:
    """Where a lower-case text may be disguised: windows, in order, that end at white space.

    Found by the kinds of neighbouring characters, for whole texts at once: a mark
    before or behind a letter, a separator between letters, three equal letters in
    a row, and characters that stand alone between white space.
    """
    if not _KINDS:
        _KINDS.append(np.fromiter((0 if 0xD800 <= c < 0xE000 else _kind(c) for c in range(0x10000)), np.uint8, 0x10000))
    code = np.frombuffer(f" {low}    ".encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _KINDS[0][np.minimum(code, 0xFFFF)]
    letter, space = (kind & LETTER) > 0, (kind & SPACE) > 0
    hit = ((kind[1:-4] & MARK) > 0) & letter[2:-3]
    hit |= ((kind[1:-4] & BETWEEN) > 0) & letter[:-5] & letter[2:-3]
    hit |= ((kind[1:-4] & ENDING) > 0) & letter[:-5]
    hit |= letter[1:-4] & (code[1:-4] == code[2:-3]) & (code[2:-3] == code[3:-2])
    alone = ~space[1:-1] & space[:-2] & space[2:]
    spaced = alone[:-3] & alone[2:-1]
    hit[: len(spaced)] |= spaced[: len(hit)]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gaps = np.flatnonzero(space[1:-4])
    last = np.searchsorted(gaps, at)
    lo = np.where(last > 0, gaps[np.maximum(last - 1, 0)] + 1, 0) if len(gaps) else np.zeros(len(at), np.int64)
    reach = at + np.where(hit[at] & np.append(spaced, np.zeros(max(0, len(hit) - len(spaced)), bool))[at], 3, 0)
    after = np.searchsorted(gaps, reach)
    hi = np.where(after < len(gaps), gaps[np.minimum(after, max(len(gaps) - 1, 0))], len(low)) if len(gaps) else np.full(len(at), len(low))
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            s = _symbols(text or "")
            for lo in range(0, len(s) - 2, 1 << 20):
                p = s[lo : lo + (1 << 20) + 2]
                total += np.bincount((p[:-2] * SYMBOLS + p[1:-1]) * SYMBOLS + p[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow one another, over all texts whole; a table of fixed size."""
    rows = docs.select("text").mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(SYMBOLS**3)
    for r in rows:
        total[r["gram"]] = r["n"]
    return total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log chance of the third symbol after two, mixed with the chances after one and after none."""
    one = counts.sum(axis=(0, 1)) + 1
    two = counts.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
    return np.log((counts + 4 * p2) / (counts.sum(axis=2, keepdims=True) + 4))


def with_lexicon(counts: np.ndarray, words: list[str], share: float = 1e-4) -> np.ndarray:
    """Counts in which each word of a lexicon makes up at least that share of all symbols: what disguises hide."""
    out, each = counts.copy(), max(10.0, share * counts.sum())
    for word in words:
        s = [0, 0, *map(symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            out[a, b, c] += each
    return out


def _choices(char: str, before: str, run: int, pairs: bool) -> list[tuple[str, float]]:
    """What a character of a span may have been written for: letters, a gap or nothing, with the channel's log chance.

    run: how often the character stands in a row; with ``pairs`` two in a row are both meant.
    """
    out = [(char, SAME)] if char.isalpha() else []
    out += [(c, LEETED) for c in LEET.get(char, "")]
    if char == before and not (pairs and run == 2):
        out.append(("", REPEATED))
    if not char.isalnum():
        out.append(("", NOISE / 2 if char in LEET else SEPARATOR))
    if char.isspace() or char in ".-_*":
        out.append((" ", SAME if char.isspace() else SEPARATOR))  # a gap between words, weighed by the character model
    return out or [("", NOISE)]


@dataclass
class Restorer:
    """Viterbi decoding of disguised spans under a character model."""

    logp: np.ndarray
    lexicon: frozenset[str] = frozenset()
    known: dict[str, str] = field(default_factory=dict)

    def decode(self, span: str, pairs: bool) -> str:
        """The likeliest letters of a span: Viterbi over states of the last two symbols."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i, char in enumerate(span):
            run = 1
            while i + run < len(span) and span[i + run] == char:
                run += 1
            back = i
            while back and span[back - 1] == char:
                back -= 1
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for letter, chance in _choices(char, span[i - 1] if i else "", run + i - back, pairs):
                for (a, b), (score, text) in paths.items():
                    if letter:
                        c = symbol(letter)
                        state, new = (b, c), (score + chance + float(self.logp[a, b, c]), text + letter)
                    else:
                        state, new = (a, b), (score + chance, text)
                    if state not in after or new > after[state]:
                        after[state] = new
            paths = after
        return max((s + float(self.logp[a, b, 0]), t) for (a, b), (s, t) in paths.items())[1]

    def readings(self, span: str) -> str:
        """What a span says as it stands, and what it most likely says, with doubled letters read as one and as two."""
        got = self.known.get(span)
        if got is None:
            own = span.strip("!?.,;:\"'()[]|*_- ")
            parts = [own[i : i + SPAN] for i in range(0, len(own), SPAN)]
            got = " ".join(dict.fromkeys([*_WORDS.findall(own), *("".join(self.decode(p, pairs) for p in parts) for pairs in (False, True))]))
            if len(self.known) > 1 << 17:
                self.known.clear()
            self.known[span] = got
        return got

    def restore(self, text: str) -> str:
        """The text in lower case with disguised spans replaced by what they most likely say."""
        low, out, at = text.lower(), [], 0
        for lo, hi in suspect_windows(low):
            out += [low[at:lo], _SUSPECT.sub(lambda m: f" {self.readings(m.group(0))} ", low[lo:hi])]
            at = hi
        return "".join([*out, low[at:]])

    def tokens(self, text: str | None) -> set[str]:
        """The words of the restored text; a word with a doubled letter is decoded if a telling word has it once."""
        found = set(_WORDS.findall(self.restore(text))) if text else set()
        if self.lexicon:
            for word in [w for w in found if _DOUBLE.search(w) and _DOUBLE.sub(r"\1", w) in self.lexicon]:
                found.update(self.readings(word).split())
        return found


def features(word: str) -> list[str]:
    """A word and its first letters, each with its kind."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


@dataclass
class ToxicityModel:
    restorer: Restorer
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.lengths = {len(w) - 1 for w in self.weights if w.endswith("~")}

    def score(self, text: str | None) -> float:
        w, tokens = self.weights, self.restorer.tokens(text)
        x = self.bias + sum(w[t] for t in tokens if t in w)
        for k in PREFIXES:
            if k in self.lengths:
                x += sum(w[t] for t in {f"{t[:k]}~" for t in tokens if len(t) > k} if t in w)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _descend(at: np.ndarray, col: np.ndarray, y: np.ndarray, size: int, l1: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with l1 and l2 penalties, by accelerated proximal steps."""
    n = len(y)
    x, top = np.ones(size + 1), 1.0
    for _ in range(20):  # the largest curvature, by power iteration; the last coordinate is the bias
        z = np.bincount(at, x[col], n) + x[-1]
        x = np.append(np.bincount(col, z[at], size), z.sum()) / n
        top = np.linalg.norm(x)
        x /= top
    step = 3.5 / top
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = np.append(np.zeros(size), math.log(share / (1 - share)))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        z = np.bincount(at, v[col], n) + v[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        new = v - step * (np.append(np.bincount(col, r[at], size), r.sum()) + l2 * np.append(v[:-1], 0))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit_weights(rows: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, float]:
    """Weights of words: an l1 penalty picks few words, then their weights are fitted without it."""
    y = np.array([r[1] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([np.array(r[0], np.int64) for r in rows] or [np.empty(0, np.int64)])
    picked, _ = _descend(at, col, y, size, 0.2 / math.sqrt(len(y)) * max(y.mean(), 0.02) ** 0.5 / 2, 0, 1500)
    of = np.cumsum(picked != 0) - 1
    stay = picked[col] != 0
    w, b = _descend(at[stay], of[col[stay]], y, int((picked != 0).sum()), 0, 1e-5, 2000)
    out = np.zeros(size)
    out[picked != 0] = w
    return out, b


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY) -> ToxicityModel:
    """Fit the character model on all texts and the classifier on a bounded sample of labelled rows.

    At most about ``max_train`` labelled rows are read, chosen by the hash of the
    id.  The vocabulary holds the words whose presence tells most; words met in
    fewer than three documents are left out of it.
    """
    counts = character_counts(docs)
    logp = language_model(counts)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(logp)  # SYMBOLS to the third: fixed
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = marked.count()
    if n > max_train:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n) + 1)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            ids, toxic, found = [], [], []
            for i, text, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(i), toxic.append(y), found.append(sorted({f for t in restorer.tokens(text) for f in features(t)}))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(toxic, pa.int32()), "words": pa.array(found, pa.list_(pa.string()))})

    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # about max_train rows
    read = cut(sample.mapInArrow(words, "doc_id long, toxic int, words array<string>"))
    count = read.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    total, toxic = count[0], count[1] or 0
    if not toxic or toxic == total:
        return ToxicityModel(Restorer(logp), {}, math.log((toxic + 0.5) / (total - toxic + 0.5)))
    seen = read.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    share = toxic / total
    telling = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    told = {r["w"]: (r["t"], r["n"]) for r in seen.orderBy(F.desc(telling), "w").limit(vocabulary).collect()}
    vocab = sorted(told)
    at = {w: i for i, w in enumerate(vocab)}
    known = F.array(*map(F.lit, vocab)) if vocab else F.lit(None).cast("array<string>")
    rows = read.select("doc_id", "toxic", F.array_intersect("words", known).alias("w")).orderBy("doc_id").collect()
    weights, bias = fit_weights([([at[w] for w in r["w"] or []], r["toxic"]) for r in rows], len(vocab))
    kept = {w: float(x) for w, x in zip(vocab, weights) if x}
    for w, x in kept.items():  # a picked word that was met often enough counts alone for what it told alone
        t, n = told[w]
        if x > 0 and n >= SURE and t >= 0.9 * n:
            kept[w] = max(x, math.log((t + 0.5) / (n - t + 0.5)) - float(bias))
    lexicon = [w for w, x in kept.items() if x > 1 and not w.endswith("~")]
    return ToxicityModel(Restorer(language_model(with_lexicon(counts, lexicon)), frozenset(lexicon)), kept, float(bias))


def with_toxicity(docs: DataFrame, model: ToxicityModel, score: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 of the restored text; null and empty texts get that of no words."""
    parts = (model.restorer.logp, model.restorer.lexicon, model.weights, model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # character model and vocabulary: fixed bounds
    loaded: list[ToxicityModel] = []  # one for each task, so that spans already read are kept

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not loaded:
            logp, lexicon, weights, bias = shared.value
            loaded.append(ToxicityModel(Restorer(logp, lexicon), weights, bias))
        return pd.Series([loaded[0].score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    kept = [c for c in docs.columns if c != score]
    return docs.select(*kept, of("text").alias(score))


def held_out() -> Column:
    """Rows whose labels are kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every document.

    The text alone is scored, whole however long.  Null and empty texts get the
    score of a text without words; rows repeated are scored alike, a score of 0.5
    counts as toxic; an empty table gives no rows;
    other columns of ``docs`` are not read.  Without labels of both kinds the
    score is their share.
    """
    model = train(docs, labels.where(~held_out()), max_train)
    scored = with_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), model, "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
