"""Token-id files: an adaptive context-mixing range coder over whole corpora.

File format.  A token file is a table of blocks.  A block holds the ids of whole
or parts of documents in ascending order and is coded by itself: its model and
its coder start anew, and it carries a CRC-32 of its ids (little-endian unsigned
32-bit), so a damaged block is found and costs no other block.  The first block
of a part has 4,096 ids and each next one sixteen times as many, up to a million:
short parts keep several blocks, long ones get blocks that can be coded fast.

Model.  For each id, an order-2 and an order-1 context (the hash of the last two
ids, the last id) each predict one id with a confidence, and order 0 gives every id
a share by how often it has come.  The three are mixed with weights that depend on
both confidences and on whether the predictions agree, and that are learnt by
counting how often each order was right.  An id that the block has not had yet is
coded by order 0's share for new ids and by its sixteen bits.  All decisions drive
carry-less range coders.

A block is cut into streams of up to 512 ids, each with a coder of its own, which
go forward in lock step as lanes of numpy arrays.  All streams of a block share one
model, so it learns from all of them.  It stands still for a round of steps and then
learns what the round has brought: rounds of one step at first, of up to 64 later.
So writer and reader know the same, and tables are rebuilt a few times in a block.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, new_table, shuffle_partitions

#: Ids in the first block of a part, in the largest one, and how many times as many the next one has; documents in a block.
BLOCK, MOST, GROWTH, DOCS = 4096, 1 << 20, 16, 1 << 16
#: Ids in a stream, streams that are coded at once, and steps in a round at most.
STREAM, LANES, ROUND = 512, 2048, 64
#: Bits of an id, of the slots of a context's table, of a mixing weight, and of the sum of order 0's shares.
ID_BITS, SLOT_BITS, PBITS, CBITS = 16, 16, 12, 16
SLOTS = 1 << SLOT_BITS
#: Mixing weights: by confidence of order 2 (0 to 7) and of order 1, and by whether both predict the same.
MIXES = 128
#: The bounds of the coder's interval.
TOP, BOTTOM, WORD = 1 << 32, 1 << 28, np.uint64(32)
#: Bytes that a coded id may take at most: a word at each of two settlings.
ID_BYTES = 8

_HALF, _WEIGHT, _SHARE, _RAW = np.uint64(0xFFFFFFFF), np.uint64(PBITS), np.uint64(CBITS), np.uint64(ID_BITS)
_LOW, _ONE = np.uint32(65535), np.uint32(1 << 16)


class _Coder:
    """Range coders of many streams, without carries.

    The interval is (low, low + range) of 64 bits.  Its leading 32 bits go out
    once they are settled, or once the range has become too small, which is then
    cut so that they settle.  Between two calls of ``settle`` decisions may take
    28 bits; so each call moves a word at most.
    """

    def __init__(self, lanes: int, steps: int, data: bytes | None = None) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.code = np.zeros(lanes, np.uint64)
        self.reads = data is not None
        self.room = ID_BYTES // 4 * steps + 2
        if data is None:
            self.buf, self.at = np.zeros(lanes * self.room, np.uint32), np.arange(lanes) * self.room
        else:
            sizes = np.frombuffer(data, "<u2", lanes).astype(np.int64)
            self.buf = np.frombuffer(data, ">u4", offset=2 * lanes).astype(np.uint32)
            self.end = np.cumsum(sizes)
            self.at = self.end - sizes
            for _ in range(2):
                self.code = (self.code << WORD) | self._next(slice(None))

    def _next(self, lane: np.ndarray | slice) -> np.ndarray:
        """The next word of streams; behind their ends there are zeros."""
        at = self.at[lane]
        words = np.where(at < self.end[lane], self.buf.take(at, mode="clip"), 0)
        self.at[lane] = at + 1
        return words

    def settle(self, lane: slice | np.ndarray) -> None:
        low, width = self.low[lane], self.range[lane]
        out = np.flatnonzero(((low ^ (low + width)) < TOP) | (width < BOTTOM))
        if not len(out):
            return
        out = out + lane.start if isinstance(lane, slice) else lane[out]
        lo, w = self.low[out], self.range[out]
        w = np.where((lo ^ (lo + w)) >= TOP, (np.uint64(0) - lo) & np.uint64(BOTTOM - 1), w)
        if self.reads:
            self.code[out] = (self.code[out] << WORD) | self._next(out)
        else:
            at = self.at[out]
            self.buf[at] = lo >> WORD
            self.at[out] = at + 1
        self.low[out], self.range[out] = lo << WORD, w << WORD

    def raw(self, lane: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """Code sixteen bits of some streams, or find them."""
        self.settle(lane)
        unit = self.range[lane] >> _RAW
        if value is None:
            value = np.minimum((self.code[lane] - self.low[lane]) // unit, np.uint64((1 << ID_BITS) - 1))
        self.low[lane] += unit * value
        self.range[lane] = unit
        return value

    def finish(self) -> bytes:
        """How many words each stream has, and the words; where one suffices to end a stream, the other is left out."""
        self.settle(slice(0, len(self.low)))
        short = self.range >= TOP
        self.buf[self.at] = np.where(short, self.low + np.uint64(TOP - 1), self.low) >> WORD
        self.buf[self.at + 1] = self.low & _HALF
        sizes = self.at + 2 - short - np.arange(len(self.at)) * self.room
        used = np.arange(self.room) < sizes[:, None]
        return sizes.astype("<u2").tobytes() + self.buf.reshape(-1, self.room)[used].astype(">u4").tobytes()


class _Model:
    """What all streams of a block have taught so far; the same for writer and reader."""

    def __init__(self, streams: int, steps: int = 0) -> None:
        #: Ids by step, behind two rows of zeros.
        self.ids = np.zeros((steps + 2, streams), np.int64)
        #: Order 2, order 1: the predicted id, and above its sixteen bits its confidence (0 to 7).
        self.guess = np.zeros(2 * SLOTS, np.uint32)
        #: How often order 2 held, order 1 instead, neither; and the weight of order 2 and (upper half) of both together.
        self.held = np.zeros((MIXES, 3), np.int64)
        self.mix = np.zeros(MIXES, np.uint64)
        #: Order 0: counts of ids, the ids seen, each id's number among these (others: that of a new id), what number has a
        #: share's slot, and where (upper half) a number's share starts and how wide it is.
        self.count = np.zeros(1 << ID_BITS, np.int64)
        self.seen, self.symbol = 0, np.zeros(1, np.uint32)
        self.rank = np.zeros(1 << ID_BITS, np.int64)
        self.slot = np.zeros(1 << CBITS, np.uint16)
        self.part = np.array([1 << CBITS], np.uint64)

    def look(self, last2: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of both contexts, what stands there, the predicted ids, and which weights hold."""
        at2, at1 = (last * 40503 + last2 * 25173) & (SLOTS - 1), last + SLOTS
        k2, k1 = self.guess.take(at2, mode="clip"), self.guess.take(at1, mode="clip")
        g2, g1 = k2 & _LOW, k1 & _LOW
        mix = ((k2 >> np.uint32(16)) << np.uint32(4)) | ((k1 >> np.uint32(16)) << np.uint32(1)) | (g2 == g1)
        return at2, at1, k2, k1, g2, g1, mix.astype(np.int64)

    def learn(self, got: np.ndarray, looked: tuple[np.ndarray, ...]) -> None:
        """What the ids of a round teach, in the order of its steps."""
        at2, at1, k2, k1, g2, g1, mix = looked
        got32 = got.astype(np.uint32)
        right2, right1 = g2 == got32, g1 == got32
        # a right guess is trusted more, a wrong one less, and one that was little trusted gives way
        for at, known, guess, right in ((at2, k2, g2, right2), (at1, k1, g1, right1)):
            trust = known >> np.uint32(16)
            less = np.where(trust > 1, guess, got32) | ((trust >> np.uint32(1)) << np.uint32(16))
            self.guess[at] = np.where(right, known + (trust < 7) * _ONE, less)  # of several for a place the last one stays
        # weights: by what the last rounds have shown, where little is known by what all confidences have together
        self.held -= self.held >> 1
        self.held += np.bincount(3 * mix + np.where(right2, 0, 2 - right1.astype(np.int64)), minlength=3 * MIXES).reshape(MIXES, 3)
        alike, top = self.held.reshape(-1, 2, 3).sum(axis=0), (1 << PBITS) - 1
        usual = np.tile(2 * top * alike // (alike.sum(axis=1, keepdims=True) + 1), (MIXES // 2, 1))
        weight = (self.held * top + usual)[:, :2] // (self.held.sum(axis=1, keepdims=True) + 2)
        self.mix = (weight[:, 0] | weight.sum(axis=1) << 32).astype(np.uint64)
        # order 0: every id seen has a share, and new ones together have one by how many the round had
        more = np.bincount(got, minlength=1 << ID_BITS)
        new = int(more[self.count == 0].sum())
        self.count += more
        ids = np.flatnonzero(self.count)
        count, n = self.count[ids], len(ids)
        free = max(0, (1 << CBITS) - n - 1)
        escape = min(free // 2, free * new // len(got))
        share = 1 + count * (free - escape) // int(count.sum())
        left = (1 << CBITS) - int(share.sum())
        share[count.argmax()] += max(0, left - 1 - escape)
        share = np.append(share, min(left, 1 + escape))
        self.part = ((np.cumsum(share) - share) << 32 | share).astype(np.uint64)
        self.slot = np.repeat(np.arange(n + 1).astype(np.uint16), share)
        self.seen, self.symbol = n, np.append(ids, 0).astype(np.uint32)
        self.rank[:] = n
        self.rank[ids] = np.arange(n)

    def round(self, lo: int, hi: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Ids of some steps and what the model says before them."""
        last2, last, got = (self.ids[lo + i : hi + i].ravel() for i in range(3))
        return got, self.look(last2, last)


def _shape(n: int) -> tuple[int, int]:
    """Streams and steps of a block; the last streams may end in zeros that no one reads."""
    streams = -(-n // STREAM)
    return streams, -(-n // streams)


def _rounds(steps: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < steps:
        hi = min(lo + max(1, min(lo, ROUND)), steps)
        yield lo, hi
        lo = hi


def _lanes(streams: int) -> list[slice]:
    return [slice(lo, min(lo + LANES, streams)) for lo in range(0, streams, LANES)]


def _encode(ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    streams, steps = _shape(len(ids))
    m, coder = _Model(streams, steps), _Coder(streams, steps)
    m.ids[2:] = np.pad(ids, (0, streams * steps - len(ids))).reshape(streams, steps).T
    for lo, hi in _rounds(steps):
        got, looked = m.round(lo, hi)
        *_, g2, g1, mix = looked
        weight, rank = m.mix.take(mix), m.rank.take(got)
        part, w2, both = m.part.take(rank), weight & _HALF, weight >> WORD
        by2 = (g2 == got) & (w2 > 0)
        plain = ~(by2 | (g1 == got) & (both > w2))
        # where the order that gives the id starts among the three, how wide it is, and order 0's share of it
        start, wide = np.where(plain, both, np.where(by2, 0, w2)), np.where(by2, w2, both - w2)
        inner, share, new = np.where(plain, part >> WORD, 0), part & _HALF, plain & (rank == m.seen)
        start, wide, inner, share, plain, new, value = (x.reshape(hi - lo, streams) for x in (start, wide, inner, share, plain, new, got.astype(np.uint64)))
        any_new = new.any(axis=1)
        for lane in _lanes(streams):
            low, width = coder.low[lane], coder.range[lane]
            for t in range(hi - lo):
                coder.settle(lane)
                unit = width >> _WEIGHT
                at = unit * start[t, lane]
                low += at
                rest = (width - at) >> _SHARE
                low += rest * inner[t, lane]
                np.multiply(unit, wide[t, lane], out=width)
                np.copyto(width, rest * share[t, lane], where=plain[t, lane])
                if any_new[t]:
                    few = np.flatnonzero(new[t, lane]) + lane.start
                    coder.raw(few, value[t, few])
        m.learn(got, looked)
    return coder.finish()


def _decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint16)
    streams, steps = _shape(n)
    m, coder = _Model(streams, steps), _Coder(streams, steps, data)
    for lo, hi in _rounds(steps):
        for lane in _lanes(streams):
            low, width, code = coder.low[lane], coder.range[lane], coder.code[lane]
            for t in range(lo, hi):
                *_, g2, g1, mix = m.look(m.ids[t, lane], m.ids[t + 1, lane])
                weight = m.mix.take(mix, mode="clip")
                coder.settle(lane)
                unit = width >> _WEIGHT
                w2, both = unit * (weight & _HALF), unit * (weight >> WORD)
                at = code - low
                guessed, by2 = at < both, at < w2
                at -= both
                rest = (width - both) >> _SHARE
                rank = m.slot.take((at // rest).view(np.int64), mode="clip").astype(np.int64)  # of guessed ones any, not used
                part = m.part.take(rank, mode="clip")
                skip = rest * (part >> WORD)
                skip += both
                np.copyto(skip, w2, where=guessed)
                np.copyto(skip, 0, where=by2)
                low += skip
                np.multiply(rest, part & _HALF, out=width)
                both -= w2
                np.copyto(width, both, where=guessed)
                np.copyto(width, w2, where=by2)
                got = m.symbol.take(rank, mode="clip")
                np.copyto(got, g1, where=guessed)
                np.copyto(got, g2, where=by2)
                new = rank == m.seen
                new &= ~guessed
                if new.any():
                    few = np.flatnonzero(new)
                    got[few] = coder.raw(few + lane.start, None)
                m.ids[t + 2, lane] = got
        m.learn(*m.round(lo, hi))
    return m.ids[2:].T.ravel()[:n].astype(np.uint16)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code arrays of ids below 65536, each by itself."""
    return [_encode(b) for b in blocks]


def decode_blocks(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The arrays that ``encode_blocks`` has coded."""
    return [_decode(d, n) for d, n in zip(data, sizes)]


#: Signs that can end a word; behind letters they are a piece of their own in the vocabulary's splitting (an apostrophe may not be).
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Signs of a word's end at most, where it is looked up by itself; bytes of text whose words are looked up together.
ENDING, TEXT_BYTES = 8, 32 << 20

#: Letters that lower-casing and composition leave one for one (without those that are only look-alikes of letters).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Words of such letters and printable ASCII, where no apostrophe makes a piece of its own, and their pieces in lower case.
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]+")
_PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The splitting that the short cuts below are made for.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _byte_signs() -> dict[int, str]:
    """The signs by which byte-level vocabularies write bytes: visible ones stand for themselves."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in seen)}


def _lay_out(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` with numbers ``at``, one behind the other, and where each one starts and the last one ends."""
    offsets = np.append(0, 2 * np.cumsum(sizes))
    runs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    taken = runs.take(pa.array(at))
    bounds = np.frombuffer(taken.buffers()[1], np.int64, len(at) + 1) // 2
    return np.frombuffer(taken.buffers()[2] or b"", "<u2", int(bounds[-1])), bounds


def _runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts one behind the other, and how many each has."""
    return np.frombuffer(b"".join(parts), "<u2"), np.fromiter(map(len, parts), np.int64, len(parts)) // 2


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Pieces:
    """Ids, as bytes of 16-bit integers, of whole texts.

    The vocabulary's splitting never joins what white space parts, so a text's ids
    are those of its parts one after the other.  Texts are parted at ASCII's white
    space and each distinct part is encoded once.  Most are letters with signs
    behind them: the letters, in lower case, are one piece, which the library's
    model encodes without normalising and splitting it again; so are the pieces of
    other parts of Latin letters and ASCII.  All other parts, and all texts of a
    vocabulary with other steps, go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 1 << 19) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << ID_BITS:
            raise ValueError("ids must be below 65536")
        steps = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in steps["added_tokens"]]  # these are found in texts before any splitting
        self.parted = all(steps[k] == v for k, v in _STEPS.items()) and all(added) and not any(re.search(r"\s", t) for t in added)
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        self.apart = all(re.search(f"[{re.escape(SIGNS)}].*[A-Za-z]", t) for t in added)  # then letters with signs behind them hold none
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        self.known: dict[str, bytes] = {}
        self.most = most

    def _whole(self, texts: list[str]) -> list[bytes]:
        """By the whole tokenizer."""
        out: list[bytes] = []
        for lo in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces in lower case; beyond a bound what was known is given up first."""
        out = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        tokenize, number = self.model.tokenize, attrgetter("id")
        for i in new:
            piece = pieces[i]
            if len(self.known) >= self.most:
                self.known.clear()
            ids = self.known.get(piece)  # it may have come twice
            if ids is None:
                seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
                ids = self.known[piece] = array("H", map(number, tokenize(seen))).tobytes()
            out[i] = ids
        return out

    def _others(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are not letters with signs behind them."""
        out = [b"".join(self._pieces(_PIECE.findall(p.lower()))) if _PLAIN.fullmatch(p) and not self.added.search(p) else None for p in parts]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._whole([parts[i] for i in left])):
            out[i] = ids
        return out

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ids of distinct parts."""
        stems = pc.utf8_rtrim(parts, SIGNS)
        extra = pc.subtract(pc.binary_length(parts), pc.binary_length(stems))
        easy = pc.and_(pc.match_substring_regex(stems, f"^[{_LETTERS}]+$"), pc.less_equal(extra, ENDING))
        if not self.apart:
            easy = pc.and_not(easy, pc.match_substring_regex(parts, self.added.pattern))
        words = pc.utf8_lower(stems.filter(easy)).dictionary_encode()
        runs = self._pieces(_strings(words.dictionary))
        two = np.zeros((len(parts), 2), np.int64)
        easy, extra = easy.to_numpy(zero_copy_only=False), extra.to_numpy()
        two[easy, 0] = words.indices.to_numpy()
        two[:, 1] = len(runs)
        runs.append(b"")
        for n in range(1, ENDING + 1):
            some = np.flatnonzero(easy & (extra == n))
            if len(some):
                ends = pc.utf8_slice_codeunits(parts.take(pa.array(some)), -n).dictionary_encode()
                two[some, 1] = len(runs) + ends.indices.to_numpy()
                runs += self._pieces(ends.dictionary.to_pylist())
        others = _strings(parts.filter(pa.array(~easy)))
        two[~easy, 0] = len(runs) + np.arange(len(others))
        flat, bounds = _lay_out(*_runs(runs + self._others(others)), two.ravel())
        return flat, np.diff(bounds[::2])

    def encode_all(self, texts: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one behind the other, each with ``tail`` behind it, and where each one ends."""
        texts, n = pc.fill_null(texts, ""), len(texts)
        if not self.parted:
            flat, sizes = _runs([ids + tail for ids in self._whole(texts.to_pylist())])
            return flat, np.cumsum(sizes)
        cut_up = pc.ascii_split_whitespace(texts)
        stream = cut_up.flatten().dictionary_encode()
        flat, sizes = self._distinct(stream.dictionary)
        last = np.cumsum(cut_up.value_lengths().to_numpy().astype(np.int64) + 1)
        at = np.full(len(stream) + n, len(sizes))
        is_part = np.ones(len(at), bool)
        is_part[last - 1] = False
        at[is_part] = stream.indices.to_numpy()
        end = np.frombuffer(tail, "<u2")
        flat, bounds = _lay_out(np.concatenate([flat, end]), np.append(sizes, len(end)), at)
        return flat, bounds[last]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def _tokenize(path: str, end_id: int):
    """Ids of each text, with the end id, as bytes of 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tail = _Pieces(path), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TEXT_BYTES, side="right")))
                some = batch.slice(lo, hi - lo)
                ids, ends = pieces.encode_all(some.column(1), tail)
                if 2 * len(ids) >= 1 << 31:  # more than a binary column can point to; only a single text can come to that
                    raise OverflowError("the ids of a text take more than 2 GB")
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), coded], ["doc_id", "part", "ids"])
                lo = hi

    return run


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, sorted by part and doc_id, to blocks.  A block names its documents and their ids in it."""
    part, number = None, 0
    ids: list[np.ndarray] = []
    docs: list[tuple[int | None, int, bool]] = []
    room = BLOCK

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal ids, docs, room, number
        if docs:
            own = np.concatenate(ids)
            row = {"part": part, "block": number, "doc_ids": [d[0] for d in docs], "counts": [d[1] for d in docs], "last": [d[2] for d in docs]}
            yield pa.RecordBatch.from_pylist([row | {"ids_crc32": zlib.crc32(own.astype("<u4").tobytes()), "payload": encode_blocks([own])[0]}], schema=BLOCK_ARROW)
            number += 1
        ids, docs, room = [], [], min(BLOCK * GROWTH**number, MOST)

    for batch in batches:
        for doc, p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != part:
                yield from close()
                part, number, room = p, 0, BLOCK
            own = np.frombuffer(raw.as_buffer(), "<u2")
            at = 0
            while at < len(own):
                take = min(room, len(own) - at)
                ids.append(own[at : at + take])
                docs.append((doc, take, at + take == len(own)))
                at += take
                room -= take
                if not room or len(docs) == DOCS:
                    yield from close()
    yield from close()


BLOCK_SCHEMA = "part int, block long, doc_ids array<long>, counts array<int>, last array<boolean>, ids_crc32 long, payload binary"
BLOCK_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("last", pa.list_(pa.bool_())), ("ids_crc32", pa.int64()), ("payload", pa.binary())]
)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None) -> None:
    """Write the ids of all documents to ``path``, in ascending ``doc_id`` order.

    Each text is encoded whole (null: empty) without special tokens and gets
    ``end_id``.  Parts follow one another by ``doc_id``: their bounds are quantiles
    of doc_id, so a part is a bounded piece of the file; rows of equal doc_id share
    a part, in the order of their ids' checksum; null comes first.  Very long texts
    go over as many blocks as they need.  An empty table writes an empty file;
    other columns are not read.  A vocabulary with ids from 65,536 on raises an
    error.
    """
    spark = docs.sparkSession
    n = parts or 4 * shuffle_partitions(spark)
    bounds = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = sorted({int(b) for b in bounds})
    part = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    coded = docs.select("doc_id", "text", part.cast("int").alias("part")).mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, part int, ids binary")
    sorted_rows = coded.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "doc_id", F.crc32("ids"))
    # a row takes up to a megabyte, so the writer looks at what it holds behind every few
    options = {"compression": "none", "parquet.page.size.row.check.min": 4, "parquet.block.size": 32 << 20}
    sorted_rows.mapInArrow(_write_blocks, BLOCK_SCHEMA).write.options(**options).parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """For each block part, block, piece, doc_id, n and last of its pieces, their ends, and all ids (32-bit)."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i] for name in batch.schema.names}
            part, block, counts = r["part"].as_py(), r["block"].as_py(), r["counts"].values
            ends, n = np.cumsum(counts.to_numpy()), len(counts)
            ids = decode_blocks([r["payload"].as_py()], [int(ends[-1])])[0].astype("<u4")
            if zlib.crc32(ids) != r["ids_crc32"].as_py():
                raise ValueError(f"block {block} of part {part} is damaged")
            place = [np.full(n, part, np.int32), np.full(n, block, np.int64), np.arange(n, dtype=np.int32)]
            yield [*map(pa.array, place), r["doc_ids"].values, counts, r["last"].values], ends, ids


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, ends, ids in _decoded(batches):
        offsets = np.append(0, 2 * ends).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
        yield pa.RecordBatch.from_arrays([*columns, own], schema=PIECE_ARROW)


def _read_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the checksum of their ids, where they are whole documents for certain, else with the ids."""
    for columns, ends, ids in _decoded(batches):
        crc, own = [], []
        for i, (lo, hi, last) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), columns[5].to_pylist())):
            whole = i > 0 and last
            crc.append(zlib.crc32(ids[lo:hi]) if whole else None)
            own.append(None if whole else ids[lo:hi].astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary()), pa.array(crc, pa.int64())], schema=SUM_ARROW)


PIECE_SCHEMA = "part int, block long, piece int, doc_id long, n int, last boolean, ids binary"
PIECE_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("last", pa.bool_()), ("ids", pa.binary())])
SUM_SCHEMA, SUM_ARROW = PIECE_SCHEMA + ", crc long", PIECE_ARROW.append(pa.field("crc", pa.int64()))


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents from a token file: part, block, piece (their order), doc_id, n, last, ids (16-bit, little-endian).

    A document that crosses blocks has several pieces; ``last`` marks its end.  A
    block whose checksum does not hold raises an error.
    """
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_read_blocks, PIECE_SCHEMA)


def _join_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from pieces in order: crc32 runs on over pieces, documents of several blocks are never held."""
    crc, n, start = 0, 0, None
    for batch in batches:
        out: dict[str, list] = {"part": [], "first_block": [], "first_piece": [], "doc_id": [], "n_tokens": [], "ids_crc32": []}
        c = batch.to_pydict()
        for part, block, piece, doc, m, last, ids, whole in zip(*(c[k] for k in ("part", "block", "piece", "doc_id", "n", "last", "ids", "crc"))):
            start = start or (block, piece)
            crc, n = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"), crc) if whole is None else whole, n + m
            if last:
                for key, v in zip(out, (part, *start, doc, n, crc)):
                    out[key].append(v)
                crc, n, start = 0, 0, None
        yield pa.RecordBatch.from_pydict(out, schema=DOC_ARROW)


DOC_ARROW = pa.schema([("part", pa.int32()), ("first_block", pa.int64()), ("first_piece", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document of a token file.

    Ids are summed up where their block is decoded; only those of documents that may cross blocks are moved.
    """
    pieces = spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_read_sums, SUM_SCHEMA)
    ordered = pieces.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "block", "piece")
    each = cut(ordered.mapInArrow(_join_crc, "part int, first_block long, first_piece int, doc_id long, n_tokens long, ids_crc32 long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.groupBy("part").agg(F.sum("n_tokens").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("first_block", "first_piece").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumn("run", F.sum("n_tokens").over(inside)).join(F.broadcast(bases), "part")  # a row for each part
    return summed.select("doc_id", (F.col("base") + F.col("run") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a token file of ``docs`` to the shared folder and give its digest."""
    path = new_table(docs.sparkSession, "ids")
    write_token_file(docs, path, tokenizer, end_id)
    return token_digest(docs.sparkSession, path)
