"""Problem 5: text that was decoded with a wrong encoding, found and restored by a hidden Markov model.

States: one clean state and one per pair of encodings (the one the bytes were in, the one they were read as), and one
for characters that were lost (replacement characters and what stands between them). What a state emits is scored by
one character bigram model of clean text: the clean state by the characters as they are, a pair's state by what the
inverse transform of that pair makes of them. Entering and leaving a pair's state costs a fixed amount. The Viterbi
path labels each character, and each labelled span gets its state's inverse transform.

The bigram model is fitted on all rows, without texts that are plainly damaged; the first model labels all rows, and the
texts it finds damaged are left out of the second. The pairs of neighbours are counted on the executors; the driver gets
one row a distinct pair. In a larger table the counts weigh as those of TRAIN_ROWS rows with the same shares would, so that
damage which no model finds doesn't become usual by its mere number, and a pair counts once less than it stands there, so
that no text speaks for its own damage. A text in which every pair of neighbouring characters is a usual one
stays in the clean state without a Viterbi run. Runs are vectorised over batches of texts. Only states in which a stay
gains something take part, and a text without any isn't damaged: whether a text is damaged is known without its path.

Glyphs are labelled in the order in which they stand on their page, so that a damaged letter is seen in its word. Their
restored texts come out as those of chunks do.

Defined results: null gives null and is no case; empty texts are clean; a record delivered twice counts once; glyphs
without a page are taken in stretches of their order; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.llm.p2_forms import LOOKS
from folio.llm.rolling import code_points
from folio.session import table

#: Rows from which on the counts of all rows are scaled down to this many.
TRAIN_ROWS = 8_000
#: Costs (negative log probabilities) of entering and of leaving a pair's state.
ENTER, LEAVE = 8.0, 3.0
#: The same for pairs of one-byte encodings, whose single characters prove less than a valid sequence of bytes does.
ENTER_ONE = 11.0
#: A pair of neighbours is usual from this log probability on.
USUAL = -9.5
#: Vertical distance, in points, from which two glyphs stand on different lines.
LINE = 3.0
#: Distance, in points along either axis, up to which a glyph counts as printed over another.
OVER = 1.0
FLOOR = -20.0
#: Gains up to which a state is looked at again step by step (they are sums of rounded numbers).
TIE = 1e-3
#: Code points of the texts that are labelled at once (about 800 bytes each); a longer text is labelled alone.
BATCH = 120_000
#: Places in the order of glyphs without a page that are looked at together.
STRETCH = 4_096
#: Characters in the square of scores (4 bytes a pair of them), and places of the largest square in which pairs are counted.
GRID, SQUARE = 2_048, 8_000_000
#: Scores of a character that only looks like another (problem 2), of the one after it, and of a capital after a small letter.
DISGUISE, AFTER_DISGUISE, CAPITAL = -5.0, -4.0, -7.0
# Encodings as Python names them. UTF-8 read as one of these:
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r")
# One-byte encodings (in, read as).
CONFUSED = (
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp437", "cp1252"),
    ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1253", "cp1252"), ("cp1256", "cp1252"), ("cp874", "cp1252"), ("cp1251", "mac_roman"), ("mac_cyrillic", "cp1251"),
)
# Two-byte encodings read as Western text.
TWO_BYTES = ("gbk", "cp932", "big5", "euc_kr")
# Two-byte encodings as which UTF-8 is read.
WIDE = ("gbk", "cp932")
LOST = 0xFFFD
# Ranges of characters that look like others or like nothing, wherever they stand.
DISGUISES = ((0xA0, 0xA0), (0xAD, 0xAD), (0x300, 0x36F), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2E80, 0x2FDF), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFEFF, 0xFEFF), (0xFF01, 0xFF9F))


def _small() -> np.ndarray:
    """By code point below 0x10000: the small letter of a capital, a space for a line break, else the character itself."""
    out = np.arange(0x10000)
    for k in range(0x10000):
        if not 0xD800 <= k < 0xE000 and len(low := chr(k).lower()) == 1 and ord(low) < 0x10000:
            out[k] = ord(low)
    out[10] = 32  # a line may begin with what stands after a space elsewhere
    return out


SMALL = _small()
HAS_CAPITAL = np.zeros(0x10000, bool)
HAS_CAPITAL[SMALL[SMALL != np.arange(0x10000)]] = True
LOOK_ALIKE = np.zeros(0x10000, bool)
LOOK_ALIKE[[ord(c) for cs in LOOKS.values() for c in cs]] = True
ALWAYS_DISGUISE = np.zeros(0x10000, bool)
for _a, _b in DISGUISES:
    ALWAYS_DISGUISE[_a : _b + 1] = True


def small_letter(codes: np.ndarray) -> np.ndarray:
    """Small letters that have a capital."""
    return HAS_CAPITAL[np.where(codes < 0x10000, codes, 0)]


def disguised(codes: np.ndarray) -> np.ndarray:
    """Which characters of a text are disguises: always, or look-alikes in a run of letters that holds an ASCII letter."""
    low = np.where(codes < 0x10000, codes, 0)
    before = np.concatenate([[10], codes[:-1]])
    latin = ((codes | 32) >= 97) & ((codes | 32) <= 122)
    looks = LOOK_ALIKE[low]
    run = np.cumsum(~(latin | looks))
    mixed = np.bincount(run, latin) > 0
    # a no-break space or soft hyphen may be the second half of a damaged letter
    half = ((codes == 0xA0) | (codes == 0xAD)) & (before >= 0xC0) & (before < 0x500)
    return (ALWAYS_DISGUISE[low] & ~half) | (looks & mixed[run])


def small(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0x10000, SMALL[np.where(codes < 0x10000, codes, 0)], codes)


def _to_byte(encoding: str) -> np.ndarray:
    """By code point below 0x10000: the byte that is read as it in the encoding, -1 if none. Bytes that Western code
    pages leave open are read as control characters."""
    out = np.full(0x10000, -1, np.int16)
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
        if encoding == "cp1252" or (b < 0xA0 and encoding.startswith("cp125")):
            if out[b] < 0:
                out[b] = b
    return out


@dataclass
class Units:
    """What a state makes of a text: at each place where a unit begins, its length and one or two restored code points."""

    size: np.ndarray
    first: np.ndarray
    second: np.ndarray = field(default=None)


def _utf8_units(b: np.ndarray) -> Units:
    """Units of an array of bytes (-1: none), one byte a character."""
    n = len(b)
    pad = np.concatenate([b, np.full(3, -1, b.dtype)]).astype(np.int64)
    b0, b1, b2, b3 = (pad[k : k + n] for k in range(4))
    tail = lambda x: (x >= 0x80) & (x < 0xC0)
    two = (b0 >= 0xC2) & (b0 < 0xE0) & tail(b1)
    three = (b0 >= 0xE0) & (b0 < 0xF0) & tail(b1) & tail(b2)
    four = (b0 >= 0xF0) & (b0 < 0xF5) & tail(b1) & tail(b2) & tail(b3)
    code = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
    good = (two & (code >= 0x80)) | (three & (code >= 0x800) & ((code < 0xD800) | (code > 0xDFFF))) | (four & (code >= 0x10000) & (code < 0x110000))
    size = np.where(good, np.where(two, 2, np.where(three, 3, 4)), 0)
    return Units(size, np.where(good, code, 0))


class Pairs:
    """The states' inverse transforms, vectorised over an array of code points."""

    def __init__(self):
        self.names: list[tuple[str, str]] = [("utf-8", x) for x in READ_AS] + list(CONFUSED) + [(x, "cp1252") for x in TWO_BYTES] + [("utf-8", x) for x in WIDE] + [("lost", "lost")]
        self.byte = {x: _to_byte(x) for x in {y for _, y in self.names if y not in (*WIDE, "lost")}}
        self.single = {}
        for true, read in CONFUSED:
            lut = np.zeros(0x10000, np.int64)
            for c in np.flatnonzero(self.byte[read] >= 0):
                try:
                    lut[c] = ord(bytes([self.byte[read][c]]).decode(true))
                except UnicodeDecodeError:
                    pass
            lut[lut == np.arange(0x10000)] = 0
            self.single[true, read] = lut
        self.double = {}
        for true in TWO_BYTES:
            lut = np.zeros(0x10000, np.int64)
            for a in range(0x81, 0xFF):
                for b in range(0x40, 0xFF):
                    try:
                        c = bytes([a, b]).decode(true)
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        lut[a << 8 | b] = ord(c)
            self.double[true] = lut
        #: By encoding: first and second byte of a code point's code; the second is 0 for a code of one byte.
        self.wide = {}
        for read in WIDE:
            first, second = np.zeros(0x10000, np.int64), np.zeros(0x10000, np.int64)
            lut = self.double[read]
            of = np.flatnonzero(lut > 0)
            first[lut[of]], second[lut[of]] = of >> 8, of & 255
            for b in range(128, 256):
                try:
                    first[ord(bytes([b]).decode(read))] = b
                except UnicodeDecodeError:
                    pass
            self.wide[read] = first, second

    def units(self, state: int, codes: np.ndarray) -> Units:
        true, read = self.names[state]
        low = np.where(codes < 0x10000, codes, 0)
        n = len(codes)
        if read == "lost":
            return Units(((codes == LOST) | ((codes >= 0x80) & (codes < 0xA0))).astype(np.int64), codes)
        if read in self.wide:
            b1, b2 = (np.concatenate([x[low], np.zeros(3, np.int64)]) for x in self.wide[read])
            at = lambda x, k: x[k : k + n]
            tail = lambda x: (x >= 0x80) & (x < 0xC0)
            join = lambda x, y, z: (x & 15) << 12 | (y & 63) << 6 | z & 63
            double = [at(b2, k) > 0 for k in range(3)]
            head = double[0] & (at(b1, 0) >= 0xE0) & (at(b1, 0) < 0xF0) & tail(at(b2, 0))
            code = join(at(b1, 0), at(b2, 0), at(b1, 1))
            good = head & tail(at(b1, 1)) & (code >= 0x800) & ((code < 0xD800) | (code > 0xDFFF))
            # a unit's bytes may end with a one-byte character, within one that swallowed an ASCII character, or after three
            three = good & ~double[1] & (at(b1, 1) > 0)
            six = good & double[1] & double[2] & (at(b2, 1) >= 0xE0) & (at(b2, 1) < 0xF0) & tail(at(b1, 2)) & tail(at(b2, 2))
            four = good & double[1] & ~six & (at(b2, 1) >= 0x40) & (at(b2, 1) < 0x7F)
            two = double[0] & (at(b1, 0) >= 0xC3) & (at(b1, 0) < 0xE0) & tail(at(b2, 0))
            size = np.where(six, 3, np.where(four | three, 2, np.where(two, 1, 0)))
            return Units(size, np.where(two, (at(b1, 0) & 31) << 6 | at(b2, 0) & 63, code), np.where(six, join(at(b2, 1), at(b1, 2), at(b2, 2)), np.where(four, at(b2, 1), 0)))
        if true == "utf-8":
            return _utf8_units(self.byte[read][low])
        if (true, read) in self.single:
            to = self.single[true, read][low]
            return Units((to > 0).astype(np.int64), to)
        b = self.byte["cp1252"][low].astype(np.int64)
        b = np.where((b < 0) & (codes >= 0x40) & (codes < 0x7F) & (true != "gbk"), codes, b)
        high = b >= 0x81
        begins = high & ~np.concatenate([[False], high[:-1]])
        place = np.arange(n)
        since = place - np.maximum.accumulate(np.where(begins, place, 0))
        follow = np.concatenate([b[1:], [-1]])
        to = np.where(high & (since % 2 == 0) & (follow >= 0x40), self.double[true][(np.maximum(b, 0) << 8 | np.maximum(follow, 0)) & 0xFFFF], 0)
        return Units(np.where(to > 0, 2, 0), to)


class Bigrams:
    """Log probabilities of a character after another, with unigram back-off."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, weight: float = 1.0, backed: float = 4.0):
        # each character but the last line break is the first of a pair
        self.chars, owner = np.unique(np.append(pairs >> 21, SMALL[10]), return_inverse=True)
        counts = counts * weight
        n = np.bincount(owner, np.append(counts, weight))
        self.single = np.log((n + 0.0) / (n.sum() + 1000.0))
        self.total, self.backed = n, backed
        prob = np.exp(self._one(pairs & 0x1FFFFF))
        if weight < 1:  # one of the places may be the very one that is judged
            counts = counts - weight
            seen = counts > weight / 2
            pairs, counts, prob = pairs[seen], counts[seen], prob[seen]
        self.pairs = pairs
        self.score = np.log((counts + backed * prob) / (self._count(pairs >> 21) + backed))
        self._grid: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):  # the grid is made where it is used
        return self.__dict__ | {"_grid": None}

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """The same scores of the most frequent characters as a square, for looking up without a search: the place of a
        character by code point (-1: none), and the scores by place of the character before and its own."""
        if self._grid is None:
            usual = np.sort(np.argsort(-self.total, kind="stable")[:GRID])
            usual = usual[self.chars[usual] < 0x10000]
            place = np.full(0x10000, -1, np.int64)
            place[self.chars[usual]] = np.arange(len(usual))
            back = np.log(self.backed / (self.total[usual] + self.backed))
            scores = np.maximum(back[:, None] + self.single[usual][None, :], FLOOR)
            first, second = (self.pairs >> 21), (self.pairs & 0x1FFFFF)
            low = (first < 0x10000) & (second < 0x10000)
            a, b = place[np.where(low, first, 0)], place[np.where(low, second, 0)]
            both = low & (a >= 0) & (b >= 0)
            scores[a[both], b[both]] = self.score[both]
            self._grid = place, scores.astype(np.float32)
        return self._grid

    def _find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return k, table[k] == keys

    def _one(self, codes: np.ndarray) -> np.ndarray:
        k, known = self._find(self.chars, codes)
        return np.where(known, self.single[k], FLOOR)

    def _count(self, codes: np.ndarray) -> np.ndarray:
        k, known = self._find(self.chars, codes)
        return np.where(known, self.total[k], 0)

    def of(self, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        raw, raw_before = codes.astype(np.int64), before.astype(np.int64)
        before, codes = small(raw_before), small(raw)
        place, scores = self.grid()
        a, b = (place[np.where(x < 0x10000, x, 0)] for x in (before, codes))
        out = scores[a, b].astype(np.float64)
        rest = np.flatnonzero((a < 0) | (b < 0) | (before > 0xFFFF) | (codes > 0xFFFF))
        if len(rest):
            k, known = self._find(self.pairs, before[rest] << 21 | codes[rest])
            backed = np.maximum(np.log(self.backed / (self._count(before[rest]) + self.backed)) + self._one(codes[rest]), FLOOR)
            out[rest] = np.where(known, self.score[k], backed)
        # a capital inside a word whose letter before it is small
        return out + CAPITAL * ((codes != raw) & (before == raw_before) & (before > 0x60) & (small_letter(raw_before)))

    def clean(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The scores of some places of a text as clean text, in which look-alike characters are allowed for."""
        before = np.concatenate([[10], codes[:-1]])
        mark = disguised(codes)
        prior = np.concatenate([[False], mark[:-1]])[at]
        out, own = self.of(before[at], codes[at]), mark[at]
        out = np.where(own, np.maximum(out, DISGUISE), out)
        return np.where(prior & ((codes[at] < 128) | own), np.maximum(out, AFTER_DISGUISE), out)


@dataclass
class Scores:
    """A batch of texts for the hidden Markov model: the code points near units and where they stand among all, where the
    texts begin, and on the places at which states differ (``first``: a text's first) what clean text and each of the
    states that begin somewhere emit, and how much a text's best stay in each state gains."""

    codes: np.ndarray
    near: np.ndarray
    starts: np.ndarray
    spots: np.ndarray
    first: np.ndarray
    clean: np.ndarray
    states: list[int]
    emits: list[np.ndarray]
    begins: list[np.ndarray]
    units: list[Units]
    gain: np.ndarray


class Model:
    """The hidden Markov model: bigrams of clean text and the states of the pairs."""

    def __init__(self, bigrams: Bigrams):
        self.bigrams = bigrams
        self.pairs = _pairs()

    def doubtful(self, texts: list[str]) -> np.ndarray:
        """Which texts hold an unusual pair of neighbours, one of them not ASCII."""
        out = np.zeros(len(texts), bool)
        codes, owner = _joined(texts)
        if not len(codes):
            return out
        before = np.concatenate([[10], codes[:-1]])
        at = np.flatnonzero((codes > 127) | (before > 127))
        rare = at[self.bigrams.clean(codes, at) < USUAL]
        out[owner[rare]] = True
        return out

    def label(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """For each text: the restored text and, by code point, whether it is damaged."""
        out = []
        for text, parts in zip(texts, self.parts(texts)):
            damaged, pieces, k = np.zeros(len(text), bool), [], 0
            for at, size, unit in parts:
                damaged[at : at + size] = True
                pieces.append(text[k:at] + unit)
                k = at + size
            out.append(("".join(pieces) + text[k:], damaged))
        return out

    def parts(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text: its damaged units in order, as places, lengths and what they are restored to."""
        out = [[] for _ in texts]
        for take in self._batches(texts):
            for k, parts in self._paths([texts[k] for k in take], self._scores([texts[k] for k in take])):
                out[take[k]] = parts
        return out

    def damaged(self, texts: list[str]) -> np.ndarray:
        """Which texts hold damaged characters, without their paths."""
        out = np.zeros(len(texts), bool)
        for take in self._batches(texts):
            out[take] = self._scores([texts[k] for k in take]).gain.max(0) > 0
        return out

    def _batches(self, texts: list[str]):
        """The places of the doubtful texts, in batches of texts of about one length."""
        todo = sorted(np.flatnonzero(self.doubtful(texts)).tolist(), key=lambda k: -len(texts[k]))
        while todo:
            take, size = [], 0
            while todo and (not take or size + len(texts[todo[-1]]) < BATCH):
                size += len(texts[todo[-1]])
                take.append(todo.pop())
            yield take

    def _scores(self, texts: list[str]) -> Scores:
        """What clean text and each state emit, on the places of some texts at which they differ.

        Characters that are neither near one that isn't ASCII nor part of a unit are left out first."""
        codes = code_points("\n" + "\n".join(texts) + "\n").astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(np.concatenate([[1], lengths[:-1] + 1]))
        high = np.concatenate([np.zeros(3, bool), codes > 127, [False]])
        # a unit has at most four characters and begins with one that isn't ASCII; the one before it tells how it begins
        near = high[3:-1] | high[4:] | high[2:-2] | high[1:-3] | high[:-4]
        near[0] = True
        kept = np.flatnonzero(near)
        seen = high[3:-1] | high[2:-2]
        clean = np.zeros(len(codes))
        clean[seen] = self.bigrams.clean(codes, np.flatnonzero(seen))
        seen[starts + lengths] = False  # the line breaks between the texts
        codes, clean, seen = codes[kept], clean[kept], seen[kept]
        place = np.arange(len(codes))
        costly = clean - 1.0 * (codes > 127)
        lost = len(self.pairs.names) - 1
        states, emits, begins, units = [], [], [], []
        for s in range(len(self.pairs.names)):
            u = self.pairs.units(s, codes)
            begin = np.zeros(len(codes), bool)
            if s == lost:
                begin = (u.size > 0) | (codes > 0xFF) & (np.concatenate([codes[1:], [0]]) == LOST)
                emit = np.where(codes == LOST, -1.0, np.where(u.size > 0, -6.0, np.where(codes > 127, -9.0, clean)))
            else:
                at = np.flatnonzero(u.size)
                if not len(at):
                    continue
                inside = np.zeros(len(codes) + 4, bool)
                for k in range(1, int(u.size.max())):
                    inside[at[u.size[at] > k] + k] = True
                inside = inside[: len(codes)]
                at = at[~inside[at]]
                # the text as this state restores it, on the places where its units begin
                shown = np.where(inside, 0, codes)
                shown[at] = u.first[at]
                tail = shown
                if u.second is not None:
                    tail = shown.copy()
                    tail[at] = np.where(u.second[at] > 0, u.second[at], u.first[at])
                begin[at] = True
                follows = np.concatenate([[False], (begin | inside)[:-1]])
                need = np.flatnonzero((begin | follows) & ~inside)
                prev = np.maximum(need - 1, 0)
                if inside.any():
                    prev = np.maximum.accumulate(np.where(inside, 0, place))[prev]
                emit = np.where(inside, 0.0, costly)
                emit[need] = self.bigrams.of(tail[prev], shown[need])
                if u.second is not None:
                    two = at[u.second[at] > 0]
                    emit[two] += self.bigrams.of(u.first[two], u.second[two])
            states.append(s)
            emits.append(emit[seen])
            begins.append(begin[seen])
            units.append(u)
        spots = kept[seen]
        first = np.searchsorted(spots, starts)
        return Scores(codes, near, starts, spots, first, clean[seen], states, emits, begins, units, self._gain(first, clean[seen], states, emits, begins))

    def _cost(self, states: list[int]) -> np.ndarray:
        return np.array([ENTER_ONE if self.pairs.names[s] in self.pairs.single else ENTER for s in states])

    def _gain(self, first, clean, states, emits, begins) -> np.ndarray:
        """By state and text: by how much the best stay in the state beats the clean state. The best path holds only
        stays that gain something, as the clean state is at least as good for the others."""
        counts = np.diff(np.append(first, len(clean)))
        owner = np.repeat(np.arange(len(first)), counts)
        end = first + counts - 1
        out = np.zeros((len(states), len(first)))
        for row, cost, emit, begin in zip(out, self._cost(states), emits, begins):
            more = emit - clean
            total = np.cumsum(more)
            total -= (total - more)[first][owner]
            # the least sum before a begin so far; the shift keeps texts apart
            shift = owner * (2 * np.abs(total).max() + np.abs(more).max() + 1e4)
            least = np.minimum.accumulate(np.where(begin, total - more, 5e3 + np.abs(total).max()) - shift) + shift
            gain = total - least - LEAVE
            gain[end] += LEAVE  # a text may end in a state
            row[:] = np.maximum.reduceat(gain, first) - cost
        return out

    def _paths(self, texts: list[str], scores: Scores):
        """The place of each text of a batch that is damaged, with its damaged units, by the best path, one step of all
        texts at a time. Places where all states emit the same (plain ASCII) are skipped."""
        able = scores.gain > -TIE
        which = np.flatnonzero(able.any(0))
        if not len(which):
            return
        used = np.flatnonzero(able.any(1))
        names = [scores.states[s] for s in used]
        rows, n_states = len(which), len(used)
        counts = np.diff(np.append(scores.first, len(scores.spots)))[which]
        steps = counts.max()
        # behind the last place every state emits 0 and nothing begins there
        emit = np.array([np.append(scores.emits[s], 0.0) for s in used])
        begin = np.array([np.append(scores.begins[s], False) for s in used])
        clean = np.append(scores.clean, 0.0)
        grid = np.full((rows, steps), len(scores.spots))
        for k, (f, n) in enumerate(zip(scores.first[which], counts)):
            grid[k, :n] = np.arange(f, f + n)
        cost = self._cost(names)[:, None]
        v0 = np.zeros(rows)
        v = np.full((n_states, rows), -1e9)
        entered = np.zeros((steps, n_states, rows), bool)
        left = np.full((steps, rows), -1, np.int8)
        for t in range(steps):
            at = grid[:, t]
            best = v.argmax(0)
            top = v[best, np.arange(rows)] - LEAVE
            leave = top > v0
            root = np.where(leave, top, v0)
            enter = np.where(begin[:, at], root - cost, -1e9)
            entered[t] = enter > v
            v = np.maximum(v, enter) + emit[:, at]
            left[t] = np.where(leave, best, -1)
            v0 = root + clean[at]
        end = v.argmax(0)
        place = np.cumsum(scores.near) - 1
        for k, text in enumerate(which.tolist()):
            state = int(end[k]) if v[end[k], k] > v0[k] else -1
            labels = []
            for t in range(counts[k] - 1, -1, -1):
                if state >= 0:
                    labels.append((int(scores.spots[grid[k, t]]), state))
                    if entered[t, state, k]:
                        state = int(left[t, k])
                else:
                    state = int(left[t, k])
            if labels:
                yield text, self._apply(texts[text], int(scores.starts[text]), [(p, int(place[p]), names[s], scores.units[used[s]]) for p, s in reversed(labels)], scores.codes)

    def _apply(self, text: str, start: int, labels: list[tuple[int, int, int, Units]], codes: np.ndarray) -> list[tuple[int, int, str]]:
        """The units that the labelled states make of a text; labels are places among all code points of the batch and
        among those kept, states and their units."""
        out, k, lost = [], 0, len(self.pairs.names) - 1
        for p, q, s, u in labels:
            at, size = p - start, int(u.size[q])
            if at < k:
                continue
            if s == lost:
                if codes[q] > 127:
                    out.append((at, 1, text[at]))
            elif size:
                second = u.second is not None and u.second[q]
                out.append((at, size, chr(int(u.first[q])) + (chr(int(second)) if second else "")))
                k = at + size
        return out


_made: list[Pairs] = []


def _pairs() -> Pairs:
    if not _made:
        _made.append(Pairs())
    return _made[0]


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours in some texts, with line breaks around each text, and how often they stand there."""
    codes = small(code_points("\n" + "\n".join(texts) + "\n").astype(np.int64))
    if codes.max() < 0x10000:
        chars = np.flatnonzero(np.bincount(codes, minlength=1))
        if len(chars) ** 2 <= SQUARE:  # counting in a square is cheaper than sorting
            place = np.zeros(chars[-1] + 1, np.int64)
            place[chars] = np.arange(len(chars))
            at = place[codes]
            n = np.bincount(at[:-1] * len(chars) + at[1:])
            seen = np.flatnonzero(n)
            return chars[seen // len(chars)] << 21 | chars[seen % len(chars)], n[seen]
    return np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts that aren't plain ASCII, a line break behind each, and whose text they are."""
    some = [k for k, t in enumerate(texts) if not t.isascii()]
    codes = code_points("".join(texts[k] + "\n" for k in some)).astype(np.int64)
    return codes, np.repeat(np.array(some, np.int64), [len(texts[k]) + 1 for k in some])


def _plain(texts: list[str]) -> np.ndarray:
    """Which texts are without what is plainly damage?"""
    out = np.ones(len(texts), bool)
    codes, owner = _joined(texts)
    out[owner[(codes == LOST) | ((codes >= 0x80) & (codes < 0xA0))]] = False
    out[owner[_utf8_units(_pairs().byte["cp1252"][np.where(codes < 0x10000, codes, 0)]).size > 0]] = False
    return out


def _sound(texts: list[str], first: Bigrams | None) -> list[str]:
    """The texts that aren't plainly damaged, or those that a first model finds undamaged."""
    if first is None:
        return [t for t, plain in zip(texts, _plain(texts)) if plain]
    return [t for t, damaged in zip(texts, Model(first).damaged(texts)) if not damaged]


def fit(texts: list[str]) -> Bigrams:
    """The bigram model of some texts, refitted without the texts that the first model finds damaged."""
    first = Bigrams(*pair_counts(_sound(texts, None)))
    return Bigrams(*pair_counts(_sound(texts, first)))


def _counted(texts: DataFrame, text: str, weight: float, first: Bigrams | None) -> Bigrams:
    """The model of the sound texts of a table, from counts of all its rows."""
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if sound := _sound(batch[text].tolist(), shared.value):
                more, n = pair_counts(sound)
                pairs, owner = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                counts = np.bincount(owner, np.concatenate([counts, n])).astype(np.int64)
        yield pd.DataFrame({"pair": pairs, "n": counts})

    found = texts.select(text).mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas().sort_values("pair")
    return Bigrams(found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), weight) if len(found) else Bigrams(*pair_counts([]))


def fitted(rows: DataFrame, key: str, text: str, most: int = TRAIN_ROWS) -> Bigrams:
    """The model of a table's texts, as ``fit`` makes it, from all rows; they weigh as ``most`` rows at most."""
    weight = min(1.0, most / max(rows.count(), 1))
    texts = rows.where(F.col(text).isNotNull()).select(key, text).dropDuplicates([key])
    return _counted(texts, text, weight, _counted(texts, text, weight, None))


def damaged_texts(rows: DataFrame, key: str, text: str, bigrams: Bigrams) -> DataFrame:
    """(key, restored) of the rows whose text is damaged, with the text as far as it can be restored."""
    shared = rows.sparkSession.sparkContext.broadcast(bigrams)

    def run(values: pd.Series) -> pd.Series:
        known = values.fillna("").tolist()
        return pd.Series([r if d.any() else None for r, d in Model(shared.value).label(known)], dtype=object)

    out = rows.select(F.col(key), pandas_udf(run, "string")(text).alias("restored"))
    return out.where("restored is not null").dropDuplicates([key])


def damaged_keys(rows: DataFrame, key: str, text: str, bigrams: Bigrams) -> DataFrame:
    """(key) of the rows whose text is damaged."""
    shared = rows.sparkSession.sparkContext.broadcast(bigrams)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series(Model(shared.value).damaged(values.fillna("").tolist()))

    return rows.where(pandas_udf(run, "boolean")(text)).select(key).distinct()


def _covered(taken: dict[int, dict[int, list[tuple[float, float]]]], cx: int, cy: int, ox: float, oy: float) -> bool:
    """Does a glyph stand at a place already taken? Places are kept by row and column of a lattice; most rows are empty."""
    for j in (cy - 1, cy, cy + 1):
        if row := taken.get(j):
            for i in (cx - 1, cx, cx + 1):
                for px, py in row.get(i, ()):
                    if abs(px - ox) <= OVER and abs(py - oy) <= OVER:
                        return True
    return False


def _by_owner(text: str, owners: list[int | None], parts: list[tuple[int, int, str]]) -> dict[int, str]:
    """The restored texts of those owners of a text's characters that hold damaged ones."""
    if not parts:
        return {}
    pieces, hit = list(text), set()
    for at, size, unit in parts:
        pieces[at : at + size] = [unit] + [""] * (size - 1)
        hit.update(owners[at : at + size])
    hit.discard(None)
    out = dict.fromkeys(hit, "")
    for owner, piece in zip(owners, pieces):
        if owner in hit:
            out[owner] += piece
    return out


def damaged_glyphs(glyphs: DataFrame, bigrams: Bigrams) -> DataFrame:
    """(glyph_id, restored) of the glyphs that hold damaged characters, with their texts as far as they can be restored:
    what several glyphs' characters stand for goes to the first, the others become empty. A page is one row: its size is
    bounded by the paper."""
    shared = glyphs.sparkSession.sparkContext.broadcast(bigrams)
    # rows without a page may be many: they are taken in stretches of their order
    part = F.when(F.col("doc_id").isNull() | F.col("page_num").isNull(), F.floor(F.coalesce("seq_no", F.lit(0)) / STRETCH) * 1_000 + F.pmod(F.hash("glyph_id"), F.when(F.col("seq_no").isNull(), 1_000).otherwise(1)))
    pages = glyphs.where("text is not null and text != ''").groupBy("doc_id", "page_num", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq_no", "glyph_id", "text", "ox", "oy"))).alias("g"))

    def run(pages: pd.Series) -> pd.Series:
        texts, owners, over = [], [], []
        for n, page in enumerate(pages):
            text, owner, last, done, taken = [], [], None, set(), {}
            for x in page:
                if x["glyph_id"] in done:
                    continue
                done.add(x["glyph_id"])
                ox, oy = x["ox"], x["oy"]
                if ox is not None and oy is not None:
                    cx, cy = int(ox // OVER), int(oy // OVER)
                    if _covered(taken, cx, cy, ox, oy):
                        over.append((n, x["glyph_id"], x["text"]))
                        continue
                    taken.setdefault(cy, {}).setdefault(cx, []).append((ox, oy))
                    if last is not None and abs(oy - last) > LINE:
                        text.append(" ")
                        owner.append(None)
                    last = oy
                text.append(x["text"])
                owner += [x["glyph_id"]] * len(x["text"])
            texts.append("".join(text))
            owners.append(owner)
        model = Model(shared.value)
        found = [_by_owner(t, o, parts) for t, o, parts in zip(texts, owners, model.parts(texts))]
        # a glyph printed over another has no word around it: only a unit of several characters, or a lost one, tells
        alone = [t if len(t) > 1 or t == chr(LOST) or "\x80" <= t < "\xa0" else "" for _, _, t in over]
        for (n, glyph, _), (restored, d) in zip(over, model.label(alone)):
            if d.any() and glyph is not None:
                found[n][glyph] = restored
        return pd.Series(found, dtype=object)

    # a glyph is one record, also where its rows name several pages
    return pages.select(F.explode(pandas_udf(run, "map<bigint, string>")("g")).alias("glyph_id", "restored")).groupBy("glyph_id").agg(F.min("restored").alias("restored"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks, glyphs = table(spark, folder, "chunks"), table(spark, folder, "glyphs")
    bigrams = fitted(chunks, "chunk_id", "content")
    records = damaged_keys(chunks, "chunk_id", "content", bigrams).select(F.lit("chunks").alias("src_table"), F.col("chunk_id").alias("rec_id"))
    return records.unionByName(damaged_glyphs(glyphs, bigrams).select(F.lit("glyphs").alias("src_table"), F.col("glyph_id").alias("rec_id")))


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged chunks with their restored contents."""
    chunks = table(spark, folder, "chunks")
    return damaged_texts(chunks, "chunk_id", "content", fitted(chunks, "chunk_id", "content"))


def p5_restored_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged glyphs with their restored texts."""
    return damaged_glyphs(table(spark, folder, "glyphs"), fitted(table(spark, folder, "chunks"), "chunk_id", "content"))


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored, "p5_restored_glyphs": p5_restored_glyphs}
ORACLE: dict[str, str] = {}
