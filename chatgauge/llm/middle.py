"""Fill-in-the-middle: a text's two cuts are found in a wavelet matrix over character classes.

Every byte of the UTF-8 text has a class: inside a character, line break, blank, first
character of a word, later character of a word. A wavelet matrix keeps the classes of a run
of texts as three bit levels with counts per 64 bits, and answers how often a class occurs
before a place by one count per level. Units are characters, words or lines: the units begun
before a place are a sum of such ranks (all classes but the first, word starts, line breaks),
and the place where the k-th unit ends is found by bisection on that sum, for all texts of a
run at once. A unit reaches up to the next unit's begin, so words keep the blanks behind
them; what stands before the first word belongs to the prefix.

The order of the pieces (form) and the two unit numbers come from the digest of seed and id:
the first four 8-digit groups of sha256("seed:id") are h1 to h4.  The text is left alone
(plain) if it is empty or holds one of the marks, or if h3 % 100 >= 100 - plain share.

Defined results: null texts are empty; empty texts are plain; a null id reads as the empty
string; repeated rows are transformed alike; very long texts are runs of their own; an empty
table gives an empty result. Further columns of any name do not matter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, short_batches, steps

#: Fixed values of the contract: the marks, and shares in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1"
INSIDE, LINE, BLANK, WORD, LATER = range(5)
LEVELS = 3
#: The classes whose ranks add up to the number of units begun.
UNITS = {"character": (LINE, BLANK, WORD, LATER), "word": (WORD,), "line": (LINE,)}


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; a text's first character begins a word if it is no blank."""
    blank = SPACES[data]
    before = np.concatenate([[True], blank[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    kind = np.where(blank, BLANK, np.where(before, WORD, LATER)).astype(np.uint8)
    kind[data == 10] = LINE
    kind[(data & 0xC0) == 0x80] = INSIDE
    return kind


class WaveletMatrix:
    """Ranks of symbols below 2**LEVELS."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), []
        for level in reversed(range(LEVELS)):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            one = bit.astype(bool)
            self.levels.append((words, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(words, before, at):
        """Ones among the first ``at`` bits."""
        k = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[k] + np.bitwise_count(words[k] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        low, high = np.zeros(1, np.int64), at
        for level, (words, before, zeros) in zip(reversed(range(LEVELS)), self.levels):
            ones = self._ones(words, before, low), self._ones(words, before, high)
            if symbol >> level & 1:
                low, high = zeros + ones[0], zeros + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return high - low


class Units:
    """Units of the texts at ``offsets`` of one run of bytes."""

    def __init__(self, data, offsets, unit="character"):
        self.matrix = WaveletMatrix(classes(data, offsets))
        self.wanted, self.low, self.high = UNITS[unit], offsets[:-1], offsets[1:]
        self.base = self.begun(self.low)
        self.count = self.begun(self.high) - self.base
        if unit == "line":
            # a line ends with its break; what follows the last break is a line too
            open_end = (self.high > self.low) & (data[np.maximum(self.high, 1) - 1] != 10) if len(data) else np.zeros(len(self.low), bool)
            self.count = self.count + open_end

        self.unit = unit

    def begun(self, at):
        return sum(self.matrix.rank(c, at) for c in self.wanted)

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """The place in each text where its first k units end: the least one after which more begin, or the text's end."""
        # a line is closed by its own symbol, other units by the begin of the next
        goal = k + (0 if self.unit == "line" else 1)
        low, high = self.low.copy(), self.high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            # a place already found may be the end of the run, where no byte follows
            reached = self.begun(np.minimum(middle + 1, self.high)) - self.base >= goal
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        if self.unit == "line":
            return np.where(k == 0, self.low, np.minimum(low + 1, self.high))
        return np.where(k == 0, self.low, low)


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of. No piece holds a mark, so each is found once."""
    if form == "plain":
        return output
    left, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = left.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = left.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


NAMES = ("form", "n", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output")
FIELDS = (
    "form string, n long, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output binary"
)


def transformed(texts, h, unit="character") -> list:
    """The NAMES columns for an Arrow array of texts and their (n, 4) numbers h1 to h4."""
    columns = [[] for _ in NAMES]
    for low, high, data, offsets in steps(texts):
        own = h[low:high]
        characters = Units(data, offsets)
        units = characters if unit == "character" else Units(data, offsets, unit)
        drawn = np.sort(own[:, :2] % (units.count + 1)[:, None], axis=1)
        cuts = [units.end_of(drawn[:, 0]), units.end_of(drawn[:, 1])]
        begun = [characters.begun(offsets[:-1]), *(characters.begun(c) for c in cuts)]
        for i in range(high - low):
            body = data[offsets[i] : offsets[i + 1]].tobytes()
            a, b = (int(c[i] - offsets[i]) for c in cuts)
            plain = not body or any(m in body for m in (PREFIX, SUFFIX, MIDDLE)) or own[i, 2] % 100 >= PLAIN_FROM
            form = "plain" if plain else "spm" if own[i, 3] % 100 < SPM_BELOW else "psm"
            values = (
                form, int(units.count[i]), *((None,) * 4 if plain else (
                    int(drawn[i, 0]), int(drawn[i, 1] - drawn[i, 0]), int(begun[1][i] - begun[0][i]), int(begun[2][i] - begun[1][i])
                )),
                body if plain else arranged(body[:a], body[a:b], body[b:], form),
            )
            for column, value in zip(columns, values):
                column.append(value)
    kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
    return [pa.array(c, k) for c, k in zip(columns, kinds)]


def _numbered(docs: DataFrame, seed) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return docs.select("doc_id", "text", *groups)


def _mapped(docs: DataFrame, unit, seed, finish, fields) -> DataFrame:
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            h = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], axis=1)
            made = dict(zip(NAMES, transformed(batch.column(1), h, unit)))
            columns = {"doc_id": batch.column(0)} | finish(made)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _numbered(docs, seed).mapInArrow(run, f"doc_id {kind}, {fields}")


def fill_in_middle(docs: DataFrame, unit="character", seed=SEED) -> DataFrame:
    """(doc_id, form, n, prefix_units, middle_units, prefix_chars, middle_chars, output) for every row; output is text."""
    made = _mapped(docs, unit, seed, lambda columns: columns, FIELDS)
    return made.withColumn("output", F.decode("output", "UTF-8"))


def fill_in_middle_digests(docs: DataFrame, unit="character", seed=SEED) -> DataFrame:
    """The same with output_sha256 and restored_sha256 in place of the output, so that no text leaves its task."""

    def digests(columns):
        outputs, forms = columns.pop("output").to_pylist(), columns["form"].to_pylist()
        back = (restored(o, f) for o, f in zip(outputs, forms))
        return columns | {
            "output_sha256": pa.array([hashlib.sha256(o).hexdigest() for o in outputs], pa.string()),
            "restored_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
        }

    fields = FIELDS.removesuffix("output binary") + "output_sha256 string, restored_sha256 string"
    return _mapped(docs, unit, seed, digests, fields)
