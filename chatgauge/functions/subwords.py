"""Sub-word tokens of byte-level byte-pair vocabularies, given as a file of merge ranks.

The vocabulary is data: its path is always a parameter. A file has a line for each token,
base64 of its bytes and its rank. A text is split by PATTERN (or the vocabulary's own) into
pieces; in each piece the adjacent pair of least rank is merged, leftmost first, until no
pair has a rank.
"""

import base64
import heapq

import regex
from pyspark.sql import SparkSession

#: Fixed value: the pattern that goes with the published byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: More entries than any published vocabulary has; with them a broadcast stays near 100 MB.
MOST_ENTRIES = 1_000_000
#: Pieces whose tokens a worker remembers, and the longest of them in bytes (below 256); about 30 MB.
KEPT, SHORT = 200_000, 64
#: Vocabularies whose pieces a worker remembers.
HELD = 2


def read_ranks(spark: SparkSession, path) -> dict:
    """{token bytes: rank} of a rank file, read by Spark, so from any store it reads."""
    rows = spark.read.text(path).where("value <> ''").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} tokens is not broadcast")
    pairs = (r["value"].split(" ") for r in rows)
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has a token for every byte")
    return ranks


def merged_lengths(piece: bytes, ranks: dict) -> list:
    """Byte lengths of a piece's tokens; a heap of pairs keeps long pieces at n log n."""
    if piece in ranks:
        return [len(piece)]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i, stop):
        rank = ranks.get(piece[i:stop])
        if rank is not None:
            heapq.heappush(heap, (rank, i, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # a pair that has changed since it was offered
        if not alive[i] or middle >= stop or end[middle] != stop:
            continue
        end[i], alive[middle] = stop, False
        if stop < n:
            before[stop] = i
            offer(i, end[stop])
        if before[i] >= 0:
            offer(before[i], stop)
    return [end[i] - i for i in range(n) if alive[i]]


class Subwords:
    """Counts and cuts texts by tokens."""

    def __init__(self, ranks: dict, pattern=PATTERN):
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), {}

    def lengths(self, piece: bytes):
        found = self.known.get(piece)
        if found is None:
            found = merged_lengths(piece, self.ranks)
            if len(piece) <= SHORT:
                if len(self.known) >= KEPT:
                    self.known.clear()
                found = self.known[piece] = bytes(found)
        return found

    def count(self, text: str) -> int:
        return sum(len(self.lengths(m[0].encode())) for m in self.pattern.finditer(text))

    def cut(self, text: str, n: int):
        """(bytes of the first n tokens, whether more follow); the text is read no further than that."""
        taken = size = 0
        for m in self.pattern.finditer(text):
            lengths = self.lengths(m[0].encode())
            if taken + len(lengths) > n:
                return size + sum(lengths[: n - taken]), True
            taken, size = taken + len(lengths), size + sum(lengths)
        return size, False


_held = []


def worker_subwords(ranks: dict, pattern=PATTERN) -> Subwords:
    """The one ``Subwords`` of this worker for a broadcast vocabulary, whichever column or task asks for it."""
    for words in _held:
        if words.ranks is ranks and words.pattern.pattern == pattern:
            return words
    _held.append(Subwords(ranks, pattern))
    del _held[:-HELD]
    return _held[-1]
