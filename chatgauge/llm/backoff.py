"""Stupid-backoff scores of texts against the rest of the corpus.

For the word c after a b the score S is n(a b c) / n(a b) if a b c occurs elsewhere, else
0.4 times n(b c) / n(b) if b c does, else 0.16 times n(c) / N, else 0.064 / N: counts of
orders 3, 2 and 1 over all texts, the text's own occurrences subtracted at every order
alike (from N too). The second word of a text starts at pairs, the first at words. A text's
score is the sum of log S. No n-gram is left out of the counts, however rare.

The corpus is first stored in units of at most UNIT_ROWS texts and about UNIT_BYTES, so that a
place (unit, row, word) means the same in every later pass. Then every n-gram, with its
place, goes to the hash partition of its key; a partition holds all occurrences of its keys,
counts them, joins the counts to the occurrences, subtracts each text's own, and sends what
is above 0 to the place's unit. Last, each unit's texts meet these counts and are summed up.

Places travel in packed arrays, one for each (unit, partition), so Spark moves few large
rows. The commonest n-grams (at most COMMON, found in a sample of SAMPLE texts, counted over
all) are broadcast instead of shuffled: no partition has to hold a key that many texts
share, and the choice has no bearing on results. The key space is cut into slices, one pass
over the stored texts each, and so are the units at last; the shuffle files of a pass go when
its result is written.

Keys are 64-bit hashes of the words; two n-grams with one hash would share their counts.

Defined results: null and empty texts have no words, score 0 and null per_word; words are
compared as written; repeated rows are texts of their own, each evidence for the others;
with a single text N is taken as 1; an empty table gives an empty result. Further columns of
any name do not matter.
"""

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, mix, short_batches, span_hashes, steps, stored, tokens

BACKOFF, ORDERS = 0.4, 3
COMMON, SAMPLE = 1 << 16, 4_096
#: Slices of the key space and of the units, n-grams of a hash partition, and bounds of a unit.
SLICES, UNIT_SLICES, PARTITION_GRAMS = 4, 3, 2_000_000
UNIT_ROWS, UNIT_BYTES = 2_048, 8 << 20
#: Texts of a batch, and packed arrays of one.
TEXTS, PACKS = 500, 128
_ORDER_SHIFT = 13  # a row of a unit takes 11 bits, the order the upper ones
_SLOTS = 1 << 20


def grams(data, offsets):
    """(row, word, keys): rows and places of all words of a run, and keys of the n-grams that end there, by order; 0 is none."""
    start, end, row = tokens(data, offsets, ~SPACES)
    word = np.maximum(span_hashes(data, start, end), np.uint64(1))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keys = [word]
    for n in range(2, ORDERS + 1):
        longer = np.zeros(len(word), np.uint64)
        if len(word) >= n:
            shorter = keys[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            longer[1:] = np.maximum(mix(shorter ^ word[1:]), np.uint64(1))
            longer[place < n - 1] = 0
        keys.append(longer)
    return row, place, keys


class Common:
    """The commonest keys and their counts, one key for each slot of a table."""

    def __init__(self, keys, counts):
        self.keys, self.counts = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int64)
        slot = (keys % np.uint64(_SLOTS)).astype(np.int64)
        self.keys[slot], self.counts[slot] = keys, counts

    def find(self, keys):
        """(whether each key is among them, its slot)."""
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        return (self.keys[slot] == keys) & (keys != 0), slot


def unit_table(docs: DataFrame) -> DataFrame:
    """(unit, row, doc_id, text), stored: units of texts that were read together."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        unit, row, size = 0, 0, 0
        for batch in batches:
            length = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            units, rows = [], []
            for n in length:
                if row == UNIT_ROWS or size and size + n > UNIT_BYTES:
                    unit, row, size = unit + 1, 0, 0
                units.append(first + unit)
                rows.append(row)
                row, size = row + 1, size + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.int64()), pa.array(rows, pa.int32()), batch.column(0), batch.column(1)], ["unit", "row", "doc_id", "text"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"unit long, row int, doc_id {kind}, text string"), "zstd")


def common_grams(units: DataFrame, most=COMMON, sample=SAMPLE) -> tuple[Common, int]:
    """The commonest n-grams of a sample of texts with their counts over all texts, and the number of words of all texts."""
    some = units.select("text", F.xxhash64("unit", "row").alias("key")).orderBy("key").limit(sample).select("text")

    def seen(batches):
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                key, n = np.unique(np.concatenate(grams(data, offsets)[2]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    found = some.mapInArrow(seen, "key long, n long").where("key <> 0").groupBy("key").agg(F.sum("n").alias("n"))
    top = found.where("n > 2").orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    chosen = Common(top.column(0).to_numpy().view(np.uint64), 0)

    def counted(batches):
        total, words = np.zeros(_SLOTS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                row, _, keys = grams(data, offsets)
                words += len(row)
                for k in keys:
                    hit, slot = chosen.find(k)
                    total += np.bincount(slot[hit], minlength=_SLOTS)
        at = np.flatnonzero(total)
        key, n = np.append(chosen.keys[at], np.uint64(0)), np.append(total[at], words)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = units.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy()
    return Common(keys[keys != 0], n[keys != 0]), int(n[keys == 0].sum())


def packed(*columns) -> bytes:
    """Arrays of one length, one after the other; 32-bit ones as two planes of 16 bits, whose upper one is mostly 0."""
    out = []
    for c in columns:
        out += [c.astype("<u2"), (c >> 16).astype("<u2")] if c.dtype == np.uint32 else [c]
    return b"".join(x.tobytes() for x in out)


def unpacked(data: bytes, *kinds):
    """The arrays of ``packed``."""
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0

    def take(kind):
        nonlocal at
        made = np.frombuffer(data, kind, n, at)
        at += made.nbytes
        return made

    for k in kinds:
        out.append(take("<u2") + (take("<u2").astype(np.uint32) << 16) if k == np.uint32 else take(k))
    return out


def runs(*columns):
    """Starts of runs of equal rows in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def exploded(units: DataFrame, common, which: int, slices: int, partitions: int) -> DataFrame:
    """(partition, unit, data): keys and places of one slice's n-grams that are not common."""

    def run(batches):
        for batch in batches:
            unit_of, row_of = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint16)
            made, first = [], 0
            for low, high, data, offsets in steps(batch.column(2)):
                row, place, keys = grams(data, offsets)
                for order, key in enumerate(keys):
                    use = np.flatnonzero(((key >> np.uint64(40)) % np.uint64(slices) == which) & (key != 0))
                    use = use[~common.value.find(key[use])[0]]
                    key, r = key[use], row[use] + first
                    made.append((unit_of[r], key, row_of[r] | np.uint16(order << _ORDER_SHIFT), place[use].astype(np.uint32)))
                first += high - low
            if not made:
                continue
            unit, key, ref, place = (np.concatenate(c) for c in zip(*made))
            part = ((key >> np.uint64(20)) % np.uint64(partitions)).astype(np.uint32)
            numbers, unit = np.unique(unit, return_inverse=True)
            # few units meet in a batch, so this is one sort by a short number
            group = unit.astype(np.uint32) * np.uint32(partitions) + part
            order = np.argsort(group.astype(np.uint16) if len(numbers) * partitions < 1 << 16 else group, kind="stable")
            group, key, ref, place = (c[order] for c in (group, key, ref, place))
            starts = runs(group) if len(group) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(group))
            yield pa.RecordBatch.from_arrays([
                pa.array((group[starts] % partitions).astype(np.int32)), pa.array(numbers[group[starts] // partitions]),
                pa.array([packed(key[a:b], ref[a:b], place[a:b]) for a, b in zip(starts, ends)], pa.binary()),
            ], ["partition", "unit", "data"])

    return units.select("unit", "row", "text").mapInArrow(run, "partition int, unit long, data binary")


def counted_elsewhere(units, blobs):
    """Places of a partition's n-grams that other texts have: (unit, row and order, place, count there), by place.

    ``blobs`` are the partition's packed arrays, ``units`` their units.
    """
    parts = [unpacked(b, np.uint64, np.uint16, np.uint32) for b in blobs]
    key, ref, place = (np.concatenate(c) for c in zip(*parts))
    numbers, unit = np.unique(units, return_inverse=True)
    unit = np.repeat(unit.astype(np.uint32), [len(p[0]) for p in parts])
    order = np.argsort(key)
    starts = runs(key[order])
    size = np.diff(np.append(starts, len(key)))
    # keys that occur once cannot occur elsewhere
    order, group = order[np.repeat(size > 1, size)], np.repeat(np.arange((size > 1).sum()), size[size > 1])
    text = unit[order].astype(np.int64) << 11 | (ref[order] & 0x7FF)
    again = np.lexsort((text, group))
    order, group, text = order[again], group[again], text[again]
    if not len(order):
        return numbers[:0], ref[:0], place[:0], place[:0]
    starts = runs(group, text)
    own = np.diff(np.append(starts, len(group)))
    other = np.repeat(np.bincount(group)[group[starts]] - own, own)
    order, other = order[other > 0], other[other > 0].astype(np.uint32)
    by_place = np.lexsort((place[order], ref[order], unit[order]))
    order = order[by_place]
    return numbers[unit[order]], ref[order], place[order], other[by_place]


def counts_by_place(rows: DataFrame, partitions: int) -> DataFrame:
    """(unit, data): for each unit the places whose n-gram occurs elsewhere, with its count."""

    def finished(units, blobs):
        unit, ref, place, n = counted_elsewhere(np.array(units, np.int64), blobs)
        starts = runs(unit) if len(unit) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(unit))
        data = [packed(ref[a:b], place[a:b], n[a:b]) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(unit[starts], pa.int64()), pa.array(data, pa.binary())], ["unit", "data"])

    def run(batches):
        now, units, blobs = None, [], []
        for batch in batches:
            for part, unit, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and blobs:
                    yield finished(units, blobs)
                    units, blobs = [], []
                now = part
                units.append(unit)
                blobs.append(blob)
        if blobs:
            yield finished(units, blobs)

    dealt = rows.repartitionById(partitions, "partition")
    return dealt.mapInArrow(run, "unit long, data binary")


def text_scores(texts, rows, blobs, common: Common, total: int):
    """(words, sum of log S) of a unit's texts, from the counts for their places."""
    n_words, scores, first = [], [], 0
    parts = [unpacked(b, np.uint16, np.uint32, np.uint32) for b in blobs]
    ref, place, n = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint16), *[np.zeros(0, np.uint32)] * 2)
    # the number of each text in ``texts`` by its row of the unit
    at = np.full(UNIT_ROWS, -1)
    at[rows] = np.arange(len(rows))
    number, order = at[ref & 0x7FF], ref >> _ORDER_SHIFT
    sorted_ = np.argsort(number, kind="stable")
    number, order, place, n = (c[sorted_] for c in (number, order, place, n))
    for low, high, data, offsets in steps(texts):
        row, _, keys = grams(data, offsets)
        begin = np.searchsorted(row, np.arange(high - low + 1))
        a, b = np.searchsorted(number, [low, high])
        other = np.zeros((ORDERS, len(row) + 1))  # the last column stands for no word
        other[order[a:b], begin[number[a:b] - low] + place[a:b]] = n[a:b]
        for k, key in enumerate(keys):
            hit, slot = common.find(key)
            use = np.flatnonzero(hit)
            if len(use):
                # a text's own occurrences of the key
                together = np.lexsort((slot[use], row[use]))
                use = use[together]
                starts = runs(row[use], slot[use])
                own = np.diff(np.append(starts, len(use)))
                other[k, use] = common.counts[slot[use]] - np.repeat(own, own)
        own_words = np.diff(begin)
        rest = np.maximum(total - own_words, 1)[row]
        known = np.arange(len(row)) - begin[row]  # words of the text before this one
        before = np.arange(len(row)) - 1
        below = [rest, other[0, before], other[1, before]]
        steps_down = np.minimum(known + 1, ORDERS)
        value = np.log(1 / rest) + steps_down * math.log(BACKOFF)
        for k in range(ORDERS):
            seen = (known >= k) & (other[k, :-1] > 0)
            value[seen] = np.log(other[k, :-1][seen] / below[k][seen]) + (steps_down[seen] - k - 1) * math.log(BACKOFF)
        n_words.append(own_words)
        scores.append(np.bincount(row, weights=value, minlength=high - low))
        first += high - low
    empty = [np.zeros(0)]
    return np.concatenate(n_words or empty).astype(np.int64), np.concatenate(scores or empty)


@contextlib.contextmanager
def freed_shuffles(spark):
    """Inside, the shuffle files of a query go as soon as its result is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scores(
    docs: DataFrame, slices=SLICES, unit_slices=UNIT_SLICES, common=COMMON, partition_grams=PARTITION_GRAMS
) -> DataFrame:
    """(doc_id, n_words, score, per_word) for every row of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark, TEXTS)
    with freed_shuffles(spark):
        units = unit_table(docs)
        known, total = common_grams(units, common)
        shared = spark.sparkContext.broadcast(known)  # at most ``common`` keys, in a table of fixed size
        partitions = max(1, -(-ORDERS * total // (slices * partition_grams)))
        counts = None
        for which in range(slices):
            short_batches(spark, PACKS)
            found = stored(counts_by_place(exploded(units, shared, which, slices, partitions), partitions), "zstd")
            counts = found if counts is None else counts.unionAll(found)

        kind = docs.schema["doc_id"].dataType.simpleString()

        def run(texts, blobs):
            texts = texts.combine_chunks()
            n, score = text_scores(
                texts["text"].combine_chunks(), texts["row"].to_numpy(), blobs["data"].to_pylist(), shared.value, total
            )
            return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n), "score": pa.array(score)})

        scored, fields = None, f"doc_id {kind}, n_words long, score double"
        for which in range(unit_slices):
            asked, found = (t.where(f"pmod(xxhash64(unit), {unit_slices}) = {which}") for t in (units, counts))
            part = stored(asked.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(run, fields))
            scored = part if scored is None else scored.unionAll(part)
    return scored.selectExpr("*", "if(n_words = 0, NULL, score / n_words) AS per_word")
