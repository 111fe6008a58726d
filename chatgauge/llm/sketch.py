"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below 1/FRACTION of the hash range, so its size follows the
text's, and besides that the FLOOR least hashes, so a short text is kept whole. Both survive
merging: the sketch of parts together is made of the sketches of the parts. A sketch is
complete up to its reach: the whole range if it has fewer than FLOOR hashes, else the
threshold or its last hash, whichever is further. Two sketches are compared up to the lesser
reach: the share of the smaller one's hashes that lies in the larger estimates containment
even for texts of very different length. A text of fewer than five words is one shingle; one
without words has an empty sketch.

``fingerprint_neighbours`` compares each document with an edited copy and with the document
of the next smaller id, by their fingerprints alone; ``exact_*`` are the same shares over all
shingles, by which the estimates can be judged. Ids are cut into ranges by quantiles (an id
that fills several, and rows without an id, are cut by a hash of the text); each range is one
sorted run, followed by a copy of the first document of the next range, so one shuffle of the
texts brings neighbours together and a task reads its run as a stream.

Defined results: a null text is empty; equal ids are ordered by a hash of the text, rows
without an id come last; after the last document comes the first, also when there is only
one; two texts without words are alike (1), one with and one without are not (0), nor are
texts of which one has no hash within the common reach; an empty table gives an empty result.
Ids are whole numbers. Further columns of any name do not matter.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, gram_hashes, short_batches, span_hashes, steps, tokens

SHINGLE, FRACTION, FLOOR = 5, 2, 64
LIMIT = np.uint64((1 << 64) // FRACTION)
EVERYTHING = np.uint64((1 << 64) - 1)
MAX_RANGES = 10_000


def shingles(texts):
    """(row, hash) of all distinct shingles, sorted by row and hash."""
    rows, hashes, low_row = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for low, high, data, offsets in steps(texts):
        start, end, row = tokens(data, offsets, ~SPACES)
        words = span_hashes(data, start, end)
        count = np.bincount(row, minlength=high - low)
        found = [gram_hashes(words, row, SHINGLE)]
        for k in range(1, SHINGLE):
            short = count[row] == k
            if short.any():
                found.append(gram_hashes(words[short], row[short], k))
        h, r = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        rows.append(r[new] + low_row)
        hashes.append(h[new])
        low_row += high - low
    return np.concatenate(rows), np.concatenate(hashes)


def scaled(found):
    """What of ``shingles`` is kept: the hashes below the threshold and the FLOOR least of each row."""
    row, h = found
    place = np.arange(len(row)) - np.searchsorted(row, row)
    wanted = (h < LIMIT) | (place < FLOOR)
    return row[wanted], h[wanted]


def sketches(texts):
    """The sketches of texts."""
    return scaled(shingles(texts))


def encoded(sketch, n):
    """Each row's hashes as text: base64 of the sorted numbers, eight bytes each."""
    row, h = sketch
    edges = np.searchsorted(row, np.arange(n + 1))
    data = h.astype(">u8").tobytes()
    return [base64.b64encode(data[8 * a : 8 * b]).decode() for a, b in zip(edges[:-1], edges[1:])]


def decoded(text):
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merged(*texts):
    """The sketch of several texts together (their shingles, not those across the seams)."""
    h = np.unique(np.concatenate([decoded(t) for t in texts] or [np.zeros(0, np.uint64)]))
    return base64.b64encode(scaled((np.zeros(len(h), np.int64), h))[1].astype(">u8").tobytes()).decode()


def reach(sketch, n):
    """Up to which hash the sketch of each row is complete."""
    row, h = sketch
    count = np.bincount(row, minlength=n)
    last = np.zeros(n, np.uint64)
    np.maximum.at(last, row, h)
    return np.where(count < FLOOR, EVERYTHING, np.maximum(last, LIMIT - np.uint64(1)))


def shares(a, b, n):
    """(containment of the smaller in the larger, Jaccard) of rows 0..n-1 of two sets of hashes."""
    na, nb = (np.bincount(x[0], minlength=n) for x in (a, b))
    row, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) else np.zeros(n)
    least, all_ = np.minimum(na, nb), na + nb - both
    return both / np.maximum(least, 1), both / np.maximum(all_, 1)


def likeness(a, b, n):
    """``shares`` estimated from two sketches; rows without a hash on both sides are alike."""
    common = np.minimum(reach(a, n), reach(b, n))
    within = [tuple(x[s[1] <= common[s[0]]] for x in s) for s in (a, b)]
    empty = (np.bincount(a[0], minlength=n) == 0) & (np.bincount(b[0], minlength=n) == 0)
    return tuple(np.where(empty, 1.0, x) for x in shares(*within, n))


def likeness_of(fingerprint, other):
    """(containment, Jaccard) of two stored fingerprints."""
    a, b = ((np.zeros(len(h), np.int64), h) for h in map(decoded, (fingerprint, other)))
    return tuple(float(x[0]) for x in likeness(a, b, 1))


def edited(text, following):
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _part(found, low, high):
    """Rows low..high-1, numbered from 0."""
    row, h = found
    a, b = np.searchsorted(row, [low, high])
    return row[a:b] - low, h[a:b]


def compare(ids, texts):
    """Columns for all rows but the last, each compared with its edited text and the next row."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    whole = shingles(pa.array(texts, pa.large_string())), shingles(pa.array(changed, pa.large_string()))
    all_own, all_next, all_changed = _part(whole[0], 0, n), _part(whole[0], 1, n + 1), whole[1]
    kept = scaled(whole[0]), scaled(whole[1])
    own, following, of_changed = _part(kept[0], 0, n), _part(kept[0], 1, n + 1), kept[1]
    values = [*likeness(own, of_changed, n), *likeness(own, following, n)]
    neither = [np.bincount(all_own[0], minlength=n) + np.bincount(x[0], minlength=n) == 0 for x in (all_changed, all_next)]
    exact = [np.where(e, 1.0, shares(all_own, x, n)[0]) for e, x in zip(neither, (all_changed, all_next))]
    return [
        ids.slice(0, n), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(encoded(own, n), pa.string()), pa.array(encoded(of_changed, n), pa.string()),
        *(pa.array(x, pa.float64()) for x in (values[0], values[2], values[1], values[3], *exact)),
    ]


NAMES = (
    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    "jaccard_edited", "jaccard_next", "exact_edited", "exact_next",
)


class Ranges:
    """Numbers of sorted ranges for (id, key): higher ids have higher numbers, rows without an id the least.

    ``cuts`` are quantiles of the ids: one that repeats is an id that fills ranges of its own,
    which are cut by the key (a signed 64-bit hash), as are the ``of_null`` ranges without an id.
    """

    def __init__(self, cuts, of_null):
        self.cuts, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.width = np.where(times > 1, times, 0)
        self.start = of_null + np.concatenate([[0], np.cumsum(1 + self.width)])
        self.of_null = of_null

    @staticmethod
    def _share(key, n):
        return np.minimum(((key / 2.0**64 + 0.5) * n).astype(np.int64), np.maximum(n, 1) - 1)

    def of(self, ids, null, key):
        at = np.searchsorted(self.cuts, ids)
        inside = np.minimum(at, max(len(self.cuts) - 1, 0))
        own = (self.width[inside] > 0) & (self.cuts[inside] == ids) if len(self.cuts) else np.zeros(len(ids), bool)
        number = self.start[at]
        if own.any():
            number = number + np.where(own, 1 + self._share(key, self.width[inside]), 0)
        return np.where(null, self._share(key, np.full(len(ids), self.of_null)), number)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """NAMES for every row of (doc_id, text); doc_id is a number."""
    spark = docs.sparkSession
    short_batches(spark)
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = min(MAX_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = ", ".join(f"{(k + 1) / parts:.6f}D" for k in range(parts - 1)) or "0.5D"
    told = bare.selectExpr(
        f"percentile_approx(doc_id, array({quantiles}), 10000) AS cuts", "count(*) AS n", "count(doc_id) AS n_ids"
    ).first()
    if not told["n"]:
        return bare.mapInArrow(lambda batches: iter(()), _schema())
    ranges = Ranges(told["cuts"] or [], -(-(told["n"] - told["n_ids"]) * parts // told["n"]))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series, key: pd.Series) -> pd.Series:
        known = ids.fillna(0).to_numpy(np.int64)
        return pd.Series(ranges.of(known, ids.isna().to_numpy(), key.to_numpy(np.int64))).astype("int32")

    keyed = bare.withColumn("key", F.xxhash64("text"))
    ranged = keyed.withColumn("run", run_of("doc_id", "key"))
    # the first document of every range: one row a range, about ``parts`` of them
    firsts = [
        (r["run"], r["first"]["doc_id"], r["first"]["key"])
        for r in ranged.groupBy("run").agg(F.max(F.struct("doc_id", "key")).alias("first")).orderBy(F.desc("run")).collect()
    ]
    guests = {}
    for (run, *_), (_, *first) in zip(firsts, [*firsts[1:], firsts[0]]):
        guests.setdefault(tuple(first), []).append(run)
    known = ", ".join(f"'{first}:{key}', array({', '.join(map(str, runs))})" for (first, key), runs in guests.items())
    visits = f"coalesce(element_at(map({known}), concat(coalesce(CAST(doc_id AS STRING), 'None'), ':', key)), array())"
    sent = ranged.selectExpr(
        "doc_id", "text", "key",
        f"explode(concat(array(struct(run AS run, false AS guest)), transform({visits}, r -> struct(r AS run, true AS guest)))) AS place",
    ).selectExpr("doc_id", "text", "place.run AS run", "place.guest AS guest", "key")
    ordered = sent.repartition(parts, "run").sortWithinPartitions(
        F.desc("run"), "guest", F.desc_nulls_last("doc_id"), F.desc("key"), "text"
    ).drop("key")

    def run(batches):
        ids, texts, runs = pa.array([], pa.int64()), [], []
        for batch in batches:
            own = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            # a range ends with its first guest, further guests are repeated ids
            number = batch.column(2).to_numpy(zero_copy_only=False)
            before_guest = np.concatenate([[bool(runs) and runs[-1] == (number[0] if len(number) else None, True)], own[:-1]])
            before_run = np.concatenate([[runs[-1][0] if runs else -2], number[:-1]])
            use = np.flatnonzero(~(own & before_guest & (before_run == number)))
            if not len(use):
                continue
            new_ids = batch.column(0).cast(pa.int64()).take(pa.array(use))
            ids = pa.concat_arrays([ids, new_ids])
            texts += batch.column(1).take(pa.array(use)).to_pylist()
            runs += [(int(number[i]), bool(own[i])) for i in use]
            if len(texts) > 1:
                yield from _compared(ids, texts, runs)
                ids, texts, runs = ids.slice(len(texts) - 1), texts[-1:], runs[-1:]

    return ordered.mapInArrow(run, _schema())


def _compared(ids, texts, runs):
    # a guest is only looked at; the row after it starts another range
    asked = pa.array([i for i in range(len(texts) - 1) if not runs[i][1]], pa.int64())
    made = pa.RecordBatch.from_arrays(compare(ids, texts), NAMES)
    yield made.take(asked)


def _schema():
    return ", ".join(f"{c} {t}" for c, t in zip(NAMES, ["long", "long", *["string"] * 3, *["double"] * 6]))
