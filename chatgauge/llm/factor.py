"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its lower-cased alphanumeric terms, and of the first STEM bytes of the
longer ones, hashed to BUCKETS. The margin is
bias + sum of weights + sum over pairs of terms of the product of their factor vectors, so a
pair can count for more than its parts. Every bucket that occurs in LEAST_TEXTS texts of the
bounded sample enters the machine, whatever its effect by itself.

Training goes in two rounds, in numpy on small batches. The first moves a parameter away from
its start only by as much as the sum of its gradients exceeds EVIDENCE times the root of the
sum of their squares, so a term stays out unless it alone (by its weight) or with others (by
its factors, which start small and not at 0) tells labels apart beyond chance. The second
trains the terms that moved with Adam, without that threshold. Buckets are counted on the
executors; only those known are sent on. Scoring looks at whole texts, a batch at a time.

Only rows outside fold 0 are learned from; SAMPLE bounds their number (chosen by a hash of
the id). Defined results: null and empty texts have no terms and get the score of the bias;
without labelled rows, or with one class only, all get the smoothed mean label; repeated
rows score alike; a repeated labelled id counts once with its mean label; an empty table
gives an empty result. Further columns of any name do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, held_out, mix, sampled_ids, short_batches, span_hashes, steps, stored, tokens

SAMPLE = 20_000
BUCKETS, FACTORS, STEM, LEAST_TEXTS = 1 << 18, 8, 5, 5
EVIDENCE, START, FIRST_RATE, FIRST_EPOCHS = 2.5, 0.02, 0.2, 6
EPOCHS, BATCH, RATE, PENALTY = 8, 256, 0.02, 1e-4


def term_sets(texts):
    """(row, bucket) of the distinct terms of each text, over an Arrow array."""
    first = 0
    for low, high, data, offsets in steps(texts):
        data = LOWER[data]
        start, end, row = tokens(data, offsets, ALNUM)
        longer = end - start > STEM
        hashes = np.concatenate([
            span_hashes(data, start, end), mix(span_hashes(data, start[longer], start[longer] + STEM) + np.uint64(1))
        ])
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        both = np.unique(np.concatenate([row, row[longer]]) * BUCKETS + bucket)
        yield first, high - low, both // BUCKETS, both % BUCKETS
        first += high - low


class Machine:
    def __init__(self, buckets, bias, weights, factors):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors
        self.squares = (factors**2).sum(1)

    def margins(self, row, term, n):
        total = self.bias + np.bincount(row, weights=self.weights[term], minlength=n)
        total -= 0.5 * np.bincount(row, weights=self.squares[term], minlength=n)
        for f in self.factors.T:
            total += 0.5 * np.bincount(row, weights=f[term], minlength=n) ** 2
        return total

    def known(self, row, bucket):
        """Rows and numbers of the terms that the machine knows."""
        number = np.full(BUCKETS, -1, np.int32)
        number[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        at = number[bucket]
        return row[at >= 0], at[at >= 0]

    def scores(self, texts):
        out = [np.zeros(0)]
        for _, n, row, bucket in term_sets(texts):
            out.append(1 / (1 + np.exp(-np.clip(self.margins(*self.known(row, bucket), n), -35, 35))))
        return np.concatenate(out)


class Batches:
    """Shuffled batches of texts as (texts, number in the batch and term of each of their terms)."""

    def __init__(self, row, term, n, random):
        self.term, self.n, self.random = term, n, random
        self.edges = np.searchsorted(row, np.arange(n + 1))

    def __iter__(self):
        order = self.random.permutation(self.n)
        for low in range(0, self.n, BATCH):
            chosen = order[low : low + BATCH]
            size = self.edges[chosen + 1] - self.edges[chosen]
            local = np.repeat(np.arange(len(chosen)), size)
            at = np.repeat(self.edges[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield chosen, local, self.term[at]


def slopes(theta, bias, local, term, y):
    """(slope of the loss by margin, slope of the margin by each term's parameters) of a batch; theta has the weight first."""
    v = theta[term, 1:]
    sums = np.stack([np.bincount(local, weights=c, minlength=len(y)) for c in v.T], axis=1)
    squares = np.bincount(local, weights=(v**2).sum(1), minlength=len(y))
    margin = bias + np.bincount(local, weights=theta[term, 0], minlength=len(y)) + 0.5 * ((sums**2).sum(1) - squares)
    slope = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y
    return slope, np.concatenate([np.ones((len(term), 1)), sums[local] - v], axis=1)


def _summed(term, values, m):
    return np.stack([np.bincount(term, weights=c, minlength=m) for c in values.T], axis=1)


def first_round(batches, y, m, bias, random):
    """(theta, bias): parameters with evidence; a term without any is 0 throughout."""
    start = np.concatenate([np.zeros((m, 1)), random.normal(0, START, (m, FACTORS))], axis=1)
    theta, total, noise, bias_noise = start.copy(), np.zeros_like(start), np.zeros_like(start), 1.0
    for epoch in range(1, FIRST_EPOCHS + 1):
        for chosen, local, term in batches:
            slope, by_term = slopes(theta, bias, local, term, y[chosen])
            each = slope[local, None] * by_term
            before = np.sqrt(noise)
            noise += _summed(term, each**2, m)
            after = np.sqrt(noise)
            total += _summed(term, each, m) - (after - before) / FIRST_RATE * (theta - start)
            # the same texts come again every epoch, which adds to sums but not to evidence
            excess = np.maximum(0, np.abs(total) - EVIDENCE * after * np.sqrt(epoch))
            theta = start - np.sign(total) * excess * FIRST_RATE / (1 + after)
            bias_noise += (slope**2).sum()
            bias -= FIRST_RATE * slope.sum() / np.sqrt(bias_noise)
    moved = theta != start
    theta[~moved[:, 1:].any(axis=1), 1:] = 0
    return theta, bias


def second_round(batches, y, theta, bias, random):
    """Adam from where the first round ended; terms without factors get small ones again."""
    theta, bias, m = theta.copy(), np.array([bias]), len(theta)
    bare = ~theta[:, 1:].any(axis=1)
    theta[bare, 1:] = random.normal(0, 2 * START, (int(bare.sum()), FACTORS))
    moments, step = [np.zeros_like(theta), np.zeros_like(theta), np.zeros(1), np.zeros(1)], 0
    for _ in range(EPOCHS):
        for chosen, local, term in batches:
            slope, by_term = slopes(theta, bias[0], local, term, y[chosen])
            slope /= len(chosen)
            step += 1
            gradient = _summed(term, slope[local, None] * by_term, m) + PENALTY * theta
            for x, g, k in ((theta, gradient, 0), (bias, np.array([slope.sum()]), 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
                x -= RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)
    return theta, float(bias[0])


def fit(row, bucket, y, seed=7, least_texts=LEAST_TEXTS) -> Machine:
    """Train on (row, bucket) pairs, sorted by row, of len(y) texts with labels y in [0, 1]."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    machine = Machine(np.zeros(0, np.int64), float(np.log(mean / (1 - mean))), np.zeros(0), np.zeros((0, FACTORS)))
    if len(y) == 0 or y.min() == y.max():
        return machine
    machine.buckets = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= least_texts)
    random = np.random.default_rng(seed)
    row, term = machine.known(row, bucket)
    theta, bias = first_round(Batches(row, term, len(y), random), y, len(machine.buckets), machine.bias, random)
    use = theta.any(axis=1)
    machine.buckets = machine.buckets[use]
    row, term = row[use[term]], (np.cumsum(use) - 1)[term[use[term]]]
    theta, bias = second_round(Batches(row, term, len(y), random), y, theta[use], bias, random)
    return Machine(machine.buckets, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def labelled_terms(docs: DataFrame, labels: DataFrame, value="toxic", limit=SAMPLE, least_texts=LEAST_TEXTS):
    """(row, bucket, y) of the sample, of buckets in at least ``least_texts`` texts; texts become term sets on the executors."""
    ids = F.broadcast(sampled_ids(labels, value, limit))  # two numbers a row, at most ``limit`` rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "target", "text")

    def run(batches):
        for batch in batches:
            made = []
            for _, n, row, bucket in term_sets(batch.column(2)):
                edges = np.searchsorted(row, np.arange(n + 1))
                made += [bucket[edges[i] : edges[i + 1]].astype(np.int32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "target", "terms"]
            )

    # repeated ids bring more rows than were chosen
    sets = stored(rows.mapInArrow(run, "doc_id string, target double, terms binary").orderBy("doc_id", "terms").limit(limit))

    def counted(batches):
        texts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                texts[np.frombuffer(terms, np.int32)] += 1
        at = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(texts[at])], ["bucket", "n"])

    counts = sets.select("terms").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequent = np.zeros(BUCKETS, bool)
    frequent[counts.where(F.col("n") >= least_texts).select("bucket").toArrow().column(0).to_numpy()] = True

    def known(batches):
        for batch in batches:
            kept = [np.frombuffer(t, np.int32) for t in batch.column(2).to_pylist()]
            kept = pa.array([t[frequent[t]].tobytes() for t in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], ["doc_id", "target", "terms"])

    made = sets.mapInArrow(known, "doc_id string, target double, terms binary").orderBy("doc_id", "terms").toArrow()
    parts = [np.frombuffer(t.as_buffer(), np.int32) for t in made["terms"]]
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(s) for s in parts]) if parts else np.zeros(0, np.int32)
    return row, np.concatenate([*parts, np.zeros(0, np.int32)]), made["target"].to_numpy()


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit=SAMPLE, threshold=0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    short_batches(docs.sparkSession)
    machine = fit(*labelled_terms(docs, labels, limit=limit))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
