"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of a text are byte-class and word counts, made for a batch of whole texts at once
in numpy. Trees are grown on the driver from a bounded sample of labelled rows: each feature
is cut into at most BINS quantile bins, a split is the best cut of the per-bin sums of
gradients and hessians. The grown trees are flattened into arrays (feature, cut, left, right,
value), and all rows of a batch walk a tree together, level by level.

Only rows outside fold 0 are learned from; SAMPLE bounds their number (chosen by a hash of
the id). Defined results: null and empty texts have all-zero statistics and a score; without
labelled rows, or with one class only, the score is the smoothed mean label for all; repeated
rows score alike; a repeated labelled id counts once with its mean label; an empty table
gives an empty result. Further columns of any name do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, SPACES, held_out, sampled_ids, short_batches, span_hashes, steps, tokens

SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 10, 1.0
FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "upper", "digits", "symbols", "stops", "shouts",
    "pipes", "commas", "lines", "high_bytes", "distinct", "adjacent", "repeated_pairs", "suffixed", "capital_words",
    "repeated_lines", "other",
)


def _class_table():
    table = np.full(256, 10, np.uint8)
    table[128:] = 1
    for k, chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b".", b"!?", b"|",
        b",;:", b"\n", b"",
    )):
        table[list(chars)] = k
    table[SPACES & (np.arange(256) != 10)] = 11
    return table


_CLASSES = _class_table()


def _sums(values, row, n):
    return np.bincount(row, weights=values, minlength=n)


def _repeated(hashes, row, n):
    """Per row, entries that equal an earlier one of the same row."""
    if not len(hashes):
        return np.zeros(n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][same], minlength=n).astype(float)


def statistics(texts) -> np.ndarray:
    """(texts x FEATURES) numbers of an Arrow array of texts."""
    out = [np.zeros((0, len(FEATURES)))]
    for low, high, data, offsets in steps(texts):
        n = high - low
        owner = np.repeat(np.arange(n), np.diff(offsets))
        kinds = np.bincount(owner * 12 + _CLASSES[data], minlength=12 * n).reshape(n, 12).astype(float)
        start, end, row = tokens(data, offsets, ~SPACES)
        size = end - start
        words = np.bincount(row, minlength=n).astype(float)
        per_word, chars = np.maximum(words, 1), np.maximum(_sums(size, row, n), 1)
        mean = _sums(size, row, n) / per_word
        spread = np.sqrt(np.maximum(_sums(size.astype(float) ** 2, row, n) / per_word - mean**2, 0))
        hashes = span_hashes(data, start, end)
        together = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        adjacent = np.bincount(row[1:][together & (hashes[1:] == hashes[:-1])], minlength=n) if len(row) else np.zeros(n)
        pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[together] if len(row) else hashes
        pair_rows = row[1:][together] if len(row) else row
        upper = _CLASSES[data] == 2
        shouted = upper[start] & upper[np.minimum(start + 1, len(data) - 1)] & (size > 1) if len(start) else np.zeros(0, bool)
        symbol = ~ALNUM[data[end - 1]] & ~ALNUM[data[np.maximum(end - 2, 0)]] & (size > 2) if len(start) else np.zeros(0, bool)
        not_break = np.ones(256, bool)
        not_break[10] = False
        line_start, line_end, line_row = tokens(data, offsets, not_break)
        lines = np.bincount(line_row, minlength=n).astype(float)
        again = _repeated(span_hashes(data, line_start, line_end), line_row, n)
        out.append(np.stack([
            np.log1p(words), mean, spread, _sums(size > 15, row, n) / per_word, kinds[:, 2] / chars, kinds[:, 3] / chars,
            kinds[:, 4] / per_word, kinds[:, 5] / per_word, kinds[:, 6] / per_word, kinds[:, 7] / per_word,
            kinds[:, 8] / per_word, kinds[:, 9] / per_word, kinds[:, 1] / chars,
            1 - _repeated(hashes, row, n) / per_word, adjacent / per_word, _repeated(pairs, pair_rows, n) / per_word,
            _sums(symbol, row, n) / per_word, _sums(shouted, row, n) / per_word, again / np.maximum(lines, 1),
            kinds[:, 10] / chars,
        ], axis=1))
    return np.concatenate(out)


class Trees:
    """Boosted trees as flat arrays; node 0 of each tree is its root, a leaf points to itself."""

    def __init__(self, base):
        self.base, self.depth = base, 0
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def close(self):
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.asarray(getattr(self, name), np.int64))
        self.cut, self.value = np.asarray(self.cut, float), np.asarray(self.value, float)
        return self

    def margins(self, x):
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def _grow(trees, binned, cuts, gradient, hessian, rows, depth):
    """Add the subtree of ``rows``; returns its node and fills ``trees``."""
    node = len(trees.feature)
    g, h = gradient[rows].sum(), hessian[rows].sum()
    for name, x in (("feature", 0), ("cut", 0.0), ("left", node), ("right", node), ("value", -RATE * g / (h + RIDGE))):
        getattr(trees, name).append(x)
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return node
    n_features = binned.shape[1]
    flat = (binned[rows].astype(np.int64) + np.arange(n_features) * BINS).ravel()
    sums = [
        np.bincount(flat, weights=np.repeat(w, n_features), minlength=n_features * BINS).reshape(n_features, BINS).cumsum(1)
        for w in (gradient[rows], hessian[rows], np.ones(len(rows)))
    ]
    gl, hl, nl = sums
    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
        return node
    trees.feature[node], trees.cut[node] = int(f), float(cuts[f][b])
    goes = binned[rows, f] <= b
    trees.left[node] = _grow(trees, binned, cuts, gradient, hessian, rows[goes], depth - 1)
    trees.right[node] = _grow(trees, binned, cuts, gradient, hessian, rows[~goes], depth - 1)
    return node


def fit(x, y, n_trees=TREES, depth=DEPTH) -> Trees:
    """Boosted trees for the log loss of labels y in [0, 1]."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return trees.close()
    trees.depth = depth
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    margin, every = np.full(len(y), trees.base), np.arange(len(y))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(trees.feature)
        trees.roots.append(_grow(trees, binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), every, depth))
        at = np.full(len(y), first)
        feature, cut = np.asarray(trees.feature), np.asarray(trees.cut)
        left, right = np.asarray(trees.left), np.asarray(trees.right)
        for _ in range(depth):
            at = np.where(x[every, feature[at]] <= cut[at], left[at], right[at])
        margin = margin + np.asarray(trees.value)[at]
    return trees.close()


def labelled_statistics(docs: DataFrame, labels: DataFrame, value="quality", limit=SAMPLE):
    """(x, y) of the sample; texts become statistics on the executors, only these are collected."""
    ids = F.broadcast(sampled_ids(labels, value, limit))  # two numbers a row, at most ``limit`` rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "target", "text")

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())],
                ["doc_id", "target", "x"],
            )

    made = rows.mapInArrow(run, "doc_id string, target double, x binary").orderBy("doc_id", "x").limit(limit).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in made), float).reshape(len(made), len(FEATURES))
    return x, np.array([r["target"] for r in made], float)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = pa.array(trees.scores(statistics(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, limit=SAMPLE, threshold=0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    short_batches(docs.sparkSession)
    trees = fit(*labelled_statistics(docs, labels, limit=limit))
    return score(docs, trees).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
