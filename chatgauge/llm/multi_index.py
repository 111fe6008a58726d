"""Hard negatives by an inverted multi-index.

A row's vector is cut into two halves; each half has a codebook (k-means on a bounded sample)
and a row's cell is its pair of nearest codewords. For a query q a codeword c with radius r
bounds the half's part of the score by q.c + |q| r, so a cell is bounded by the sum of two
numbers, and the multi-sequence heap visits cells by falling bound. A search ends when the
next bound is below what is still wanted: the last of the first rows found, or the lower end
of every window that is not full. Nothing past that point can matter, so results are exact;
the codebooks only decide how many cells are looked at.

The index holds every row. It is dealt by a hash of vec_id into shards of about SHARD_ROWS
rows, each with radii of its own, and the queries into blocks of BLOCK anchors; one group is
one shard with one block, so a task holds neither all rows nor all anchors. What shards
find is merged by a ranking per anchor. Positives are found first, then the windows that
their scores open, as two such passes over the same stored index.

Scores are integer inner products of floor(256 x); they are computed in doubles where all
sums stay below 2**53, else as 64-bit integers, and beyond those the job fails.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component,
take no part; of rows with equal vec_id the least (label, vector) takes part; missing
components of shorter vectors are zero; ties go to the smaller vec_id; an anchor without
positives, or a positive without rows in its window, has no row; an empty table gives an
empty result. Further columns of any name do not matter.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS, BLOCK = 16_384, 4_096
#: Codewords of a half, and rows from which they are learned (chosen by a hash of vec_id).
CODES, SAMPLE, ROUNDS = 16, 4_096, 12
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's: fixed values of the contract.
LOW, HIGH = 50, 95
#: Rows scored at once: cells are taken from the heap until so many are together.
TOGETHER = 512


def matrix(column, dims) -> np.ndarray:
    """Rows of an Arrow list column as one matrix, short ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dims), np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    out[at, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact(*tables):
    """The tables as doubles if every inner product stays exact, else as 64-bit integers."""
    most = 1
    for t in tables:
        most *= int(np.abs(t).max(initial=0))
    most *= max([t.shape[1] for t in tables] + [1])
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors exceed 64 bits")
    return [t.astype(np.float64) for t in tables] if most < 1 << 53 else list(tables)


def codebook(rows, codes=CODES, rounds=ROUNDS, seed=11) -> np.ndarray:
    """k-means codewords of the rows (fewer than ``codes`` if there are fewer distinct rows)."""
    rows = np.unique(rows.astype(np.float64), axis=0)
    if len(rows) <= codes:
        return rows if len(rows) else np.zeros((1, rows.shape[1]))
    words = rows[np.random.default_rng(seed).choice(len(rows), codes, replace=False)]
    for _ in range(rounds):
        near = nearest(rows, words)
        for k in np.unique(near):
            words[k] = rows[near == k].mean(0)
    return words


def nearest(rows, words) -> np.ndarray:
    return ((words**2).sum(1) - 2 * rows @ words.T).argmin(1)


class MultiIndex:
    """Rows of one shard, ordered by cell."""

    def __init__(self, ids, labels, vectors, books):
        self.half = books[0].shape[1]
        self.books = books
        parts = vectors[:, : self.half].astype(np.float64), vectors[:, self.half :].astype(np.float64)
        codes = [nearest(p, b) for p, b in zip(parts, books)]
        self.radii = []
        for p, b, c in zip(parts, books, codes):
            away = np.sqrt(((p - b[c]) ** 2).sum(1))
            radius = np.zeros(len(b))
            np.maximum.at(radius, c, away)
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.slack = 1e-9 * float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)).max(initial=0))

    def visits(self, q):
        """(upper bound, lower bound, first row, end) of the cells that have rows, by falling upper bound."""
        q = q.astype(np.float64)
        tops, lows = [], []
        for part, book, radius in zip((q[: self.half], q[self.half :]), self.books, self.radii):
            middle, reach = book @ part, np.sqrt(part @ part) * radius
            tops.append(middle + reach)
            lows.append(middle - reach)
        orders = [np.argsort(-t, kind="stable") for t in tops]
        (a, b), n = [t[o].tolist() for t, o in zip(tops, orders)], len(tops[1])
        slack = self.slack * float(np.sqrt(q @ q)) + 1e-9
        heap, taken = [(-(a[0] + b[0]), 0, 0)], set()
        while heap:
            bound, i, j = heapq.heappop(heap)
            taken.add((i, j))
            # a neighbour is offered once both cells before it are taken
            if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in taken):
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
            if j + 1 < n and (i == 0 or (i - 1, j + 1) in taken):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            x, y = orders[0][i], orders[1][j]
            low, high = self.starts[x * n + y], self.starts[x * n + y + 1]
            if low < high:
                yield slack - bound, lows[0][x] + lows[1][y] - slack, low, high

    def groups(self, q, wanted, below=None):
        """Row numbers of cells together, until the next bound is under ``wanted()``; cells wholly over ``below`` are passed over."""
        spans, size = [], 0
        for top, low, first, end in self.visits(q):
            if top < wanted():
                break
            if below is not None and low > below:
                continue
            spans.append(np.arange(first, end))
            size += end - first
            if size >= TOGETHER:
                yield np.concatenate(spans)
                spans, size = [], 0
        if spans:
            yield np.concatenate(spans)

    def positives(self, q, own, label, k=POSITIVES):
        """(ids, scores) of the first k other rows of the label."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        for rows in self.groups(q, lambda: scores[-1] if len(scores) == k else -np.inf):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != own)]
            ids, scores = first(np.append(ids, self.ids[rows]), np.append(scores, self.vectors[rows] @ q), k)
        return ids, scores.astype(np.int64)

    def negatives(self, q, label, windows, k=NEGATIVES):
        """For each (low, high) the (ids, scores) of the first k rows of other labels inside it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)) for _ in windows]

        def wanted():
            return min(max(low, s[-1]) if len(s) == k else low for (low, _), (_, s) in zip(windows, found))

        for rows in self.groups(q, wanted, max((high for _, high in windows), default=0)) if windows else ():
            rows = rows[self.labels[rows] != label]
            scores = self.vectors[rows] @ q
            for w, (low, high) in enumerate(windows):
                inside = (scores >= low) & (scores <= high)
                if inside.any():
                    ids, had = found[w]
                    found[w] = first(np.append(ids, self.ids[rows[inside]]), np.append(had, scores[inside]), k)
        return [(ids, scores.astype(np.int64)) for ids, scores in found]


def first(ids, scores, k):
    """The k first by falling score, then by id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def integer_rows(embeddings: DataFrame, mixed_every=7, n_labels=10) -> DataFrame:
    """(vec_id, label, v): rows that take part, one for each vec_id, label changed where vec_id is divisible by ``mixed_every``."""
    clean = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = embeddings.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {clean}").selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id",
        f"CAST(if(vec_id % {mixed_every} = 0, pmod(label + 1, {n_labels}), label) AS BIGINT) AS label",
        "transform(embedding, x -> CAST(floor(256D * CAST(x AS DOUBLE)) AS BIGINT)) AS v",
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.label", "least.v")


def learned_books(rows: DataFrame, dims: int, sample=SAMPLE):
    """Two codebooks, learned from at most ``sample`` rows."""
    some = rows.select(F.xxhash64("vec_id").alias("key"), "vec_id", "v").orderBy("key", "vec_id").limit(sample).select("v").toArrow()
    vectors = matrix(some.column(0), dims)
    return codebook(vectors[:, : dims // 2]), codebook(vectors[:, dims // 2 :])


def _tables(shard, block, dims, books):
    """The index of a shard's rows and the anchors' vectors, in one number type."""
    vectors, queries = exact(matrix(shard["v"], dims), matrix(block["q"], dims))
    index = MultiIndex(shard["vec_id"].to_numpy(), shard["label"].to_numpy(), vectors, books)
    return index, queries


def _table(schema, rows):
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(np.array(c, np.int64)) for c in columns], schema)


def hard_negatives(
    embeddings: DataFrame, anchor_every=50, positives=POSITIVES, negatives=NEGATIVES, low=LOW, high=HIGH,
    shard_rows=SHARD_ROWS, block=BLOCK, sample=SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``anchor_every``.
    """
    spark = embeddings.sparkSession
    rows = stored(integer_rows(embeddings))
    n, n_anchors, dims = rows.agg(
        F.count("*"), F.count_if(F.col("vec_id") % anchor_every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))
    ).first()
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    if not n_anchors:
        return spark.createDataFrame([], ", ".join(f"{c} BIGINT" for c in names)).withColumn("rank", F.lit(0))
    dims = max(dims, 2)  # both halves have a component, if only zeros
    books = learned_books(rows, dims, sample)
    n_shards, n_blocks = -(-n // shard_rows), -(-n_anchors // block)

    def dealt(name, n_parts):
        return F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(n_parts)).cast("int")

    def everywhere(column, n_parts):
        return F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias(column)

    shards = rows.select("vec_id", "label", "v", dealt("shard", n_shards).alias("shard"), everywhere("block", n_blocks))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(
        "vec_id", F.col("label").alias("own"), F.col("v").alias("q"), dealt("block", n_blocks).alias("block")
    )

    def searched(asked, search, columns):
        """``search(index, query, anchor)`` for every anchor of a block in every shard."""

        def run(shard, block):
            found = []
            if shard.num_rows and block.num_rows:
                index, queries = _tables(shard, block, dims, books)
                for k, anchor in enumerate(block.drop_columns(["q"]).to_pylist()):
                    found += search(index, queries[k], anchor)
            return _table(columns, found)

        blocks = asked.select("*", everywhere("shard", n_shards))
        together = shards.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block"))
        return together.applyInArrow(run, ", ".join(f"{c} long" for c in columns))

    def near(index, q, anchor):
        ids, scores = index.positives(q, anchor["vec_id"], anchor["own"], positives)
        return [(anchor["vec_id"], i, s) for i, s in zip(ids, scores)]

    ranked = W.partitionBy("vec_id").orderBy(F.desc("score"), "id")
    chosen = searched(anchors, near, ["vec_id", "id", "score"]).withColumn("place", F.row_number().over(ranked))
    chosen = chosen.where(F.col("place") <= positives).groupBy("vec_id").agg(
        F.collect_list(F.struct("id", "score")).alias("near")  # at most ``positives`` entries
    )
    asked = stored(anchors.join(chosen, "vec_id"))

    def windowed(index, q, anchor):
        near = anchor["near"]
        spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in near]
        asked_of = [k for k, (a, b) in enumerate(spans) if a <= b]
        found = index.negatives(q, anchor["own"], [spans[k] for k in asked_of], negatives)
        return [
            (anchor["vec_id"], near[k]["id"], i, near[k]["score"], s)
            for k, (ids, scores) in zip(asked_of, found) for i, s in zip(ids, scores)
        ]

    ranked = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    merged = searched(asked, windowed, names).withColumn("rank", F.row_number().over(ranked))
    return merged.where(F.col("rank") <= negatives)
