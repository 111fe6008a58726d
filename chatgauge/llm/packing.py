"""Packing by optimal length buckets.

The histogram of all lengths decides the bucket bounds: dynamic programming finds those that
minimise the padding of the whole corpus exactly. Batches of a token budget then form inside
each bucket. A document longer than the longest sequence is cut into pieces, none is dropped.

The histogram has at most ``longest`` rows, whatever the corpus, and is all that the driver
sees. Buckets are dealt over shards by a hash of the document, as many as the histogram asks
for, so a bucket that holds most rows is not one task's work; each shard numbers its own
rows, and ends with one batch that may not be full.

Defined results: a document without tokens (null, empty) has one row with a null bucket and
batch; repeated rows are packed each; an empty table gives an empty result; a length on a
bound belongs to that bucket; with fewer distinct lengths than buckets there are fewer
buckets. Further columns of any name do not matter.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, word_count

LONGEST, BUCKETS, BUDGET = 2048, 8, 16384
SHARD_ROWS = 50_000


def best_bounds(lengths, counts, buckets=BUCKETS):
    """Bucket bounds (subset of the lengths, the largest included) of least total padding.

    cost(i, j) pads lengths i..j to the j-th; best[j] after k buckets is the minimum over i of
    best[i - 1] with k - 1 buckets plus cost(i, j). Ties take the smallest i.
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    rows = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * x)])
    m = len(x)
    far = np.iinfo(np.int64).max // 4
    best, cuts = np.full(m + 1, far, np.int64), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        new, cut_at = np.full(m + 1, far, np.int64), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            padded = best[:j] + (rows[j] - rows[:j]) * x[j - 1] - (tokens[j] - tokens[:j])
            cut_at[j] = int(np.argmin(padded))
            new[j] = padded[cut_at[j]]
        best = new
        cuts.append(cut_at)
    bounds, j = [], m
    for cut_at in reversed(cuts):
        bounds.append(int(x[j - 1]))
        j = int(cut_at[j])
        if j == 0:
            break
    return bounds[::-1]


def pieces(docs: DataFrame, longest=LONGEST) -> DataFrame:
    """(doc_id, piece, first_token, length): whole texts in pieces of at most ``longest`` words."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("tokens"))
    return sized.selectExpr(
        "doc_id", "tokens", f"explode(sequence(0L, greatest(0L, tokens - 1) DIV {longest})) AS piece"
    ).selectExpr(
        "doc_id", "piece", f"piece * {longest} AS first_token", f"least({longest}, tokens - piece * {longest}) AS length"
    )


def pack(docs: DataFrame, longest=LONGEST, buckets=BUCKETS, budget=BUDGET, shard_rows=SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, length, bucket, padded, shard, batch, slot), a row for each piece.

    ``padded`` is the bucket's bound; a batch (bucket, shard, batch) holds budget // padded
    pieces, one at least.
    """
    cutted = cut(pieces(docs, longest))
    histogram = cutted.where("length > 0").groupBy("length").count().collect()  # at most ``longest`` rows
    bounds = best_bounds([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    lows = [0, *bounds[:-1]]
    held = [sum(r["count"] for r in histogram if low < r["length"] <= high) for low, high in zip(lows, bounds)]
    facts = [
        (k, high, max(1, -(-n // shard_rows)), max(1, budget // high)) for k, (high, n) in enumerate(zip(bounds, held))
    ]
    choice = "CASE " + " ".join(
        f"WHEN length BETWEEN 1 AND {high} THEN named_struct('bucket', {k}, 'padded', {high}L, 'shards', {s}, 'room', {room})"
        for k, high, s, room in facts
    ) + " END" if facts else "CAST(NULL AS STRUCT<bucket: INT, padded: BIGINT, shards: INT, room: INT>)"
    mixed = F.xxhash64("doc_id", "piece")
    dealt = cutted.withColumn("b", F.expr(choice)).select(
        "doc_id", "piece", "first_token", "length", F.col("b.bucket").alias("bucket"), F.col("b.padded").alias("padded"),
        # rows without tokens need no order; they are spread like the others
        F.pmod(F.xxhash64(mixed), F.coalesce(F.col("b.shards"), F.lit(1)).cast("long")).cast("int").alias("shard"),
        F.coalesce(F.col("b.room"), F.lit(1)).alias("room"), mixed.alias("order_key"),
    )
    within = Window.partitionBy("bucket", "shard").orderBy("order_key", "doc_id", "piece", "length")
    full = dealt.where("bucket IS NOT NULL").withColumn("n", F.row_number().over(within) - 1)
    empty = dealt.where("bucket IS NULL").withColumn("n", F.lit(None).cast("int"))
    return full.unionByName(empty).selectExpr(
        "doc_id", "piece", "first_token", "length", "bucket", "padded", "if(n IS NULL, NULL, shard) AS shard",
        "n DIV room AS batch", "CAST(n % room AS INT) AS slot",
    )
