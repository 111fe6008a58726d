"""Mixing sources to target weights with equal-token blocks and Sainte-Laguë quotas.

Each source's documents are put in a seeded order in shards of bounded size, and every
shard's stream of words is cut into equal blocks. Blocks are given to sources by highest
quotients v / (2k - 1) (v: the ideal number), a source's blocks to its shards likewise, and
within a shard a seeded run of blocks, round the end of the stream, is taken once more than
the rest. As the order of documents is random, a run is a random sample of documents, and
only those at its ends are taken in part. What a document gives follows from its place in
the stream by arithmetic, so blocks are never rows.

What goes to the driver: one row per source (a mix states a weight for each, so their number
is that of the recipe) and one per shard, at most MAX_SHARDS a source.

Defined results: null texts have size 0 and give nothing; a null source is a source of its
own, last in order; a null doc_id is ordered like an empty one; equal rows may change places,
which the result doesn't show; an empty table or one without words gives targets and takings
of 0. Further columns of any name do not matter. Reruns agree.
"""

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK = 64
SHARD_WORDS, MAX_SHARDS = 2_000_000, 4096
SEED = "mix"
PLAN = (
    "plan_source STRING, plan_shard LONG, plan_size LONG, plan_target DOUBLE, plan_all LONG, "
    "low1 LONG, high1 LONG, low2 LONG, high2 LONG"
)


def targets(sizes, weights, share=SHARE, most=MOST):
    """Target words per source: in proportion to the weights, none above ``most`` times its size.

    ``sizes`` and ``weights`` are lists. Sources are filled in the order of the level at
    which they stop; what they leave is shared by the others.
    """
    total, caps = share * sum(sizes), [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight, level = total, sum(weights), None
    for i in order:
        level = left / weight
        if level <= caps[i] / weights[i]:
            break
        left, weight, level = left - caps[i], weight - weights[i], None
    return [caps[i] if level is None else min(float(caps[i]), weights[i] * level) for i in range(len(sizes))]


def sainte_lague(ideal, most, seats):
    """Integer quotas: ``seats`` go one by one to the highest quotient ideal / (2 k + 1).

    ``most`` bounds each quota; earlier entries win ties. Starts two below each ideal number
    (whose quotients are above any that the last seats reach), so few seats go by the heap.
    """
    quota = [max(0, min(m, int(v) - 2)) for v, m in zip(ideal, most)]
    while sum(quota) > seats:
        quota = [max(0, q - 1) for q in quota]
    heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(ideal, quota, most)) if q < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(quota)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        quota[i] += 1
        if quota[i] < most[i]:
            heapq.heappush(heap, (-ideal[i] / (2 * quota[i] + 1), i))
    return quota


def _key(seed):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _number(digest):
    """A number below 2^32 of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _blocks(words, block):
    return max(1, (2 * words + block) // (2 * block)) if words else 0


def plan_mix(shards, weights=WEIGHTS, share=SHARE, block=BLOCK, seed=SEED):
    """Rows of PLAN from (source, shard, words) rows."""
    import hashlib

    of = defaultdict(list)
    for source, shard, words in shards:
        of[source].append((shard, words))
    sources = sorted((s for s in of if s is not None)) + [None] * (None in of)
    sizes = [sum(w for _, w in of[s]) for s in sources]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share)
    counts = [sum(_blocks(w, block) for _, w in of[s]) for s in sources]
    ideal = [aim * n / size if size else 0.0 for aim, n, size in zip(aims, counts, sizes)]
    quotas = sainte_lague(ideal, [MOST * n for n in counts], int(sum(ideal) + 0.5))
    rows = []
    for source, size, aim, n, quota in zip(sources, sizes, aims, counts, quotas):
        own = sorted(of[source])
        blocks = [_blocks(w, block) for _, w in own]
        parts = sainte_lague([quota * b / n if n else 0.0 for b in blocks], [MOST * b for b in blocks], quota)
        for (shard, words), b, q in zip(own, blocks, parts):
            whole, extra = divmod(q, b) if b else (0, 0)
            digest = hashlib.md5(f"{seed}|{'' if source is None else source}|{shard}".encode()).hexdigest()
            first = int(digest[:8], 16) % b if b else 0
            edge = lambda k, w=words, b=b: k * w // b if b else 0
            last = first + extra
            rows.append((
                source, shard, size, float(aim), whole, edge(first), edge(min(last, b)), 0, edge(max(0, last - b)),
            ))
    return rows


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, block=BLOCK, seed=SEED, shard_words=SHARD_WORDS,
        keep=()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, whole, extra_from, extra_to, wrapped_to).

    A document gives its words ``whole`` times, and the words from ``extra_from`` to
    ``extra_to`` and those before ``wrapped_to`` once more. ``keep`` names columns to carry.
    """
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep))
    source = F.col("source")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()
    shards = [(r["source"], max(1, min(MAX_SHARDS, -(-r["words"] // shard_words)))) for r in by_source]
    split = F.broadcast(spark.createDataFrame(shards, "split_source STRING, n_shards LONG"))
    placed = (
        sized.join(split, source.eqNullSafe(F.col("split_source"))).drop("split_source")
        .withColumn("order_key", _key(seed)).withColumn("shard", _number(F.col("order_key")) % F.col("n_shards"))
    )
    sums = placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()
    rows = plan_mix([tuple(r) for r in sums], weights, share, block, seed)
    plan = F.broadcast(spark.createDataFrame(rows, PLAN))
    before = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size")
    streamed = placed.withColumn(
        "stop", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("start", F.col("stop") - F.col("size"))
    met = streamed.join(
        plan, source.eqNullSafe(F.col("plan_source")) & (F.col("shard") == F.col("plan_shard"))
    )
    inside = "greatest(0L, least(stop, {1}) - greatest(start, {0}))".format
    return met.selectExpr(
        "doc_id", "source", "size", "plan_size AS source_size", "plan_target AS target",
        f"plan_all * size + {inside('low1', 'high1')} + {inside('low2', 'high2')} AS taken",
        "plan_all AS whole", "greatest(0L, low1 - start) AS extra_from", "least(size, high1 - start) AS extra_to",
        "least(size, high2 - start) AS wrapped_to", *keep,
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: columns of ``docs``, one row for each copy taken.

    A copy taken in part holds the taken words, joined by blanks.
    """
    chosen = mix(docs.withColumn("row_of_mix", F.struct(*docs.columns)), keep=("row_of_mix",), **options)
    part = (
        r"array_join(filter(regexp_extract_all(coalesce(row_of_mix.text, ''), r'" + r"[^\x20\x09-\x0D]+" + r"', 0), "
        "(w, i) -> (i >= extra_from AND i < extra_to) OR i < wrapped_to), ' ')"
    )
    copies = chosen.where("taken > 0").selectExpr(
        "row_of_mix", "size", "whole", "extra_from", "extra_to", "wrapped_to", "taken - whole * size AS extra",
        "explode(sequence(1, CAST(whole AS INT) + if(taken > whole * size, 1, 0))) AS copy",
    )
    text = f"if(copy <= whole OR extra = size, row_of_mix.text, {part})"
    return copies.select(*[
        F.expr(text).alias(c) if c == "text" else F.col("row_of_mix")[c].alias(c) for c in docs.columns
    ])
