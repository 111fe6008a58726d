"""Prompts that a training and a test set share, counted exactly.

The test prompts' hashes set bits of a Bloom filter: bits are or-ed by word in partial
aggregates and the words become one array, which is broadcast (its size is bounded, whatever
the number of prompts). Training rows that the filter lets through, the shared ones and a few
per cent more, are then joined with the test set by the SHA-256 of the prompt. So no training
text is shuffled, and of the training set only the digests of those few rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each test prompt, probes, and the most bits of a filter (16 MB).
BITS, PROBES, MOST_BITS = 12, 5, 1 << 27


def _places(prompt: str, bits: int) -> list:
    """(word, bit) as SQL for each probe; the text is hashed once."""
    at = [f"pmod(xxhash64({k}, xxhash64({prompt})), {bits})" for k in range(PROBES)]
    return [(f"{p} DIV 64", f"shiftleft(1L, CAST({p} % 64 AS INT))") for p in at]


def bloom_filter(rows: DataFrame, prompt="prompt", bits=None) -> tuple[DataFrame, int]:
    """(one row with ``words``, an array of 64-bit words, and the number of bits) of the prompts of ``rows``."""
    if bits is None:
        n = max(1, rows.where(F.col(prompt).isNotNull()).count())
        bits = min(MOST_BITS, max(64, 1 << (n * BITS - 1).bit_length()))
    pairs = ", ".join(f"struct({w} AS word, {b} AS bit)" for w, b in _places(prompt, bits))
    probes = rows.where(F.col(prompt).isNotNull()).selectExpr(f"inline(array({pairs}))")
    words = probes.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = rows.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    # bits / 64 words at most
    return every.agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(bit, 0L) AS bit))), w -> w.bit) AS words")), bits


def maybe_in(rows: DataFrame, words: DataFrame, bits: int, prompt="prompt") -> DataFrame:
    """Rows whose prompt may be among those of the filter; one that is among them always stays."""
    tests = " AND ".join(f"(element_at(words, CAST({w} AS INT) + 1) & {b}) <> 0" for w, b in _places(prompt, bits))
    return rows.where(F.col(prompt).isNotNull()).withColumn("words", words.scalar()).where(tests).drop("words")


def shared_prompts(train: DataFrame, test: DataFrame, prompt="prompt", bits=None) -> DataFrame:
    """(digest, n_train, n_test) of every prompt that both tables hold."""
    words, bits = bloom_filter(test, prompt, bits)

    def digests(rows, name):
        return rows.select(F.sha2(prompt, 256).alias("digest")).groupBy("digest").agg(F.count("*").alias(name))

    few = digests(maybe_in(train.select(prompt), words, bits, prompt), "n_train")
    return few.join(digests(test.where(F.col(prompt).isNotNull()), "n_test"), "digest")


def overlap(train: DataFrame, test: DataFrame, prompt="prompt", bits=None) -> DataFrame:
    """One row: (n_prompts, n_train, n_test) distinct shared prompts and the rows of either table that hold one."""
    return shared_prompts(train, test, prompt, bits).agg(
        F.count("*").alias("n_prompts"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("n_test"), F.lit(0)).alias("n_test"),
    )
