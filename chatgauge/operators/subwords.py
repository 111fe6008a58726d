"""Length caps in the tokens of a model's vocabulary.

Texts go to Arrow batches of one column (at most Spark's 64 MB each), read text by text; nothing is
shuffled. Counts and caps of one plan run in the same Python worker, one for each task, with one memory
of pieces. The vocabulary, read by Spark from a path the caller names, is broadcast (its number of
entries is checked). A cap reads a text only up to the cut, a count reads all of it. What a cap keeps is
a prefix of the text: a token may end inside a character, which then falls away.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.subwords import PATTERN, read_ranks, worker_subwords
from ..functions.text import truncated


class Vocabulary:
    """A rank file made known to all workers of a session."""

    def __init__(self, spark, path, pattern=PATTERN):
        self.ranks, self.pattern = spark.sparkContext.broadcast(read_ranks(spark, path)), pattern


# Plain Arrow functions, not iterators: Spark runs several of them in one worker, iterators in a worker each.


def with_token_count(df: DataFrame, column: str, vocabulary: Vocabulary, name="n_tokens") -> DataFrame:
    """Add the number of tokens of a text column; null for null."""
    ranks, pattern = vocabulary.ranks, vocabulary.pattern

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        words = worker_subwords(ranks.value, pattern)
        return pa.array([words.count(t.as_py()) if t.is_valid else None for t in texts], pa.int64())

    return df.withColumn(name, count(column))


def token_capped(df: DataFrame, column: str, n: int, vocabulary: Vocabulary, flag=None, size=None) -> DataFrame:
    """Cut a text column after its first ``n`` tokens; null stays null.

    ``flag`` names a column that says whether tokens were left out, ``size`` one with the
    bytes of the tokens kept.
    """
    ranks, pattern = vocabulary.ranks, vocabulary.pattern

    @F.arrow_udf("text string, cut boolean, size long")
    def cut(texts: pa.Array) -> pa.Array:
        words = worker_subwords(ranks.value, pattern)
        rows = []
        for x in texts:
            t = x.as_py()
            if t is None:
                rows.append((None, None, None))
                continue
            kept, more = words.cut(t, n)
            rows.append((t.encode()[:kept].decode("utf-8", "ignore") if more else t, more, kept))
        kinds = {"text": pa.string(), "cut": pa.bool_(), "size": pa.int64()}
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds)
        )

    staged = df.withColumn("_cut", cut(column))
    kept = [F.col("_cut.text").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    extra = [F.col(f"_cut.{field}").alias(c) for field, c in (("cut", flag), ("size", size)) if c]
    return staged.select(*kept, *extra)


def capped(df: DataFrame, column: str, n: int, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Cut after n tokens of the vocabulary, or blank-separated ones without a vocabulary."""
    return token_capped(df, column, n, vocabulary) if vocabulary else truncated(df, column, n)
