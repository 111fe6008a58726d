"""Helpers of the corpus operators: word arithmetic on Arrow text, splits and small tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch handed to Python; texts are long, so batches are kept short.
BATCH_ROWS = 1000
#: Bytes of text that one numpy step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    ALNUM[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of whole texts hold few rows, so that a worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from the files (survives lost executors)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, compression="snappy") -> DataFrame:
    """Like ``cut`` by a Parquet table of its own in the shared folder: for large tables of numbers."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of the contract's pattern; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; fold 0 is held out. Null ids have no fold."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sampled_ids(labels: DataFrame, value: str, limit: int) -> DataFrame:
    """(doc_id, target) of at most ``limit`` labelled ids outside fold 0, in the order of a hash.

    A repeated id counts once with its mean label; rows without id or label are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).where(fold(F.col("doc_id")) != 0)
    means = ids.groupBy("doc_id").agg(F.avg(F.col(value).cast("double")).alias("target"))
    return means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def steps(texts: pa.Array):
    """(first row, last row, bytes, offsets) for runs of rows of about STEP_BYTES; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    _, spans, data = texts.buffers()
    offsets = np.frombuffer(spans, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + STEP_BYTES, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(start, end, row) of every run of bytes in ``inside``; no run crosses a document's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial (all spans at once)."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, row: np.ndarray, n: int):
    """(hash, row) of every run of n words inside one document."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(words) - n + 1
    total = words[:last].copy()
    for k in range(1, n):
        total = mix(total * _ODD + words[k : k + last])
    whole = row[:last] == row[n - 1 :]
    return total[whole], row[:last][whole]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
