"""Stored evaluations: confusion counts by batch, which add up without scoring anything again.

A batch of scored examples is stored as its confusion counts, at most classes^2 rows a task.
Withdrawing examples stores their counts with the sign turned. Every metric is made from the
sum. Rows of a batch carry its name, and equal rows of one batch count once, so an append
that is repeated after a failure changes nothing; different rows under one name fail.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import confusion

SCHEMA = "batch STRING, task STRING, expected STRING, predicted STRING, n BIGINT"


def append_scored(scored: DataFrame, path, batch, sign=1):
    """Add the examples (task, expected, predicted) of a batch."""
    counts = confusion(scored).select(F.lit(batch).alias("batch"), "task", "expected", "predicted", (F.col("n") * sign).alias("n"))
    counts.write.mode("append").parquet(path)


def withdraw_scored(scored: DataFrame, path, batch):
    """Take examples that were added before out again; ``batch`` names the withdrawal."""
    append_scored(scored, path, batch, sign=-1)


def merge_counts(log: DataFrame) -> DataFrame:
    """(task, expected, predicted, n) of everything added and not withdrawn."""
    cell = ["task", "expected", "predicted"]
    once = log.groupBy("batch", *cell).agg(F.max("n").alias("n"), F.min("n").alias("least"))
    differs = F.raise_error(F.concat(F.lit("two contents of batch "), "batch")).cast("bigint")
    sums = once.select(*cell, F.when(F.col("n") == F.col("least"), F.col("n")).otherwise(differs).alias("n"))
    total = sums.groupBy(*cell).agg(F.sum("n").alias("n")).where("n <> 0")
    short = F.raise_error(F.lit("more examples were withdrawn than added")).cast("bigint")
    return total.select(*cell, F.when(F.col("n") > 0, F.col("n")).otherwise(short).alias("n"))


def stored_counts(spark: SparkSession, path) -> DataFrame:
    """Merged counts of an evaluation; one that is not there yet is empty."""
    try:
        log = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], SCHEMA)
    return merge_counts(log)
