"""Registry of evaluated models: an append-only parquet table, an observed-remove set.

Every registered entry has an id of its own. Removing a name appends a mark for each entry of
that name which the removal has read, so no file is ever rewritten, writers do not lose each
other's rows, and an entry that a removal has not seen stays, whenever its rows land. A
listing is the entries without a mark. ``version``, one above all that an append has read,
only orders listings; ``registered_at`` is information only.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "name STRING, task STRING, path STRING, accuracy DOUBLE, f1 DOUBLE, size_mb DOUBLE, "
    "registered_at TIMESTAMP, seq BIGINT, removed BOOLEAN, version BIGINT, entry_id STRING"
)
FIELDS = ["name", "task", "path", "accuracy", "f1", "size_mb"]


def entry_name(task, model, prefix="chatgauge"):
    """prefix-task-model, with the last path part of the model, lower-cased."""
    return F.concat_ws("-", F.lit(prefix), task, F.lower(F.element_at(F.split(model, "/"), -1)))


def registry_entries(models: DataFrame, order="seq", at=None, version=1) -> DataFrame:
    """Entries stamped for appending; ``order`` keeps their order within one append."""
    stamp = F.current_timestamp() if at is None else at
    return models.select(
        *FIELDS, stamp.cast("timestamp").alias("registered_at"), F.col(order).cast("bigint").alias("seq"),
        F.lit(False).alias("removed"), F.lit(version).cast("bigint").alias("version"), F.uuid().alias("entry_id"),
    )


def _log(spark: SparkSession, path) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _next_version(spark, path):
    return (_log(spark, path).agg(F.max("version")).first()[0] or 0) + 1


def registry_append(models: DataFrame, path, order="seq"):
    version = _next_version(models.sparkSession, path)
    registry_entries(models, order, version=version).write.mode("append").parquet(path)


def registry_remove(spark: SparkSession, path, name):
    """Remove every entry of that name that is listed now; unknown names are no error."""
    log = _log(spark, path)
    seen = _alive(log).where(F.col("name") == name)
    seen.withColumns({"removed": F.lit(True), "registered_at": F.current_timestamp()}).write.mode("append").parquet(path)


def _alive(log: DataFrame) -> DataFrame:
    marks = log.where("removed").select("entry_id")
    return log.where(~F.col("removed")).join(marks, "entry_id", "left_anti").select(log.columns)


def current_entries(log: DataFrame) -> DataFrame:
    """Entries of the log that no removal has marked."""
    return _alive(log).select(*FIELDS, "registered_at", "seq", "version")


def registry_list(spark: SparkSession, path) -> DataFrame:
    """Current entries, oldest first; a registry that is not there yet is empty."""
    return current_entries(_log(spark, path)).orderBy("version", "seq")


def registry_find(entries: DataFrame, wanted) -> DataFrame:
    """The first entry whose name or task is ``wanted``."""
    hit = (F.col("name") == wanted) | (F.col("task") == wanted)
    return entries.where(hit).orderBy("version", "seq").limit(1)


def without_name(entries: DataFrame, name) -> DataFrame:
    """Entries without those of that name; a task of that name does not count."""
    return entries.where(~F.col("name").eqNullSafe(F.lit(name)))
