"""Session helpers: recommended settings, and lineage cuts that survive executor loss."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", app="chatgauge", **conf):
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where a local session names none (single-machine tests) a temporary folder is
    made, once per session, and recorded in the session settings; on a cluster that is an error.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("chatgauge.test.folder", None)
    )
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chatgauge-")
        spark.conf.set("chatgauge.test.folder", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one: all intermediate tables lie in it."""
    return f"{shared_folder(spark)}/chatgauge-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name) -> str:
    """A path that nothing has been written to yet, below this application's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession):
    """Delete this application's intermediate tables, once everything made from them is written.

    Results are read lazily from these tables, so only the caller knows when that is. Spark
    has no call of its own to delete files in any store it writes to; Hadoop's is used.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
