"""Reading example files with their order, and loading train and test sets."""

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.convert import to_messages
from ..operators.limits import head_n

ORDER = "seq"
BLANK = " \t\r\n\f\x0b"


def _scanned(spark, paths):
    """Lines as one scan numbers them: by file, block of the file, and a number that rises inside a block."""
    return spark.read.text(paths).select(
        F.btrim(F.col("value"), F.lit(BLANK)).alias("raw"), "_metadata.file_path", "_metadata.file_block_start",
    ).withColumn("number", F.monotonically_increasing_id())


def _lines(spark, paths):
    """Non-blank lines with ``seq``: file and number of the line in it, blank ones counted.

    How many lines lie before a block of a file comes from one count per block; that is a
    row for each 128 MB of input, so it is broadcast. Blocks are those of this plan, for the
    lines and for the counts alike, so line numbers are the same however files are split.
    """
    scanned = _scanned(spark, paths)
    block = ["file_path", "file_block_start"]
    counts = scanned.groupBy(*block).agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = F.sum("n").over(W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(*block, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    placed = scanned.join(F.broadcast(base), block)
    order = F.struct("file_path", (F.col("number") + F.col("base")).alias("line")).alias(ORDER)
    return placed.where(F.col("raw") != "").select(order, "raw")


def read_jsonl(spark: SparkSession, paths, schema=None, positions=True) -> DataFrame:
    """Non-blank lines with their position.

    Without a schema the result is ``raw`` (one JSON text per row) and with one the
    parsed columns; a malformed line raises.  ``seq`` is (file, line number), the same in
    every read however files are split.  It takes a count over the lines first; where no
    order is needed, ``positions=False`` leaves ``seq`` and that pass out.
    """
    lines = _lines(spark, paths) if positions else _scanned(spark, paths).where(F.col("raw") != "").select("raw")
    if schema is None:
        return lines
    kept = [ORDER] if positions else []
    return lines.select(*kept, F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("row")).select(*kept, "row.*")


def read_table(spark: SparkSession, paths) -> DataFrame:
    """Parquet rows with ``seq``: the file name, then the row's place in its file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    order = F.struct(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")
    )
    return spark.read.parquet(*paths).select(order.alias(ORDER), "*")


READERS = {"jsonl": read_jsonl, "parquet": read_table}


def read_examples(spark: SparkSession, paths, format, positions=True) -> DataFrame:
    """Examples in the stated format; the kind of source is never guessed from the path.

    ``positions=False`` leaves out ``seq`` where it costs a pass of its own (JSON lines).
    """
    if format not in READERS:
        raise ValueError(f"format must be one of {sorted(READERS)}")
    if format == "jsonl":
        return read_jsonl(spark, paths, positions=positions)
    return READERS[format](spark, paths)


def choose_split(split, splits) -> str:
    """The named split if it is there, else the first one."""
    splits = list(splits)
    if not splits:
        raise ValueError("the dataset has no split")
    return split if split in splits else splits[0]


def read_split(spark: SparkSession, root, split, splits, format="parquet"):
    """One split of a dataset kept as one folder per split, and the name of the split read."""
    used = choose_split(split, splits)
    return read_examples(spark, f"{root.rstrip('/')}/{used}", format), used


def _names(spark, paths) -> DataFrame:
    """(file_path) of all files below the paths; their content is not read."""
    return spark.read.format("binaryFile").load(paths).select("_metadata.file_path")


def read_head(spark: SparkSession, paths, format, n) -> DataFrame:
    """The first n rows in file order, opening only as many files as hold them.

    Files are opened from the front in growing batches until n rows are covered, the way
    ``take`` widens its search. The driver sees the names of opened files only, and of each
    batch one row: the file in which row n lies, if it does.
    """
    if not n:
        return read_examples(spark, paths, format)
    if format not in READERS:
        raise ValueError(f"format must be one of {sorted(READERS)}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    names, opened, batch, covered, last = _names(spark, paths), [], 1, 0, None
    while last is None:
        rest = names.where(F.col("file_path") > opened[-1]) if opened else names
        chosen = [r["file_path"] for r in rest.orderBy("file_path").limit(batch).collect()]
        if not chosen:
            break
        counts = _counted(spark, chosen, format).groupBy("file_path").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.orderBy("file_path")) + covered  # a row for each file of the batch
        placed = counts.select("file_path", upto.alias("upto"), "n")
        # the first file that reaches row n, and the rows of the batch
        last, covered = placed.agg(
            F.min_by(F.struct("file_path", (F.col("upto") - F.col("n")).alias("before")), F.when(F.col("upto") >= n, F.col("upto"))),
            F.coalesce(F.max("upto"), F.lit(covered)),
        ).first()
        opened, batch = opened + chosen, batch * 4
    if not opened:
        return read_examples(spark, paths, format).limit(0)
    if last is None:
        return read_examples(spark, [unquote(f) for f in opened], format)
    needed = [f for f in opened if f <= last["file_path"]]
    rows, keep = read_examples(spark, [unquote(f) for f in needed], format), n - last["before"]
    position = F.col(ORDER)
    if format == "parquet":
        return rows.where((position["file_path"] != needed[-1]) | (position["row_index"] < keep))
    # blank lines have numbers too, so the place of the last line is looked up
    ends = read_examples(spark, unquote(needed[-1]), format).select(position["line"].alias("line"))
    cut = head_n(ends, keep, "line").agg(F.max("line").alias("line")).scalar()
    return rows.where((position["file_path"] != needed[-1]) | (position["line"] <= cut))


def _counted(spark, files, format) -> DataFrame:
    """(file_path) for every row of the files."""
    read = [unquote(f) for f in files]
    if format == "parquet":
        return spark.read.parquet(*read).select("_metadata.file_path")
    return _scanned(spark, read).where(F.col("raw") != "").select("file_path")


def _load(spark, path, format, n, drop_unknown, positions):
    # the limit comes before the conversion: dropped rows still use up places
    rows = read_head(spark, path, format, n) if n else read_examples(spark, path, format, positions)
    return to_messages(rows, drop_unknown=drop_unknown)


def load_train(spark: SparkSession, path, spec, format="jsonl", positions=True) -> DataFrame:
    """The first ``max_samples`` training examples (all if unset), as messages.

    Where all are loaded and their order does not matter, ``positions=False`` saves JSON lines a pass.
    """
    return _load(spark, path, format, spec.max_samples, format != "jsonl", positions)


def load_test(spark: SparkSession, path, spec, format="jsonl", unset=None, positions=True) -> DataFrame:
    """The first ``max_val_samples`` test examples, or ``unset`` (None: all) where the settings name none."""
    return _load(spark, path, format, spec.max_val_samples or unset, format != "jsonl", positions)
