"""Model cards: identity, task, metrics and benchmark of each task as JSON, and the export of an evaluation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import literal
from ..operators.metrics import rounded
from ..operators.timings import compare_variants
from ..sources.specs import spec_frame
from . import registry

METHOD = "QLoRA + SFT"  # fixed value


def build_report(metrics: DataFrame, per_class: DataFrame, benchmarks: DataFrame, specs, project="chatgauge", version="0.1.0") -> DataFrame:
    """(task, card): one JSON text per task.

    ``benchmarks`` is (task, base_model, …): every further column goes into the
    card's ``benchmark`` part.
    """
    counts = "struct(label, struct(samples, correct, accuracy, tp, fp, fn) AS counts)"
    classes = (
        rounded(per_class)
        .groupBy("task")
        # at most one entry per configured class
        .agg(F.expr(f"map_from_entries(array_sort(collect_list({counts}))) AS per_class"))
    )
    kept = ", ".join(c for c in metrics.columns if c not in ("task", "quality_gate", "evaluated", "correct"))
    scores = rounded(metrics).join(classes, "task", "left").selectExpr("task", f"struct({kept}, per_class) AS metrics")
    extras = ", ".join(c for c in benchmarks.columns if c not in ("task", "base_model"))
    bench = benchmarks.selectExpr("task", "base_model", f"struct({extras}) AS benchmark")
    limits = "task_type, classes, quality_gate, max_samples, max_val_samples, max_test_samples"
    settings = spec_frame(metrics.sparkSession, specs).selectExpr("task", "task_type", "system_prompt", f"struct({limits}) AS config")
    return settings.join(scores, "task").join(bench, "task").selectExpr(
        "task",
        f"to_json(struct({literal(project)} AS project, {literal(version)} AS version, base_model, task, task_type, "
        f"system_prompt, {literal(METHOD)} AS method, config, metrics, benchmark, "
        "date_format(current_timestamp(), \"yyyy-MM-dd HH:mm:ss 'UTC'\") AS timestamp)) AS card",
    )


def write_report(report: DataFrame, path, mode="errorifexists"):
    """One folder per task, one JSON text in each."""
    report.withColumnRenamed("card", "value").write.mode(mode).partitionBy("task").text(path)


def read_report(spark, path) -> DataFrame:
    """(task, card) of written cards."""
    return spark.read.schema("value STRING, task STRING").text(path, wholetext=True).select("task", F.col("value").alias("card"))


def benchmark_block(benchmarks: DataFrame) -> DataFrame:
    """(model, ...) the benchmark part of a card from rows by variant.

    Sizes and speed are those of fp16; ``comparison`` sets both variants side by side and is
    null for a model whose int4 variant was not measured.
    """
    both = "fp16_size_mb, int4_size_mb, fp16_latency_ms, int4_latency_ms, size_reduction"
    compared = compare_variants(benchmarks).selectExpr("model", f"if(int4_size_mb IS NULL, NULL, struct({both})) AS comparison")
    full = benchmarks.where("variant = 'fp16'").selectExpr(
        "model", "total_parameters", "size_mb AS model_size_mb", "avg_latency_ms", "tokens_per_second"
    )
    return full.join(compared, "model")


def export_models(evaluation, benchmarks: DataFrame, models: DataFrame, specs, cards, entries, **card_options):
    """Write a card of every evaluated model below ``cards`` and append its entry to the registry at ``entries``.

    ``models`` is (task, base_model, path), ``benchmarks`` has a row for each model and variant.
    """
    block = benchmark_block(benchmarks)
    measured = models.join(block, models["base_model"] == block["model"], "left").drop("model")
    write_report(build_report(evaluation.metrics, evaluation.per_class, measured.drop("path"), specs, **card_options), cards)
    scores = rounded(evaluation.metrics).select("task", "accuracy", "f1")
    # one row a task; the order of an export is that of its task names
    made = measured.join(scores, "task").select(
        registry.entry_name(F.col("task"), F.col("base_model")).alias("name"), "task", "path", "accuracy", "f1",
        F.col("model_size_mb").alias("size_mb"), F.row_number().over(Window.orderBy("task", "base_model")).alias("seq"),
    )
    registry.registry_append(made, entries)
