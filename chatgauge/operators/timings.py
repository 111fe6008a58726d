"""Latency, size and variant comparison over tables of timed runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_sql, printed_sql
from ..schema import FP16_BYTES, INT4_BYTES, TOKENS_PER_RUN, WARMUP_RUNS


def latency_summary(timings: DataFrame, warmup=WARMUP_RUNS, tokens=TOKENS_PER_RUN) -> DataFrame:
    """(model, variant, runs, avg_latency_ms, tokens_per_second) of (model, variant, run_no, seconds).

    The first ``warmup`` runs are left out.  Seconds are summed as decimals, so the
    mean does not depend on how the rows are partitioned.
    """
    means = (
        timings.where(f"run_no > {int(warmup)}")
        .groupBy("model", "variant")
        .agg(F.expr("count(*) AS runs"), F.expr("CAST(sum(CAST(seconds AS DECIMAL(24,9))) AS DOUBLE) / count(*) AS mean"))
    )
    return means.selectExpr(
        "model", "variant", "runs", "mean * 1000 AS avg_latency_ms",
        f"try_divide({float(tokens)!r}D, mean) AS tokens_per_second",
    )


def estimate_size_sql(parameters: str, variant: str) -> str:
    """Megabytes of a model by its parameter count, unrounded; null for an unknown variant."""
    width = f"CASE {variant} WHEN 'fp16' THEN {FP16_BYTES!r}D WHEN 'int4' THEN {INT4_BYTES!r}D END"
    return f"CAST({parameters} AS DOUBLE) * {width} / 1e6D"


def benchmark_report(latencies: DataFrame, models: DataFrame) -> DataFrame:
    """Latencies joined with (model, total_parameters), rounded as reported."""
    rows = latencies.join(models, "model").selectExpr(
        "model", "variant", "total_parameters", f"{estimate_size_sql('total_parameters', 'variant')} AS size_mb",
        "avg_latency_ms", "tokens_per_second",
    )
    return rows.selectExpr(
        "model", "variant", "total_parameters",
        *[f"{exact_sql(c, 1)} AS {c}" for c in ("size_mb", "avg_latency_ms", "tokens_per_second")],
    )


def compare_variants(benchmarks: DataFrame) -> DataFrame:
    """One row per model with both variants side by side and the size saved.

    A variant that could not be run has nulls, and so has the saving.
    """
    wide = benchmarks.groupBy("model").agg(*[
        F.expr(f"max({c}) FILTER (WHERE variant = '{v}') AS {v}_{short}")
        for c, short in (("size_mb", "size_mb"), ("avg_latency_ms", "latency_ms"))
        for v in ("fp16", "int4")
    ])
    saved = wide.selectExpr("*", "(1 - try_divide(int4_size_mb, fp16_size_mb)) * 100 AS saved")
    shown = saved.selectExpr(*wide.columns, f"{exact_sql('saved', 0)} AS saved")
    return shown.selectExpr(*wide.columns, f"concat({printed_sql('saved', 0)}, '%') AS size_reduction")
