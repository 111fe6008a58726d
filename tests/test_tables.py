"""Timings, sizes, runs, registry, reports and training texts."""

import json

import pytest

from chatgauge.operators.runs import overfit_flags, run_metrics
from chatgauge.operators.summary import run_summary
from chatgauge.operators.timings import benchmark_report, compare_variants, latency_summary
from chatgauge.plans.evaluation import evaluate_scored
from chatgauge.sinks import registry, report
from chatgauge.sinks.training_text import training_text, write_training_text
from chatgauge.sources.specs import task_specs


def timing_rows(spark):
    rows = [("m", v, i + 1, 9.0 if i < 3 else s) for v, s in (("fp16", 0.5), ("int4", 0.25)) for i in range(13)]
    return spark.createDataFrame(rows + [("n", "fp16", i + 1, 0.1) for i in range(13)], "model STRING, variant STRING, run_no INT, seconds DOUBLE")


def test_latency_leaves_out_warmups(spark):
    rows = {(r["model"], r["variant"]): r for r in latency_summary(timing_rows(spark)).collect()}
    assert (rows["m", "fp16"]["avg_latency_ms"], rows["m", "fp16"]["tokens_per_second"], rows["m", "fp16"]["runs"]) == (500.0, 64.0, 10)


def test_sizes_and_comparison(spark):
    models = spark.createDataFrame([("m", 500_000_000), ("n", 500_000_000)], "model STRING, total_parameters BIGINT")
    bench = benchmark_report(latency_summary(timing_rows(spark)), models)
    assert {(r["model"], r["variant"]): r["size_mb"] for r in bench.collect()} == {("m", "fp16"): 1000.0, ("m", "int4"): 300.0, ("n", "fp16"): 1000.0}
    rows = {r["model"]: r for r in compare_variants(bench).collect()}
    assert (rows["m"]["size_reduction"], rows["m"]["int4_latency_ms"]) == ("70%", 250.0)
    assert (rows["n"]["size_reduction"], rows["n"]["int4_size_mb"]) == (None, None)


RUNS = [
    ("a", 456.0, 1.0, 1.2, 200), ("b", 60.0, 1.0, 1.05, 1), ("c", 60.0, 1.0, None, 1), ("d", 60.0, 1.0, 0.0, 1),
    ("e", 60.0, 0.0, 1.2, 1), ("f", 90.0, 1 / 32, 5 / 32, 1),
]


def test_overfitting(spark):
    runs = spark.createDataFrame(RUNS, "run STRING, train_seconds DOUBLE, train_loss DOUBLE, eval_loss DOUBLE, steps BIGINT")
    rows = {r["run"]: r for r in run_metrics(runs).collect()}
    for run, seconds, train, loss, steps in RUNS:
        flagged = bool(loss and train and loss - train > 0.1)
        text = (
            f"OVERFITTING DETECTED: eval_loss ({loss:.4f}) >> train_loss ({train:.4f}), gap={loss - train:.4f}. "
            "Consider: fewer steps, higher dropout, or more data."
        ) if flagged else None
        assert rows[run]["overfitting_warning"] == text
        assert rows[run]["train_time_minutes"] == round(seconds / 60, 1)
        assert rows[run]["final_loss"] == round(train, 4)
        assert rows[run]["eval_loss"] == (round(loss, 4) if loss else None)
        assert rows[run]["steps_completed"] == steps
    assert overfit_flags(runs).columns == runs.columns + ["overfitting_warning"]


MODELS = "name STRING, task STRING, path STRING, accuracy DOUBLE, f1 DOUBLE, size_mb DOUBLE, seq BIGINT"


def entries(spark, *rows):
    return spark.createDataFrame([(n, t, f"outputs/{i}", 0.9, 0.8, 1.0, i) for i, (n, t) in enumerate(rows)], MODELS)


def listed(spark, path):
    return [(r["name"], r["task"]) for r in registry.registry_list(spark, path).collect()]


def test_registry_life(spark, tmp_path):
    path = f"{tmp_path}/registry"
    assert listed(spark, path) == []
    registry.registry_append(entries(spark, ("x", "t"), ("y", "x")), path)
    registry.registry_append(entries(spark, ("x", "t")), path)
    assert listed(spark, path) == [("x", "t"), ("y", "x"), ("x", "t")]
    everything = registry.registry_list(spark, path)
    assert registry.registry_find(everything, "t").first()["seq"] == 0
    assert [r["name"] for r in registry.registry_find(everything, "x").collect()] == ["x"]
    assert registry.registry_find(everything, "none").count() == 0
    registry.registry_remove(spark, path, "t")
    assert len(listed(spark, path)) == 3
    registry.registry_remove(spark, path, "x")
    assert listed(spark, path) == [("y", "x")]
    registry.registry_append(entries(spark, ("x", "again")), path)
    assert listed(spark, path) == [("y", "x"), ("x", "again")]
    assert registry.without_name(registry.registry_list(spark, path), "x").count() == 1


def test_entry_name(spark):
    df = spark.createDataFrame([("hdfs", "Org/Base-0.5B-Instruct"), ("t", "Plain")], "task STRING, model STRING")
    names = [r[0] for r in df.select(registry.entry_name(df["task"], df["model"])).collect()]
    assert names == ["chatgauge-hdfs-base-0.5b-instruct", "chatgauge-t-plain"]


@pytest.fixture(scope="module")
def evaluation(spark):
    specs = task_specs([{"task": "t", "classes": ["A", "B"], "quality_gate": 0.5}])
    rows = spark.createDataFrame([("t", "A", "A"), ("t", "B", "A"), ("t", "A", "A")], "task STRING, expected STRING, predicted STRING")
    return specs, evaluate_scored(rows, specs)


def test_model_card(spark, tmp_path, evaluation):
    specs, result = evaluation
    bench = spark.createDataFrame([("t", "org/m", 5, 12.5)], "task STRING, base_model STRING, total_parameters BIGINT, avg_latency_ms DOUBLE")
    cards = report.build_report(result.metrics, result.per_class, bench, specs)
    report.write_report(cards, f"{tmp_path}/cards")
    card = json.loads(spark.read.text(f"{tmp_path}/cards").first()["value"])
    assert (card["base_model"], card["task_type"], card["method"]) == ("org/m", "binary", "QLoRA + SFT")
    assert card["metrics"]["accuracy"] == 0.6667 and card["metrics"]["quality_gate_passed"] is True
    assert card["metrics"]["per_class"]["A"]["samples"] == 2
    assert card["benchmark"] == {"total_parameters": 5, "avg_latency_ms": 12.5}
    assert card["config"]["classes"] == ["A", "B"] and card["timestamp"].endswith(" UTC")


def test_run_summary(spark, evaluation):
    runs = spark.createDataFrame([("t", "org/m", "out", 7.6, "OVERFITTING")], "task STRING, model STRING, output STRING, train_time_minutes DOUBLE, overfitting_warning STRING")
    assert run_summary(evaluation[1].metrics, runs).first()["lines"] == [
        "Task: t", "Model: org/m", "Accuracy: 66.7%", "F1: 80.0%", "Train time: 7.6 min", "Output: out", "OVERFITTING", "Quality gate passed.",
    ]


def test_training_text(spark, tmp_path):
    df = spark.createDataFrame([([("user", "a b c"), ("assistant", "d")],)], "messages ARRAY<STRUCT<role: STRING, content: STRING>>")
    text = "<|im_start|>user\na b c<|im_end|>\n<|im_start|>assistant\nd<|im_end|>"
    write_training_text(df, f"{tmp_path}/texts")
    rows = spark.read.parquet(f"{tmp_path}/texts")
    assert rows.columns == ["text"] and rows.first()["text"] == text
    assert training_text(df, 3).first()["text"] == "<|im_start|>user\na b"
