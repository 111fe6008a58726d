"""Evaluations that add up, and the export of cards and registry entries."""

import json
import random

import pytest

from chatgauge.plans.evaluation import evaluate_counts, evaluate_scored
from chatgauge.sinks import evaluations, registry, report
from chatgauge.sources.specs import task_specs

SPECS = task_specs([
    {"task": "a", "classes": ["X", "Y"], "max_test_samples": None, "quality_gate": 0.5},
    {"task": "b", "task_type": "multiclass", "classes": ["P", "Q", "R"], "max_test_samples": None},
])
SHAPE = "id BIGINT, task STRING, expected STRING, predicted STRING"


def scored(spark, n=300):
    rng = random.Random(2)
    names = {"a": ["X", "Y"], "b": ["P", "Q", "R"]}
    rows = []
    for i in range(n):
        task = rng.choice("ab")
        expected = rng.choice([*names[task], None])
        rows.append((i, task, expected, rng.choice(names[task]) if expected else None))
    return spark.createDataFrame(rows, SHAPE)


def tables(result):
    return sorted(result.metrics.collect()), sorted(result.per_class.collect())


def test_two_appends_and_a_withdrawal_equal_one_run(spark, tmp_path):
    rows, path = scored(spark), f"{tmp_path}/e"
    assert evaluations.stored_counts(spark, path).count() == 0
    evaluations.append_scored(rows.where("id < 100"), path, "one")
    evaluations.append_scored(rows.where("id >= 100"), path, "two")
    assert tables(evaluate_counts(evaluations.stored_counts(spark, path), SPECS)) == tables(evaluate_scored(rows, SPECS))
    evaluations.withdraw_scored(rows.where("id % 4 = 0"), path, "gone")
    kept = evaluate_scored(rows.where("id % 4 <> 0"), SPECS)
    assert tables(evaluate_counts(evaluations.stored_counts(spark, path), SPECS)) == tables(kept)
    # an append repeated after a failure counts once
    evaluations.append_scored(rows.where("id < 100"), path, "one")
    evaluations.withdraw_scored(rows.where("id % 4 = 0"), path, "gone")
    assert tables(evaluate_counts(evaluations.stored_counts(spark, path), SPECS)) == tables(kept)


def test_stored_evaluations_refuse_what_does_not_add_up(spark, tmp_path):
    rows = scored(spark)
    evaluations.append_scored(rows, f"{tmp_path}/e", "one")
    evaluations.append_scored(rows.where("id < 100"), f"{tmp_path}/e", "one")
    with pytest.raises(Exception, match="two contents of batch one"):
        evaluations.stored_counts(spark, f"{tmp_path}/e").collect()
    evaluations.append_scored(rows.where("id < 10"), f"{tmp_path}/f", "one")
    evaluations.withdraw_scored(rows, f"{tmp_path}/f", "two")
    with pytest.raises(Exception, match="withdrawn"):
        evaluations.stored_counts(spark, f"{tmp_path}/f").collect()


def test_export_writes_cards_and_entries(spark, tmp_path):
    result = evaluate_scored(scored(spark), SPECS)
    bench = spark.createDataFrame(
        [("org/M", "fp16", 10, 100.0, 5.0, 6.4), ("org/M", "int4", 10, 30.0, 2.0, 16.0), ("N", "fp16", 20, 200.0, 7.0, 4.6)],
        "model STRING, variant STRING, total_parameters BIGINT, size_mb DOUBLE, avg_latency_ms DOUBLE, tokens_per_second DOUBLE",
    )
    models = spark.createDataFrame([("a", "org/M", "out/a"), ("b", "N", "out/b")], "task STRING, base_model STRING, path STRING")
    for _ in range(2):
        report.export_models(result, bench, models, SPECS, f"{tmp_path}/cards-{_}", f"{tmp_path}/registry")
    cards = {r["task"]: json.loads(r["card"]) for r in report.read_report(spark, f"{tmp_path}/cards-0").collect()}
    assert cards["a"]["benchmark"] == {
        "total_parameters": 10, "model_size_mb": 100.0, "avg_latency_ms": 5.0, "tokens_per_second": 6.4,
        "comparison": {"fp16_size_mb": 100.0, "int4_size_mb": 30.0, "fp16_latency_ms": 5.0, "int4_latency_ms": 2.0, "size_reduction": "70%"},
    }
    assert "comparison" not in cards["b"]["benchmark"] and cards["b"]["base_model"] == "N"
    listed = registry.registry_list(spark, f"{tmp_path}/registry").collect()
    assert [(r["name"], r["size_mb"]) for r in listed] == [("chatgauge-a-m", 100.0), ("chatgauge-b-n", 200.0)] * 2
    assert listed[0]["accuracy"] == cards["a"]["metrics"]["accuracy"]
