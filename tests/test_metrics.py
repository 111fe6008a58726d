"""Metrics: worked examples, a pure-Python second opinion, and invariants."""

import random

import pytest

from chatgauge.operators.metrics import class_counts, confusion, confusion_matrix, rounded
from chatgauge.plans.evaluation import evaluate_scored
from chatgauge.sources.specs import HDFS_GATES, shipped_specs, spec_frame, task_specs

SCORED = "task STRING, expected STRING, predicted STRING"


def scored(spark, task, pairs, partitions=3):
    return spark.createDataFrame([(task, e, p) for e, p in pairs], SCORED).repartition(partitions)


def ratio(a, b):
    return a / b if b else 0.0


def python_metrics(pairs, classes, binary):
    seen = [(e, p) for e, p in pairs if e is not None]
    cells = {
        c: (sum(e == p == c for e, p in seen), sum(p == c != e for e, p in seen), sum(e == c != p for e, p in seen)) for c in classes
    }
    scores = []
    for tp, fp, fn in cells.values():
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        scores.append((p, r, ratio(2 * p * r, p + r)))
    accuracy = ratio(sum(e == p for e, p in seen), len(pairs))
    if binary:
        return (accuracy, *scores[0])
    means = []
    for column in zip(*scores):
        total = 0.0
        for value in column:
            total = total + value
        means.append(total / len(classes))
    return (accuracy, *means)


BINARY = [("A", "A")] * 4 + [("A", "B")] + [("B", "A")] * 2 + [("B", "B")] * 2 + [(None, None)]


@pytest.mark.parametrize("gate,passed", [(0.6, True), (0.61, False)])
def test_binary_example(spark, gate, passed):
    specs = task_specs([{"task": "t", "classes": ["a", "b"], "quality_gate": gate}])
    result = evaluate_scored(scored(spark, "t", BINARY), specs)
    row = result.metrics.first()
    assert (row["total_samples"], row["tp"], row["fp"], row["fn"], row["tn"], row["correct"]) == (10, 4, 2, 1, 2, 6)
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.6, 4 / 6, 0.8)
    assert round(row["f1"], 4) == 0.7273
    assert row["quality_gate_passed"] is passed
    classes = {r["label"]: (r["samples"], r["accuracy"]) for r in result.per_class.collect()}
    assert classes == {"A": (5, 0.8), "B": (4, 0.5)}


def test_multiclass_example(spark):
    pairs = [("A", "A")] * 2 + [("A", "B")] + [("B", "B")] * 2 + [("B", "C"), ("C", "C"), ("C", "A")]
    specs = task_specs([{"task": "t", "task_type": "multiclass", "classes": list("ABCD")}])
    result = evaluate_scored(scored(spark, "t", pairs), specs)
    row = rounded(result.metrics).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.625, 0.4583, 0.4583, 0.4583)
    assert (row["tp"], row["tn"]) == (None, None)
    classes = {r["label"]: r for r in result.per_class.collect()}
    assert (classes["D"]["samples"], classes["D"]["accuracy"], classes["D"]["fp"]) == (0, 0.0, 0)
    assert sorted(classes) == list("ABCD")


def test_task_without_rows(spark):
    specs = task_specs([{"task": "t"}, {"task": "u", "task_type": "multiclass"}])
    rows = evaluate_scored(scored(spark, "other", [("A", "A")]), specs).metrics.collect()
    assert sorted((r["task"], r["total_samples"], r["accuracy"], r["f1"]) for r in rows) == [("t", 0, 0.0, 0.0), ("u", 0, 0.0, 0.0)]


def test_gate_looks_at_the_rounded_accuracy(spark):
    pairs = [("A", "A")] * 94996 + [("A", "B")] * 5004
    specs = task_specs([{"task": "t", "classes": ["A", "B"], "quality_gate": 0.95}])
    df = spark.range(100000).selectExpr("'t' AS task", "'A' AS expected", "if(id < 94996, 'A', 'B') AS predicted")
    row = evaluate_scored(df, specs).metrics.first()
    assert row["accuracy"] == len([1 for e, p in pairs if e == p]) / len(pairs) < 0.95
    assert row["quality_gate_passed"]


def test_a_missing_prediction_is_wrong_but_not_positive(spark):
    specs = task_specs([{"task": "t", "classes": ["A", "B"]}])
    row = evaluate_scored(scored(spark, "t", [("A", None), ("B", None), ("A", "A")]), specs).metrics.first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["correct"]) == (1, 0, 1, 1, 1)


@pytest.mark.parametrize("seed,kind", [(1, "binary"), (2, "multiclass"), (3, "per_class")])
def test_random_pairs(spark, seed, kind):
    rng = random.Random(seed)
    classes = ["A", "B", "C", "D", "E"]
    pairs = [(rng.choice(classes[:4]), rng.choice(classes)) if rng.random() > 0.1 else (None, None) for _ in range(997)]
    specs = task_specs([{"task": "t", "task_type": kind, "classes": classes}])
    results = [evaluate_scored(scored(spark, "t", p, n), specs) for p, n in ((pairs, 1), (pairs[::-1], 7))]
    first, second = [r.metrics.first() for r in results]
    assert first == second
    assert (first["accuracy"], first["precision"], first["recall"], first["f1"]) == python_metrics(pairs, classes, kind != "multiclass")
    counts = class_counts(results[0].counts).where("label IS NOT NULL").collect()
    skipped = sum(e is None for e, _ in pairs)
    assert sum(r["samples"] for r in counts) == len(pairs) - skipped == first["evaluated"]
    assert sum(r["tp"] for r in counts) == first["correct"]
    assert sum(r["fp"] for r in counts) == sum(r["fn"] for r in counts)
    if kind != "multiclass":
        assert first["tp"] + first["fp"] + first["fn"] + first["tn"] == len(pairs) - skipped
    report = results[0].per_class.collect()
    assert len(report) == (5 if kind == "multiclass" else 4)
    assert all(r["accuracy"] == ratio(r["tp"], r["tp"] + r["fn"]) for r in report)


def test_confusion_is_one_shuffle(spark):
    plan = confusion(spark.createDataFrame([("t", e, p) for e, p in BINARY], SCORED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_confusion_matrix(spark):
    rows = confusion_matrix(confusion(scored(spark, "t", BINARY)), ["A", "B"]).collect()
    assert {r["expected"]: (r["A"], r["B"]) for r in rows} == {"A": (4, 1), "B": (2, 2)}


def test_report_lines(spark):
    specs = task_specs([{"task": "t", "classes": ["a", "b"], "quality_gate": 0.955}])
    lines = evaluate_scored(scored(spark, "t", BINARY), specs).lines().first()["lines"]
    assert lines == [
        "Accuracy: 60.0% | F1: 72.7%", "Precision: 66.7% | Recall: 80.0%", "TP=4 FP=2 FN=1 TN=2", "", "Per-class breakdown:",
        "  A: 80.0% (4/5)", "  B: 50.0% (2/4)", "", f"Quality Gate ({0.955 * 100:.0f}%): FAIL",
    ]


def test_specs(spark):
    specs = {s.task: s for s in shipped_specs("latency")}
    assert specs["hdfs-anomaly"].classes == ("ANOMALY", "NORMAL") and specs["hdfs-anomaly"].quality_gate == HDFS_GATES["latency"] == 0.9
    assert specs["cve-analysis"].max_test_samples == 1000 and not specs["cve-analysis"].is_binary
    row = spec_frame(spark, task_specs([{"task": "it's", "learning_rate": 3, "classes": ["x", "y"]}])).first()
    assert (row["task"], row["classes"], row["quality_gate"], row["max_samples"], row["max_val_samples"]) == ("it's", ["X", "Y"], 0.95, None, 500)
    with pytest.raises(ValueError):
        task_specs([{"task": "t"}, {"task": "t"}])
