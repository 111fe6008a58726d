"""Task settings as data: one row per evaluation task."""

from typing import NamedTuple, Optional

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import literal
from ..functions.labels import clean_classes
from ..schema import BINARY_CLASSES, MULTICLASS_CLASSES

# What a task gets where its row says nothing.
DEFAULTS = {
    "task": "hdfs-anomaly",
    "task_type": "binary",
    "classes": None,
    "quality_gate": 0.95,
    "max_samples": None,
    "max_val_samples": 500,
    "max_test_samples": 500,
    "system_prompt": (
        "You are a HDFS log anomaly detection expert. Classify each log entry as "
        "ANOMALY or NORMAL. Respond with ONLY the classification label followed by a "
        "brief reason."
    ),
}

# The shipped tasks.
HDFS_GATES = {"accuracy": 0.96, "balanced": 0.95, "latency": 0.90}
SHIPPED = [
    {"task": "hdfs-anomaly"},
    {
        "task": "cve-analysis",
        "task_type": "multiclass",
        "classes": ["CRITICAL", "HIGH", "MEDIUM", "LOW"],
        "quality_gate": 0.95,
        "max_samples": 50000,
        "max_val_samples": 1000,
        "max_test_samples": 1000,
        "system_prompt": (
            "You are a cybersecurity expert specializing in CVE analysis. Given a CVE "
            "description, classify its severity as CRITICAL, HIGH, MEDIUM, or LOW, and "
            "provide a brief risk assessment."
        ),
    },
    {
        "task": "phishing-detection",
        "task_type": "binary",
        "classes": ["PHISHING", "LEGITIMATE"],
        "quality_gate": 0.95,
        "max_samples": 50000,
        "max_val_samples": 1000,
        "max_test_samples": 1000,
        "system_prompt": (
            "You are a phishing email detection expert. Classify each email as PHISHING "
            "or LEGITIMATE. Respond with ONLY the classification label and a brief reason."
        ),
    },
]

COLUMNS = (
    "task STRING, task_type STRING, classes ARRAY<STRING>, quality_gate DOUBLE, "
    "max_samples BIGINT, max_val_samples BIGINT, max_test_samples BIGINT, system_prompt STRING"
)


class TaskSpec(NamedTuple):
    task: str
    task_type: str
    classes: tuple
    quality_gate: float
    max_samples: Optional[int]
    max_val_samples: Optional[int]
    max_test_samples: int
    system_prompt: str

    @property
    def is_binary(self):
        return self.task_type in ("binary", "per_class")


def task_specs(rows) -> list:
    """Settings rows (dicts) to specs; gaps take the defaults, unknown keys are ignored."""
    specs = []
    for row in rows:
        values = {key: row.get(key, default) for key, default in DEFAULTS.items()}
        spec = TaskSpec(**values)
        fallback = BINARY_CLASSES if spec.is_binary else MULTICLASS_CLASSES
        specs.append(spec._replace(classes=clean_classes(spec.classes or fallback)))
    if len({s.task for s in specs}) != len(specs):
        raise ValueError("every task needs its own name")
    return specs


def shipped_specs(hdfs_profile="accuracy") -> list:
    """The three shipped tasks; the profile picks the gate of the first."""
    rows = [dict(SHIPPED[0], quality_gate=HDFS_GATES[hdfs_profile])] + SHIPPED[1:]
    return task_specs(rows)


def spec_frame(spark: SparkSession, specs) -> DataFrame:
    """The specs as an inline table; they come from the driver, so their size is known."""
    names, types = zip(*[column.strip().split(" ") for column in COLUMNS.split(", ")])
    rows = ", ".join(
        "(" + ", ".join(f"CAST({literal(value)} AS {kind})" for value, kind in zip(spec, types)) + ")" for spec in specs
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(names)})")


def spec_classes(spark: SparkSession, specs) -> DataFrame:
    """One row per (task, class) with the position of the class in its list."""
    rows = ", ".join(
        f"({literal(s.task)}, {literal(s.task_type)}, {pos}, {literal(label)})" for s in specs for pos, label in enumerate(s.classes)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(task, task_type, pos, label)")
