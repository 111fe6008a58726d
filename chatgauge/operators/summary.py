"""Report texts of metrics tables, one array of lines per task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_sql, printed_sql
from .metrics import SCORES, rounded

GATE = "if(quality_gate_passed, 'PASS', 'FAIL')"


def _with_percents(table: DataFrame) -> DataFrame:
    """Rounded metrics with a text column ``<name>_text`` for each share."""
    names = [c for c in SCORES if c in table.columns]
    scaled = rounded(table).selectExpr("*", *[f"{c} * 100 AS _{c}" for c in names])
    exact = scaled.selectExpr(*table.columns, *[f"{exact_sql(f'_{c}', 1)} AS _{c}" for c in names])
    return exact.selectExpr(*table.columns, *[f"concat({printed_sql(f'_{c}', 1)}, '%') AS {c}_text" for c in names])


def summary_lines(metrics: DataFrame, per_class: DataFrame) -> DataFrame:
    """(task, lines): headline metrics, counts of binary tasks, classes, gate."""
    line = "concat('  ', label, ': ', accuracy_text, ' (', tp, '/', samples, ')')"
    classes = (
        _with_percents(per_class)
        .groupBy("task")
        # at most one entry per configured class
        .agg(F.expr(f"transform(array_sort(collect_list(struct(pos, {line} AS line))), c -> c.line) AS classes"))
    )
    table = _with_percents(metrics.selectExpr("*", "quality_gate * 100 AS _gate")).selectExpr("*", f"{exact_sql('_gate', 0)} AS gate")
    # fixed values: the wording of the lines
    lines = (
        "concat(array(concat('Accuracy: ', accuracy_text, ' | F1: ', f1_text), "
        "concat('Precision: ', precision_text, ' | Recall: ', recall_text)), "
        "if(task_type = 'binary', array(concat('TP=', tp, ' FP=', fp, ' FN=', fn, ' TN=', tn)), array()), "
        "if(classes IS NULL, array(), concat(array('', 'Per-class breakdown:'), classes)), "
        f"array('', concat('Quality Gate (', {printed_sql('gate', 0)}, '%): ', {GATE})))"
    )
    return table.join(classes, "task", "left").selectExpr("task", f"{lines} AS lines")


def run_summary(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """(task, lines): the closing summary of trained tasks.

    ``runs`` is (task, model, output, train_time_minutes, overfitting_warning).
    """
    # fixed values: the wording of the lines
    lines = (
        "concat(array(concat('Task: ', task), concat('Model: ', model), concat('Accuracy: ', accuracy_text), "
        f"concat('F1: ', f1_text), concat('Train time: ', {printed_sql('train_time_minutes', 1)}, ' min'), "
        "concat('Output: ', output)), "
        "if(overfitting_warning IS NULL, array(), array(overfitting_warning)), "
        "array(if(quality_gate_passed, 'Quality gate passed.', 'Quality gate NOT passed.')))"
    )
    minutes = [f"{exact_sql('train_time_minutes', 1)} AS {c}" if c == "train_time_minutes" else c for c in runs.columns]
    return _with_percents(metrics).join(runs.selectExpr(*minutes), "task").selectExpr("task", f"{lines} AS lines")
