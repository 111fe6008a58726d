"""Confusion counts and the metrics made from them, for many tasks at once.

Scored rows are aggregated once, to (task, expected, predicted, n).  That table has
at most classes^2 + 1 rows per task, and every metric is computed from it.  Rows
whose ``expected`` is null were skipped: they count in n and nowhere else.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import literal
from ..functions.rounding import exact_sql, ratio_sql
from ..sources.specs import spec_classes, spec_frame

SCORES = ("accuracy", "precision", "recall", "f1")
BINARY = "task_type IN ('binary', 'per_class')"


def confusion(scored: DataFrame) -> DataFrame:
    """(task, expected, predicted, n), the one pass over scored rows."""
    return scored.groupBy("task", "expected", "predicted").agg(F.expr("count(*) AS n"))


def confusion_matrix(counts: DataFrame, classes) -> DataFrame:
    """One row per (task, expected), one column of counts per predicted class."""
    cells = [F.expr(f"coalesce(sum(n) FILTER (WHERE predicted = {literal(c)}), 0L) AS `{c}`") for c in classes]
    return counts.where("expected IS NOT NULL").groupBy("task", "expected").agg(*cells)


def class_counts(counts: DataFrame) -> DataFrame:
    """(task, label, samples, tp, fp, fn, skipped) of every label that occurs.

    Each cell speaks for two labels: its expected one (sample, hit or miss) and its
    predicted one (false alarm), so one aggregate covers both sides.
    """
    def role(label, **numbers):
        cells = ", ".join(f"'{c}', {numbers.get(c, '0L')}" for c in ("samples", "tp", "fp", "fn", "skipped"))
        return f"named_struct('label', {label}, {cells})"

    miss = "if(expected <=> predicted, 0L, n)"
    truth = role("expected", samples="n", tp=f"n - {miss}", fn=miss)
    guess = role("predicted", fp=miss)
    roles = f"CASE WHEN expected IS NULL THEN array({role('expected', skipped='n')}) ELSE array({truth}, {guess}) END"
    sums = [F.sum(c).alias(c) for c in ("samples", "tp", "fp", "fn", "skipped")]
    return counts.selectExpr("task", f"inline({roles})").groupBy("task", "label").agg(*sums)


def per_class_report(counts: DataFrame, specs) -> DataFrame:
    """(task, label, pos, samples, correct, accuracy, tp, fp, fn): configured classes of every task.

    Multiclass tasks list all their classes, seen or not; binary tasks only those
    seen as ground truth.
    """
    listed = spec_classes(counts.sparkSession, specs)
    found = class_counts(counts).where("label IS NOT NULL")
    cells = [f"coalesce({c}, 0L) AS {c}" for c in ("samples", "tp", "fp", "fn")]
    table = listed.join(found, ["task", "label"], "left").selectExpr("task", "task_type", "label", "pos", *cells)
    return table.where(f"NOT {BINARY} OR samples > 0").selectExpr(
        "task", "label", "pos", "samples", "tp AS correct", f"{ratio_sql('tp', 'samples')} AS accuracy", "tp", "fp", "fn"
    )


def task_totals(counts: DataFrame, specs) -> DataFrame:
    """One row per task: n, evaluated, correct, and the counts of its classes by position."""
    # the specs come from the driver, so this side is small by construction
    listed = F.broadcast(spec_classes(counts.sparkSession, specs).drop("task_type"))
    return (
        class_counts(counts)
        .join(listed, ["task", "label"], "left")
        .groupBy("task")
        .agg(
            F.expr("sum(samples + skipped) AS total_samples"),
            F.expr("sum(samples) AS evaluated"),
            F.expr("sum(tp) AS correct"),
            # one entry per configured class, no more
            F.expr("collect_list(if(pos IS NULL, NULL, struct(pos, tp, fp, fn))) AS found"),
        )
    )


def metrics(counts: DataFrame, specs) -> DataFrame:
    """Accuracy, precision, recall, F1 and the gate of every task, as raw doubles.

    Binary tasks measure their first class (tp, fp, fn, tn given); multiclass ones
    average over all configured classes, summing in class order.  A task without
    any row gets zeros.  The gate looks at the accuracy rounded to four places.
    """
    settings = spec_frame(counts.sparkSession, specs).select("task", "task_type", "classes", "quality_gate")
    rows = settings.join(task_totals(counts, specs), "task", "left").selectExpr(
        "task", f"if({BINARY}, 'binary', 'multiclass') AS task_type", "quality_gate",
        *[f"coalesce({c}, 0L) AS {c}" for c in ("total_samples", "evaluated", "correct")],
        "transform(sequence(0, size(classes) - 1), i -> coalesce(try_element_at(filter(found, e -> e.pos = i), 1), "
        "named_struct('pos', i, 'tp', 0L, 'fp', 0L, 'fn', 0L))) AS cells",
    )
    rates = rows.selectExpr(
        "*", "transform(cells, c -> named_struct("
        f"'precision', {ratio_sql('c.tp', '(c.tp + c.fp)')}, 'recall', {ratio_sql('c.tp', '(c.tp + c.fn)')})) AS rates",
    )
    f1 = ratio_sql("2 * r.precision * r.recall", "(r.precision + r.recall)")
    scores = rates.selectExpr(
        "*", "transform(rates, r -> named_struct("
        f"'precision', r.precision, 'recall', r.recall, 'f1', {f1})) AS scores",
    )

    def score(name):
        mean = f"aggregate(scores, 0D, (acc, s) -> acc + s.{name}) / CAST(size(scores) AS DOUBLE)"
        return f"if(task_type = 'binary', scores[0].{name}, {mean}) AS {name}"

    tn = "evaluated - cells[0].tp - cells[0].fp - cells[0].fn"
    table = scores.selectExpr(
        "task", "task_type", "total_samples", "evaluated", "correct",
        f"{ratio_sql('correct', 'total_samples')} AS accuracy",
        *map(score, ("precision", "recall", "f1")),
        *[f"if(task_type = 'binary', cells[0].{c}, NULL) AS {c}" for c in ("tp", "fp", "fn")],
        f"if(task_type = 'binary', {tn}, NULL) AS tn", "quality_gate",
    )
    return quality_gate(table)


def quality_gate(table: DataFrame) -> DataFrame:
    """Add ``quality_gate_passed``: the rounded accuracy reaches the gate."""
    return table.selectExpr("*", f"{exact_sql('accuracy', 4)} >= quality_gate AS quality_gate_passed")


def rounded(table: DataFrame, digits=4) -> DataFrame:
    """Metrics as reported: four decimals."""
    return table.selectExpr(*[f"{exact_sql(c, digits)} AS {c}" if c in SCORES else f"`{c}`" for c in table.columns])
