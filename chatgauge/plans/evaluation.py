"""End-to-end plans: examples or turns to metrics of many tasks in one job."""

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.limits import head_n_per_task
from ..operators.metrics import confusion, metrics, per_class_report
from ..operators.score import attach_responses, label_responses, prepare, score_examples
from ..operators.summary import summary_lines
from ..session import cut_lineage


class Evaluation(NamedTuple):
    counts: DataFrame
    metrics: DataFrame
    per_class: DataFrame

    def lines(self) -> DataFrame:
        return summary_lines(self.metrics, self.per_class)


def evaluate_scored(scored: DataFrame, specs, keep=False) -> Evaluation:
    """Evaluate (task, expected, predicted).

    With ``keep`` the confusion counts, a few rows per task, are written once, so
    that the several tables made from them do not score the examples again.
    """
    counts = confusion(scored)
    return evaluate_counts(cut_lineage(counts) if keep else counts, specs)


def evaluate_counts(counts: DataFrame, specs) -> Evaluation:
    """Evaluate (task, expected, predicted, n), for instance those of ``sinks.evaluations``."""
    return Evaluation(counts, metrics(counts, specs), per_class_report(counts, specs))


def capped(examples: DataFrame, specs) -> DataFrame:
    """The first ``max_test_samples`` examples of every task by ``seq``."""
    return head_n_per_task(examples, {s.task: s.max_test_samples for s in specs})


def evaluate(examples: DataFrame, specs, factory, keep=True, **options) -> Evaluation:
    """Score (task, example_id, seq, messages) with a predictor and evaluate."""
    return evaluate_scored(score_examples(capped(examples, specs), specs, factory, **options), specs, keep)


def evaluate_stored(examples: DataFrame, specs, predictions: DataFrame, keep=False, **options) -> Evaluation:
    """Evaluate answers that were generated elsewhere: (task, example_id, response)."""
    prepared = prepare(capped(examples, specs), specs, **options)
    return evaluate_scored(label_responses(attach_responses(prepared, predictions), specs), specs, keep)
