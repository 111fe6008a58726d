"""Over-fitting flags and reported metrics of training runs."""

from pyspark.sql import DataFrame

from ..functions.rounding import exact_sql, printed_sql
from ..schema import LOSS_GAP


def overfit_flags(runs: DataFrame) -> DataFrame:
    """Add ``overfitting_warning`` where the evaluation loss is more than LOSS_GAP above.

    A loss that is null, NaN or exactly 0 never gives a warning; an infinite one (a run that
    diverged) does.
    """
    kept = runs.columns
    gaps = runs.selectExpr(
        *kept, f"if(eval_loss <> 0 AND train_loss <> 0 AND NOT isnan(eval_loss - train_loss) AND eval_loss - train_loss > {LOSS_GAP!r}D, eval_loss - train_loss, NULL) AS _gap"
    )
    shown = gaps.selectExpr(
        # only runs with a warning print numbers
        *kept, f"{exact_sql('_gap', 4)} AS _gap", f"if(_gap IS NULL, NULL, {exact_sql('eval_loss', 4)}) AS _eval",
        f"if(_gap IS NULL, NULL, {exact_sql('train_loss', 4)}) AS _train",
    )
    # fixed value: the text of the warning
    text = (
        f"concat('OVERFITTING DETECTED: eval_loss (', {printed_sql('_eval', 4)}, ') >> train_loss (', "
        f"{printed_sql('_train', 4)}, '), gap=', {printed_sql('_gap', 4)}, "
        "'. Consider: fewer steps, higher dropout, or more data.')"
    )
    return shown.selectExpr(*kept, f"if(_gap IS NULL, NULL, {text}) AS overfitting_warning")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Runs as reported: minutes with one decimal, losses with four, the warning."""
    rows = overfit_flags(runs.selectExpr("*", "train_seconds / 60 AS _minutes"))
    return rows.selectExpr(
        "run", f"{exact_sql('_minutes', 1)} AS train_time_minutes", f"{exact_sql('train_loss', 4)} AS final_loss",
        f"if(eval_loss <> 0, {exact_sql('eval_loss', 4)}, NULL) AS eval_loss", "steps AS steps_completed", "overfitting_warning",
    )
