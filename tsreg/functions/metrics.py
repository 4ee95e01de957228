"""Error measures of predictions, each set in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreg.operators.timeline import DAILY, Timeline, add_lags

MEASURES = ("mse", "rmse", "mae", "r2", "mape")


def metric_columns(label: str = "label", prediction: str = "prediction") -> list[Column]:
    """Aggregates ``n, mse, rmse, mae, r2, mape, n_zero_label``.

    r2 is measured against the mean of the label. Rows with label 0 have no percentage error: mape
    leaves them out and ``n_zero_label`` counts them.
    """
    y, error = F.col(label), F.col(label) - F.col(prediction)
    scored = error.isNotNull()
    mse = F.avg(error * error)
    spread = F.var_pop(F.when(scored, y))
    return [
        F.count(error).alias("n"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(spread > 0, F.lit(1.0) - mse / spread).alias("r2"),
        F.avg(F.when(y != 0, F.abs(error) / F.abs(y))).alias("mape"),
        F.count_if(scored & (y == 0)).alias("n_zero_label"),
    ]


def regression_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row of measures, or one per group of ``by``."""
    return df.groupBy(*by).agg(*metric_columns(label, prediction))


def metric_rows(metrics: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Measures as rows ``(…ids, metric, value)``."""
    return metrics.unpivot(list(ids), list(MEASURES), "metric", "value")


def directional_accuracy(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    line: Timeline = DAILY,
    bucketed: bool = False,
) -> DataFrame:
    """Share of rows whose predicted move from the previous actual value has the actual sign.

    The first row of each series has no previous value and is left out. ``bucketed``: the rows have kept
    their ``_bucket`` from an earlier :func:`add_lags` on the same ``line`` and are not shuffled again.
    """
    key = line.cell if bucketed else line.by
    rows = df.select(*key, line.order, label, prediction)
    moves = add_lags(rows, [label], [1], line, bucketed=bucketed)
    previous = F.col(f"{label}_lag_1")
    hit = F.signum(F.col(prediction) - previous) == F.signum(F.col(label) - previous)
    return moves.agg(
        F.count(hit).alias("n"), F.avg(hit.cast("int")).alias("directional_accuracy")
    )
