"""Saved models and back-tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsreg.functions.columns import feature_columns
from tsreg.functions.features import assembler
from tsreg.functions.metrics import metric_rows, regression_metrics
from tsreg.operators.ordering import horizon, horizon_series
from tsreg.operators.timeline import DAILY, Timeline, add_lags
from tsreg.plans import sequence

BAR_FEATURES = ("open", "high", "low", "volume")
HORIZONS = {"7 days": 7, "14 days": 14, "30 days": 30}
LOADERS: dict[str, Callable[[str], Model | sequence.Weights]] = {
    "linear": LinearRegressionModel.load,
    "tree": DecisionTreeRegressionModel.load,
    "pipeline": PipelineModel.load,
    "sequence": lambda path: sequence.load_weights(SparkSession.active(), path),
}


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(name: str, path: str) -> Model | sequence.Weights:
    """Model of a registered kind; a fitted scaler comes back as a stage of its pipeline."""
    if name not in LOADERS:
        raise ValueError(f"unknown model {name!r}: use one of {sorted(LOADERS)}")
    return LOADERS[name](path)


def horizon_days(option: str, custom: int | None = None) -> int:
    """Rows of a horizon option (``7 days``, ``14 days``, ``30 days`` or ``Custom``)."""
    if option == "Custom":
        if custom is None or custom < 1:
            raise ValueError("a custom horizon needs 1 or more days")
        return custom
    if option not in HORIZONS:
        raise ValueError(f"unknown horizon {option!r}: use {[*HORIZONS, 'Custom']}")
    return HORIZONS[option]


def labelled(
    bars: DataFrame, columns: Sequence[str] | None = None, label: str = "close", line: Timeline = DAILY
) -> DataFrame:
    """Key (``symbol, date``), ``features`` (vector) and ``label`` of a bar table."""
    picked = list(columns or feature_columns(bars))
    return (
        assembler(picked)
        .transform(bars)
        .withColumnRenamed(label, "label")
        .select(*line.by, line.order, "features", "label")
    )


def with_lead(
    bars: DataFrame, days: int, columns: Sequence[str] = BAR_FEATURES, line: Timeline = DAILY
) -> DataFrame:
    """Bars whose feature columns stem from ``days`` rows earlier, for a forecast of the label.

    With 0 the features are those of the label's own day: a fit that explains, but predicts nothing.
    Rows without such history are left out, by their place in the series: a null or NaN value that
    stands there stays, as cleaning is a step of its own.
    """
    if days == 0:
        return bars
    placed = bars.withColumn("_there", F.lit(True))
    lagged = add_lags(placed, [*columns, "_there"], [days], line)
    known = lagged.filter(F.col(f"_there_lag_{days}").isNotNull())
    return known.withColumns({c: F.col(f"{c}_lag_{days}") for c in columns}).select(*bars.columns)


def horizon_features(
    bars: DataFrame, n: int, columns: Sequence[str] = BAR_FEATURES, per_series: bool = False
) -> DataFrame:
    """Features and label of the first ``n`` bars, of the table or of each series."""
    rows = horizon_series(bars, n) if per_series else horizon(bars, n)
    return labelled(rows, columns)


class Backtest(NamedTuple):
    predictions: DataFrame
    metrics: DataFrame


def backtest(
    bars: DataFrame,
    model: Model,
    n: int,
    columns: Sequence[str] = BAR_FEATURES,
    per_series: bool = False,
    name: str = "model",
) -> Backtest:
    """Predictions for the first ``n`` bars with their actual values, and the measures of them."""
    return _judged(model.transform(horizon_features(bars, n, columns, per_series)), name)


def backtest_sequence(
    bars: DataFrame,
    scaler: PipelineModel,
    weights: sequence.Weights,
    length: int,
    n: int,
    name: str = "sequence",
    line: Timeline = DAILY,
    value: str = "close",
) -> Backtest:
    """:func:`backtest` of the sequence network: the first ``n`` days of each series that have
    ``length`` days before them in ``bars``."""
    if n < 1:
        raise ValueError("the horizon must be 1 or more")
    samples = sequence.serving_samples(bars, scaler, length, n, value, line)
    return _judged(sequence.predictions(samples, scaler, weights, line=line), name, line)


def _judged(scored: DataFrame, name: str, line: Timeline = DAILY) -> Backtest:
    predictions = scored.select(*line.by, line.order, "label", "prediction", F.lit(name).alias("model"))
    return Backtest(predictions, metric_rows(regression_metrics(predictions, by=["model"]), ["model"]))
