"""Joins of predictions with history, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("symbol", "date")


def only_predicted(history: DataFrame, predictions: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``history`` whose key was predicted."""
    return history.join(predictions.select(*key), list(key), "left_semi")


def prediction_join(
    inputs: DataFrame, predictions: DataFrame, name: str = "close_prediction", key: Sequence[str] = KEY
) -> DataFrame:
    """Inputs with their prediction, matched by key. Equal feature vectors do not multiply rows."""
    predicted = predictions.select(*key, F.col("prediction").alias(name))
    return inputs.join(predicted, list(key), "inner")


def match_on_value(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, measure: str
) -> DataFrame:
    """Left rows that have equal-valued right rows, with their number and the range of a measure.

    The right side is combined per value before the join, so it holds each value once and a value
    that many rows share multiplies nothing. ``n_matches`` sums up to the rows of a join of all
    pairs. Nulls match nothing.
    """
    per_value = (
        right.filter(F.col(right_value).isNotNull())
        .groupBy(F.col(right_value).alias("_value"))
        .agg(
            F.count("*").alias("n_matches"),
            F.min(measure).alias(f"min_{measure}"),
            F.max(measure).alias(f"max_{measure}"),
        )
    )
    return left.join(per_value, left[left_value] == per_value["_value"], "inner").drop("_value")


def actual_vs_predicted(
    history: DataFrame, predictions: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """Predicted days only: ``symbol, date, close, prediction``."""
    return (
        history.select(*key, "close")
        .join(predictions.select(*key, "prediction"), list(key), "inner")
        .select(*key, "close", "prediction")
    )


def history_with_predictions(
    history: DataFrame, predictions: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """All days, with null where nothing was predicted."""
    return (
        history.select(*key, "close")
        .join(predictions.select(*key, "prediction"), list(key), "left")
        .select(*key, "close", "prediction")
    )


def overlay(
    history: DataFrame,
    train_predictions: DataFrame,
    test_predictions: DataFrame,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """``symbol, date, close, train_prediction, test_prediction`` over the whole history."""
    train = train_predictions.select(*key, F.col("prediction").alias("train_prediction"))
    test = test_predictions.select(*key, F.col("prediction").alias("test_prediction"))
    return (
        history.select(*key, "close").join(train, list(key), "left").join(test, list(key), "left")
    )


def overlay_long(joined: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Chart rows ``(symbol, date, series, value)`` of ``close`` and ``prediction``, nulls left out."""
    return joined.unpivot(list(key), ["close", "prediction"], "series", "value").filter(
        F.col("value").isNotNull()
    )


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct left rows that are no right rows.

    Both sides are made distinct first: copies are combined before the shuffle, and the anti join
    runs on the partitioning this leaves.
    """
    return left.distinct().subtract(right.distinct())


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows less as many copies as the right side has."""
    return left.exceptAll(right)
