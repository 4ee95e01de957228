"""Model choice: holdout grids, cross-validation, rolling origin."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import nullcontext
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsreg.functions.features import build_pipeline
from tsreg.functions.metrics import MEASURES, metric_columns
from tsreg.operators.clean import dedup_rows
from tsreg.operators.ordering import (
    TIME_ORDER,
    Split,
    chrono_split,
    fold_column,
    rolling_origin_folds,
)
from tsreg.sources.stage import staged

# Parameter grids of the study.
LINEAR_GRID = {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}
TREE_GRID = {
    "maxDepth": [5, 10, 15],
    "maxBins": [32, 64, 128],
    "minInstancesPerNode": [1, 2, 3],
    "minInfoGain": [0.0, 0.01, 0.02],
}
SEED = 42
PARALLELISM = 4


def linear(features: str = "features", label: str = "label", **params: object) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, **params)


def tree(features: str = "features", label: str = "label", **params: object) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, seed=SEED, **params)


def param_maps(estimator: Estimator, grid: Mapping[str, Sequence[object]]) -> list[dict]:
    """All combinations of a grid given by parameter names."""
    names = list(grid)
    return [
        {estimator.getParam(n): v for n, v in zip(names, values)}
        for values in product(*grid.values())
    ]


def named(params: Mapping) -> dict[str, str]:
    return {p.name: str(v) for p, v in params.items()}


def evaluator(metric: str = "rmse", label: str = "label") -> RegressionEvaluator:
    """A fresh evaluator: none is shared or re-aimed between uses."""
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)


def better(metric: str) -> Callable[[Iterable[float]], float]:
    return max if evaluator(metric).isLargerBetter() else min


def measures(predictions: DataFrame, label: str = "label") -> dict[str, float]:
    """All measures of a prediction table by one job."""
    row = predictions.agg(*metric_columns(label)).first()
    return {m: row[m] for m in MEASURES}


class Tried(NamedTuple):
    """Outcome of a search: the chosen model, its parameters, and every trial as rows."""

    model: Model
    params: dict[str, str]
    trials: DataFrame


def grid_search(
    train: DataFrame,
    valid: DataFrame,
    estimator: Estimator,
    grid: Sequence[dict],
    metric: str = "rmse",
    label: str = "label",
) -> Tried:
    """Fit every combination on ``train`` and keep the best on ``valid`` (a tail of the training
    time, not the test part). Trials report the measures on both parts, each of its own model."""
    models: list[Model | None] = [None] * len(grid)

    with staged(train, "grid-train") as seen, staged(valid, "grid-valid") as held:

        def run(_: int) -> list[tuple]:
            index, model = next(fits)
            models[index] = model
            rows = []
            for split, part in (("train", seen), ("valid", held)):
                found = measures(model.transform(part), label)
                rows += [(index, named(grid[index]), split, m, found[m]) for m in MEASURES]
            return rows

        fits = estimator.fitMultiple(seen, grid)
        with ThreadPool(min(PARALLELISM, len(grid))) as pool:
            rows = [r for part in pool.map(run, range(len(grid)), chunksize=1) for r in part]
    scores = {r[0]: r[4] for r in rows if r[2] == "valid" and r[3] == metric}
    best = better(metric)(sorted(scores), key=scores.__getitem__)
    trials = train.sparkSession.createDataFrame(
        rows, "trial int, params map<string,string>, split string, metric string, value double"
    )
    return Tried(models[best], named(grid[best]), trials)


def _validated(
    table: DataFrame,
    splits: Sequence[tuple[int, Column, Column]],
    estimator: Estimator,
    grid: Sequence[dict],
    metric: str,
    label: str,
) -> Tried:
    """Fit every combination on each ``(fold, train filter, validation filter)``, several at a time,
    and refit the one with the best mean on the whole table."""

    def run(job: tuple[int, tuple[int, Column, Column]]) -> tuple:
        trial, (fold, seen, held) = job
        model = estimator.fit(table.filter(seen), grid[trial])
        found = measures(model.transform(table.filter(held)), label)
        return trial, named(grid[trial]), fold, found[metric]

    jobs = [(trial, split) for trial in range(len(grid)) for split in splits]
    with ThreadPool(min(PARALLELISM, len(jobs))) as pool:
        rows = pool.map(run, jobs, chunksize=1)
    means = {
        trial: sum(r[3] for r in rows if r[0] == trial) / len(splits) for trial in range(len(grid))
    }
    best = better(metric)(sorted(means), key=means.__getitem__)
    trials = table.sparkSession.createDataFrame(
        rows, "trial int, params map<string,string>, fold int, metric double"
    )
    return Tried(estimator.fit(table, grid[best]), named(grid[best]), trials)


def cross_validate(
    train: DataFrame,
    estimator: Estimator,
    grid: Sequence[dict],
    folds: int = 5,
    metric: str = "rmse",
    label: str = "label",
    keys: Sequence[str] = TIME_ORDER,
    seed: int = SEED,
    written: bool = False,
) -> Tried:
    """k-fold choice with folds drawn from the hash of the key: repeatable under any partitioning.

    Gives what ``CrossValidator`` gives on the same fold column, whose check of that column is a
    Python function called on every row of every fold; here folds are plain filters. ``written``:
    ``train`` reads a table that is written already.
    """
    if folds < 2:
        raise ValueError("cross-validation needs 2 or more folds")
    folded = fold_column(train, keys, folds, seed)
    in_fold = F.col("fold")
    splits = [(i, in_fold != i, in_fold == i) for i in range(folds)]
    with nullcontext(folded) if written else staged(folded, "cv-train") as table:
        return _validated(table, splits, estimator, grid, metric, label)


def mean_metrics(tried: Tried | DataFrame, metric: str = "rmse") -> DataFrame:
    """``(trial, params, avg_metric, std_metric, chosen)``: folds of each combination together.

    Takes a search's outcome or the table of its trials.
    """
    trials = tried.trials if isinstance(tried, Tried) else tried
    summed = trials.groupBy("trial").agg(
        F.first("params").alias("params"),
        F.avg("metric").alias("avg_metric"),
        F.stddev_samp("metric").alias("std_metric"),
    )
    rank = F.col("avg_metric").desc() if better(metric) is max else F.col("avg_metric").asc()
    # one row per combination: the window holds the grid, not the data
    place = F.row_number().over(Window.orderBy(rank, "trial"))
    return summed.withColumn("chosen", place == 1)


def rolling_origin(
    train: DataFrame,
    estimator: Estimator,
    grid: Sequence[dict],
    folds: int = 3,
    metric: str = "rmse",
    label: str = "label",
    first: str = "date",
    written: bool = False,
) -> Tried:
    """Time-ordered validation: fold i trains on all days up to its cut and scores the block after
    it, so no model sees rows later than those it is judged on. ``written``: ``train`` reads a table
    that is written already."""
    day = F.to_date(first)
    with nullcontext(train) if written else staged(train, "origin-train") as table:
        splits = [
            (int(c["fold"]), day <= c["train_end"], (day > c["train_end"]) & (day <= c["valid_end"]))
            for c in rolling_origin_folds(table, folds, first).orderBy("fold").collect()
        ]
        if len(splits) < folds:
            raise ValueError(f"the days allow {len(splits)} of {folds} folds")
        return _validated(table, splits, estimator, grid, metric, label)


class Trained(NamedTuple):
    model: PipelineModel
    metrics: DataFrame


def train_and_evaluate(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence[object]],
    target: str,
    num: Sequence[str] = (),
    cat: Sequence[str] = (),
    metric: str = "rmse",
    folds: int = 5,
    keys: Sequence[str] = TIME_ORDER,
    seed: int = SEED,
    split: Callable[[DataFrame], Split] = chrono_split,
    time: str | None = "date",
) -> Trained:
    """Duplicates out, split by time, pipeline, choice of parameters, and the measures of the chosen
    pipeline on both parts as rows ``(split, metric, value)``. ``metric`` steers the choice only.

    The choice is by rolling origin along the column ``time``; with None it is by random folds of
    ``keys``. Pass another ``split`` too (such as a hash split by key) for tables without time.
    """
    with staged(dedup_rows(df), "evaluate") as table:
        train, test = split(table)
        pipeline = build_pipeline(estimator, target, num, cat)
        maps = param_maps(pipeline.getStages()[-1], grid)
        if time is None:
            fitted = cross_validate(train, pipeline, maps, folds, metric, target, keys, seed, written=True)
        else:
            fitted = rolling_origin(train, pipeline, maps, folds, metric, target, time, written=True)
        rows = [
            (name, m, value)
            for name, part in (("train", train), ("test", test))
            for m, value in measures(fitted.model.transform(part), target).items()
        ]
    metrics = df.sparkSession.createDataFrame(rows, "split string, metric string, value double")
    return Trained(fitted.model, metrics)
