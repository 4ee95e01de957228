"""Grids of regression trees from few fits: smaller trees are read off the largest.

Depth and least gain only stop a tree's growth, so the trees of a grid that differ in these are one tree,
left earlier. A row walks the largest tree once and is scored at each stop.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.operators.ordering import TIME_ORDER, fold_column
from tsreg.plans import tune
from tsreg.sources.stage import discard, fresh_path, stage

# executors need no copy of this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STOPS = ("maxDepth", "minInfoGain")


class Flat(NamedTuple):
    """Nodes of a tree as arrays, by id."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray  # -1 at a leaf
    right: np.ndarray
    gain: np.ndarray
    value: np.ndarray


def flatten(model: DecisionTreeRegressionModel, spark) -> Flat:
    """The nodes of a tree on numbers, from the table that it is saved as (2 to the depth at most)."""
    path = fresh_path(spark, "tree")
    model.write().save(path)
    split = F.col("split")
    rows = spark.read.parquet(f"{path}/data").select("id", "prediction", "gain", "leftChild", "rightChild",
        split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    ).orderBy("id").toArrow()
    discard(spark, path)
    columns = {name: rows.column(name).to_numpy() for name in rows.column_names}
    if (columns["categories"][columns["leftChild"] >= 0] >= 0).any():
        raise ValueError("splits on categories are not held")
    return Flat(
        columns["feature"].astype(np.int64),
        np.nan_to_num(columns["threshold"].astype(np.float64)),
        columns["leftChild"].astype(np.int64),
        columns["rightChild"].astype(np.int64),
        columns["gain"],
        columns["prediction"],
    )


def at_stops(tree: Flat, x: np.ndarray, depths: Sequence[int], gains: Sequence[float]) -> dict[tuple[int, float], np.ndarray]:
    """Predictions of the trees that stop at each depth and each least gain."""
    out = {}
    for gain in gains:
        node = np.zeros(len(x), np.int64)
        for depth in range(max(depths) + 1):
            if depth in depths:
                out[depth, gain] = tree.value[node]
            on = (tree.left[node] >= 0) & (tree.gain[node] >= gain)
            side = x[np.arange(len(x)), np.maximum(tree.feature[node], 0)] <= tree.threshold[node]
            node = np.where(on, np.where(side, tree.left[node], tree.right[node]), node)
    return out


def cross_validate(
    train: DataFrame,
    grid: dict[str, Sequence[object]],
    folds: int = 5,
    label: str = "label",
    keys: Sequence[str] = TIME_ORDER,
    seed: int = tune.SEED,
) -> DataFrame:
    """``(trial, params, fold, metric)``: root mean squared errors of every point of ``grid`` on every fold.

    Trials count as in ``tune.param_maps``. Only the points that differ in other parameters are fitted, at
    the greatest depth and the smallest gain; one scan scores all trials of a fold.
    """
    spark = train.sparkSession
    table = stage(fold_column(train, keys, folds, seed), "trees-cv")
    names = list(grid)
    points = [dict(zip(names, values)) for values in product(*grid.values())]
    depths, gains = ([*dict.fromkeys(p.get(name, default) for p in points)] for name, default in zip(STOPS, (5, 0.0)))
    kinds = [*dict.fromkeys(tuple((n, v) for n, v in p.items() if n not in STOPS) for p in points)]

    def grown(job: tuple[int, tuple]) -> Flat:
        fold, kind = job
        model = tune.tree(label=label, maxDepth=max(depths), minInfoGain=min(gains), **dict(kind))
        return flatten(model.fit(table.filter(F.col("fold") != fold)), spark)

    jobs = [(fold, kind) for fold in range(folds) for kind in kinds]
    with ThreadPool(min(tune.PARALLELISM, len(jobs))) as pool:
        trees = dict(zip(jobs, pool.map(grown, jobs, chunksize=1)))
    place = {(tuple((n, v) for n, v in p.items() if n not in STOPS), p.get("maxDepth", 5), p.get("minInfoGain", 0.0)): k
             for k, p in enumerate(points)}
    shared = spark.sparkContext.broadcast({job: tuple(tree) for job, tree in trees.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            y = batch.column(2).to_numpy()
            for (f, kind), tree in shared.value.items():
                mine = fold == f
                for (depth, gain), found in at_stops(Flat(*tree), x[mine], depths, gains).items():
                    error = found - y[mine]
                    total = sums.setdefault((place[kind, depth, gain], f), [0.0, 0])
                    total[0] += float(error @ error)
                    total[1] += len(error)
        trial, part, error, n = zip(*((t, f, e, k) for (t, f), (e, k) in sums.items())) if sums else ((),) * 4
        arrays = [pa.array(trial, pa.int32()), pa.array(part, pa.int32()), pa.array(error, pa.float64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["trial", "fold", "error", "n"])

    rows = table.select(F.col("fold").cast("int"), vector_to_array("features"), F.col(label).cast("double"))
    parts = rows.mapInArrow(score, "trial int, fold int, error double, n bigint")
    found = parts.groupBy("trial", "fold").agg(F.sqrt(F.sum("error") / F.sum("n")).alias("metric"))
    params = spark.createDataFrame(
        [(k, {n: str(v) for n, v in p.items()}) for k, p in enumerate(points)], "trial int, params map<string,string>"
    )
    return found.join(params, "trial").select("trial", "params", "fold", "metric")
