"""Sequence regressor (LSTM) trained and applied by Spark jobs.

Samples stay on the executors. A training step broadcasts the weights (fixed size: about 1 MB at the
default layer sizes), every partition returns the gradient of its samples, Spark sums these in
groups, and the driver adds the group sums and moves the weights.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsreg.functions import network
from tsreg.functions.columns import after, up_to
from tsreg.functions.features import fit_scaler, inverse_scaled, scaled_columns
from tsreg.functions.network import Adam, Sizes
from tsreg.operators.ordering import hash_bucket, time_cut
from tsreg.operators.timeline import DAILY, Timeline, sequence_samples
from tsreg.sources.stage import staged

# executors need no copy of this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(network)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sum_groups(spark: SparkSession) -> int:
    """Groups in which gradients are summed before they reach the driver: the square root of the
    number of partitions, so that neither a group nor the driver adds up many."""
    return max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


@dataclass(frozen=True)
class Weights:
    """Trained weights with the layer sizes they belong to."""

    sizes: Sizes
    flat: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows ``(layer, name, shape, values)``."""
        parts = self.sizes.unpack(self.flat)
        rows = [
            (layer, name, list(shape), parts[layer, name].ravel().tolist())
            for layer, name, shape in self.sizes.shapes()
        ]
        return spark.createDataFrame(
            rows, "layer string, name string, shape array<int>, values array<double>"
        )


def save_weights(weights: Weights, spark: SparkSession, path: str) -> None:
    weights.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """Weights of :func:`save_weights`; the layer sizes follow from their shapes."""
    rows = {(r["layer"], r["name"]): r for r in spark.read.parquet(path).collect()}
    layers = sorted({layer for layer, _ in rows if layer.startswith("lstm")}, key=lambda n: int(n[4:]))
    sizes = Sizes(
        inputs=rows[layers[0], "weight_ih"]["shape"][1],
        hidden=tuple(rows[n, "weight_hh"]["shape"][1] for n in layers),
        dense=rows["fc1", "weight"]["shape"][0],
        outputs=rows["fc2", "weight"]["shape"][0],
    )
    flat = np.concatenate([np.asarray(rows[layer, name]["values"]) for layer, name, _ in sizes.shapes()])
    return Weights(sizes, flat)


def _matrix(x: pd.Series, dtype: np.dtype | type = np.float64) -> np.ndarray:
    """Arrays of one Arrow batch as (rows, steps, 1)."""
    return np.stack(x.to_numpy()).astype(dtype)[:, :, None]


def score(
    samples: DataFrame, weights: Weights, output: str = "prediction", precision: str = "float32"
) -> DataFrame:
    """``samples`` with the network's value for each sequence ``x``."""
    dtype = np.dtype(precision)
    shared = samples.sparkSession.sparkContext.broadcast(weights.flat.astype(dtype))
    sizes = weights.sizes

    @F.pandas_udf("double")
    def forward(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(network.predict(sizes, shared.value, _matrix(x, dtype)).astype("float64"))

    return samples.withColumn(output, forward("x"))


@dataclass(frozen=True)
class Fitted:
    weights: Weights
    losses: DataFrame


def fit(
    samples: DataFrame,
    sizes: Sizes,
    epochs: int = 200,
    rate: float = 0.001,
    batches: int = 1,
    seed: int = 42,
    line: Timeline = DAILY,
) -> Fitted:
    """Gradient descent on squared error over samples ``(series, time, x, y, held_out, valid)``.

    ``batches`` = 1 takes one step per epoch on all training samples. With more, each epoch deals
    all of them anew, by hash of key and epoch, into that many batches of about equal size. Loss
    rows ``(epoch, train_loss, valid_loss)`` are means under the weights each step started from;
    samples marked ``valid`` are scored in the first step of an epoch and never trained on.
    ``held_out`` ones, the test part, take no part at all.
    """
    if batches < 1 or epochs < 1:
        raise ValueError("epochs and batches must be 1 or more")
    spark = samples.sparkSession
    keys = [*line.by, line.order]
    seen = samples.filter(~F.col("held_out")).select(*keys, "x", "y", "valid")
    flat, rule, losses = sizes.initial(seed), Adam(sizes.count(), rate), []
    with staged(seen.repartition(*keys), "sequence-samples") as table:
        for epoch in range(1, epochs + 1):
            dealt = table.withColumn("batch", hash_bucket(keys, seed + epoch, batches))
            train, valid = np.zeros(2), np.zeros(2)
            for batch in range(batches):
                wanted = ~F.col("valid") & (F.col("batch") == batch)
                if batch == 0:
                    wanted = wanted | F.col("valid")
                gradient, sums = _step(dealt.filter(wanted), sizes, flat)
                train += sums[:2]
                valid += sums[2:]
                if sums[1]:
                    flat = rule.step(flat, gradient / sums[1])
            losses.append((epoch, *(float(s / n) if n else None for s, n in (train, valid))))
    return Fitted(
        Weights(sizes, flat),
        spark.createDataFrame(losses, "epoch int, train_loss double, valid_loss double"),
    )


@dataclass(frozen=True)
class Progress:
    """Where a training by rounds stands: epochs done, weights, and the step rule's running means."""

    epoch: int
    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: float
    losses: list[tuple[int, float | None, float | None]]


PROGRESS = (
    "epoch int, flat array<double>, mean array<double>, square array<double>, steps double, "
    "losses array<struct<epoch:int,train_loss:double,valid_loss:double>>"
)


def _resumed(spark: SparkSession, path: str) -> Progress | None:
    """The last round that was written under ``path``."""
    try:
        rows = spark.read.schema(PROGRESS).parquet(path).orderBy(F.desc("epoch")).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not rows:
        return None
    row = rows[0]
    arrays = [np.array(row[name]) for name in ("flat", "mean", "square")]
    return Progress(row["epoch"], *arrays, row["steps"], [tuple(x) for x in row["losses"]])


def fit_by_rounds(
    samples: DataFrame,
    sizes: Sizes,
    epochs: int = 200,
    rate: float = 0.001,
    batch_rows: int | None = None,
    per_round: int = 10,
    shard_rows: int = 1024,
    seed: int = 42,
    line: Timeline = DAILY,
    progress: str | None = None,
) -> Fitted:
    """Local steps on resident shards: one job for each ``per_round`` epochs instead of one for each step.

    Samples are dealt by the hash of their key into shards of about ``shard_rows``, written once. In a round
    every shard starts from the same weights, takes its own steps for ``per_round`` epochs, and returns its
    weights and running means; their means, weighted by the shards' training samples, start the next round.
    An epoch reshuffles a shard and takes a step for each ``batch_rows`` samples (all of them, if None). With one
    shard this is plain gradient descent. With ``progress``, each round is added to the table of this
    path, and a call that finds one goes on behind it; losses, ``valid`` and ``held_out`` are as in :func:`fit`.
    """
    if min(epochs, per_round, shard_rows) < 1 or (batch_rows is not None and batch_rows < 1):
        raise ValueError("epochs, rounds, batches and shards must be 1 or more")
    spark = samples.sparkSession
    keys = [*line.by, line.order]
    seen = samples.filter(~F.col("held_out"))
    shards = max(1, -(-seen.count() // shard_rows))
    dealt = seen.select(hash_bucket(keys, seed, shards).alias("shard"), *keys, "x", "y", "valid")
    zero = np.zeros(sizes.count())
    state = progress and _resumed(spark, progress)
    state = state or Progress(0, sizes.initial(seed), zero, zero, 0.0, [])
    with staged(dealt.repartitionByRange(shards, "shard"), "sequence-shards") as table:
        while state.epoch < epochs:
            state = _round(table, sizes, state, min(per_round, epochs - state.epoch), rate, batch_rows, seed, keys)
            if progress:
                row = (state.epoch, state.flat.tolist(), state.mean.tolist(), state.square.tolist(), state.steps, state.losses)
                spark.createDataFrame([row], PROGRESS).write.mode("append").parquet(progress)
    losses = [x for x in state.losses if x[0] <= epochs]
    return Fitted(
        Weights(sizes, state.flat),
        spark.createDataFrame(losses, "epoch int, train_loss double, valid_loss double"),
    )


def _shard_steps(
    sizes: Sizes, state: Progress, epochs: int, rate: float, batch_rows: int | None, seed: int, shard: int, rows: pd.DataFrame
) -> tuple[np.ndarray, np.ndarray]:
    """A shard's weights and running means after ``epochs``, times its samples; and its losses by epoch."""
    held = rows["valid"].to_numpy(dtype=bool)
    x, y = _matrix(rows["x"]), rows["y"].to_numpy(dtype=np.float64)
    train, valid = (x[~held], y[~held]), (x[held], y[held])
    n = len(train[1])
    flat, rule = state.flat, Adam(len(state.flat), rate)
    rule.mean, rule.square, rule.steps = state.mean, state.square, state.steps
    sums = np.zeros((epochs, 4))
    for k in range(epochs):
        if len(valid[1]):
            error = network.predict(sizes, flat, valid[0]) - valid[1]
            sums[k, 2:] = float(error @ error), len(error)
        if not n:
            continue
        order = np.random.default_rng([seed, state.epoch + k, shard]).permutation(n) if batch_rows else np.arange(n)
        for low in range(0, n, batch_rows or n):
            some = order[low : low + (batch_rows or n)]
            loss, gradient = network.loss_and_gradient(sizes, flat, train[0][some], train[1][some])
            flat = rule.step(flat, gradient / len(some))
            sums[k, :2] += loss, len(some)
    return n * np.concatenate([flat, rule.mean, rule.square, [rule.steps, 1.0]]), sums.ravel()


def _round(
    table: DataFrame, sizes: Sizes, state: Progress, epochs: int, rate: float, batch_rows: int | None, seed: int, keys: list[str]
) -> Progress:
    start = (state.epoch, state.flat, state.mean, state.square, state.steps)
    shared = table.sparkSession.sparkContext.broadcast(start)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [batch for batch in batches if len(batch)]
        if not rows:
            return
        # a file is a shard; small ones may share a task
        for shard, part in pd.concat(rows).groupby("shard"):
            # by key, so that a shard's order doesn't hang on how it was written
            part = part.sort_values(keys)
            begin = Progress(*shared.value, [])
            weighted, sums = _shard_steps(sizes, begin, epochs, rate, batch_rows, seed, int(shard), part)
            yield pd.DataFrame({"weighted": [weighted], "sums": [sums]})

    parts = table.mapInPandas(partial, "weighted array<double>, sums array<double>")
    groups = (
        parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(_sum_groups(table.sparkSession))).alias("part"))
        .agg(
            Summarizer.sum(array_to_vector("weighted")).alias("weighted"),
            Summarizer.sum(array_to_vector("sums")).alias("sums"),
        )
        .collect()
    )
    shared.destroy()
    size = len(state.flat)
    weighted, sums = np.zeros(3 * size + 2), np.zeros(4 * epochs)
    for group in groups:
        weighted += group["weighted"].toArray()
        sums += group["sums"].toArray()
    mean = weighted / weighted[-1] if weighted[-1] else np.concatenate([state.flat, state.mean, state.square, [state.steps, 0]])
    losses = [
        (state.epoch + k + 1, *(float(s / m) if m else None for s, m in (part[:2], part[2:])))
        for k, part in enumerate(sums.reshape(epochs, 4))
    ]
    return Progress(
        state.epoch + epochs, mean[:size], mean[size : 2 * size], mean[2 * size : 3 * size], float(mean[-2]), state.losses + losses
    )


def gradient(samples: DataFrame, weights: Weights) -> DataFrame:
    """``(layer, name, place, value)``: gradient of the summed squared error of all training samples."""
    rows = samples.filter(~F.col("held_out")).select("x", "y", "valid")
    found, _ = _step(rows, weights.sizes, weights.flat)
    parts = weights.sizes.unpack(found)
    rows = [
        (layer, name, place, float(value))
        for layer, name, _ in weights.sizes.shapes()
        for place, value in enumerate(parts[layer, name].ravel())
    ]
    return samples.sparkSession.createDataFrame(rows, "layer string, name string, place int, value double")


def _step(rows: DataFrame, sizes: Sizes, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sum of the training rows, and (loss, rows) sums of training and validation rows."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        gradient, sums = np.zeros_like(weights), np.zeros(4)
        for batch in batches:
            held = batch["valid"].to_numpy(dtype=bool)
            for part, at in ((batch[~held], 0), (batch[held], 2)):
                if part.empty:
                    continue
                x, y = _matrix(part["x"]), part["y"].to_numpy(dtype=np.float64)
                if at == 0:
                    loss, step = network.loss_and_gradient(sizes, weights, x, y)
                    gradient += step
                else:
                    error = network.predict(sizes, weights, x) - y
                    loss = float(error @ error)
                sums[at : at + 2] += loss, len(y)
        if sums.any():
            yield pd.DataFrame({"gradient": [gradient], "sums": [sums]})

    parts = rows.select("x", "y", "valid").mapInPandas(
        partial, "gradient array<double>, sums array<double>"
    )
    groups = (
        parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(_sum_groups(rows.sparkSession))).alias("part"))
        .agg(
            Summarizer.sum(array_to_vector("gradient")).alias("gradient"),
            Summarizer.sum(array_to_vector("sums")).alias("sums"),
        )
        .collect()
    )
    shared.destroy()
    gradient, sums = np.zeros_like(flat), np.zeros(4)
    for group in groups:
        gradient += group["gradient"].toArray()
        sums += group["sums"].toArray()
    return gradient, sums


@dataclass(frozen=True)
class Prepared:
    """Scaled samples with ``held_out`` set for targets behind the cut, ``valid`` for those of the last
    part of the time before it, and the fitted scaler."""

    samples: DataFrame
    scaler: PipelineModel


def prepare(
    bars: DataFrame,
    length: int,
    value: str = "close",
    numerator: int = 80,
    denominator: int = 100,
    line: Timeline = DAILY,
    restart: bool = False,
) -> Prepared:
    """Cut by time, scale by the bounds of the train part, build windows over the whole series.

    What lies before the cut is cut once more by the same share: its tail is for validation.

    Windows of the first test days reach back into the train part, so no day goes without a sample.
    With ``restart`` they start anew in the test part, whose first ``length`` days then have none.
    """
    order = (line.order, *line.by)
    cut = time_cut(bars, numerator, denominator, order)
    if cut is None:
        raise ValueError("too few rows to train on")
    scaler = fit_scaler(bars.filter(up_to(order, cut)), [value], "minmax")
    scaled = scaled_columns(scaler, bars.select(*line.by, line.order, value), ["scaled_value"])
    if restart:
        parts = (scaled.filter(up_to(order, cut)), scaled.filter(after(order, cut)))
        train, test = (sequence_samples(p, "scaled_value", length, line) for p in parts)
        samples = train.unionAll(test)
    else:
        samples = sequence_samples(scaled, "scaled_value", length, line)
    inner = time_cut(bars.filter(up_to(order, cut)), numerator, denominator, order)
    tail = F.lit(False) if inner is None else after(order, inner)
    marks = {"held_out": after(order, cut), "valid": tail & ~after(order, cut)}
    return Prepared(samples.withColumns(marks), scaler)


def serving_samples(
    bars: DataFrame,
    scaler: PipelineModel,
    length: int,
    n: int,
    value: str = "close",
    line: Timeline = DAILY,
) -> DataFrame:
    """The first ``n`` samples of each series of a table to serve, scaled by a fitted scaler."""
    scaled = scaled_columns(scaler, bars.select(*line.by, line.order, value), ["scaled_value"])
    return sequence_samples(scaled, "scaled_value", length, line, cap=n)


def predictions(
    samples: DataFrame,
    scaler: PipelineModel,
    weights: Weights,
    precision: str = "float32",
    line: Timeline = DAILY,
) -> DataFrame:
    """Key (``symbol, date``), ``label`` and ``prediction`` (and ``held_out``, if the samples have it) in original
    units, dated by the target day."""
    scored = score(samples, weights, "scaled_prediction", precision)
    priced = inverse_scaled(scaler, scored, "scaled_prediction", "prediction")
    kept = [*line.by, line.order, "label", "prediction", *({"held_out"} & set(samples.columns))]
    return inverse_scaled(scaler, priced, "y", "label").select(*kept)
