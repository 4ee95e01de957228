"""Linear fits from sufficient statistics: one scan for all folds and all points of a grid.

The sums of products of features and label (a Gram matrix, some numbers a fold) add up. Left out, a fold is
a subtraction; a rolling origin is a running sum. The fits are those of Spark's ``LinearRegression``:
features and label scaled by their deviation, penalties on the scaled coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreg.operators.ordering import TIME_ORDER, hash_bucket, rolling_origin_folds

MOST_FEATURES = 1000  # a matrix of as many rows fits into the driver many times
ROUNDS, CLOSE = 10_000, 1e-12


def gram_rows(df: DataFrame, size: int, by: Column, features: str = "features", label: str = "label") -> DataFrame:
    """``(part, n, sums)``: the upper triangle of the products of (1, features, label), by ``by``, in one scan."""
    values = F.concat(F.array(F.lit(1.0)), vector_to_array(features), F.array(F.col(label).cast("double")))
    rows = df.select(by.cast("int").alias("part"), values.alias("v"))
    # an aggregate for each cell: combined in hash tables before the few rows are shuffled
    cells = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(size + 2) for j in range(i, size + 2)]
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.array(*cells).alias("sums"))


class Gram(NamedTuple):
    """Sums of products of (1, features, label)."""

    sums: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.sums - other.sums)

    @property
    def n(self) -> float:
        return self.sums[0, 0]


def grams(df: DataFrame, size: int, by: Column, features: str = "features", label: str = "label") -> dict[int, Gram]:
    """The Gram matrix of each value of ``by``; rows with a null there are left out."""
    if size > MOST_FEATURES:
        raise ValueError(f"sums of products are for at most {MOST_FEATURES} features")
    out = {}
    for row in gram_rows(df, size, by, features, label).filter("part IS NOT NULL").collect():
        square = np.zeros((size + 2, size + 2))
        square[np.triu_indices(size + 2)] = row["sums"]
        out[row["part"]] = Gram(square + np.triu(square, 1).T)
    return out


class Line(NamedTuple):
    coefficients: np.ndarray
    intercept: float


def solve(gram: Gram, reg: float = 0.0, elastic: float = 0.0, intercept: bool = True) -> Line:
    """Coefficients of the penalised least squares that Spark's regression fits."""
    mean = gram.sums / gram.n
    centre = mean[0, 1:]
    spread = np.sqrt(np.maximum(np.diag(mean)[1:] - centre**2, 0))
    moments = mean[1:, 1:] - np.outer(centre, centre) if intercept else mean[1:, 1:]
    deviation = spread[-1]
    if deviation == 0:
        if not intercept:
            raise ValueError("a constant label needs an intercept")
        return Line(np.zeros(len(centre) - 1), float(centre[-1]))
    used = spread[:-1] > 0
    scale = np.where(used, spread[:-1], 1.0)
    a = moments[:-1, :-1] / np.outer(scale, scale)
    b = moments[:-1, -1] / (scale * deviation)
    first, second = elastic * reg / deviation, (1 - elastic) * reg / deviation
    a, b = a[np.ix_(used, used)], b[used]
    if first == 0:
        found = np.linalg.lstsq(a + second * np.eye(len(b)), b, rcond=None)[0]
    else:
        found = _descent(a, b, first, second)
    whole = np.zeros(len(used))
    whole[used] = found
    whole *= deviation / scale
    return Line(whole, float(centre[-1] - whole @ centre[:-1]) if intercept else 0.0)


def _descent(a: np.ndarray, b: np.ndarray, first: float, second: float) -> np.ndarray:
    """Least of b'Ab / 2 - b'c plus both penalties, coordinate by coordinate."""
    x = np.linalg.lstsq(a + (second + first) * np.eye(len(b)), b, rcond=None)[0]
    for _ in range(ROUNDS):
        before = x.copy()
        for j in range(len(b)):
            rest = b[j] - a[j] @ x + a[j, j] * x[j]
            x[j] = np.sign(rest) * max(abs(rest) - first, 0) / (a[j, j] + second)
        if np.abs(x - before).max() <= CLOSE * max(1.0, np.abs(x).max()):
            break
    return x


def rmse(gram: Gram, line: Line) -> float:
    """Root of the mean squared error of a line over the rows of a Gram matrix."""
    weights = np.concatenate([[-line.intercept], -line.coefficients, [1.0]])
    return float(np.sqrt(max(weights @ gram.sums @ weights, 0) / gram.n))


def _points(grid: Sequence[dict]) -> list[dict[str, object]]:
    names = {"regParam": "reg", "elasticNetParam": "elastic", "fitIntercept": "intercept"}
    points = [{p.name: v for p, v in point.items()} for point in grid]
    unknown = {n for point in points for n in point} - set(names)
    if unknown:
        raise ValueError(f"sums of products don't hold {sorted(unknown)}")
    return [{names[n]: v for n, v in point.items()} for point in points]


def trials(
    df: DataFrame, grid: Sequence[dict], splits: Sequence[tuple[int, Gram, Gram]]
) -> DataFrame:
    """``(trial, params, fold, metric)`` with the root mean squared errors of every point and split."""
    rows = [
        (trial, {p.name: str(v) for p, v in grid[trial].items()}, fold, rmse(held, solve(seen, **point)))
        for trial, point in enumerate(_points(grid))
        for fold, seen, held in splits
    ]
    return df.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, fold int, metric double")


def left_out(parts: dict[int, Gram]) -> list[tuple[int, Gram, Gram]]:
    """Each fold with the sum of all others."""
    total = Gram(sum(g.sums for g in parts.values()))
    return [(fold, total - held, held) for fold, held in sorted(parts.items())]


def running(parts: dict[int, Gram]) -> list[tuple[int, Gram, Gram]]:
    """Each block but the first, by its number, with the sum of those before it."""
    seen, out = None, []
    for block, held in sorted(parts.items()):
        if seen is not None:
            out.append((block, seen, held))
        seen = held if seen is None else seen + held
    return out


def cross_validate(
    train: DataFrame, size: int, grid: Sequence[dict], folds: int = 5, keys: Sequence[str] = TIME_ORDER, seed: int = 42
) -> DataFrame:
    """Trials of ``tune.cross_validate`` for a linear fit, all out of one scan. ``size``: number of features."""
    if folds < 2:
        raise ValueError("cross-validation needs 2 or more folds")
    parts = grams(train, size, hash_bucket(keys, seed, folds))
    return trials(train, grid, left_out(parts))


def rolling_origin(train: DataFrame, size: int, grid: Sequence[dict], folds: int = 3, first: str = "date") -> DataFrame:
    """Trials of ``tune.rolling_origin`` for a linear fit: a scan for the cut days, one for the sums."""
    cuts = rolling_origin_folds(train, folds, first).orderBy("fold").collect()
    if len(cuts) < folds:
        raise ValueError(f"the days allow {len(cuts)} of {folds} folds")
    day = F.to_date(first)
    block = F.when(day <= cuts[0]["train_end"], 0)
    for k, cut in enumerate(cuts):
        block = block.when(day <= cut["valid_end"], k + 1)
    return trials(train, grid, running(grams(train, size, block)))
