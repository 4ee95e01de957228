"""Feature vectors, scalers and encoders."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.functions import categories
from tsreg.functions.columns import minmax_inverse

def assembler(columns: Sequence[str], output: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=invalid)


def scaler_stage(kind: str, source: str, output: str, centre: bool = False) -> Estimator:
    """``standard``: by the sample deviation (centred on request). ``minmax``: to [0, 1]."""
    if kind == "standard":
        return StandardScaler(inputCol=source, outputCol=output, withMean=centre, withStd=True)
    if kind == "minmax":
        return MinMaxScaler(inputCol=source, outputCol=output, min=0.0, max=1.0)
    raise ValueError(f"unknown scaler {kind!r}: use 'standard' or 'minmax'")


class Part(NamedTuple):
    """Stages of a pipeline for one kind of columns, and the vectors that they end in."""

    stages: list[Estimator | Transformer]
    vectors: list[str]


def number_part(columns: Sequence[str], scaler: str | None) -> Part:
    """Numbers in one vector, scaled on request."""
    if not columns:
        return Part([], [])
    joined = assembler(columns, "numbers")
    if scaler is None:
        return Part([joined], ["numbers"])
    return Part([joined, scaler_stage(scaler, "numbers", "numbers_scaled")], ["numbers_scaled"])


def category_part(columns: Sequence[str]) -> Part:
    """A slot per category of each column, whatever their number."""
    if not columns:
        return Part([], [])
    indexes, slots = ([f"{column}_{kind}" for column in columns] for kind in ("index", "slots"))
    indexers = [categories.CategoryIndexer(column, index) for column, index in zip(columns, indexes)]
    return Part([*indexers, categories.encoder(indexes, slots)], slots)


def build_pipeline(
    estimator: Estimator,
    target: str,
    num: Sequence[str] = (),
    cat: Sequence[str] = (),
    scaler: str | None = "standard",
) -> Pipeline:
    """``estimator`` behind all that its one vector of features is made of."""
    numbers, slots = number_part(num, scaler), category_part(cat)
    vectors = numbers.vectors + slots.vectors
    if not vectors:
        raise ValueError("a pipeline needs numeric or category columns")
    last = estimator.copy({estimator.featuresCol: "features", estimator.labelCol: target})
    return Pipeline(stages=[*numbers.stages, *slots.stages, assembler(vectors, "features"), last])


def assembled(df: DataFrame, columns: Sequence[str], invalid: str = "error") -> DataFrame:
    """``df`` with the columns as one array ``features_array``."""
    vectors = assembler(columns, "_vector", invalid).transform(df)
    return vectors.withColumn("features_array", vector_to_array("_vector")).drop("_vector")


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str) -> PipelineModel:
    """Scaler fitted on ``train`` only. Its output ``scaled`` is a vector."""
    stages = [assembler(columns, "_raw"), scaler_stage(kind, "_raw", "scaled")]
    return Pipeline(stages=stages).fit(train)


def scaled_columns(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with the scaled values as plain columns ``names``."""
    values = model.transform(df).withColumn("_scaled", vector_to_array("scaled")).drop("_raw", "scaled")
    return values.withColumns({n: F.col("_scaled")[i] for i, n in enumerate(names)}).drop("_scaled")


def inverse_scaled(model: PipelineModel, df: DataFrame, column: str, output: str, at: int = 0) -> DataFrame:
    """``output`` in original units, with the bounds the min-max scaler was fitted to."""
    fitted = next(s for s in model.stages if isinstance(s, MinMaxScalerModel))
    low, high = float(fitted.originalMin[at]), float(fitted.originalMax[at])
    return df.withColumn(output, minmax_inverse(column, low, high, fitted.getMin(), fitted.getMax()))


def string_index(train: DataFrame, df: DataFrame, column: str, output: str) -> DataFrame:
    """Categories numbered by falling frequency in ``train``, ties by their text; unseen ones and
    nulls come last, all with the number of categories.

    Categories are counted, ranked and joined as tables, so their number has no bound.
    """
    return categories.indexed(categories.levels(train, column), df, column, output)


def one_hot(train: DataFrame, df: DataFrame, column: str, output: str) -> DataFrame:
    """A sparse vector with one slot per category of ``train``, all zero for unseen ones and nulls."""
    numbered = string_index(train, df, column, "_index")
    return categories.encoder(["_index"], [output]).fit(numbered).transform(numbered).drop("_index")
