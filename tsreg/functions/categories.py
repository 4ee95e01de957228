"""Category indexes as tables, and as a stage of a saved pipeline.

The index of a column is a table of its values by falling frequency. It is counted, ranked, stored and
joined as a table, so the number of categories has no bound, inside a pipeline neither.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsreg.operators.ordering import global_rank
from tsreg.sources.stage import stage

LEVEL, NUMBER = "_level", "_number"


class Levels(NamedTuple):
    """The categories of a column (``_level``, ``_number`` from 0) and how many there are."""

    table: DataFrame
    n: int


def levels(train: DataFrame, column: str) -> Levels:
    """Categories of ``train`` numbered by falling frequency, ties by their text; nulls are none."""
    counted = stage(
        train.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(LEVEL))
        .agg((-F.count("*")).alias("_rarity"))
        .withColumn("_text", F.col(LEVEL).cast("string")),
        "levels",
    )
    ranked = global_rank(counted, ("_rarity", "_text"), "_rank")
    return Levels(ranked.select(LEVEL, (F.col("_rank") - 1).alias(NUMBER)), counted.count())


def indexed(found: Levels, df: DataFrame, column: str, output: str) -> DataFrame:
    """``df`` with the number of its category as a double; the number of categories for all others.

    The column says how many values it has, so an encoder behind it needs no look at the rows.
    """
    nominal = {"ml_attr": {"type": "nominal", "name": output, "num_vals": found.n + 1}}
    number = F.coalesce(F.col(NUMBER), F.lit(found.n)).cast("double").alias(output, metadata=nominal)
    joined = df.join(found.table, F.col(column) == F.col(LEVEL), "left")
    return joined.select(*[c for c in df.columns if c != output], number)


def encoder(inputs: list[str], outputs: list[str]) -> OneHotEncoder:
    """Sparse vectors with a slot per category; the number for unseen values has none."""
    return OneHotEncoder(inputCols=inputs, outputCols=outputs, dropLast=True)


class CategoryIndexer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the :func:`levels` of a column."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol is not None:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> CategoryIndexModel:
        found = levels(dataset, self.getInputCol())
        # read by every later use of the model
        table = stage(found.table, "category-index")
        return self._copyValues(CategoryIndexModel(Levels(table, found.n)))


class CategoryIndexModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Numbers a column by a join with its index, which is saved as a table beside the parameters."""

    def __init__(self, found: Levels | None = None):
        super().__init__()
        self.found = found

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return indexed(self.found, dataset, self.getInputCol(), self.getOutputCol())

    def write(self) -> MLWriter:
        return _IndexWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IndexReader()


class _IndexWriter(MLWriter):
    def __init__(self, model: CategoryIndexModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"n": self.model.found.n})
        self.model.found.table.write.parquet(f"{path}/index")


class _IndexReader(MLReader):
    def load(self, path: str) -> CategoryIndexModel:
        spark: SparkSession = self.sparkSession
        stored = DefaultParamsReader.loadMetadata(path, spark)
        model = CategoryIndexModel(Levels(spark.read.parquet(f"{path}/index"), stored["n"]))
        model._resetUid(stored["uid"])
        DefaultParamsReader.getAndSetParams(model, stored)
        return model
