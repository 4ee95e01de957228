"""Profiles that refresh: a day's numbers are kept as mergeable states, merged on demand.

A state is a row for each day and column: counts, the two moments, bounds, and a KLL sketch of the values. A
refresh scans only days that the table of states doesn't have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH = 400  # size of a sketch: its ranks err by less than one in a hundred
STATES = (
    "day date, column string, n bigint, nulls bigint, mean double, squares double, min double, max double, sketch binary"
)


def day_states(df: DataFrame, columns: Sequence[str], day: str = "date") -> DataFrame:
    """The state of each day and column: one scan, combined before it is shuffled.

    ``squares`` is the sum of squared distances from the day's own mean. Rows without a day are left out.
    """
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    rows = df.filter(F.col(day).isNotNull()).select(F.to_date(day).alias("day"), F.inline(F.array(*entries)))
    return rows.groupBy("day", "column").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("squares"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", SKETCH).alias("sketch"),
    )


def refresh(df: DataFrame, path: str, columns: Sequence[str], day: str = "date") -> DataFrame:
    """Add the states of the days behind the last stored one to the table at ``path``; return all of it.

    The days come in order: a day that is stored is closed. The filter on ``day`` reaches the scan.
    """
    spark = df.sparkSession
    stored = stored_states(spark, path)
    if stored is not None:
        last = stored.agg(F.max("day")).first()[0]
        if last is not None:
            df = df.filter(F.col(day) >= F.date_add(F.lit(last), 1))
    day_states(df, columns, day).write.mode("append").parquet(path)
    return spark.read.schema(STATES).parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STATES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merged(states: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, n, nulls, mean, stddev, min, max, quantiles)`` of all days together.

    Moments and bounds are those of the rows; ``quantiles`` (one for each of ``shares``) come from the merged
    sketches.
    """
    n = F.col("n").cast("double")
    known = F.col("n") > 0
    # the distance between days' means, around the mean of all, by sums of bounded numbers
    sums = states.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        (F.sum(F.when(known, F.col("mean") * n)) / F.sum("n")).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(known, F.col("sketch"))).alias("sketch"),
    )
    centre = sums.select("column", F.col("mean").alias("centre"))
    inner = F.sum(F.col("squares") + n * (F.col("mean") - F.col("centre")) ** 2)
    spread = states.filter(known).join(F.broadcast(centre), "column").groupBy("column").agg(inner.alias("squares"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(share).cast("double")) for share in shares]
    return sums.join(spread, "column", "left").select(
        "column",
        "n",
        "nulls",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("stddev"),
        "min",
        "max",
        F.when(F.col("n") > 0, F.array(*found)).alias("quantiles"),
    )
