"""Cleaning steps: names, dates, duplicates, missing values, adjustment, calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreg.functions.columns import parse_date
from tsreg.operators.timeline import DAILY, STEPS_PER_DAY, Timeline


def cast_dates(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """``column`` as a date. Text that is no date becomes null, or fails the job when ``strict``."""
    parsed = parse_date(column)
    if strict:
        failed = F.col(column).isNotNull() & parsed.isNull()
        message = F.concat(F.lit(f"not a date in {column}: "), F.col(column).cast("string"))
        parsed = F.when(failed, F.raise_error(message)).otherwise(parsed)
    return df.withColumn(column, parsed)


def date_quality(df: DataFrame, column: str) -> DataFrame:
    """One row: all rows, and those whose text in ``column`` is not a date."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(column).isNotNull() & parse_date(column).isNull()).alias("n_bad"),
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once. Copies are combined before the shuffle, however many there are."""
    return df.dropDuplicates()


def dedup_keyed(df: DataFrame, keys: Sequence[str], prefer: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``prefer``, then by the other columns.

    A minimum over a struct instead of a row number, so that the copies of a hot key are combined
    before the shuffle.
    """
    others = [c for c in df.columns if c not in keys and c not in prefer]
    best = F.min(F.struct(*prefer, *others)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None, nan: bool = False) -> DataFrame:
    """Rows without a null in ``columns`` (all by default); with ``nan``, also without a NaN."""
    for name in columns or df.columns:
        df = df.filter(F.col(name).isNotNull())
        if nan and df.schema[name].dataType.typeName() in ("double", "float"):
            df = df.filter(~F.isnan(name))
    return df


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """Prices and volume on the scale of ``adj_close``: factor = adj_close / close."""
    factor = F.col("adj_close") / F.col("close")
    prices: dict[str, Column] = {c: F.col(c) * factor for c in ("open", "high", "low")}
    return bars.withColumns(
        {**prices, "volume": F.col("volume") / factor, "close": F.col("adj_close")}
    )


def align_calendar(df: DataFrame, line: Timeline = DAILY) -> DataFrame:
    """One row per calendar step between the first and the last row of each series.

    Steps without a row get nulls. ``line.order`` must already stand on whole steps. Each series is
    first unrolled into buckets and these, once spread over the cluster, into steps.
    """
    minutes = 1440 // STEPS_PER_DAY[line.grain]
    every = "interval 1 day" if line.grain == "day" else f"interval {minutes} minutes"
    stride = (
        f"interval {line.width} days"
        if line.grain == "day"
        else f"interval {minutes * line.width} minutes"
    )
    spans = df.groupBy(*line.by).agg(F.min(line.order).alias("_a"), F.max(line.order).alias("_z"))
    starts = spans.select(
        *line.by, "_z", F.explode(F.expr(f"sequence(_a, _z, {stride})")).alias("_start")
    ).repartition(*line.by, "_start")
    steps = starts.select(
        *line.by,
        F.explode(
            F.expr(f"sequence(_start, least(_z, _start + {stride} - {every}), {every})")
        ).alias(line.order),
    )
    return steps.join(df, [*line.by, line.order], "left").select(*df.columns)
