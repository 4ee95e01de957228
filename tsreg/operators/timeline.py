"""Per-series windows that never put a whole series into one task.

``Window.partitionBy("symbol")`` sends every row of a series to one task, so one long or hot series
stalls the job. Here a series is cut into buckets of ``width`` calendar steps. Rows are windowed
inside (series, bucket); what a bucket needs from earlier ones (a row count, the last value, the
last k values) is a small table with one row per bucket, carried along the series and joined back on
the same keys. The rows themselves are shuffled once.

Bounds: keys are unique and not null, so a bucket has at most ``width`` rows, and the carried table
has at most one row per ``width`` steps of a series. The carried table gets no broadcast hint:
adaptive execution broadcasts it when its measured size allows, and otherwise merges it with the
rows, which the window has already partitioned and sorted by the join keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS_PER_DAY = {"day": 1, "hour": 24, "minute": 1440}


def _instead(kind: T.DataType) -> Column | None:
    """Any value of a type that is not null, None for nested types."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None


@dataclass(frozen=True)
class Timeline:
    """Key of a table of series: series columns, time column and its grain."""

    by: tuple[str, ...] = ("symbol",)
    order: str = "date"
    grain: str = "day"
    width: int = 256

    def step(self) -> Column:
        """Calendar step of a row, as a number that grows with time."""
        day = F.unix_date(F.to_date(self.order)).cast("bigint")
        if self.grain == "day":
            return day
        hour = day * 24 + F.hour(self.order)
        if self.grain == "hour":
            return hour
        if self.grain == "minute":
            return hour * 60 + F.minute(self.order)
        raise ValueError(f"unknown grain {self.grain!r}: use one of {sorted(STEPS_PER_DAY)}")

    def bucketed(self, df: DataFrame) -> DataFrame:
        """``df`` with its bucket number; a null key fails the job instead of losing the row.

        The check also tells the optimizer that the series columns hold no nulls. Without it, the
        join with the carried table would add null filters to one of two otherwise equal shuffles,
        and Spark could not run them once for both.
        """
        message = F.lit(f"null in key column {(*self.by, self.order)}")

        def checked(value: Column, instead: Column | None) -> Column:
            failing = F.when(value.isNull(), F.raise_error(message)).otherwise(value)
            return failing if instead is None else F.coalesce(failing, instead)

        series = {
            field.name: checked(F.col(field.name), _instead(field.dataType))
            for field in df.select(*self.by).schema
        }
        bucket = F.floor(self.step() / self.width)
        return df.withColumns({**series, "_bucket": checked(bucket, F.lit(0).cast("bigint"))})

    @property
    def cell(self) -> tuple[str, ...]:
        return (*self.by, "_bucket")

    def inside(self) -> WindowSpec:
        """Rows of one bucket in time order."""
        return Window.partitionBy(*self.cell).orderBy(self.order)

    def over_buckets(self) -> WindowSpec:
        """Bucket rows of one series in time order (for the carried table only)."""
        return Window.partitionBy(*self.by).orderBy("_bucket")

    def earlier_buckets(self) -> WindowSpec:
        return self.over_buckets().rowsBetween(Window.unboundedPreceding, -1)


DAILY = Timeline()


def bucket_sizes(df: DataFrame, line: Timeline) -> DataFrame:
    """One row per (series, bucket): ``_n`` rows in it, ``_offset`` rows in earlier ones."""
    sizes = line.bucketed(df).groupBy(*line.cell).agg(F.count("*").alias("_n"))
    return sizes.select(
        *line.cell,
        "_n",
        F.coalesce(F.sum("_n").over(line.earlier_buckets()), F.lit(0)).alias("_offset"),
    )


def series_rank(df: DataFrame, line: Timeline = DAILY, name: str = "rn") -> DataFrame:
    """Exact position of each row in its series, from 1."""
    offsets = bucket_sizes(df, line).select(*line.cell, "_offset")
    return (
        line.bucketed(df)
        .withColumn("_pos", F.row_number().over(line.inside()))
        .join(offsets, list(line.cell), "left")
        .withColumn(name, (F.col("_offset") + F.col("_pos")).cast("bigint"))
        .drop("_bucket", "_pos", "_offset")
    )


def _last(array: Column, depth: int) -> Column:
    """The last ``depth`` elements of an array, all of it when shorter."""
    return F.slice(array, F.greatest(F.size(array) - depth + 1, F.lit(1)), F.lit(depth))


def _carried(tails: DataFrame, line: Timeline, depth: int) -> DataFrame:
    """``tails`` (one row per bucket, ``_tail``: at most ``depth`` last entries of it) with ``_carry``:
    the last ``depth`` entries before the bucket, oldest first.

    The frame goes by the number of entries before a bucket, not by buckets: it holds about three
    times ``depth`` entries at most, however deep the carry and however sparse the series is.
    """
    before = F.coalesce(F.sum(F.size("_tail")).over(line.earlier_buckets()), F.lit(0))
    nearest = Window.partitionBy(*line.by).orderBy("_before").rangeBetween(1 - 2 * depth, -1)
    return tails.withColumn("_before", before).withColumn(
        "_carry", _last(F.flatten(F.collect_list("_tail").over(nearest)), depth)
    )


def add_lags(
    df: DataFrame,
    columns: Sequence[str],
    depths: Iterable[int],
    line: Timeline = DAILY,
    bucketed: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    """``<column>_lag_<k>``: the value k rows earlier in the series, null before its start.

    One wide shuffle: a bucket becomes an array of its rows, in which the lags are looked up, and the
    carried entries come from the same arrays. Columns must have types that can be ordered.

    ``keep_bucket`` leaves the column ``_bucket`` on the rows. A second call on them, or on a part of
    them, with ``bucketed`` and the same ``line`` finds each bucket in one place and shuffles no rows.
    """
    wanted = sorted(set(depths))
    if not wanted or wanted[0] < 1:
        raise ValueError("lags must be 1 or more")
    named = [c for c in df.columns if not (bucketed and c == "_bucket")]
    others = [c for c in named if c not in (*line.by, line.order)]
    entry = F.struct(line.order, *others)
    placed = df if bucketed else line.bucketed(df)
    buckets = placed.groupBy(*line.cell).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    lagged = F.transform(
        _last(F.col("_rows"), wanted[-1]), lambda row: F.struct(*[row[c].alias(c) for c in columns])
    )
    carried = _carried(buckets.select(*line.cell, lagged.alias("_tail")), line, wanted[-1])

    def with_lags(row: Column, place: Column) -> Column:
        lags = [
            F.when(place >= k, F.get(F.col("_rows"), place - k)[c])
            .otherwise(F.get(F.col("_carry"), F.size("_carry") + place - k)[c])
            .alias(f"{c}_lag_{k}")
            for c in columns
            for k in wanted
        ]
        return F.struct(*[row[c].alias(c) for c in (line.order, *others)], *lags)

    joined = buckets.join(carried.select(*line.cell, "_carry"), list(line.cell), "left")
    kept = ["_bucket"] if keep_bucket else []
    rows = joined.select(*line.by, *kept, F.inline(F.transform("_rows", with_lags)))
    return rows.select(*named, *kept, *[f"{c}_lag_{k}" for c in columns for k in wanted])


def forward_fill(df: DataFrame, columns: Sequence[str], line: Timeline = DAILY) -> DataFrame:
    """Nulls in ``columns`` replaced by the last earlier value of the series."""
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line.order))).alias(f"_known_{c}")
        for c in columns
    ]
    carried = (
        line.bucketed(df.select(*line.by, line.order, *columns))
        .groupBy(*line.cell)
        .agg(*last_known)
        .select(
            *line.cell,
            *[
                F.last(f"_known_{c}", ignorenulls=True).over(line.earlier_buckets()).alias(f"_from_{c}")
                for c in columns
            ],
        )
    )
    so_far = line.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        line.bucketed(df)
        .withColumns({f"_near_{c}": F.last(c, ignorenulls=True).over(so_far) for c in columns})
        .join(carried, list(line.cell), "left")
        .withColumns({c: F.coalesce(f"_near_{c}", f"_from_{c}") for c in columns})
        .select(*df.columns)
    )


def sequence_samples(
    df: DataFrame,
    value: str,
    length: int,
    line: Timeline = DAILY,
    drop_last: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """Windowed samples ``(series, time, i, x, y)``: ``x`` holds the ``length`` values before a row
    and ``y`` the row's own value, so each sample carries the date it predicts.

    A series of n rows gives n - length samples, numbered by ``i`` from 1. ``drop_last`` leaves out
    the last one of each series; ``cap`` keeps the first ``cap`` of each. Pass only the test part of
    a table to let windows restart in it; pass the whole table and split by time to keep the
    history of its first days.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    if cap is not None and cap < 1:
        raise ValueError("cap must be 1 or more")
    # A bucket becomes one array of at most ``width`` values, and a sample a slice of it: cheaper
    # than a moving window, which builds each sample anew.
    entry = F.struct(F.col(line.order).alias("at"), F.col(value).alias("v"))
    buckets = (
        line.bucketed(df.select(*line.by, line.order, value))
        .groupBy(*line.cell)
        .agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    )
    tails = buckets.select(
        *line.cell,
        F.size("_rows").alias("_n"),
        _last(F.col("_rows").getField("v"), length).alias("_tail"),
    )
    carried = _carried(tails, line, length).select(
        *line.cell,
        F.coalesce(F.sum("_n").over(line.earlier_buckets()), F.lit(0)).alias("_offset"),
        F.lead("_bucket").over(line.over_buckets()).isNull().alias("_last_bucket"),
        "_carry",
    )
    held = F.size("_values") - F.size("_rows")
    rows = (
        buckets.join(carried, list(line.cell), "left")
        .withColumn("_values", F.concat("_carry", F.col("_rows").getField("v")))
        .withColumns({"_held": held, "_n": F.size("_rows")})
        .select("*", F.posexplode("_rows").alias("_pos", "_row"))
    )
    samples = rows.filter(F.col("_held") + F.col("_pos") >= length).select(
        *line.by,
        F.col("_row.at").alias(line.order),
        (F.col("_offset") + F.col("_pos") + 1 - length).alias("i"),
        F.slice("_values", F.col("_held") + F.col("_pos") - length + 1, F.lit(length)).alias("x"),
        F.col("_row.v").alias("y"),
        (F.col("_last_bucket") & (F.col("_pos") == F.col("_n") - 1)).alias("_end"),
    )
    if drop_last:
        samples = samples.filter(~F.col("_end"))
    if cap is not None:
        samples = samples.filter(F.col("i") <= cap)
    return samples.drop("_end")
