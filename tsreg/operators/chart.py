"""Chart tables of bounded length that keep a series' shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.operators.timeline import DAILY, Timeline, series_rank


def downsampled(df: DataFrame, value: str, buckets: int, line: Timeline = DAILY) -> DataFrame:
    """At most 3 rows of each of ``buckets`` parts of a series: the largest triangle, the least and the greatest value.

    A series is cut into parts of about equal numbers of rows, in order. A row's triangle stands on the mean
    points (place, value) of the parts before and behind its own; at the ends, on the part itself. Ties go
    to the first row. Rows with a null value are no points. Columns: key, ``value``, ``part`` and ``place``.

    Rows are ranked inside calendar buckets; the parts' means are one small table.
    """
    if buckets < 1:
        raise ValueError("a chart needs 1 or more buckets")
    keys = list(line.by)
    points = series_rank(df.filter(F.col(value).isNotNull()).select(*keys, line.order, value), line, "place")
    sizes = points.groupBy(*keys).agg(F.max("place").alias("_n"))
    number = F.floor((F.col("place") - 1) * buckets / F.greatest(F.col("_n"), F.lit(buckets)))
    parted = points.join(sizes, keys).withColumn("part", number).drop("_n")
    means = parted.groupBy(*keys, "part").agg(F.avg("place").alias("_x"), F.avg(value).alias("_y"))
    beside = means
    for name, step in (("left", 1), ("right", -1)):
        moved = means.select(
            *keys, (F.col("part") + step).alias("part"), F.col("_x").alias(f"_{name}_x"), F.col("_y").alias(f"_{name}_y")
        )
        beside = beside.join(moved, [*keys, "part"], "left")
        beside = beside.withColumns({f"_{name}_{c}": F.coalesce(f"_{name}_{c}", f"_{c}") for c in "xy"})
    area = F.abs(
        (F.col("_left_x") - F.col("place")) * (F.col("_right_y") - F.col("_left_y"))
        - (F.col("_left_x") - F.col("_right_x")) * (F.col(value) - F.col("_left_y"))
    )
    # areas are compared in millionths, so that a tie is one in any engine
    rounded = F.round(area, 6)
    row = F.struct(line.order, value, "place")
    chosen = (
        parted.join(beside, [*keys, "part"])
        .groupBy(*keys, "part")
        .agg(
            F.max_by(row, F.struct(rounded, -F.col("place"))).alias("largest"),
            F.min_by(row, F.struct(value, "place")).alias("least"),
            F.max_by(row, F.struct(value, -F.col("place"))).alias("greatest"),
        )
    )
    kept = F.explode(F.array_distinct(F.array("largest", "least", "greatest"))).alias("row")
    return chosen.select(*keys, "part", kept).select(*keys, f"row.{line.order}", f"row.{value}", "part", "row.place")
