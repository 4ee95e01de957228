"""Profiles of a table: one pass over the rows for all columns together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("p25", "p50", "p75")
# the sketch errs by 1 / SKETCH_ACCURACY of the rows; guesses stand SLACK to both sides of the rank
SKETCH_ACCURACY = 10_000
SLACK = 2.0 / SKETCH_ACCURACY
# rows that a search may group by value at its end
EXACT_ROWS = 50_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def table_shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and ``n_cols``."""
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols")
    )


def schema_table(df: DataFrame) -> DataFrame:
    """The schema as rows ``(column, type, nullable)``."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def _long(wide: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row of ``<measure>_<position>`` columns as one row per column."""
    entries = [
        F.struct(
            F.lit(name).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures]
        )
        for i, name in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def _unrolled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(no, value)`` per row and column.

    Feeds aggregations over many columns. The unrolled rows are combined in the same stage; one
    aggregate per column and measure instead would make generated code too long to be compiled.
    """
    entries = [
        F.struct(F.lit(i).alias("no"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*entries)))


def _named(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("no") + 1)


def _moments(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """A row per column, by its number ``no``: size, moments and bounds, and ``more`` of its ``value``."""
    # a null per column, so that a column of an empty table still gets its row
    blank = df.sparkSession.range(len(columns)).select(
        F.col("id").cast("int").alias("no"), F.lit(None).cast("double").alias("value")
    )
    return (
        _unrolled(df, columns)
        .unionAll(blank)
        .groupBy("no")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("stddev"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            *more,
        )
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n, mean, stddev, min, max)`` with numbers as numbers, for all columns in one job."""
    columns = list(columns or numeric_columns(df))
    return _moments(df, columns).select(_named(columns).alias("column"), "n", "mean", "stddev", "min", "max")


@dataclass
class _Search:
    """Search for the ``rank``-th smallest of the ``rows`` values strictly between ``low`` and ``high``."""

    no: int
    share: float
    rank: int
    weight: float
    rows: int
    low: float | None = None
    high: float | None = None
    value: float | None = None
    following: float | None = None

    @classmethod
    def start(cls, no: int, share: float, n: int) -> _Search:
        place = share * (n - 1)
        return cls(no, share, int(place) + 1, place - int(place), n)

    @property
    def range(self) -> tuple[int, float | None, float | None]:
        return self.no, self.low, self.high

    def settle(self, points: Sequence[float], counted: Mapping[int, Row]) -> None:
        """Keep the piece that holds the rank. ``counted`` has the rows and the least value of piece
        2i + 1 on point i and of the even pieces in between, if they have rows. A value that many rows
        share is a piece of its own."""
        ends = [self.low, *points, self.high]
        pieces = sorted(counted)
        for at, piece in enumerate(pieces):
            rows = counted[piece]["rows"]
            if self.rank <= rows:
                break
            self.rank -= rows
        self.rows = rows
        if piece % 2:
            self.value = points[piece // 2]
            after = counted[pieces[at + 1]]["least"] if at + 1 < len(pieces) else self.high
            self.following = self.value if self.rank < rows else after
        else:
            self.low, self.high = ends[piece // 2], ends[piece // 2 + 1]


def _inside(value: Column, low: float | None, high: float | None) -> Column:
    keep = value.isNotNull()
    if low is not None:
        keep = keep & (value > low)
    if high is not None:
        keep = keep & (value < high)
    return keep


def _by_range(searches: Sequence[_Search]) -> list[tuple[tuple, list[_Search]]]:
    grouped: dict[tuple, list[_Search]] = {}
    for s in searches:
        grouped.setdefault(s.range, []).append(s)
    return list(grouped.items())


def _ranged(
    numbers: DataFrame, ranges: Sequence[tuple], payload: Callable[..., list[Column]] = lambda at, value: []
) -> DataFrame:
    """One row ``(at, value, …payload)`` per row and range that holds its value."""
    entries, anywhere = [], F.lit(False)
    for at, (no, low, high) in enumerate(ranges):
        value = F.col(numbers.columns[no])
        inside = _inside(value, low, high)
        entries.append(F.when(inside, F.struct(F.lit(at).alias("at"), value.alias("value"), *payload(at, value))))
        anywhere = anywhere | inside
    # late ranges are narrow: most rows leave before they are unrolled
    rows = numbers.filter(anywhere).select(F.inline(F.array(*entries)))
    return rows.filter(F.col("at").isNotNull())


def _piece(value: Column, points: Sequence[float]) -> Column:
    """2i + 1 on point i, even numbers in between, by a balanced tree of comparisons."""

    def branch(a: int, b: int) -> Column:
        if a == b:
            return F.lit(2 * a)
        m = (a + b) // 2
        return (
            F.when(value < points[m], branch(a, m))
            .when(value == points[m], F.lit(2 * m + 1))
            .otherwise(branch(m + 1, b))
        )

    return branch(0, len(points))


def _spots(middle: float) -> list[float]:
    return [max(0.0, middle - SLACK), min(1.0, middle + SLACK)]


def _proposed(numbers: DataFrame, groups: Sequence[tuple[tuple, list[_Search]]]) -> list[list[float]]:
    """One scan: a sketch proposes two values around each wanted rank of a range."""
    sketches = []
    for at, ((no, low, high), members) in enumerate(groups):
        value = F.col(numbers.columns[no])
        spots = [x for s in members for x in _spots((s.rank - 0.5) / s.rows)]
        inside = F.when(_inside(value, low, high), value)
        sketches.append(F.percentile_approx(inside, spots, SKETCH_ACCURACY).alias(f"g{at}"))
    return list(numbers.agg(*sketches).first())


def _narrow(numbers: DataFrame, searches: Sequence[_Search], proposed: Mapping[int, list[float]] | None = None) -> None:
    """One scan: counts around the proposed values decide where the wanted ranks are. The values of
    whole columns may be given; else a scan before this one finds them."""
    groups = _by_range(searches)
    found = [proposed[no] for (no, _, _), _ in groups] if proposed else _proposed(numbers, groups)
    points = [sorted(set(values)) for values in found]
    counted: dict[int, dict[int, Row]] = {at: {} for at in range(len(groups))}
    pieces = _ranged(
        numbers,
        [key for key, _ in groups],
        lambda at, value: [_piece(value, points[at]).alias("piece")],
    )
    for r in pieces.groupBy("at", "piece").agg(F.count("*").alias("rows"), F.min("value").alias("least")).collect():
        counted[r["at"]][r["piece"]] = r
    for at, (_, members) in enumerate(groups):
        for s in members:
            s.settle(points[at], counted[at])


def _look_up(numbers: DataFrame, searches: Sequence[_Search]) -> None:
    """Find the values by rank among the rows of the ranges, grouped by value first."""
    groups = _by_range(searches)
    wanted = [
        (at, j, s.rank) for at, (_, members) in enumerate(groups) for j, s in enumerate(members)
    ]
    ranks = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(w, ("at", "j", "rank"))]) for w in wanted])
    ordered = Window.partitionBy("at").orderBy("value")
    found = (
        _ranged(numbers, [key for key, _ in groups])
        .groupBy("at", "value")
        .agg(F.count("*").alias("rows"))
        .select(
            "at",
            "value",
            "rows",
            F.sum("rows").over(ordered).alias("upto"),
            F.lead("value").over(ordered).alias("next"),
        )
        .select(
            "*",
            F.explode(
                F.filter(
                    ranks,
                    lambda w: (w["at"] == F.col("at"))
                    & (w["rank"] <= F.col("upto"))
                    & (w["rank"] > F.col("upto") - F.col("rows")),
                )
            ).alias("w"),
        )
        .collect()
    )
    for row in found:
        s = groups[row["at"]][1][row["w"]["j"]]
        s.value = row["value"]
        after = s.high if row["next"] is None else row["next"]
        s.following = row["value"] if s.rank < row["upto"] else after


def _first_scan(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> list[Row]:
    """:func:`_moments` of each column, with ``spots``, the sketch's values around each share."""
    spots = [x for share in shares for x in _spots(share)]
    sketch = F.percentile_approx("value", spots, SKETCH_ACCURACY).alias("spots")
    return _moments(df, columns, sketch).orderBy("no").collect()


def _exact(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], scanned: Sequence[Row], exact_rows: int
) -> dict[tuple[int, float], float]:
    """Percentiles by column number and share, after :func:`_first_scan`; none of an empty column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    searches = [
        _Search.start(no, float(share), row["n"]) for no, row in enumerate(scanned) for share in shares if row["n"]
    ]
    proposed = {no: row["spots"] for no, row in enumerate(scanned)}
    wide = [s for s in searches if s.rows > exact_rows]
    while wide:
        _narrow(numbers, wide, proposed)
        wide, proposed = [s for s in wide if s.value is None and s.rows > exact_rows], None
    narrow = [s for s in searches if s.value is None]
    if narrow:
        _look_up(numbers, narrow)
    return {
        (s.no, s.share): s.value + (s.weight * (s.following - s.value) if s.weight else 0.0) for s in searches
    }


def percentiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    shares: Sequence[float] = QUARTILES,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Exact interpolated percentiles ``(column, share, value)``; nulls are left out.

    Spark's exact ``percentile`` gathers all distinct values of a column in one task. Here a sketch
    proposes two values around each percentile, one job counts the rows before, on and between
    them, and the search goes on in the piece that holds the wanted rank. A round divides the rows
    by some thousands. Once a piece has ``exact_rows`` rows or fewer it is grouped by value and
    looked up by rank: three scans up to some hundred million rows. Every job serves all columns and
    shares; the driver sees counts only.
    """
    columns = list(columns or numeric_columns(df))
    found = _exact(df, columns, shares, _first_scan(df, columns, shares), exact_rows)
    rows = [(columns[no], share, value) for (no, share), value in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, share double, value double")


def summary(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """:func:`describe` with ``p25``, ``p50`` and ``p75``: from one sketch scan, or exact with two more."""
    columns = list(columns or numeric_columns(df))
    measures = ("n", "mean", "stddev", "min", "max")
    if approx:
        sketch = F.percentile_approx("value", list(QUARTILES)).alias("q")
        found = _moments(df, columns, sketch).select(_named(columns).alias("column"), *measures, "q")
        return found.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(QUARTILE_NAMES)]).drop("q")
    scanned = _first_scan(df, columns, QUARTILES)
    found = _exact(df, columns, QUARTILES, scanned, EXACT_ROWS)
    rows = [
        (columns[no], *[row[m] for m in measures], *[found.get((no, share)) for share in QUARTILES])
        for no, row in enumerate(scanned)
    ]
    numbers = ", ".join(f"{name} double" for name in (*measures[1:], *QUARTILE_NAMES))
    return df.sparkSession.createDataFrame(rows, f"column string, n bigint, {numbers}")


def target_correlations(
    df: DataFrame, target: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Pearson correlation of each column with ``target``, as ``(column, correlation)`` rows."""
    columns = list(columns or [c for c in numeric_columns(df) if c != target])
    found = df.agg(
        *[
            F.corr(F.col(target).cast("double"), F.col(c).cast("double")).alias(f"correlation_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return _long(found, columns, ["correlation"])


def bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest and largest value of a column."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))
