"""Exact ranks, cuts and splits along one total order, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tsreg.functions.columns import after, before, key_literals, on_key, up_to
from tsreg.operators.timeline import DAILY, Timeline, bucket_sizes
from tsreg.sources.stage import stage

TIME_ORDER = ("date", "symbol")
MAX_CELL = 1_000_000
# pieces into which one round of the search for a cut divides the rows that are left
FAN_OUT = 256


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame


def _piece(order: Sequence[str], splits: Sequence[Sequence[Column]]) -> Column:
    """Order-preserving piece number of a row: 2i + 1 on split key i, even numbers in between.

    A balanced tree of comparisons, so a row passes few of them. A key that many rows share gets a
    piece of its own.
    """

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        key = splits[middle]
        return (
            F.when(before(order, key), branch(low, middle))
            .when(on_key(order, key), F.lit(2 * middle + 1))
            .otherwise(branch(middle + 1, high))
        )

    return branch(0, len(splits))


def _split_keys(rows: DataFrame, order: Sequence[str], n: int, max_cell: int, seed: int) -> list[tuple]:
    """Keys that cut ``n`` rows into pieces of about half of ``max_cell`` rows, ``FAN_OUT`` at most.

    They come from a sample of at most a few thousand keys. Only the balance of the pieces depends
    on it: a cut counts all rows, and another round divides a piece that is still too large.
    """
    pieces = min(FAN_OUT, 2 * -(-n // max_cell))
    fraction = min(1.0, 32 * pieces / n)
    sample = rows.select(*order).sample(fraction=fraction, seed=seed).collect()
    keys = sorted({tuple(row) for row in sample})
    places = sorted({len(keys) * i // pieces for i in range(1, pieces)})
    return [keys[p] for p in places if p < len(keys)]


def _missing(order: Sequence[str]) -> Column:
    missing = F.col(order[0]).isNull()
    for name in order[1:]:
        missing = missing | F.col(name).isNull()
    return F.count_if(missing).alias("_nulls")


def _day_sizes(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows per calendar day of the first order column: never longer than the calendar."""
    return df.groupBy(F.to_date(order[0]).alias("_day")).agg(F.count("*").alias("_n"), _missing(order))


def _refuse_nulls(order: Sequence[str], found: Row | None) -> None:
    if found is not None and found["_nulls"]:
        raise ValueError(f"{found['_nulls']} rows have a null in the order columns {list(order)}")


def ranked_cells(df: DataFrame, order: Sequence[str], max_cell: int = MAX_CELL) -> DataFrame:
    """``df`` in sorted range partitions, written once, with ``_cell`` and ``_pos`` (from 0) in it.

    There are twice as many partitions as ``max_cell`` asks for on average, since their bounds come
    from a sample. Only rows that share one whole key can't be parted.
    """
    found = df.agg(F.count("*").alias("_n"), _missing(order)).first()
    _refuse_nulls(order, found)
    cells = max(1, -(-2 * found["_n"] // max_cell))
    # the row's number in its partition, below the partition's number
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(cells, *order).sortWithinPartitions(*order).withColumn("_place", place)
    return stage(ranged, "ranked").select(
        *df.columns,
        F.shiftright("_place", 33).alias("_cell"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def global_rank(
    df: DataFrame, order: Sequence[str] = TIME_ORDER, name: str = "rank", max_cell: int = MAX_CELL
) -> DataFrame:
    """Exact position of each row in ascending ``order`` over the whole table, from 1.

    Rows are sorted in range partitions of about ``max_cell`` / 2 rows, whatever the order columns and
    however many days are crowded: one shuffle. The sizes of the partitions, summed up in a table of
    one row per partition, give the offsets.
    """
    cells = ranked_cells(df, list(order), max_cell)
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("_cell")
        .agg(F.count("*").alias("_n"))
        .select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    rank = (F.col("_offset") + F.col("_pos") + 1).cast("bigint")
    return cells.join(offsets, "_cell").withColumn(name, rank).drop("_cell", "_pos", "_offset")


def _kth_key(rows: DataFrame, order: Sequence[str], k: int, n: int, max_cell: int) -> tuple:
    """Key of the k-th of ``n`` rows: counts pieces until few rows are left, then takes one row."""
    seed = 0
    while n > max_cell:
        seed += 1  # another sample if one came out empty
        splits = _split_keys(rows, order, n, max_cell, seed)
        if not splits:
            continue
        pieces = _piece(order, [key_literals(rows, order, key) for key in splits])
        tagged = rows.withColumn("_piece", pieces)
        counts = tagged.groupBy("_piece").count().orderBy("_piece").collect()
        place = 0
        while counts[place]["count"] < k:
            k -= counts[place]["count"]
            place += 1
        chosen, n = counts[place]["_piece"], counts[place]["count"]
        if chosen % 2:
            return splits[chosen // 2]
        rows = tagged.filter(F.col("_piece") == chosen).drop("_piece")
    return tuple(rows.select(*order).orderBy(*order).offset(k - 1).limit(1).first())


def _cut_at(df: DataFrame, order: Sequence[str], wanted: str, max_cell: int) -> list[Column] | None:
    """Key of row number ``wanted`` (an expression over ``_total`` rows) in ``order``.

    None if there is no such row. Two small jobs: counts per day, then the one day it falls on.
    """
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        _day_sizes(df, order)
        .select(
            "_day",
            "_n",
            F.sum("_n").over(upto).alias("_upto"),
            F.expr("sum(_n) OVER ()").alias("_total"),
            F.expr("sum(_nulls) OVER ()").alias("_nulls"),
        )
        .withColumn("_k", F.expr(wanted))
        .filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .first()
    )
    if found is None:
        return None
    _refuse_nulls(order, found)
    rows = df.filter(F.to_date(order[0]) == F.lit(found["_day"]))
    k = found["_k"] - (found["_upto"] - found["_n"])
    return key_literals(df, order, _kth_key(rows, order, k, found["_n"], max_cell))


def time_cut(
    df: DataFrame,
    numerator: int = 80,
    denominator: int = 100,
    order: Sequence[str] = TIME_ORDER,
    max_cell: int = MAX_CELL,
) -> list[Column] | None:
    """Key of the last of the first floor(n · numerator / denominator) rows, None if there is none."""
    # integer arithmetic: 0.8 * n in doubles can fall one short
    return _cut_at(df, list(order), f"_total * {int(numerator)} div {int(denominator)}", max_cell)


def chrono_split(
    df: DataFrame,
    numerator: int = 80,
    denominator: int = 100,
    order: Sequence[str] = TIME_ORDER,
    max_cell: int = MAX_CELL,
) -> Split:
    """First floor(n · numerator / denominator) rows by time as train, the others as test.

    Both parts are plain filters against one literal key: no rank, no set operation, no shuffle, and
    on a parquet table the filter prunes folders and row groups. ``order`` must be total; rows that
    tie on all of it stay together in train.
    """
    if not 0 < numerator < denominator:
        raise ValueError("the train share must lie between 0 and 1")
    cut = time_cut(df, numerator, denominator, order, max_cell)
    if cut is None:
        return Split(df.filter(F.lit(False)), df)
    order = list(order)
    return Split(df.filter(up_to(order, cut)), df.filter(after(order, cut)))


def series_cuts(df: DataFrame, wanted: Column, line: Timeline = DAILY) -> DataFrame:
    """Per series, the time ``_cut`` of its k-th row; ``wanted`` computes k from ``_total`` rows.

    Series with k = 0 are left out. Only the one bucket that holds the k-th row is numbered.
    """
    whole = Window.partitionBy(*line.by)
    cells = (
        bucket_sizes(df, line)
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_k", F.least(wanted, F.col("_total")) - F.col("_offset"))
        .filter((F.col("_k") >= 1) & (F.col("_k") <= F.col("_n")))
        .select(*line.cell, "_k")
    )
    return (
        line.bucketed(df.select(*line.by, line.order))
        .join(cells, list(line.cell))
        .withColumn("_pos", F.row_number().over(line.inside()))
        .filter(F.col("_pos") == F.col("_k"))
        .select(*line.by, F.col(line.order).alias("_cut"))
    )


def chrono_marked_series(
    df: DataFrame, numerator: int = 80, denominator: int = 100, line: Timeline = DAILY, name: str = "in_train"
) -> DataFrame:
    """``df`` with a boolean ``name``: the first floor(n · numerator / denominator) rows of each series.

    Rows that tie with the last of them on the time are among them. One wide shuffle: a bucket becomes an array
    of its rows, its size gives the number of rows before it, and only the bucket with the cut is sorted.
    """
    if not 0 < numerator < denominator:
        raise ValueError("the train share must lie between 0 and 1")
    others = [c for c in df.columns if c not in line.by]
    entry = F.struct(*[F.col(f"`{c}`") for c in others])
    buckets = line.bucketed(df).groupBy(*line.cell).agg(F.collect_list(entry).alias("_rows"))
    size = F.size("_rows").cast("bigint")
    earlier = F.coalesce(F.sum(size).over(line.earlier_buckets()), F.lit(0))
    cells = (
        buckets.withColumns({"_offset": earlier, "_total": F.sum(size).over(Window.partitionBy(*line.by))})
        # how many rows of the bucket are in front, if there are so many
        .select(*line.cell, F.expr(f"_total * {int(numerator)} div {int(denominator)} - _offset").alias("_k"))
    )
    times = F.sort_array(F.transform("_rows", lambda row: row[line.order]))
    cut = F.when((F.col("_k") >= 1) & (F.col("_k") <= size), F.get(times, (F.col("_k") - 1).cast("int")))
    marked = F.transform(
        "_rows",
        lambda row: F.struct(
            *[row[c].alias(c) for c in others],
            F.coalesce(row[line.order] <= F.col("_cut"), F.col("_k") > size).alias(name),
        ),
    )
    rows = buckets.join(cells, list(line.cell)).withColumn("_cut", cut)
    return rows.select(*line.by, F.inline(marked)).select(*[f"`{c}`" for c in df.columns], name)


def chrono_split_series(
    df: DataFrame, numerator: int = 80, denominator: int = 100, line: Timeline = DAILY
) -> Split:
    """:func:`chrono_split` inside each series; :func:`chrono_marked_series` has both parts in one table."""
    marked = chrono_marked_series(df, numerator, denominator, line, "_in_train")
    return Split(marked.filter("_in_train").drop("_in_train"), marked.filter("NOT _in_train").drop("_in_train"))


def horizon(
    df: DataFrame, n: int, order: Sequence[str] = TIME_ORDER, max_cell: int = MAX_CELL
) -> DataFrame:
    """The first ``n`` rows by time of the whole table, and any that tie with the last on all of
    ``order``.

    A filter against the key of row n, so that no task gathers them however large ``n`` is.
    """
    if n < 1:
        raise ValueError("the horizon must be 1 or more")
    order = list(order)
    cut = _cut_at(df, order, f"least(_total, {int(n)})", max_cell)
    return df if cut is None else df.filter(up_to(order, cut))


def horizon_series(df: DataFrame, n: int, line: Timeline = DAILY) -> DataFrame:
    """The first ``n`` rows by time of each series; a null key fails the job, as in all of ``timeline``."""
    if n < 1:
        raise ValueError("the horizon must be 1 or more")
    cuts = series_cuts(df, F.lit(n), line)
    return (
        df.join(cuts, list(line.by))
        .filter(F.col(line.order) <= F.col("_cut"))
        .select(*df.columns)
    )


def hash_bucket(keys: Sequence[str], seed: int, buckets: int) -> Column:
    """Bucket 0 … buckets-1 from the MD5 of the key's text: the same under any partitioning.

    The first eight hex digits of ``md5("key|key|…|seed")``, which any SQL engine can state; a null
    part of the key is left out of the text.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(buckets)).cast("int")


def hash_split(
    df: DataFrame, keys: Sequence[str], percent: int = 80, seed: int = 42
) -> Split:
    """Random split of about ``percent`` : 100 - percent, decided row by row from the key."""
    share = hash_bucket(keys, seed, 100)
    return Split(df.filter(share < percent), df.filter(share >= percent))


def fold_column(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """``df`` with a random but repeatable ``fold`` 0 … folds-1."""
    return df.withColumn("fold", hash_bucket(keys, seed, folds))


def rolling_origin_folds(df: DataFrame, folds: int, first: str = "date") -> DataFrame:
    """Cut days of rolling-origin validation: one row per fold.

    The table is cut into ``folds`` + 1 blocks of whole days with about equal row counts. Fold i
    trains on all days up to ``train_end`` and validates on the block after it, up to ``valid_end``.
    """
    if folds < 1:
        raise ValueError("folds must be 1 or more")
    _refuse_nulls([first], df.agg(_missing([first])).first())
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        _day_sizes(df, [first])
        .select(
            "_day",
            "_n",
            F.sum("_n").over(upto).alias("_upto"),
            F.expr("sum(_n) OVER ()").alias("_total"),
        )
        # the block of a day is that of its last row
        .withColumn("_block", F.expr(f"((_upto - 1) * {folds + 1}) div _total"))
        .groupBy("_block")
        .agg(F.max("_day").alias("_end"), F.sum("_n").alias("_rows"))
    )
    by_block = Window.orderBy("_block")
    return (
        blocks.select(
            F.row_number().over(by_block).alias("_no"),
            F.lag("_end").over(by_block).alias("train_end"),
            F.col("_end").alias("valid_end"),
            F.sum("_rows").over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("n_train"),
            F.col("_rows").alias("n_valid"),
        )
        .filter(F.col("train_end").isNotNull())
        .select((F.col("_no") - 1).alias("fold"), "train_end", "valid_end", "n_train", "n_valid")
    )


__all__ = [
    "Split",
    "chrono_marked_series",
    "chrono_split",
    "chrono_split_series",
    "fold_column",
    "global_rank",
    "hash_bucket",
    "hash_split",
    "horizon",
    "horizon_series",
    "ranked_cells",
    "rolling_origin_folds",
    "series_cuts",
    "time_cut",
]


def minibatches(
    df: DataFrame, keys: Sequence[str], rows: int, epoch: int = 1, seed: int = 42, max_cell: int = MAX_CELL
) -> DataFrame:
    """``df`` with ``batch`` and ``place`` (from 0): all rows dealt anew into batches of ``rows``.

    An epoch's order is that of the MD5 of key, seed and epoch, so it repeats under any partitioning. Rows
    get their numbers in it by one range sort; a batch is a range of numbers, and the last may be short.
    ``keys`` must tell all rows apart.
    """
    if rows < 1:
        raise ValueError("a batch needs 1 or more rows")
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)), F.lit(str(epoch)))
    ranked = global_rank(df.withColumn("_draw", F.md5(text)), ("_draw", *keys), "_number", max_cell)
    number = F.col("_number") - 1
    return ranked.select(
        *df.columns, F.floor(number / rows).alias("batch"), F.pmod(number, F.lit(rows)).alias("place")
    )
