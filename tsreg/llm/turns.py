"""Conversations of any length as segments: a row per at most ``SEGMENT`` turns, in order.

Turns are sorted over the whole table by ranges of (conversation, turn), so that one that holds a third of
all rows is spread over many tasks, and packed where they lie. Most conversations are one segment. Only those
at a border of two partitions can have pieces in several; there are at most twice as many as partitions, and
their pieces get their numbers from a table of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsreg.llm.common import map_arrow
from tsreg.sources.stage import stage

SEGMENT = 512
SEGMENT_BYTES = 4 << 20


def tie_order(role: str = "role", text: str = "text") -> Column:
    """Order of turns that share their number: a hash of role and text, so that equal rows are neighbours."""
    return F.xxhash64(role, text)


def _starts(ids: pa.Array) -> np.ndarray:
    """Places where another conversation begins."""
    if not len(ids):
        return np.zeros(0, np.int64)
    left, right = ids[:-1], ids[1:]
    differs = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.xor(left.is_null(), right.is_null()))
    return np.append(0, np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1)


def _cuts(low: int, high: int, sizes: np.ndarray, rows: int, most_bytes: int) -> Iterator[int]:
    """Ends of the segments of a run of turns: by number, or by bytes."""
    held = 0
    first = low
    for k in range(low, high):
        if k > first and (k - first >= rows or held + sizes[k] > most_bytes):
            yield k
            first, held = k, 0
        held += int(sizes[k])
    yield high


def _sizes(table: pa.Table) -> np.ndarray:
    total = np.zeros(table.num_rows, np.int64)
    for column in table.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy()
    return total


def segments(rows: DataFrame, rows_each: int = SEGMENT, bytes_each: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of ``rows`` (``conv_id``, ``turn``, ``tie`` and any other columns), written as a table.

    ``conv_id``; ``piece``, numbered from 0 within the conversation; ``last``, if it is the last one;
    ``start``, the place of the first turn; and all other columns as arrays in the order of (turn, tie),
    null turns first. A null ``conv_id`` is a conversation like any other.
    """
    # equal turns may be many: where they are cut doesn't matter
    keys = ["conv_id", "turn", "tie", "_salt"]
    spread = rows.withColumn("_salt", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt", "tie")
    values = [f for f in ordered.schema.fields if f.name != "conv_id"]
    conv = ordered.schema["conv_id"]
    schema = T.StructType(
        [T.StructField("conv_id", conv.dataType)]
        + [T.StructField(n, T.LongType()) for n in ("part", "piece", "start", "n")]
        + [T.StructField(n, T.BooleanType()) for n in ("border", "last")]
        + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in values]
    )
    names = [f.name for f in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: pa.Table | None = None
        done = rows_done = 0  # segments and rows of the conversation that ``held`` goes on with
        first_run = True

        def flush(table: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            nonlocal done, rows_done, first_run
            starts = _starts(table.column("conv_id").combine_chunks())
            sizes = _sizes(table)
            cuts, pieces, places, borders, lasts = [0], [], [], [], []
            for i, low in enumerate(starts):
                ends_here = i + 1 < len(starts)
                high = int(starts[i + 1]) if ends_here else table.num_rows
                at = int(low)
                for cut in _cuts(at, high, sizes, rows_each, bytes_each):
                    last = cut == high
                    if last and not ends_here and not final:
                        break
                    cuts.append(cut)
                    pieces.append(done)
                    places.append(rows_done)
                    borders.append(first_run or (last and not ends_here))
                    lasts.append(last)
                    done, rows_done, at = done + 1, rows_done + cut - at, cut
                if ends_here:
                    done, rows_done, first_run = 0, 0, False
            rest = table.slice(cuts[-1])
            if len(cuts) == 1:
                return None, rest
            full = table.slice(0, cuts[-1]).combine_chunks()
            offsets = pa.array(cuts, pa.int32())
            lists = []
            for name in names:
                column = full.column(name).combine_chunks()
                lists.append(pa.ListArray.from_arrays(offsets, column))
            ids = full.column("conv_id").combine_chunks().take(pa.array(cuts[:-1]))
            numbers = [pa.array(x, pa.int64()) for x in ([part] * len(pieces), pieces, places, np.diff(cuts))]
            flags = [pa.array(x, pa.bool_()) for x in (borders, lasts)]
            batch = pa.RecordBatch.from_arrays(
                [ids, *numbers, *flags, *lists],
                names=["conv_id", "part", "piece", "start", "n", "border", "last", *names],
            )
            return batch, rest

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            out, held = flush(table if held is None else pa.concat_tables([held, table]).combine_chunks(), False)
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            out, _ = flush(held, True)
            yield out

    found = stage(map_arrow(ordered, run, schema), "turn-segments")
    return _numbered(found)


def _numbered(found: DataFrame) -> DataFrame:
    """Numbers that go on from partition to partition, for conversations that lie at a border."""
    # two conversations a partition at most, so these tables are bounded by the number of partitions
    border = found.filter("border").select(F.col("conv_id").alias("b")).distinct()
    at_border = found.join(F.broadcast(border), found["conv_id"].eqNullSafe(F.col("b")), "left_semi")
    parts = at_border.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.sum("n").alias("rows"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.select(
            F.col("conv_id").alias("o_conv"),
            F.col("part").alias("o_part"),
            F.coalesce(F.sum("k").over(before), F.lit(0)).alias("o_piece"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("o_start"),
            F.sum("k").over(whole).alias("o_pieces"),
        )
    )
    joined = found.join(
        F.broadcast(offsets), found["conv_id"].eqNullSafe(F.col("o_conv")) & (found["part"] == F.col("o_part")), "left"
    )
    others = [c for c in found.columns if c not in ("conv_id", "part", "piece", "start", "n", "border", "last")]
    piece = F.col("piece") + F.coalesce("o_piece", F.lit(0))
    return joined.select(
        "conv_id",
        piece.alias("piece"),
        F.coalesce(piece == F.col("o_pieces") - 1, F.col("last")).alias("last"),
        (F.col("start") + F.coalesce("o_start", F.lit(0))).alias("start"),
        *others,
    )


def doubled(table: DataFrame, keys: str, merge, label: str, forward: bool = True) -> DataFrame:
    """Running products of ``value`` over ``piece`` within ``conv_id``, by joins at doubled distances.

    ``merge(earlier, later)`` of two columns gives that of their product. With ``forward`` a row holds the
    product of the pieces up to its own, else from its own on.
    """
    table = stage(table.select(keys, "piece", "value"), label)
    most = table.agg(F.max("piece")).first()[0] or 0
    step = 1
    while step <= most:
        other = table.select(
            F.col(keys).alias("o_key"),
            (F.col("piece") + (step if forward else -step)).alias("o_piece"),
            F.col("value").alias("o_value"),
        )
        joined = table.join(
            other, table[keys].eqNullSafe(F.col("o_key")) & (table["piece"] == F.col("o_piece")), "left"
        )
        pair = (F.col("o_value"), F.col("value")) if forward else (F.col("value"), F.col("o_value"))
        product = F.when(F.col("o_piece").isNull(), F.col("value")).otherwise(merge(*pair))
        table = stage(joined.select(keys, "piece", product.alias("value")), label)
        step *= 2
    return table
