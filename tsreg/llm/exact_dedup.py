"""Exact duplicates by counting quotient filters (Pandey et al., SIGMOD 2017).

Each text gets a 64-bit fingerprint. Every partition builds counting quotient filters over its
fingerprints, one per block of the fingerprint space: the top bits of a fingerprint name the block,
the next bits are the quotient, kept as an occupied bit and a run of slots, and only the rest, the
remainder, is stored, in as few bytes as hold it, sorted within its run. A slot that counts one takes a
bit for that; larger counts follow in as few bytes as hold the largest. Filters of a block merge
without loss by their sorted remainders, one after the other, and equal ones become one slot at once.
Only rows whose fingerprint counts more than one go on to the comparison of bytes, where Spark groups
by the whole normalised text.

Nothing depends on how the copies are spread: a fingerprint that a third of all rows share is one
counter per partition, and equal texts are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreg.llm.common import drop_rows, lower_ascii, lowered, map_arrow
from tsreg.sources.stage import stage

BLOCK_ROWS = 1 << 17
MIN_BLOCK_BITS = 6
FLUSH_ROWS = 1 << 20

FILTERS = pa.schema(
    [
        ("block", pa.int64()),
        ("quotient_bits", pa.int32()),
        ("occupied", pa.binary()),
        ("run_ends", pa.binary()),
        ("remainders", pa.binary()),
        ("many", pa.binary()),
        ("counts", pa.binary()),
    ]
)


def narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each of ``values``."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers out of :func:`narrow`'s bytes."""
    wide = np.zeros((n, 8), np.uint8)
    if n:
        low = np.frombuffer(data, np.uint8).reshape(n, -1)
        wide[:, : low.shape[1]] = low
    return wide.reshape(-1).view("<u8")


def width_of(largest: int) -> int:
    """Bytes that hold ``largest``, at least one."""
    return max(1, (int(largest).bit_length() + 7) // 8)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, fingerprint and SHA-256 of each normalised text (A-Z lower-cased, null as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lowered(batch.column(1))
            prints = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64)
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), pa.array(shas, pa.string())],
                names=["doc_id", "fingerprint", "text_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {kind}, fingerprint bigint, text_sha256 string")


def build_filter(block: int, block_bits: int, prints: np.ndarray, counts: np.ndarray) -> tuple:
    """One filter out of sorted distinct fingerprints of a block and their counts."""
    rest = 64 - block_bits
    quotient_bits = min(max(0, math.ceil(math.log2(len(prints)))), rest - 1)
    remainder_bits = np.uint64(rest - quotient_bits)
    inside = prints & np.uint64((1 << rest) - 1)
    quotients = (inside >> remainder_bits).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotients] = 1
    run_ends = np.append(quotients[1:] != quotients[:-1], True).astype(np.uint8)
    remainders = inside & ((np.uint64(1) << remainder_bits) - np.uint64(1))
    many = counts > 1
    return (
        block,
        quotient_bits,
        np.packbits(occupied).tobytes(),
        np.packbits(run_ends).tobytes(),
        narrow(remainders, width_of((1 << int(remainder_bits)) - 1)),
        np.packbits(many).tobytes(),
        narrow(counts[many], width_of(counts.max())),
    )


def read_filter(block_bits: int, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of a filter: the inverse of :func:`build_filter`."""
    rest, quotient_bits = 64 - block_bits, row["quotient_bits"]
    n = len(row["remainders"]) // width_of((1 << (rest - quotient_bits)) - 1)
    remainders = widen(row["remainders"], n)
    occupied = np.unpackbits(np.frombuffer(row["occupied"], np.uint8))[: 1 << quotient_bits]
    ends = np.unpackbits(np.frombuffer(row["run_ends"], np.uint8))[:n]
    run = np.concatenate(([0], np.cumsum(ends, dtype=np.int64)[:-1]))  # number of the run that a slot is in
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    high = np.uint64((row["block"] << rest) & ((1 << 64) - 1)) if block_bits else np.uint64(0)
    prints = high | (quotients << np.uint64(rest - quotient_bits)) | remainders
    many = np.unpackbits(np.frombuffer(row["many"], np.uint8))[:n].astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = widen(row["counts"], int(many.sum())).astype(np.int64)
    return prints, counts


def merged(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted fingerprints with summed counts."""
    order = np.argsort(prints, kind="stable")  # runs that are sorted already: a merge
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def merge_filters(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run out of filters' sorted runs; held are runs of at least doubling lengths, so each slot moves
    a logarithmic number of times."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> None:
        right, left = held.pop(), held.pop()
        held.append(merged(*map(np.concatenate, zip(left, right))))

    for part in parts:
        held.append(part)
        while len(held) > 1 and len(held[-2][0]) < 2 * len(held[-1][0]):
            join()
    while len(held) > 1:
        join()
    return held[0]


def partition_filters(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Counting quotient filters of each partition, a row per block that has fingerprints."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.concatenate(held)
        prints, counts = merged(prints, np.ones(len(prints), np.int64))
        blocks = (prints >> np.uint64(64 - block_bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        rows = [
            build_filter(int(blocks[s]), block_bits, prints[s:e], counts[s:e])
            for s, e in zip(starts, np.append(starts[1:], len(prints)))
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), FILTERS)], schema=FILTERS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield flush(held)
                held = []
        if sum(map(len, held)):
            yield flush(held)

    return map_arrow(
        fingerprints.select("fingerprint"),
        run,
        "block bigint, quotient_bits int, occupied binary, run_ends binary, remainders binary, many binary, "
        "counts binary",
    )


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints that count more than one over all partitions (``fingerprint``, ``copies``).

    The number of blocks follows ``n_rows``, so that a merge task holds about ``BLOCK_ROWS``
    fingerprints whatever the size of the table.
    """
    block_bits = max(MIN_BLOCK_BITS, math.ceil(math.log2(max(1, n_rows) / BLOCK_ROWS)))

    def merge(filters: pa.Table) -> pa.Table:
        rows = (row for batch in filters.to_batches(64) for row in batch.to_pylist())
        prints, counts = merge_filters(read_filter(block_bits, row) for row in rows)
        often = counts > 1
        return pa.table(
            {"fingerprint": prints[often].view(np.int64), "copies": counts[often]}
        )

    filters = partition_filters(fingerprints, block_bits)
    return filters.groupBy("block").applyInArrow(merge, "fingerprint bigint, copies bigint")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id``, ``text``, others are ignored).

    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Texts are equal when
    identical after lower-casing A-Z; null counts as empty. The row with the largest ``doc_id``
    stays; null ids are below all others, and a group without any id keeps one of its rows with
    ``keep_id`` null. Of rows that repeat both id and text exactly one is kept. An empty table
    gives an empty result.
    """
    found = stage(digests(docs), "exact-digests")
    repeated = stage(repeated_fingerprints(found, found.count()), "exact-repeated")

    texts = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    routed = texts.withColumn("fingerprint", F.xxhash64("norm")).join(
        repeated, "fingerprint", "left_semi"
    )
    # grouping by the text itself compares bytes; copies meet before they are shuffled
    verified = (
        routed.groupBy("norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("norm", 256).alias("group_sha"), "keep_id", "group_size")
    )
    rows = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n"))
    joined = rows.join(verified, F.col("text_sha256") == F.col("group_sha"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"),
        "text_sha256",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops, all columns as they are.

    Null texts are empty ones; null ids are below all others; of rows that repeat both id and text one
    stays, whatever their other columns; an empty table stays one.
    """
    groups = exact_groups(docs).filter("group_size > 1")
    rows = groups.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("one"))
    drops = stage(rows.filter("n > 1 OR NOT one").drop("n"), "exact-drops")
    return drop_rows(docs, drops, {"text_sha256": F.sha2(lower_ascii(docs["text"]), 256)})
