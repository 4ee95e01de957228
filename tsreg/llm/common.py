"""Helpers that several operators of this package use."""

from __future__ import annotations

import ctypes
import os
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    The archive lies in the driver's own folder for added files, from where Spark serves it.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_tsreg_shipped", False) or not os.path.isdir(package):
        return
    folder = os.path.join(SparkFiles.getRootDirectory(), "ship")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "tsreg_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for place, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(place, name)
                archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._tsreg_shipped = True


_KEPT: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps in this worker from task to task; what others kept is dropped."""
    for other in [name for name in _KEPT if name != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def give_back() -> None:
    """Hand free memory back to the system: workers wait for the next stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    owner: str = "",
) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts don't pile up in a worker.

    Sets the two batch limits of the session, which Spark reads when it plans the job. Free memory is
    given back after each batch. ``owner`` names the :func:`worker_cache` that stays in the workers.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        for batch in run(batches):
            yield batch
            give_back()
        give_back()

    return df.mapInArrow(trimmed, schema)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def lowered(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text with A-Z lower-cased and nothing else changed, null as empty."""
    return texts_of(pc.ascii_lower(column))


def lower_ascii(text):
    """SQL form of :func:`lowered`."""
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILTER_CHUNK = 1 << 16
FILTER_MOST = 1 << 27  # bits, 16 MB


def _listed(ids: DataFrame) -> Column:
    """A test of ``doc_id`` that holds for all ids in ``ids`` and few others: a bit for each hash value.

    A filter of a size that follows the number of ids, up to ``FILTER_MOST`` bits. Its bits are set in
    chunks on the executors.
    """
    n = ids.count()
    if not n:
        return F.lit(False)
    bits = min(FILTER_MOST, max(FILTER_CHUNK, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits))

    def pack(rows: pa.Table) -> pa.Table:
        number = rows.column("place").to_numpy()
        flags = np.zeros(FILTER_CHUNK, np.uint8)
        flags[number % FILTER_CHUNK] = 1
        return pa.table({"chunk": [int(number[0]) // FILTER_CHUNK], "bits": [np.packbits(flags).tobytes()]})

    places = ids.select(place.alias("place")).distinct()
    parts = places.withColumn("chunk", F.floor(F.col("place") / FILTER_CHUNK)).groupBy("chunk")
    ship(ids.sparkSession)
    held = np.zeros(bits // 8, np.uint8).reshape(-1, FILTER_CHUNK // 8)
    for row in parts.applyInArrow(pack, "chunk bigint, bits binary").toLocalIterator():
        held[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    byte = F.substring(F.lit(held.tobytes()), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    shifted = F.call_function("shiftright", value, F.lit(7) - (place % 8).cast("int"))
    return shifted.bitwiseAND(F.lit(1)) == 1


def unused(name: str, *taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as set it apart from all of ``taken``, case apart."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name = "_" + name
    return name


def drop_rows(docs: DataFrame, drops: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows that ``drops`` lists, all columns as they are.

    ``drops`` is a table that is there already: ``doc_id``, the columns named in ``keys`` and ``one``, true
    where one of the rows that tie on all of them stays. Only rows whose ``doc_id`` passes a filter over
    ``drops`` get their keys computed and take part in a join; the others stay where they are.
    """
    maybe = _listed(drops.select("doc_id"))
    columns = docs.columns
    names = {key: unused(f"_{key}", columns) for key in keys}
    right = drops.withColumnsRenamed({c: unused(f"_drop_{c}", columns, names.values()) for c in drops.columns})
    of = dict(zip(drops.columns, right.columns))
    met = docs.filter(maybe).select("*", *[value.alias(names[key]) for key, value in keys.items()])
    equal = met["doc_id"].eqNullSafe(right[of["doc_id"]])
    for key in keys:
        equal = equal & met[names[key]].eqNullSafe(right[of[key]])
    joined = met.join(right, equal, "left")
    stays = joined.filter(F.col(of["one"]).isNull()).select(*columns)
    tied = joined.filter(of["one"]).dropDuplicates(["doc_id", *names.values()]).select(*columns)
    return docs.filter(~maybe).unionByName(stays).unionByName(tied)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)],
        schema=schema,
    )
