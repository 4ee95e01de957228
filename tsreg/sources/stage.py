"""Places for intermediate tables.

A plan that several jobs read (model fits, cuts, iterative training) is written
once as parquet into the shared folder the cluster names in
``spark.checkpoint.dir``. Unlike cached blocks, such a table outlives the
executors that made it, keeps column pruning and filter pushdown, and ends the
lineage of whatever is built on it.

Every table has an owner that deletes it: a ``with staged(...)`` block, or else
the application, at whose end the file system removes what is left.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared scratch folder of this application, without trailing slash."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir", None)
        if configured is None:
            # one process: nothing else has to reach the folder
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="tsreg-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under :func:`work_dir` that no other call returns."""
    root = f"{work_dir(spark)}/tsreg"
    context = spark.sparkContext
    if getattr(context, "_tsreg_root", None) != root:
        files, folder = _files(spark, root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        context._tsreg_root = root
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path as it takes it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of :func:`fresh_path`, if anything does."""
    if not path.startswith(f"{work_dir(spark)}/tsreg/"):
        raise ValueError(f"{path} is not a staged table")
    files, place = _files(spark, path)
    files.delete(place, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    For tables that a lazy result goes on reading; they are deleted when the application ends.
    """
    return _written(df, fresh_path(df.sparkSession, label))


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """:func:`stage` for a block: the table is deleted at its end, after an error too.

    What is read from it has to be consumed inside the block.
    """
    path = fresh_path(df.sparkSession, label)
    try:
        yield _written(df, path)
    finally:
        discard(df.sparkSession, path)


def stage_once(df: DataFrame, label: str) -> DataFrame:
    """:func:`stage`, but an equal plan over the same files is written once per application.

    Plans are compared by Spark after canonicalisation, so names of intermediate columns don't matter. Files
    count as the same by their names, which Spark never uses twice. A table that was deleted is written again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not hasattr(context, "_tsreg_tables"):
        context._tsreg_tables = {}
    key = (df.semanticHash(), tuple(df.columns), tuple(sorted(df.inputFiles())))
    for plan, path, table in context._tsreg_tables.get(key, []):
        if plan.sparkSession is spark and plan.sameSemantics(df) and _exists(spark, f"{path}/_SUCCESS"):
            return table
    path = fresh_path(spark, label)
    table = _written(df, path)
    context._tsreg_tables.setdefault(key, []).append((df, path, table))
    return table
