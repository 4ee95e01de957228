"""Price bars: scans, sinks and bars made from single trades."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsreg.functions.columns import normalize_names
from tsreg.sources.stage import stage

KEY = ("symbol", "date")

# Fixed header of the CSV layout; "Symbol" is present when a file holds many series.
CSV_FIELDS = (
    ("Date", T.DateType()),
    ("Open", T.DoubleType()),
    ("High", T.DoubleType()),
    ("Low", T.DoubleType()),
    ("Close", T.DoubleType()),
    ("Adj Close", T.DoubleType()),
    ("Volume", T.LongType()),
)

BAR_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "adj_close", "volume")


def csv_schema(with_symbol: bool) -> T.StructType:
    """Schema of the CSV layout. Never inferred: volumes would flip between int and bigint."""
    fields = [T.StructField(name, kind) for name, kind in CSV_FIELDS]
    if with_symbol:
        fields.append(T.StructField("Symbol", T.StringType()))
    return T.StructType(fields)


def read_bars(
    spark: SparkSession, path: str, fmt: str = "csv", symbol: str | None = None
) -> DataFrame:
    """Bars from CSV or parquet, in the order of ``BAR_COLUMNS``.

    ``symbol`` names the one series of a CSV file without a ``Symbol`` column. A value that does
    not parse in a column that is read, or a header that differs from the layout, fails the job; columns
    that a query leaves out are not parsed. :func:`quarantined_bars` looks at all of them.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select(*BAR_COLUMNS)
    if fmt != "csv":
        raise ValueError(f"unknown bar format {fmt!r}: use 'csv' or 'parquet'")
    raw = (
        spark.read.schema(csv_schema(with_symbol=symbol is None))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    named = normalize_names(raw)
    if symbol is not None:
        named = named.withColumn("symbol", F.lit(symbol))
    return named.select(*BAR_COLUMNS)


CORRUPT = "_corrupt"


class Quarantined(NamedTuple):
    """Bars that parse, and the lines that don't (``file``, ``line``)."""

    bars: DataFrame
    rejected: DataFrame


def quarantined_bars(
    spark: SparkSession, path: str, symbol: str | None = None, most: int | None = None
) -> Quarantined:
    """Bars of a CSV folder, with the lines of which any column doesn't parse in a table of their own.

    All columns are parsed, whatever is read later. A line counts as rejected if a value doesn't parse, if
    fields are missing or too many, or if it has no key. The scan happens once; both parts read what it wrote.
    ``most``: fail if more lines than that are rejected. A header that differs from the layout fails the job.
    """
    schema = csv_schema(with_symbol=symbol is None).add(CORRUPT, T.StringType())
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path)
    )
    fields = [f.name for f in schema.fields if f.name != CORRUPT]
    key = F.col("Date").isNull() if symbol is not None else F.col("Date").isNull() | F.col("Symbol").isNull()
    whole = F.concat_ws(",", *[F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in fields])
    line = F.coalesce(F.col(CORRUPT), F.when(key, whole))
    named = raw.select("*", line.alias("line"), F.col("_metadata.file_path").alias("file"))
    found = stage(named.drop(CORRUPT), "csv-quarantine")
    rejected = found.filter("line IS NOT NULL").select("file", "line")
    if most is not None:
        n = rejected.limit(most + 1).count()
        if n > most:
            raise ValueError(f"more than {most} lines of {path} don't parse")
    good = normalize_names(found.filter("line IS NULL").drop("line", "file"))
    if symbol is not None:
        good = good.withColumn("symbol", F.lit(symbol))
    return Quarantined(good.select(*BAR_COLUMNS), rejected)


def write_bars_csv(df: DataFrame, path: str) -> None:
    """CSV folder with the fixed header, in (symbol, date) order over the part files."""
    (
        df.select(
            F.col("date").alias("Date"),
            F.col("open").alias("Open"),
            F.col("high").alias("High"),
            F.col("low").alias("Low"),
            F.col("close").alias("Close"),
            F.col("adj_close").alias("Adj Close"),
            F.col("volume").alias("Volume"),
            F.col("symbol").alias("Symbol"),
        )
        .sort("Symbol", "Date")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_bars(df: DataFrame, path: str) -> None:
    """Parquet folder split by year and clustered by (symbol, date).

    A date filter drops year folders; inside them the row groups hold narrow key ranges. The range
    sort spreads a long series over many tasks.
    """
    (
        df.select(*BAR_COLUMNS, F.year("date").alias("year"))
        .repartitionByRange("year", "symbol", "date")
        .sortWithinPartitions("year", "symbol", "date")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def bars_from_trades(
    trades: DataFrame,
    symbol: str | Column,
    when: str | Column,
    price: str,
    size: str,
    sequence: Column,
    markdown: str,
    combine: bool = True,
) -> DataFrame:
    """One bar per (symbol, day) out of single trades.

    ``sequence`` orders the trades of a day. Give one number rather than a struct: then every
    aggregation buffer is a primitive, and Spark combines in hash tables on the map side instead of
    sorting all trades first. ``adj_close`` takes the largest ``markdown`` of the day off the close.

    Without ``combine`` trades are shuffled before anything is combined: for tables with few trades per
    bar, where the hash tables of a map task would hold a bar for nearly each trade and spill.
    """
    keyed = trades.withColumns(
        {"_symbol": F.col(symbol) if isinstance(symbol, str) else symbol, "_date": F.to_date(when)}
    )
    if not combine:
        keyed = keyed.repartition("_symbol", "_date")
    return (
        keyed.groupBy(F.col("_symbol").alias("symbol"), F.col("_date").alias("date"))
        .agg(
            F.min_by(price, sequence).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, sequence).alias("close"),
            F.max(markdown).alias("markdown"),
            F.sum(size).cast("bigint").alias("volume"),
        )
        .withColumn("adj_close", F.col("close") * (F.lit(1.0) - F.col("markdown")))
        .select(*BAR_COLUMNS)
    )
