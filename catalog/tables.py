"""Tables the queries start from, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsreg.operators.timeline import Timeline, add_lags
from tsreg.sources.bars import bars_from_trades
from tsreg.sources.stage import stage_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle if SQL can say it."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_number() -> Column:
    """Order of the trades of a day in one number: order key, then price in cents (below 2^24).

    A decimal, as order keys of large tables go beyond 2^39.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return F.col("l_orderkey").cast("decimal(20,0)") * F.lit(1 << 24).cast("decimal(9,0)") + cents


def bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Daily bars out of ``lineitem``: one series per return flag, or per supplier."""
    found = bars_from_trades(
        table(spark, sf_dir, "lineitem"),
        symbol=symbol,
        when="l_shipdate",
        price="l_extendedprice",
        size="l_quantity",
        sequence=sequence_number(),
        markdown="l_discount",
        # a supplier has little more than one line item a day
        combine=symbol != "l_suppkey",
    )
    # text only now: a number is the shorter key of the trades
    return found.withColumn("symbol", F.col("symbol").cast("string"))


def bar_table(
    spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag", columns: Sequence[str] | None = None
) -> DataFrame:
    """:func:`bars` written once per application, for queries that read them more than once.

    With ``columns``, only these beside the key: others are neither aggregated nor shuffled nor written.
    """
    rows = bars(spark, sf_dir, symbol)
    if columns is not None:
        rows = rows.select("symbol", "date", *columns)
    return stage_once(rows, f"bars-{symbol}")


def supplier_bars(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Many series: about as many bars as line items, so name the ``columns`` that a query reads."""
    return bar_table(spark, sf_dir, "l_suppkey", columns)


def whole_hour(ts: str) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


HOURLY = Timeline(order="ts", grain="hour")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value and number of events per type and hour, with gaps."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"), whole_hour("ts").alias("ts"))
        .agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("n_events"))
    )


def predictions_by_lag(history: DataFrame, depth: int, keep_bucket: bool = False) -> DataFrame:
    """A predictor both engines can state: the close ``depth`` rows earlier.

    With ``keep_bucket``, rows keep the bucket that the lags put them in, for further lags.
    """
    rows = history.select("symbol", "date", "close")
    lagged = add_lags(rows, ["close"], [depth], keep_bucket=keep_bucket)
    return lagged.filter(F.col(f"close_lag_{depth}").isNotNull()).select(
        "symbol",
        "date",
        *(["_bucket"] if keep_bucket else []),
        F.col("close").alias("label"),
        F.col(f"close_lag_{depth}").alias("prediction"),
    )


def bars_sql(symbol: str = "l_returnflag") -> str:
    return f"""
bars AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice, tick) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, arg_max(l_extendedprice, tick) AS close,
         arg_max(l_extendedprice, tick) * (CAST(1 AS DOUBLE) - max(l_discount)) AS adj_close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_orderkey * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS tick
        FROM lineitem)
  GROUP BY 1, 2)"""


BARS = bars_sql()
SUPPLIER_BARS = bars_sql("l_suppkey")

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY date, symbol) AS rn, count(*) OVER () AS total FROM bars)"""

HOURLY_SQL = """
hourly AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value,
         count(*) AS n_events
  FROM events GROUP BY 1, 2)"""

ALIGNED_SQL = (
    HOURLY_SQL
    + """,
steps AS (
  SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM hourly GROUP BY symbol),
aligned AS (
  SELECT s.symbol, s.ts, h.value, h.n_events FROM steps s LEFT JOIN hourly h USING (symbol, ts))"""
)


def lag_sql(depth: int, source: str = "bars", name: str = "predicted") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT symbol, date, close AS label,
           lag(close, {depth}) OVER (PARTITION BY symbol ORDER BY date) AS prediction
    FROM {source}) WHERE prediction IS NOT NULL)"""


def bucket_sql(keys: list[str], seed: int, buckets: int) -> str:
    """``ordering.hash_bucket`` in SQL."""
    text = " || '|' || ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {buckets}"
