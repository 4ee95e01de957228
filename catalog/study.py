"""Queries on scans, profiles, cleaning, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.tables import (
    ALIGNED_SQL,
    BARS,
    HOURLY,
    RANKED,
    SUPPLIER_BARS,
    bar_table,
    bars,
    bucket_sql,
    hourly,
    query,
    supplier_bars,
    table,
)
from tsreg.functions import columns
from tsreg.functions.columns import feature_columns, label_and_features
from tsreg.operators import clean, ordering, profile, relations, timeline
from tsreg.sources.bars import read_bars, write_bars, write_bars_csv
from tsreg.sources.stage import fresh_path, stage

NUMBERS = [
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_partkey",
    "l_orderkey",
    "l_suppkey",
    "l_linenumber",
]


@query(f"WITH {BARS} SELECT * FROM bars")
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv-scan")
    write_bars_csv(bars(spark, sf_dir), path)
    return read_bars(spark, path)


@query(f"WITH {BARS}, {RANKED} SELECT * EXCLUDE (rn, total) FROM ranked WHERE rn > total * 80 // 100")
def csv_sink_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "csv-sink")
    write_bars_csv(ordering.chrono_split(bar_table(spark, sf_dir)).test, path)
    return read_bars(spark, path)


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, open, high, low, close, adj_close, volume FROM bars
WHERE date >= DATE '1997-01-01' AND date < DATE '1999-01-01'"""
)
def parquet_by_year(spark, sf_dir):
    """Bars written in year folders, two of which are read back."""
    path = fresh_path(spark, "bars-by-year")
    write_bars(bars(spark, sf_dir, "l_suppkey"), path)
    two = spark.read.parquet(path).filter("year BETWEEN 1997 AND 1998")
    return two.drop("year")


@query("SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def table_shape(spark, sf_dir):
    return profile.table_shape(table(spark, sf_dir, "lineitem"))


ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count_if({c} IS NULL)::BIGINT AS n_nulls FROM orders"
        for c, kind in ORDER_TYPES.items()
    )
)
def schema_profile(spark, sf_dir):
    """Types and null counts of a table, one row per column."""
    orders = table(spark, sf_dir, "orders")
    nulls = profile.null_counts(orders).unpivot([], orders.columns, "column", "n_nulls")
    return profile.schema_table(orders).join(nulls, "column").select("column", "type", "n_nulls")


@query(
    f"""WITH {ALIGNED_SQL}
SELECT count_if(symbol IS NULL)::BIGINT AS symbol, count_if(ts IS NULL)::BIGINT AS ts,
       count_if(value IS NULL)::BIGINT AS value, count_if(n_events IS NULL)::BIGINT AS n_events
FROM aligned"""
)
def null_counts(spark, sf_dir):
    return profile.null_counts(clean.align_calendar(hourly(spark, sf_dir), HOURLY))


def _per_column(measures: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {measures.replace('@', c)} FROM lineitem" for c in NUMBERS
    )


MOMENTS = """count(@) AS n, round(avg(@), 6) AS mean, round(stddev_samp(@), 6) AS stddev,
min(@)::DOUBLE AS min, max(@)::DOUBLE AS max"""


@query(_per_column(MOMENTS))
def describe_numeric(spark, sf_dir):
    found = profile.describe(table(spark, sf_dir, "lineitem"), NUMBERS)
    return found.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(
    _per_column(
        MOMENTS
        + ", quantile_cont(@::DOUBLE, 0.25) AS p25, quantile_cont(@::DOUBLE, 0.5) AS p50,"
        + " quantile_cont(@::DOUBLE, 0.75) AS p75"
    )
)
def summary_percentiles(spark, sf_dir):
    found = profile.summary(table(spark, sf_dir, "lineitem"), NUMBERS)
    return found.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(
    f"WITH {SUPPLIER_BARS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(corr(close, {c}), 8) AS correlation FROM bars"
        for c in ("open", "high", "low", "volume")
    )
)
def target_correlations(spark, sf_dir):
    rows = bars(spark, sf_dir, "l_suppkey")
    found = profile.target_correlations(rows, "close", feature_columns(rows))
    return found.withColumn("correlation", F.round("correlation", 8))


@query(f"WITH {SUPPLIER_BARS} SELECT min(close) AS min_close, max(close) AS max_close FROM bars")
def close_bounds(spark, sf_dir):
    return profile.bounds(bars(spark, sf_dir, "l_suppkey"), "close")


COPIES = ["l_suppkey", "l_quantity", "l_discount", "l_returnflag"]


@query(f"SELECT DISTINCT {', '.join(COPIES)} FROM lineitem")
def dedup_rows(spark, sf_dir):
    return clean.dedup_rows(table(spark, sf_dir, "lineitem").select(*COPIES))


KEYED = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    f"""SELECT {', '.join(KEYED)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
WHERE rn = 1"""
)
def dedup_keyed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEYED)
    return clean.dedup_keyed(rows, KEYED[:2], KEYED[2:])


@query(
    """SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderstatus AS order_status,
o_totalprice AS total_price, o_orderpriority AS order_priority FROM orders"""
)
def normalize_names(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_custkey").alias(" Customer Key"),
        F.col("o_orderstatus").alias("ORDER STATUS"),
        F.col("o_totalprice").alias("Total Price "),
        F.col("o_orderpriority").alias("Order_Priority"),
    )
    return columns.normalize_names(raw)


@query(
    """SELECT o_orderkey, TRY_CAST(text AS DATE) AS order_date FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d.%m.%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders)"""
)
def date_cast(spark, sf_dir):
    written = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("order_date"))
    return clean.cast_dates(rows, "order_date")


@query(
    """SELECT count(*) AS n_rows, count_if(o_orderstatus = 'P')::BIGINT AS n_bad FROM orders"""
)
def date_cast_quality(spark, sf_dir):
    written = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    rows = table(spark, sf_dir, "orders").select(written.alias("order_date"))
    return clean.date_quality(rows, "order_date")


@query(
    f"WITH {SUPPLIER_BARS} SELECT symbol, date, open, high, low, volume, close AS label FROM bars"
)
def label_projection(spark, sf_dir):
    rows = bars(spark, sf_dir, "l_suppkey")
    return label_and_features(rows, "close", feature_columns(rows))


@query(f"WITH {SUPPLIER_BARS} SELECT symbol, date, close FROM bars ORDER BY symbol, date")
def price_series(spark, sf_dir):
    return bars(spark, sf_dir, "l_suppkey").select("symbol", "date", "close").orderBy("symbol", "date")


@query(f"WITH {ALIGNED_SQL} SELECT * FROM aligned")
def calendar_align(spark, sf_dir):
    return clean.align_calendar(hourly(spark, sf_dir), HOURLY)


@query(f"WITH {ALIGNED_SQL} SELECT * FROM aligned WHERE value IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return clean.drop_nulls(clean.align_calendar(hourly(spark, sf_dir), HOURLY), ["value"])


@query(f"WITH {ALIGNED_SQL} SELECT symbol, ts, coalesce(value, 0) AS value, coalesce(n_events, 0) AS n_events FROM aligned")
def fill_nulls(spark, sf_dir):
    aligned = clean.align_calendar(hourly(spark, sf_dir), HOURLY)
    return clean.fill_nulls(aligned, {"value": 0.0, "n_events": 0})


@query(
    f"""WITH {ALIGNED_SQL}
SELECT symbol, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, n_events FROM aligned"""
)
def forward_fill(spark, sf_dir):
    aligned = stage(clean.align_calendar(hourly(spark, sf_dir), HOURLY), "aligned")
    return timeline.forward_fill(aligned, ["value"], HOURLY)


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, open * factor AS open, high * factor AS high, low * factor AS low,
       adj_close AS close, adj_close, volume / factor AS volume
FROM (SELECT *, adj_close / close AS factor FROM bars)"""
)
def adjusted_bars(spark, sf_dir):
    return clean.adjusted_bars(bars(spark, sf_dir, "l_suppkey"))


@query(f"WITH {SUPPLIER_BARS}, {RANKED} SELECT symbol, date, close, rn AS rank FROM ranked")
def global_rank(spark, sf_dir):
    return ordering.global_rank(supplier_bars(spark, sf_dir, ["close"]))


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars"""
)
def series_rank(spark, sf_dir):
    return timeline.series_rank(supplier_bars(spark, sf_dir, ["close"]))


@query(
    f"WITH {SUPPLIER_BARS}, {RANKED} SELECT symbol, date, close FROM ranked WHERE rn <= total * 80 // 100"
)
def chrono_split_train(spark, sf_dir):
    return ordering.chrono_split(supplier_bars(spark, sf_dir, ["close"])).train.select("symbol", "date", "close")


@query(
    f"WITH {SUPPLIER_BARS}, {RANKED} SELECT symbol, date, close FROM ranked WHERE rn > total * 80 // 100"
)
def chrono_split_test(spark, sf_dir):
    return ordering.chrono_split(supplier_bars(spark, sf_dir, ["close"])).test.select("symbol", "date", "close")


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT count(*) AS n_total, count(*) * 80 // 100 AS n_train, count(*) - count(*) * 80 // 100 AS n_test
FROM bars"""
)
def chrono_split_sizes(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, [])
    train, test = ordering.chrono_split(rows)
    tagged = train.select(F.lit(True).alias("in_train")).unionAll(test.select(F.lit(False)))
    return tagged.agg(
        F.count("*").alias("n_total"),
        F.count_if("in_train").alias("n_train"),
        F.count_if(~F.col("in_train")).alias("n_test"),
    )


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, close, rn <= total * 80 // 100 AS in_train FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY symbol) AS total FROM bars)"""
)
def chrono_split_by_symbol(spark, sf_dir):
    return ordering.chrono_marked_series(supplier_bars(spark, sf_dir, ["close"]))


SIDES = ["l_suppkey", "l_quantity", "l_linestatus"]


@query(
    f"""SELECT {', '.join(SIDES)} FROM lineitem WHERE l_returnflag <> 'R'
EXCEPT SELECT {', '.join(SIDES)} FROM lineitem WHERE l_returnflag = 'R'"""
)
def except_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return relations.except_distinct(
        rows.filter(~returned).select(*SIDES), rows.filter(returned).select(*SIDES)
    )


@query(
    f"""SELECT {', '.join(SIDES)} FROM lineitem WHERE l_returnflag <> 'R'
EXCEPT ALL SELECT {', '.join(SIDES)} FROM lineitem WHERE l_returnflag = 'R'"""
)
def except_all(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return relations.except_all(
        rows.filter(~returned).select(*SIDES), rows.filter(returned).select(*SIDES)
    )


SPLIT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    f"""SELECT {', '.join(SPLIT_KEYS)},
CASE WHEN {bucket_sql(SPLIT_KEYS, 42, 100)} < 80 THEN 'train' ELSE 'test' END AS part FROM lineitem"""
)
def hash_split(spark, sf_dir):
    train, test = ordering.hash_split(table(spark, sf_dir, "lineitem").select(*SPLIT_KEYS), SPLIT_KEYS)
    return train.withColumn("part", F.lit("train")).unionAll(test.withColumn("part", F.lit("test")))


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, close, CAST({bucket_sql(["symbol", "date"], 42, 5)} AS INT) AS fold FROM bars"""
)
def fold_assignment(spark, sf_dir):
    rows = bars(spark, sf_dir, "l_suppkey").select("symbol", "date", "close")
    return ordering.fold_column(rows, ["symbol", "date"], 5)


@query(
    f"""WITH {SUPPLIER_BARS},
days AS (SELECT date, count(*) AS n FROM bars GROUP BY date),
cum AS (SELECT *, sum(n) OVER (ORDER BY date) AS upto, sum(n) OVER () AS total FROM days),
blocks AS (
  SELECT CAST(((upto - 1) * 5) // total AS BIGINT) AS block, max(date) AS valid_end, sum(n) AS n_valid
  FROM cum GROUP BY 1),
folds AS (
  SELECT row_number() OVER w AS no, lag(valid_end) OVER w AS train_end, valid_end,
         sum(n_valid) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train,
         n_valid
  FROM blocks WINDOW w AS (ORDER BY block))
SELECT no - 1 AS fold, train_end, valid_end, n_train::BIGINT AS n_train, n_valid::BIGINT AS n_valid
FROM folds WHERE train_end IS NOT NULL"""
)
def rolling_origin_folds(spark, sf_dir):
    found = ordering.rolling_origin_folds(bars(spark, sf_dir, "l_suppkey"), 4)
    return found.withColumn("fold", F.col("fold").cast("bigint"))
