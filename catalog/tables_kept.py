"""Queries on tables that are kept or bounded: quarantined lines, states of days, chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.tables import BARS, SUPPLIER_BARS, bar_table, query, supplier_bars
from tsreg.operators import chart, states
from tsreg.sources.bars import CSV_FIELDS, quarantined_bars
from tsreg.sources.stage import fresh_path

PROFILED = ("open", "close", "volume")
CHART_BUCKETS = 20


@query(
    f"""WITH {BARS}
SELECT 'good' AS kind, count(*) AS n, round(sum(close) / 1e3, 3) AS total FROM bars WHERE day(date) NOT IN (13, 14, 15)
UNION ALL SELECT 'number', count(*), NULL FROM bars WHERE day(date) = 13
UNION ALL SELECT 'date', count(*), NULL FROM bars WHERE day(date) = 14
UNION ALL SELECT 'short', count(*), NULL FROM bars WHERE day(date) = 15"""
)
def csv_quarantine(spark, sf_dir):
    """Bars written as lines, three days of each month spoilt: a volume, a date, missing fields."""
    path = fresh_path(spark, "csv-bad")
    rows = bar_table(spark, sf_dir)
    day = F.dayofmonth("date")
    fields = [F.when(day == 14, F.lit("no date")).otherwise(F.col("date").cast("string"))]
    fields += [F.col(c).cast("string") for c in ("open", "high", "low", "close", "adj_close")]
    fields += [F.when(day == 13, F.lit("many")).otherwise(F.col("volume").cast("string")), F.col("symbol")]
    line = F.when(day == 15, F.concat_ws(",", *fields[:3])).otherwise(F.concat_ws(",", *fields))
    header = ",".join([*(name for name, _ in CSV_FIELDS), "Symbol"])
    rows.select(line.alias(header)).write.option("header", True).option("sep", "\t").csv(path)
    found = quarantined_bars(spark, path, most=1_000_000_000)
    # only one column is read, yet bad values of the others are known
    good = found.bars.agg(F.count("*").alias("n"), F.round(F.sum("close") / 1e3, 3).alias("total"))
    kind = F.when(F.col("line").startswith("no date"), "date").when(F.col("line").contains("many"), "number")
    bad = found.rejected.groupBy(kind.otherwise("short").alias("kind")).agg(F.count("*").alias("n"))
    return good.select(F.lit("good").alias("kind"), "n", "total").unionByName(
        bad.withColumn("total", F.lit(None).cast("double"))
    )


@query(
    f"""WITH {SUPPLIER_BARS}, long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM bars" for c in PROFILED)})
SELECT col AS "column", count(v) AS n, count(*) - count(v) AS nulls, round(avg(v), 4) AS mean,
       round(stddev_samp(v), 4) AS stddev, min(v) AS min, max(v) AS max FROM long GROUP BY col"""
)
def profile_refresh(spark, sf_dir):
    """States of the days up to 1998, stored; then those of the days behind, added; all merged."""
    rows, path = supplier_bars(spark, sf_dir, PROFILED), fresh_path(spark, "states")
    states.refresh(rows.filter("date < DATE '1999-01-01'"), path, PROFILED)
    found = states.merged(states.refresh(rows, path, PROFILED))
    return found.drop("quantiles").withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(
    f"""WITH {SUPPLIER_BARS},
placed AS (SELECT symbol, date, close, row_number() OVER w AS place, count(*) OVER (PARTITION BY symbol) AS n
           FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
parted AS (SELECT symbol, date, close, place, (place - 1) * {CHART_BUCKETS} // greatest(n, {CHART_BUCKETS}) AS part FROM placed),
means AS (SELECT symbol, part, avg(place) AS x, avg(close) AS y FROM parted GROUP BY symbol, part),
beside AS (SELECT m.symbol, m.part, coalesce(l.x, m.x) AS lx, coalesce(l.y, m.y) AS ly, coalesce(r.x, m.x) AS rx,
                  coalesce(r.y, m.y) AS ry
           FROM means m LEFT JOIN means l ON l.symbol = m.symbol AND l.part = m.part - 1
           LEFT JOIN means r ON r.symbol = m.symbol AND r.part = m.part + 1),
areas AS (SELECT p.*, round(abs((lx - place) * (ry - ly) - (lx - rx) * (close - ly)), 6) AS area
          FROM parted p JOIN beside USING (symbol, part)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY area DESC, place) AS a,
                  row_number() OVER (PARTITION BY symbol, part ORDER BY close, place) AS b,
                  row_number() OVER (PARTITION BY symbol, part ORDER BY close DESC, place) AS c FROM areas)
SELECT symbol, date, close, part, place FROM ranked WHERE a = 1 OR b = 1 OR c = 1"""
)
def chart_rows(spark, sf_dir):
    """The chart of each supplier's closes: at most 60 rows, extremes kept."""
    return chart.downsampled(supplier_bars(spark, sf_dir, ["close"]), "close", CHART_BUCKETS)
