"""Quarantined lines, states of days, chart rows."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.helpers import by_series, make_bars, uneven_series
from tsreg.operators import chart, states
from tsreg.sources.bars import quarantined_bars
from tsreg.sources.stage import fresh_path

HEADER = "Date,Open,High,Low,Close,Adj Close,Volume,Symbol"
LINES = [
    "2020-01-02,1,2,0.5,1.5,1.5,10,a",
    "2020-01-03,1,2,0.5,1.5,1.5,x,a",  # a column that no one may read
    "2020-13-01,1,2,0.5,1.5,1.5,10,a",
    "2020-01-05,1,2,0.5",
    "2020-01-06,1,2,0.5,1.5,1.5,10,a,more",
    ",1,2,0.5,1.5,1.5,10,a",
    "2020-01-07,1,2,0.5,1.5,1.5,10,",
    "2020-01-08,1,2,0.5,,1.5,10,b",  # a missing value is no fault of the line
]


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    found = quarantined_bars(spark, str(tmp_path), most=6)
    assert [(r["symbol"], r["date"].day) for r in found.bars.select("symbol", "date").orderBy("date").collect()] == [("a", 2), ("b", 8)]
    rejected = found.rejected.collect()
    assert len(rejected) == 6 and all(r["file"].endswith("a.csv") for r in rejected)
    assert {LINES[1], LINES[2], LINES[3], LINES[4]} <= {r["line"] for r in rejected}
    with pytest.raises(ValueError, match="more than 5"):
        quarantined_bars(spark, str(tmp_path), most=5)


def test_header_of_another_layout_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Day,Open\n2020-01-02,1\n")
    with pytest.raises(Exception, match="header|CSV"):
        quarantined_bars(spark, str(tmp_path)).bars.collect()


def test_states_refresh(spark):
    """Stored days aren't scanned again; merged states are the profile of all rows, quantiles within the bound."""
    bars = make_bars(spark, uneven_series(), null_share=0.1)
    path = fresh_path(spark, "states")
    cut = dt.date(2020, 6, 1)
    states.refresh(bars.filter(F.col("date") < cut), path, ["close", "volume"])
    again = bars.withColumn("close", F.when(F.col("date") < cut, 1e9).otherwise(F.col("close")))
    table = states.refresh(again, path, ["close", "volume"])
    assert table.groupBy("day", "column").count().filter("count > 1").isEmpty()
    got = {r["column"]: r for r in states.merged(table).collect()}
    rows = bars.collect()
    for column in ("close", "volume"):
        values = sorted(r[column] for r in rows if r[column] is not None)
        row = got[column]
        assert (row["n"], row["nulls"]) == (len(values), len(rows) - len(values))
        assert (row["min"], row["max"]) == (values[0], values[-1])
        assert row["mean"] == pytest.approx(statistics.fmean(values)) and row["stddev"] == pytest.approx(statistics.stdev(values))
        for share, found in zip((0.25, 0.5, 0.75), row["quantiles"]):
            rank = sum(v <= found for v in values) / len(values)
            assert abs(rank - share) < 0.02
    before = table.count()
    assert states.refresh(bars, path, ["close", "volume"]).count() == before
    empty = states.merged(states.day_states(bars.limit(0), ["close"]))
    assert empty.collect() == []


def slow_chart(rows, buckets):
    """Three rows of each part by plain loops."""
    points = [(k + 1, r["date"], r["close"]) for k, r in enumerate(r for r in rows if r["close"] is not None)]
    parts = {}
    for p in points:
        parts.setdefault((p[0] - 1) * buckets // max(len(points), buckets), []).append(p)
    mean = {k: (statistics.fmean(p[0] for p in v), statistics.fmean(p[2] for p in v)) for k, v in parts.items()}
    out = set()
    for k, held in parts.items():
        (lx, ly), (rx, ry) = mean.get(k - 1, mean[k]), mean.get(k + 1, mean[k])
        area = lambda p: round(abs((lx - p[0]) * (ry - ly) - (lx - rx) * (p[2] - ly)), 6)
        out |= {max(held, key=lambda p: (area(p), -p[0])), min(held, key=lambda p: (p[2], p[0])), max(held, key=lambda p: (p[2], -p[0]))}
    return out


@pytest.mark.parametrize("buckets", [1, 7, 500])
def test_chart_rows(spark, buckets):
    bars = make_bars(spark, uneven_series(), seed=random.Random(4).randrange(99), null_share=0.1)
    found = by_series(chart.downsampled(bars, "close", buckets).collect())
    for symbol, rows in by_series(bars.collect()).items():
        got = {(r["place"], r["date"], r["close"]) for r in found.get(symbol, [])}
        assert got == slow_chart(rows, buckets) and len(found.get(symbol, [])) <= 3 * buckets
    with pytest.raises(ValueError):
        chart.downsampled(bars, "close", 0)
