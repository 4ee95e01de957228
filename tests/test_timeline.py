import pytest
from helpers import by_series, make_bars, uneven_series
from pyspark.sql import functions as F

from tsreg.operators import timeline as tl

LINES = [tl.Timeline(width=w) for w in (1, 7, 64, 100_000)]


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark, uneven_series(), null_share=0.3).cache()


@pytest.mark.parametrize("line", LINES, ids=lambda x: f"w{x.width}")
def test_series_rank(bars, line):
    for rows in by_series(tl.series_rank(bars, line).collect()).values():
        assert [r["rn"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("line", LINES, ids=lambda x: f"w{x.width}")
def test_lags(bars, line):
    got = by_series(tl.add_lags(bars, ["close", "volume"], [1, 3], line).collect())
    assert sum(len(r) for r in got.values()) == bars.count()
    for rows in got.values():
        for i, row in enumerate(rows):
            for c in ("close", "volume"):
                for k in (1, 3):
                    assert row[f"{c}_lag_{k}"] == (rows[i - k][c] if i >= k else None)


@pytest.mark.parametrize("line", LINES, ids=lambda x: f"w{x.width}")
def test_forward_fill(bars, line):
    before = by_series(bars.collect())
    after = by_series(tl.forward_fill(bars, ["close"], line).collect())
    for name, rows in before.items():
        known, want = None, []
        for row in rows:
            known = row["close"] if row["close"] is not None else known
            want.append(known)
        assert [r["close"] for r in after[name]] == want


@pytest.mark.parametrize("line", LINES, ids=lambda x: f"w{x.width}")
@pytest.mark.parametrize("length,drop_last,cap", [(1, False, None), (5, True, None), (30, False, 4), (5, True, 2)])
def test_sequence_samples(bars, line, length, drop_last, cap):
    got = by_series(tl.sequence_samples(bars, "close", length, line, drop_last, cap).collect())
    for name, rows in by_series(bars.collect()).items():
        values = [r["close"] for r in rows]
        want = [
            (rows[i + length]["date"], values[i : i + length], values[i + length])
            for i in range(len(values) - length)
        ]
        want = want[: len(want) - 1] if drop_last and want else want
        want = want[:cap] if cap else want
        assert [(r["date"], r["x"], r["y"]) for r in got.get(name, [])] == want
        assert [r["i"] for r in got.get(name, [])] == list(range(1, len(want) + 1))


def test_null_key_fails(spark, bars):
    bad = bars.withColumn("symbol", F.when(F.col("symbol") != "one", F.col("symbol")))
    with pytest.raises(Exception, match="null in key column"):
        tl.series_rank(bad).collect()


def test_bad_arguments(bars):
    with pytest.raises(ValueError):
        tl.add_lags(bars, ["close"], [0])
    with pytest.raises(ValueError):
        tl.sequence_samples(bars, "close", 0)
    with pytest.raises(ValueError):
        tl.sequence_samples(bars, "close", 2, cap=0)


def test_hourly_grain(spark):
    rows = [("a", f"2024-03-{d:02d} {h:02d}:00:00", float(d * 24 + h)) for d in range(1, 5) for h in range(0, 24, 3)]
    df = spark.createDataFrame(rows, "symbol string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    line = tl.Timeline(order="ts", grain="hour", width=10)
    got = sorted(tl.add_lags(df, ["v"], [2], line).collect(), key=lambda r: r["ts"])
    assert [r["v_lag_2"] for r in got] == [None, None] + [r["v"] for r in got[:-2]]


@pytest.mark.parametrize("kind", ["decimal(10,2)", "date", "boolean", "tinyint", "double", "timestamp", "string", "binary"])
def test_null_series_fail_whatever_their_type(spark, kind):
    rows = make_bars(spark, {"1": [1, 2, 3], "2": [4, 5]})
    key = {"date": "date'2020-01-01'", "timestamp": "timestamp'2020-01-01 00:00:00'", "boolean": "symbol = '1'"}
    whole = rows.withColumn("k", F.expr(key.get(kind, f"cast(symbol as {kind})")))
    line = tl.Timeline(by=("k",))
    if kind not in ("date", "timestamp"):
        assert tl.series_rank(whole, line).agg(F.max("rn")).first()[0] == 3
    holed = whole.withColumn("k", F.when(F.col("symbol") == "1", F.col("k")))
    for call in (tl.series_rank, lambda df, by: tl.sequence_samples(df, "close", 1, by)):
        with pytest.raises(Exception, match="null in key column"):
            call(holed, line).collect()


def test_lags_take_one_scan_and_one_wide_shuffle(spark, tmp_path):
    rows = make_bars(spark, uneven_series()).withColumns({"open": F.col("close") + 1, "note": F.lit("x")})
    rows.write.parquet(str(tmp_path / "bars"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lagged = tl.add_lags(spark.read.parquet(str(tmp_path / "bars")), ["close"], [1, 3])
        lagged.collect()
        plan = lagged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") + plan.count("Scan parquet") - plan.count("ReusedExchange") <= 1
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("line", LINES, ids=lambda x: f"w{x.width}")
def test_lags_of_lagged_rows(bars, line):
    """Lags over what a filter on other lags leaves: the same with the rows left in their buckets."""
    def twice(kept):
        once = tl.add_lags(bars, ["close"], [2], line, keep_bucket=kept).filter("close_lag_2 IS NOT NULL")
        found = tl.add_lags(once, ["close"], [1, 3], line, bucketed=kept)
        assert found.columns == [*bars.columns, "close_lag_2", "close_lag_1", "close_lag_3"]
        return sorted(found.collect(), key=lambda r: (r["symbol"], r["date"]))

    rows = twice(True)
    assert rows and rows == twice(False)
    assert tl.add_lags(bars, ["close"], [1], line, keep_bucket=True).columns == [*bars.columns, "_bucket", "close_lag_1"]


@pytest.mark.parametrize("depth", [1, 5, 40, 400])
def test_deep_lags_of_sparse_series(spark, depth):
    rows = make_bars(spark, uneven_series())
    for width in (1, 7, 64):
        got = by_series(tl.add_lags(rows, ["close"], [depth], tl.Timeline(width=width)).collect())
        for name, mine in by_series(rows.collect()).items():
            want = [None] * min(depth, len(mine)) + [r["close"] for r in mine[:-depth]]
            assert [r[f"close_lag_{depth}"] for r in got[name]] == want[: len(mine)]
