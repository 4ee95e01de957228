import datetime as dt

import pytest
from helpers import by_series, make_bars, uneven_series
from pyspark.sql import functions as F

from tsreg.operators import ordering as od
from tsreg.operators.timeline import Timeline


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark, uneven_series()).cache()


@pytest.fixture(scope="module")
def hot_day(spark):
    """Most rows on one day, and one key with many rows."""
    series = {f"s{i:04d}": [3] for i in range(400)} | {"a": list(range(8))}
    extra = make_bars(spark, {"s0007": [3] * 900}, seed=5)
    return make_bars(spark, series).union(extra).cache()


def in_order(df):
    return sorted(df.collect(), key=lambda r: (r["date"], r["symbol"]))


@pytest.mark.parametrize("max_cell", [1, 20, 10**6])
def test_global_rank(bars, max_cell):
    rows = in_order(od.global_rank(bars, max_cell=max_cell))
    assert [r["rank"] for r in rows] == list(range(1, bars.count() + 1))


@pytest.mark.parametrize("max_cell", [1, 50, 10**6])
def test_global_rank_on_a_hot_day(hot_day, max_cell):
    rows = sorted(od.global_rank(hot_day, max_cell=max_cell).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(r["date"], r["symbol"]) for r in rows]
    assert keys == sorted(keys) and len(rows) == hot_day.count()


@pytest.mark.parametrize("max_cell", [1, 20, 10**6])
@pytest.mark.parametrize("share", [(80, 100), (1, 3), (1, 1000)])
def test_chrono_split(bars, share, max_cell):
    train, test = od.chrono_split(bars, *share, max_cell=max_cell)
    rows = in_order(bars)
    k = len(rows) * share[0] // share[1]
    assert in_order(train) == rows[:k] and in_order(test) == rows[k:]


@pytest.mark.parametrize("max_cell", [1, 50])
def test_chrono_split_on_a_hot_day_keeps_ties_together(hot_day, max_cell):
    train, test = od.chrono_split(hot_day, 1, 2, max_cell=max_cell)
    a, b = in_order(train), in_order(test)
    assert len(a) + len(b) == hot_day.count()
    assert (a[-1]["date"], a[-1]["symbol"]) < (b[0]["date"], b[0]["symbol"])
    assert len(a) >= hot_day.count() // 2


def test_split_is_a_pushed_filter(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "bars"))
    train, _ = od.chrono_split(spark.read.parquet(str(tmp_path / "bars")))
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "LessThan(date" in plan


def test_empty_and_null(spark, bars):
    train, test = od.chrono_split(bars.limit(0))
    assert train.count() == test.count() == 0
    with pytest.raises(ValueError, match="null"):
        od.chrono_split(bars.withColumn("symbol", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        od.chrono_split(bars, 100, 100)


def test_split_per_series(bars):
    train, test = od.chrono_split_series(bars, 80, 100, Timeline(width=9))
    a, b = by_series(train.collect()), by_series(test.collect())
    for name, rows in by_series(bars.collect()).items():
        k = len(rows) * 80 // 100
        assert a.get(name, []) == rows[:k] and b.get(name, []) == rows[k:]


@pytest.mark.parametrize("n", [1, 7, 10**5])
def test_horizon(bars, n):
    assert in_order(od.horizon(bars, n)) == in_order(bars)[:n]
    got = by_series(od.horizon_series(bars, n).collect())
    for name, rows in by_series(bars.collect()).items():
        assert got[name] == rows[:n]


def test_long_horizon_per_series(bars):
    got = by_series(od.horizon_series(bars, 40, Timeline(width=9)).collect())
    for name, rows in by_series(bars.collect()).items():
        assert got[name] == rows[:40]


@pytest.mark.parametrize("days", [600, 1])
def test_no_cell_holds_a_crowded_day(spark, days):
    rows = spark.range(240_000).select(
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % days).cast("int")).alias("date"),
        F.concat(F.lit("s"), F.col("id")).alias("symbol"),
    )
    cells = od.ranked_cells(rows, ["date", "symbol"], max_cell=4000)
    assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 8000
    ranked = od.global_rank(rows, max_cell=4000)
    found = ranked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(found) == (1, 240_000, 240_000)


@pytest.mark.parametrize("n", [1, 30, 2000])
def test_horizon_per_series_refuses_null_keys(bars, n):
    holed = bars.withColumn("date", F.when(F.dayofmonth("date") > 3, F.col("date")))
    with pytest.raises(Exception, match="null in key column"):
        od.horizon_series(holed, n).collect()


def test_horizon_below_one(bars):
    for call in (od.horizon, od.horizon_series):
        with pytest.raises(ValueError):
            call(bars, 0)


def test_hash_split_ignores_partitioning(bars):
    a = od.hash_split(bars, ["symbol", "date"])
    b = od.hash_split(bars.repartition(7), ["symbol", "date"])
    assert in_order(a.train) == in_order(b.train)
    assert a.train.count() + a.test.count() == bars.count()
    assert 0.7 < a.train.count() / bars.count() < 0.9
    folds = {r["fold"] for r in od.fold_column(bars, ["symbol", "date"], 5).collect()}
    assert folds == set(range(5))


def test_rolling_origin_folds(bars):
    folds = sorted(od.rolling_origin_folds(bars, 4).collect(), key=lambda r: r["fold"])
    rows = in_order(bars)
    assert [f["fold"] for f in folds] == [1, 2, 3, 4]
    for f in folds:
        assert f["n_train"] == sum(r["date"] <= f["train_end"] for r in rows)
        assert f["n_valid"] == sum(f["train_end"] < r["date"] <= f["valid_end"] for r in rows)
    assert folds[-1]["valid_end"] == max(r["date"] for r in rows)


def test_timestamp_order(spark):
    rows = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz").repartition(3)
    train, test = od.chrono_split(df, 80, 100, order=("ts", "k"), max_cell=10)
    assert train.count() == 400 and test.count() == 100
    ranked = sorted(od.global_rank(df, ("ts", "k"), max_cell=10).collect(), key=lambda r: r["ts"])
    assert [r["rank"] for r in ranked] == list(range(1, 501))


def test_marked_series(spark, bars):
    """Both parts in one table, any column types, ties with the cut in front."""
    rows = bars.select("symbol", "date", F.create_map(F.lit("a"), "close").alias("m x"))
    found = od.chrono_marked_series(rows, line=Timeline(width=9))
    assert found.columns == [*rows.columns, "in_train"]
    got = by_series(found.collect())
    for name, held in by_series(bars.collect()).items():
        k = len(held) * 80 // 100
        assert [(r["date"], r["m x"]["a"], r["in_train"]) for r in got[name]] == [
            (r["date"], r["close"], i < k) for i, r in enumerate(held)
        ]
    days = [dt.date(2024, 1, d) for d in (1, 2, 2, 2, 3)]
    tied = spark.createDataFrame([("s", d, k) for k, d in enumerate(days)], "symbol string, date date, k int")
    marks = {r["k"]: r["in_train"] for r in od.chrono_marked_series(tied, 40).collect()}
    assert marks == {0: True, 1: True, 2: True, 3: True, 4: False}
    assert not any(r["in_train"] for r in od.chrono_marked_series(tied.filter("k = 0")).collect())
