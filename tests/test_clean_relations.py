import datetime as dt

import pytest
from helpers import DAY0, by_series, make_bars, uneven_series
from pyspark.sql import functions as F

from tsreg.functions import columns
from tsreg.operators import clean, relations
from tsreg.operators.timeline import Timeline
from tsreg.sources import bars as src
from tsreg.sources.stage import fresh_path


@pytest.fixture(scope="module")
def full(spark):
    """Bars with all columns, two series over 40 days with gaps."""
    base = make_bars(spark, {"a": range(0, 40, 2), "b": range(5, 40, 3)})
    price = F.col("close")
    return base.select(
        "symbol", "date", (price - 1).alias("open"), (price + 2).alias("high"), (price - 3).alias("low"),
        "close", (price / 2).alias("adj_close"), "volume",
    ).cache()


def keyed(df):
    return sorted(df.collect(), key=lambda r: (r["symbol"], r["date"]))


def test_csv_round_trip(spark, full):
    path = fresh_path(spark, "csv")
    src.write_bars_csv(full, path)
    back = src.read_bars(spark, path)
    assert keyed(back) == keyed(full)
    assert dict(back.dtypes)["volume"] == "bigint" and dict(back.dtypes)["date"] == "date"


def test_csv_of_one_symbol_and_bad_input(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    (tmp_path / "one.csv").write_text(head + "2021-01-04,1.0,2.0,0.5,1.5,1.5,3000000000\n")
    row = src.read_bars(spark, str(tmp_path / "one.csv"), symbol="x").first()
    assert (row["symbol"], row["date"], row["volume"]) == ("x", dt.date(2021, 1, 4), 3_000_000_000)
    (tmp_path / "bad.csv").write_text(head + "2021-01-04,oops,2.0,0.5,1.5,1.5,30\n")
    with pytest.raises(Exception):
        src.read_bars(spark, str(tmp_path / "bad.csv"), symbol="x").collect()
    (tmp_path / "names.csv").write_text(head.replace("Open", "Opn") + "2021-01-04,1,2,0.5,1.5,1.5,30\n")
    with pytest.raises(Exception):
        src.read_bars(spark, str(tmp_path / "names.csv"), symbol="x").collect()
    with pytest.raises(ValueError):
        src.read_bars(spark, "x", fmt="xml")


def test_parquet_layout_prunes_years(spark, full):
    path = fresh_path(spark, "bars")
    src.write_bars(full, path)
    assert keyed(src.read_bars(spark, path, "parquet")) == keyed(full)


def test_bars_from_trades_orders_by_sequence(spark):
    rows = [("a", "2020-01-01 10:00:00", 5.0, 2.0, 3, 0.1), ("a", "2020-01-01 09:00:00", 7.0, 1.0, 1, 0.5),
            ("a", "2020-01-01 11:00:00", 6.0, 4.0, 2, 0.2)]
    trades = spark.createDataFrame(rows, "s string, t string, p double, q double, no bigint, d double")
    bar = src.bars_from_trades(trades, "s", F.col("t").cast("timestamp"), "p", "q", F.col("no"), "d").first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (7.0, 7.0, 5.0, 5.0, 7)
    assert bar["adj_close"] == 2.5


def test_names_and_features(spark, full):
    raw = spark.createDataFrame([(1, 2.0, "x")], "` Adj Close` int, Open double, NAME string")
    assert columns.normalize_names(raw).columns == ["adj_close", "open", "name"]
    assert columns.feature_columns(full) == ["open", "high", "low", "volume"]


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("29.02.2020",), (None,)], "d string")
    assert [r["d"] for r in clean.cast_dates(df, "d").collect()] == [dt.date(2020, 2, 29), None, None]
    assert tuple(clean.date_quality(df, "d").first()) == (3, 1)
    with pytest.raises(Exception, match="not a date"):
        clean.cast_dates(df, "d", strict=True).collect()


def test_dedup(spark):
    rows = [("a", DAY0, 2.0)] * 50 + [("a", DAY0, 1.0), ("b", DAY0, None)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert clean.dedup_rows(df).count() == 3
    kept = {r["symbol"]: r["close"] for r in clean.dedup_keyed(df, ["symbol", "date"], ["close"]).collect()}
    assert kept == {"a": 1.0, "b": None}


@pytest.mark.parametrize("width", [4, 1000])
def test_calendar(full, width):
    got = by_series(clean.align_calendar(full, Timeline(width=width)).collect())
    have = {(r["symbol"], r["date"]): r for r in full.collect()}
    for name, rows in got.items():
        days = [r["date"] for r in rows]
        assert days == [days[0] + dt.timedelta(days=i) for i in range(len(days))]
        assert days[0] == min(d for s, d in have if s == name) and days[-1] == max(d for s, d in have if s == name)
        for r in rows:
            assert r["close"] == (have[name, r["date"]]["close"] if (name, r["date"]) in have else None)
    assert sum(r["close"] is not None for rows in got.values() for r in rows) == len(have)


def test_nulls_and_adjustment(full):
    aligned = clean.align_calendar(full)
    assert clean.drop_nulls(aligned, ["close"]).count() == full.count()
    assert clean.fill_nulls(aligned, {"close": -1.0}).filter("close = -1").count() == aligned.count() - full.count()
    for old, new in zip(keyed(full), keyed(clean.adjusted_bars(full))):
        assert new["close"] == old["adj_close"] and new["volume"] == pytest.approx(old["volume"] * 2)
        assert new["high"] == pytest.approx(old["high"] / 2)


def test_joins_of_predictions(full):
    days = full.filter("symbol = 'a'").select("symbol", "date", (F.col("close") + 1).alias("prediction"))
    assert keyed(relations.only_predicted(full, days)) == [r for r in keyed(full) if r["symbol"] == "a"]
    assert relations.prediction_join(full, days).count() == days.count()
    seen = relations.actual_vs_predicted(full, days).collect()
    assert len(seen) == days.count() and all(r["prediction"] == r["close"] + 1 for r in seen)
    whole = relations.history_with_predictions(full, days)
    assert whole.count() == full.count() and whole.filter("prediction IS NULL").count() == full.count() - days.count()
    assert relations.overlay_long(whole).count() == full.count() + days.count()
    both = relations.overlay(full, days, days.limit(0))
    assert both.filter("test_prediction IS NULL").count() == full.count()


def test_value_join_and_its_compact_form(spark):
    left = spark.createDataFrame([(i, 5.0 if i < 6 else float(i)) for i in range(9)] + [(9, None)], "id int, close double")
    right = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (7.0, 2.0), (None, 9.0)], "label double, prediction double")
    pairs = left.join(right, left["close"] == right["label"])
    compact = relations.match_on_value(left, right, "close", "label", "prediction")
    assert pairs.count() == 13 and compact.count() == 7
    assert compact.agg(F.sum("n_matches")).first()[0] == pairs.count()
    row = compact.filter("id = 0").first()
    assert (row["min_prediction"], row["max_prediction"]) == (1.0, 3.0)


def test_except(spark):
    left = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (None,)], "x int")
    right = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(str(r["x"]) for r in relations.except_distinct(left, right).collect()) == ["2", "None"]
    assert sorted(str(r["x"]) for r in relations.except_all(left, right).collect()) == ["1", "1", "2", "2", "None"]


def test_series_of_every_kind_survive_the_calendar(spark):
    df = make_bars(spark, uneven_series())
    assert clean.drop_nulls(clean.align_calendar(df), ["close"]).count() == df.count()


def test_nan_is_dropped_on_request_only(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert clean.drop_nulls(df, ["x"]).count() == 3
    assert clean.drop_nulls(df, ["x"], nan=True).count() == 2
    assert clean.drop_nulls(df).count() == 2
