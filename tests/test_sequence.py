import datetime as dt
import math

import numpy as np
import pytest
from helpers import DAY0
from pyspark.sql import functions as F

from tsreg.functions.network import Sizes, loss_and_gradient
from tsreg.operators import ordering
from tsreg.operators.timeline import Timeline
from tsreg.plans import sequence as sq
from tsreg.plans import serve
from tsreg.sources.stage import fresh_path

SIZES = Sizes(hidden=(6, 5, 4), dense=4)


@pytest.fixture(scope="module")
def waves(spark):
    days = spark.range(120).select(F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("date"), "id")
    names = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "symbol string, shift double")
    return days.join(names).select(
        "symbol", "date", (F.sin(F.col("id") / 5 + F.col("shift")) * 10 + 50).alias("close")
    ).cache()


@pytest.fixture(scope="module")
def prepared(waves):
    return sq.prepare(waves, length=6)


def test_prepare(prepared, waves):
    rows = prepared.samples.collect()
    assert len(rows) == 240 - 12
    cut = max(r["date"] for r in rows if not r["held_out"])
    assert all(r["date"] >= cut for r in rows if r["held_out"])
    # 192 train rows, of which the first 6 days of both series are history only
    assert sum(not r["held_out"] for r in rows) == 192 - 12
    train_max = waves.filter(F.col("date") <= F.lit(cut)).agg(F.max("close")).first()[0]
    fitted = prepared.scaler.stages[1]
    assert float(fitted.originalMax[0]) == pytest.approx(train_max)


def test_one_step_equals_the_single_task_gradient(prepared):
    seen = prepared.samples.filter("NOT held_out")
    pdf = seen.filter("NOT valid").toPandas()
    x = np.stack(pdf["x"].to_numpy())[:, :, None]
    loss, gradient = loss_and_gradient(SIZES, SIZES.initial(1), x, pdf["y"].to_numpy())
    got, sums = sq._step(seen.repartition(5), SIZES, SIZES.initial(1))
    assert np.allclose(got, gradient) and sums[0] == pytest.approx(loss) and sums[1] == len(pdf)
    assert sums[3] == prepared.samples.filter("valid").count() > 0


def test_the_test_part_is_not_seen_while_fitting(prepared):
    changed = prepared.samples.withColumn("y", F.when(F.col("held_out"), 1e6).otherwise(F.col("y")))
    a, b = (sq.fit(s, SIZES, epochs=1) for s in (prepared.samples, changed))
    assert np.array_equal(a.weights.flat, b.weights.flat) and a.losses.collect() == b.losses.collect()
    assert not prepared.samples.filter("held_out AND valid").count()
    last = prepared.samples.filter("NOT valid AND NOT held_out").agg(F.max("date")).first()[0]
    assert prepared.samples.filter("valid").agg(F.min("date")).first()[0] >= last


def test_hourly_series_of_another_key(spark):
    line = Timeline(by=("kind",), order="ts", grain="hour")
    rows = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") / 2).cast("int"))).alias("ts"),
        F.sin(F.col("id") / 9).alias("value"),
    )
    prepared = sq.prepare(rows, 4, "value", line=line)
    fitted = sq.fit(prepared.samples, SIZES, epochs=1, line=line)
    found = sq.predictions(prepared.samples, prepared.scaler, fitted.weights, line=line)
    assert found.columns == ["kind", "ts", "label", "prediction", "held_out"] and found.count() == 192
    tested = serve.backtest_sequence(rows, prepared.scaler, fitted.weights, 4, 3, line=line, value="value")
    assert tested.predictions.count() == 6


def test_training_lowers_the_loss(prepared):
    full = sq.fit(prepared.samples, SIZES, epochs=6, rate=0.02)
    losses = [r["train_loss"] for r in full.losses.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] and len(losses) == 6
    assert all(not math.isnan(r["valid_loss"]) for r in full.losses.collect())
    mini = sq.fit(prepared.samples, SIZES, epochs=2, rate=0.02, batches=3)
    losses = [r["train_loss"] for r in mini.losses.orderBy("epoch").collect()]
    assert losses[1] < losses[0]


def test_weights_round_trip_and_predictions(spark, prepared, waves):
    weights = sq.Weights(SIZES, SIZES.initial(9))
    path = fresh_path(spark, "weights")
    sq.save_weights(weights, spark, path)
    back = sq.load_weights(spark, path)
    assert back.sizes == SIZES and np.array_equal(back.flat, weights.flat)
    a = sq.predictions(prepared.samples, prepared.scaler, weights).orderBy("symbol", "date").collect()
    b = sq.predictions(prepared.samples, prepared.scaler, back).orderBy("symbol", "date").collect()
    assert a == b
    closes = {(r["symbol"], r["date"]): r["close"] for r in waves.collect()}
    assert all(r["label"] == pytest.approx(closes[r["symbol"], r["date"]]) for r in a)


def test_restarted_windows_leave_out_the_first_test_days(waves, prepared):
    again = sq.prepare(waves, 6, restart=True).samples
    assert again.filter("NOT held_out").count() == prepared.samples.filter("NOT held_out").count()
    assert again.filter("held_out").count() == prepared.samples.filter("held_out").count() - 12


def test_backtest_is_dated_by_the_predicted_day(waves, prepared):
    test = ordering.chrono_split(waves).test
    found = serve.backtest_sequence(test, prepared.scaler, sq.Weights(SIZES, SIZES.initial(9)), 6, 7)
    rows = found.predictions.collect()
    closes = {(r["symbol"], r["date"]): r["close"] for r in test.collect()}
    first = min(d for _, d in closes)
    assert len(rows) == 14 and min(r["date"] for r in rows) >= first + dt.timedelta(days=6)
    assert all(r["label"] == pytest.approx(closes[r["symbol"], r["date"]]) for r in rows)
    assert {r["metric"] for r in found.metrics.collect()} == {"mse", "rmse", "mae", "r2", "mape"}


def test_lead_days(waves):
    bars = waves.withColumn("open", F.col("close") + 1)
    ahead = {(r["symbol"], r["date"]): r for r in serve.with_lead(bars, 2, ["open"]).collect()}
    own = {(r["symbol"], r["date"]): r for r in bars.collect()}
    assert len(ahead) == len(own) - 4 and serve.with_lead(bars, 0) is bars
    for (name, day), row in ahead.items():
        assert row["open"] == own[name, day - dt.timedelta(days=2)]["open"]
        assert row["close"] == own[name, day]["close"]
