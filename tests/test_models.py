"""Metrics, features, tuning and serving."""

import datetime as dt

import pytest
from helpers import DAY0
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from tsreg.functions import features, metrics
from tsreg.functions.columns import minmax_inverse
from tsreg.operators import ordering
from tsreg.operators.timeline import add_lags
from tsreg.plans import serve, tune
from tsreg.sources.stage import fresh_path


@pytest.fixture(scope="module")
def bars(spark):
    days = spark.range(150).select(F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("date"), "id")
    names = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "symbol string, k double")
    price = 50 + F.sin(F.col("id") * F.col("k")) * 9
    return days.join(names).select(
        "symbol", "date", price.alias("open"), (price + F.cos(F.col("id")) + 3).alias("high"),
        (price - F.sin(F.col("id") * 3) - 3).alias("low"),
        (price * 0.9 + F.cos(F.col("id") * 5) * 2).alias("close"),
        price.alias("adj_close"), (F.col("id") * 37 % 101).alias("volume"),
    ).cache()


@pytest.fixture(scope="module")
def parts(bars):
    split = ordering.chrono_split(bars)
    return [serve.labelled(p, serve.BAR_FEATURES).cache() for p in split]


@pytest.fixture(scope="module")
def model(parts):
    return tune.linear().fit(parts[0])


def test_metrics_equal_the_evaluator(parts, model):
    scored = model.transform(parts[1])
    row = metrics.regression_metrics(scored).first()
    for name in ("mse", "rmse", "mae", "r2"):
        want = RegressionEvaluator(labelCol="label", metricName=name).evaluate(scored)
        assert row[name] == pytest.approx(want), name
    by_symbol = metrics.regression_metrics(scored, by=["symbol"]).collect()
    assert sum(r["n"] for r in by_symbol) == row["n"] == parts[1].count()
    assert metrics.metric_rows(metrics.regression_metrics(scored)).count() == 5


def test_percentage_error_skips_zero_labels(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["mape"] == pytest.approx((0.5 + 0.25) / 2) and row["n_zero_label"] == 1
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert metrics.regression_metrics(flat).first()["r2"] is None


def test_directional_accuracy(spark):
    labels, guesses = [10.0, 12.0, 11.0, 11.0, 15.0], [9.0, 11.0, 13.0, 11.0, 16.0]
    rows = [("a", DAY0 + dt.timedelta(days=i), y, p) for i, (y, p) in enumerate(zip(labels, guesses))]
    df = spark.createDataFrame(rows, "symbol string, date date, label double, prediction double")
    assert tuple(metrics.directional_accuracy(df).first()) == (4, 0.75)


def test_minmax_and_its_inverse(bars):
    train = ordering.chrono_split(bars).train
    fitted = features.fit_scaler(train, ["close"], "minmax")
    scaled = features.scaled_columns(fitted, bars, ["s"])
    # the bounds come from the train part only
    seen = scaled.join(train.select("symbol", "date"), ["symbol", "date"]).agg(F.min("s"), F.max("s")).first()
    assert tuple(seen) == pytest.approx((0.0, 1.0))
    back = features.inverse_scaled(fitted, scaled, "s", "restored")
    assert back.agg(F.max(F.abs(F.col("restored") - F.col("close")))).first()[0] < 1e-9
    other = bars.limit(1).select(minmax_inverse(F.lit(0.5), 10, 30, -1, 1).alias("v")).first()
    assert other["v"] == 25.0


def test_scalers_on_constant_columns(bars):
    flat = bars.withColumn("one", F.lit(3.0))
    for kind, value in (("minmax", 0.5), ("standard", 0.0)):
        fitted = features.fit_scaler(flat, ["one"], kind)
        assert features.scaled_columns(fitted, flat, ["s"]).first()["s"] == value
    with pytest.raises(ValueError):
        features.scaler_stage("robust", "a", "b")


def test_index_and_one_hot_with_ties_and_unseen(spark):
    train = spark.createDataFrame([("x",), ("b",), ("a",), ("x",)], "c string")
    df = spark.createDataFrame([("a",), ("b",), ("x",), ("new",)], "c string")
    index = {r["c"]: r["i"] for r in features.string_index(train, df, "c", "i").collect()}
    assert index == {"x": 0.0, "a": 1.0, "b": 2.0, "new": 3.0}
    slots = {r["c"]: r["s"] for r in features.one_hot(train, df, "c", "s").collect()}
    assert slots["a"].toArray().tolist() == [0.0, 1.0, 0.0] and slots["new"].numNonzeros() == 0


def test_null_feature_fails_unless_skipped(bars):
    holed = bars.withColumn("open", F.when(F.col("date") > F.lit(DAY0), F.col("open")))
    with pytest.raises(Exception):
        features.assembled(holed, ["open"]).collect()
    assert features.assembled(holed, ["open"], "skip").count() == bars.count() - 2


def test_best_of_a_grid_by_direction(parts):
    model = tune.linear(maxIter=5)
    grid = tune.param_maps(model, {"regParam": [50.0, 0.0], "elasticNetParam": [0.0]})
    low = tune.grid_search(parts[0], parts[1], model, grid, "rmse")
    high = tune.grid_search(parts[0], parts[1], model, grid, "r2")
    # a larger r2 is better: both measures choose the weak penalty
    assert low.params["regParam"] == high.params["regParam"] == "0.0"
    rows = {(r["trial"], r["split"], r["metric"]): r["value"] for r in low.trials.collect()}
    assert len(rows) == 2 * 2 * 5
    # the reported train measures belong to the chosen model, not to the last of the grid
    want = tune.measures(low.model.transform(parts[0]))["rmse"]
    assert rows[1, "train", "rmse"] == pytest.approx(want)


def test_cross_validation_equals_spark_on_the_same_folds(parts):
    model = tune.tree(maxDepth=2)
    grid = tune.param_maps(model, {"maxDepth": [1, 3]})
    a = tune.cross_validate(parts[0], model, grid, folds=3)
    b = tune.cross_validate(parts[0].repartition(5), model, grid, folds=3)
    rows = tune.mean_metrics(a).orderBy("trial").collect()
    again = tune.mean_metrics(b).orderBy("trial").collect()
    folded = ordering.fold_column(parts[0], ["date", "symbol"], 3)
    want = CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=tune.evaluator(), numFolds=3, foldCol="fold"
    ).fit(folded)
    for found in (rows, again):
        assert [r["avg_metric"] for r in found] == pytest.approx(want.avgMetrics)
        assert [r["chosen"] for r in found] == [m == min(want.avgMetrics) for m in want.avgMetrics]
    assert a.model.getMaxDepth() == want.bestModel.getMaxDepth() == int(a.params["maxDepth"])


def test_rolling_origin_never_trains_on_later_days(parts, monkeypatch):
    seen = []
    model = tune.linear()
    fit = type(model).fit

    def spy(self, df, params=None):
        seen.append(df.agg(F.max("date")).first()[0])
        return fit(self, df, params)

    monkeypatch.setattr(type(model), "fit", spy)
    found = tune.rolling_origin(parts[0], model, tune.param_maps(model, {"regParam": [0.0]}), folds=3)
    cuts = sorted(r["train_end"] for r in ordering.rolling_origin_folds(parts[0], 3).collect())
    assert sorted(seen)[:3] == cuts and found.trials.count() == 3


def test_train_and_evaluate(bars):
    doubled = bars.unionAll(bars)
    found = tune.train_and_evaluate(
        doubled, tune.linear(), {"regParam": [0.0, 1.0]}, "close", serve.BAR_FEATURES, ["symbol"], folds=2
    )
    got = {(r["split"], r["metric"]): r["value"] for r in found.metrics.collect()}
    train, test = ordering.chrono_split(bars)
    assert got["test", "rmse"] == pytest.approx(tune.measures(found.model.transform(test), "close")["rmse"])
    assert got["train", "mae"] == pytest.approx(tune.measures(found.model.transform(train), "close")["mae"])


def test_save_and_load(spark, bars, parts, model):
    path = fresh_path(spark, "model")
    serve.save_model(model, path)
    again = serve.load_model("linear", path)
    assert again.transform(parts[1]).collect() == model.transform(parts[1]).collect()
    pipeline = features.build_pipeline(tune.tree(maxDepth=3), "close", serve.BAR_FEATURES, ["symbol"], "minmax")
    fitted = pipeline.fit(bars)
    serve.save_model(fitted, path)
    back = serve.load_model("pipeline", path)
    assert back.stages[1].originalMax == fitted.stages[1].originalMax
    assert back.transform(bars).select("prediction").collect() == fitted.transform(bars).select("prediction").collect()
    with pytest.raises(ValueError, match="unknown model"):
        serve.load_model("forest", path)


def test_backtest(bars, parts, model):
    test = ordering.chrono_split(bars).test
    found = serve.backtest(test, model, 7, name="linear")
    rows = found.predictions.collect()
    days = {(r["symbol"], r["date"]): r["close"] for r in test.collect()}
    assert len(rows) == 7 and all(r["label"] == days[r["symbol"], r["date"]] for r in rows)
    rmse = {r["metric"]: r["value"] for r in found.metrics.collect()}["rmse"]
    assert rmse == pytest.approx((sum((r["label"] - r["prediction"]) ** 2 for r in rows) / 7) ** 0.5)
    assert serve.backtest(test, model, 7, per_series=True).predictions.count() == 14
    assert serve.backtest(test, model, 10**4).predictions.count() == test.count()
    with pytest.raises(ValueError):
        serve.backtest(test, model, 0)


def test_horizon_options():
    assert [serve.horizon_days(o) for o in ("7 days", "14 days", "30 days")] == [7, 14, 30]
    assert serve.horizon_days("Custom", 5) == 5
    for option, days in (("Custom", None), ("Custom", 0), ("a year", None)):
        with pytest.raises(ValueError):
            serve.horizon_days(option, days)


def test_forecast_features_come_from_earlier_days(bars):
    lagged = add_lags(bars, list(serve.BAR_FEATURES), [1]).filter("open_lag_1 IS NOT NULL")
    fitted = tune.linear().fit(serve.labelled(lagged, [f"{c}_lag_1" for c in serve.BAR_FEATURES]))
    assert fitted.numFeatures == 4


def test_grids_have_the_sizes_of_the_study():
    assert len(tune.param_maps(tune.linear(), tune.LINEAR_GRID)) == 9
    assert len(tune.param_maps(tune.tree(), tune.TREE_GRID)) == 81


def test_index_of_numbers_goes_by_their_text(spark):
    rows = spark.createDataFrame([(9,), (10,), (100,), (None,)], "c int")
    index = {r["c"]: r["i"] for r in features.string_index(rows, rows, "c", "i").collect()}
    assert index == {10: 0.0, 100: 1.0, 9: 2.0, None: 3.0}


def test_lead_keeps_rows_by_place(bars):
    holed = bars.filter("symbol = 'a' AND date < '2020-01-08'").withColumn(
        "open",
        F.when(F.dayofmonth("date") == 3, None).when(F.dayofmonth("date") == 4, float("nan")).otherwise(F.col("open")),
    )
    assert serve.with_lead(holed, 1, ["open"]).count() == holed.count() - 1


def test_rolling_origin_refuses_what_it_cannot_fold(parts):
    few = parts[0].filter("date < '2020-01-03'")
    with pytest.raises(ValueError, match="folds"):
        tune.rolling_origin(few, tune.linear(), [{}], folds=5)
    holed = parts[0].withColumn("date", F.when(F.dayofmonth("date") > 5, F.col("date")))
    with pytest.raises(ValueError, match="null"):
        tune.rolling_origin(holed, tune.linear(), [{}], folds=2)
