"""Category stages, sums of products, truncated trees, batches and training by rounds."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tests.helpers import make_bars, uneven_series
from tsreg.functions import categories, features
from tsreg.functions.network import Sizes
from tsreg.operators import ordering
from tsreg.plans import gram, sequence, serve, trees, tune
from tsreg.sources.stage import fresh_path


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        x = [rng.uniform(0, 10), rng.gauss(5, 2), rng.uniform(100, 900)]
        y = 3 * x[0] - 2 * x[1] + 0.01 * x[2] + rng.gauss(0, 1)
        rows.append((f"s{k % 3}", k, *x, 7.0, y))
    frame = spark.createDataFrame(rows, "symbol string, k int, a double, b double, c double, d double, close double")
    dated = frame.withColumn("date", F.date_add(F.lit("2020-01-01"), F.floor(F.col("k") / 3).cast("int"))).repartition(4)
    return serve.labelled(dated, ["a", "b", "c", "d"])


def test_many_categories_in_a_saved_pipeline(spark):
    """200,000 categories, one with a third of the rows: fitted, saved, loaded and applied as tables."""
    rows = spark.range(300_000).select(
        F.when(F.col("id") < 100_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("c"),
        (F.col("id") % 17).cast("double").alias("x"),
        (F.col("id") % 5).cast("double").alias("y"),
    )
    model = features.build_pipeline(
        LinearRegression(maxIter=1, solver="l-bfgs", regParam=1.0), "y", num=["x"], cat=["c"]
    ).fit(rows)
    path = fresh_path(spark, "many")
    serve.save_model(model, path)
    back = serve.load_model("pipeline", path)
    index = next(s for s in back.stages if isinstance(s, categories.CategoryIndexModel))
    assert index.found.n == 200_001
    some = rows.filter("c IN ('c100007', 'c250001', 'hot')").dropDuplicates(["c"])
    unseen = spark.createDataFrame([("hot", 1.0, 1.0), ("new", 1.0, 1.0), (None, 1.0, 1.0)], "c string, x double, y double")
    for df in (some, unseen):
        kept = ["c", "c_index", "prediction"]
        got = [{tuple(r) for r in m.transform(df).select(*kept).collect()} for m in (model, back)]
        assert got[0] == got[1]
    found = {r["c"]: r for r in back.transform(unseen).collect()}
    assert found["hot"]["c_index"] == 0 and found["new"]["c_index"] == found[None]["c_index"] == 200_001
    assert found["hot"]["c_slots"].size == 200_001 and found["new"]["c_slots"].numNonzeros() == 0


def test_category_stage_in_a_search(spark):
    """A pipeline with a category stage is copied, tuned and fitted on each fold's own categories."""
    bars = make_bars(spark, uneven_series())
    found = tune.train_and_evaluate(bars, tune.linear(), {"regParam": [0.0, 0.1]}, "close", num=["volume"], cat=["symbol"])
    got = {(r["split"], r["metric"]): r["value"] for r in found.metrics.collect()}
    test = ordering.chrono_split(bars).test
    assert got["test", "rmse"] == pytest.approx(tune.measures(found.model.transform(test), "close")["rmse"])


def test_sums_give_what_spark_fits(table):
    """All points of the grid, a constant feature among the columns."""
    sums = gram.grams(table, 4, F.lit(0))[0]
    for reg in (0.0, 0.01, 0.1, 1.0):
        for elastic in (0.0, 0.5, 1.0):
            fitted = tune.linear(regParam=reg, elasticNetParam=elastic, tol=1e-12, maxIter=2000).fit(table)
            line = gram.solve(sums, reg, elastic)
            assert np.allclose(line.coefficients, fitted.coefficients.toArray(), rtol=1e-4, atol=1e-5)
            assert line.intercept == pytest.approx(fitted.intercept, rel=1e-4)
            error = tune.measures(fitted.transform(table))["rmse"]
            assert gram.rmse(sums, line) == pytest.approx(error, rel=1e-5)


def test_no_intercept(spark):
    rows = spark.createDataFrame([(1.0, 3.5), (2.0, 5.5), (3.0, 9.5), (4.0, 11.5)], "x double, label double")
    table = features.assembler(["x"]).transform(rows)
    line = gram.solve(gram.grams(table, 1, F.lit(0))[0], intercept=False)
    fitted = tune.linear(fitIntercept=False).fit(table)
    assert line.coefficients == pytest.approx(fitted.coefficients.toArray()) and line.intercept == 0


def test_folds_are_left_out_by_subtraction(table):
    model = tune.linear(tol=1e-12, maxIter=2000)
    grid = tune.param_maps(model, {"regParam": [0.01, 1.0], "elasticNetParam": [0.0, 1.0]})
    slow = tune.cross_validate(table, model, grid, folds=3).trials.collect()
    fast = gram.cross_validate(table, 4, grid, folds=3).collect()
    want = {(r["trial"], r["fold"]): (r["params"], r["metric"]) for r in slow}
    assert len(fast) == 12
    for row in fast:
        params, metric = want[row["trial"], row["fold"]]
        assert row["params"] == params and row["metric"] == pytest.approx(metric, rel=1e-5)
    means = tune.mean_metrics(gram.cross_validate(table, 4, grid, folds=3)).collect()
    assert sum(r["chosen"] for r in means) == 1


def test_origins_are_running_sums(table):
    model = tune.linear()
    grid = tune.param_maps(model, {"regParam": [0.0, 1.0]})
    slow = tune.rolling_origin(table, model, grid, folds=3).trials.collect()
    fast = gram.rolling_origin(table, 4, grid, folds=3).collect()
    want = {(r["trial"], r["fold"]): r["metric"] for r in slow}
    assert {(r["trial"], r["fold"]): r["metric"] for r in fast} == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def test_odd_sums(spark, table):
    with pytest.raises(ValueError, match="features"):
        gram.grams(table, 10_000, F.lit(0))
    with pytest.raises(ValueError, match="maxIter"):
        gram.cross_validate(table, 4, tune.param_maps(tune.linear(), {"maxIter": [1]}))
    flat = gram.Gram(np.array([[2.0, 3.0, 8.0], [3.0, 5.0, 12.0], [8.0, 12.0, 32.0]]))
    assert gram.solve(flat).coefficients == pytest.approx([0.0]) and gram.solve(flat).intercept == 4


def test_smaller_trees_are_read_off(table):
    """Every point and fold as if it were fitted alone."""
    grid = {"maxDepth": [1, 3, 6], "minInstancesPerNode": [1, 20], "minInfoGain": [0.0, 0.5, 4.0]}
    fast = {(r["trial"], r["fold"]): r for r in trees.cross_validate(table, grid, folds=2).collect()}
    model = tune.tree()
    maps = tune.param_maps(model, grid)
    slow = tune.cross_validate(table, model, maps, folds=2).trials.collect()
    assert len(slow) == len(fast) == 36
    for row in slow:
        got = fast[row["trial"], row["fold"]]
        assert got["params"] == row["params"] and got["metric"] == pytest.approx(row["metric"], rel=1e-9)
    assert len({round(r["metric"], 6) for r in fast.values()}) > 10


@pytest.mark.parametrize("rows", [16, 32, 1000])
def test_minibatches(spark, rows):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(5)
    dealt = [ordering.minibatches(df, ["k"], rows, epoch, max_cell=100).collect() for epoch in (1, 1, 2)]
    for found in dealt:
        assert {r["k"] for r in found} == set(range(500)) and all(r["v"] == 2 * r["k"] for r in found)
        places = {(r["batch"], r["place"]) for r in found}
        assert places == {(k // rows, k % rows) for k in range(500)}
    order = [{r["k"]: (r["batch"], r["place"]) for r in found} for found in dealt]
    assert order[0] == order[1] != order[2]
    assert ordering.minibatches(df.limit(0), ["k"], rows).count() == 0
    with pytest.raises(ValueError):
        ordering.minibatches(df, ["k"], 0)


SMALL = Sizes(hidden=(4, 3, 2), dense=2)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        wave = np.sin(np.arange(120) / 5 + s) / 2 + 0.5 + rng.normal(0, 0.02, 120)
        for k in range(3, 120):
            rows.append((f"s{s}", k, wave[k - 3 : k].tolist(), float(wave[k]), k > 100, 80 < k <= 100))
    schema = "symbol string, date int, x array<double>, y double, held_out boolean, valid boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_one_shard_is_plain_descent(samples):
    """All samples in one shard and one batch: the same steps as the synchronous training."""
    want = sequence.fit(samples, SMALL, epochs=6, rate=0.01)
    got = sequence.fit_by_rounds(samples, SMALL, epochs=6, rate=0.01, per_round=4, shard_rows=10_000)
    assert np.allclose(got.weights.flat, want.weights.flat, rtol=1e-9, atol=1e-12)
    for a, b in zip(*(sorted(f.losses.collect()) for f in (want, got))):
        assert tuple(a) == pytest.approx(tuple(b))


def test_rounds_go_on_where_they_stopped(spark, samples):
    """Interrupted and resumed: the weights and losses of an uninterrupted course; the loss falls."""
    how = {"rate": 0.01, "batch_rows": 16, "per_round": 5, "shard_rows": 100}
    whole = sequence.fit_by_rounds(samples, SMALL, epochs=30, **how)
    path = fresh_path(spark, "progress")
    sequence.fit_by_rounds(samples, SMALL, epochs=15, progress=path, **how)
    again = sequence.fit_by_rounds(samples, SMALL, epochs=30, progress=path, **how)
    assert np.allclose(again.weights.flat, whole.weights.flat, rtol=1e-12, atol=1e-14)
    losses = sorted(whole.losses.collect())
    assert [r["epoch"] for r in losses] == list(range(1, 31))
    assert losses[-1]["train_loss"] < 0.5 * losses[0]["train_loss"] and losses[-1]["valid_loss"] < losses[0]["valid_loss"]
    rows = spark.read.parquet(path)
    assert {r["epoch"] for r in rows.select("epoch").collect()} == {5, 10, 15, 20, 25, 30}


def test_held_out_samples_take_no_part(samples):
    turned = samples.withColumn("y", F.when(F.col("held_out"), 99.0).otherwise(F.col("y")))
    how = {"epochs": 3, "batch_rows": 32, "per_round": 3}
    a, b = (sequence.fit_by_rounds(s, SMALL, **how) for s in (samples, turned))
    assert np.array_equal(a.weights.flat, b.weights.flat)
