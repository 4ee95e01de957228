"""Queries on fitted models: linear, tree, pipelines, tuning, persistence, back-tests, sequences."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.network_sql import network_sql
from catalog.tables import BARS, HOURLY, RANKED, bar_table, bucket_sql, hourly, query, table
from tsreg.functions.features import build_pipeline
from tsreg.functions.network import Sizes
from tsreg.operators.ordering import chrono_split
from tsreg.plans import gram, sequence, serve, tune
from tsreg.sources.stage import fresh_path, stage

# Small layers and few steps: the full ones take minutes, and check nothing more.
SMALL = Sizes(hidden=(8, 6, 4), dense=4)


def _sweep(step: int) -> str:
    """SQL step of least squares: take what feature ``step`` explains (in the train part) out of
    the features after it and of the target."""
    z, left = f"z{step}", [f"z{i}" for i in range(step + 1, 5)] + ["e"]

    def share(c: str) -> str:
        return (
            f"sum({z} * {c}) FILTER (WHERE in_train) OVER () / "
            f"sum({z} * {z}) FILTER (WHERE in_train) OVER ()"
        )

    swept = ", ".join(f"{c} - {z} * ({share(c)}) AS {c}" for c in left)
    return f"sweep{step} AS (SELECT symbol, date, rn, in_train, label, {swept} FROM sweep{step - 1})"


def _centred(column: str, name: str) -> str:
    return f"{column} - avg({column}) FILTER (WHERE in_train) OVER () AS {name}"


OLS = f"""{BARS}, {RANKED},
parts AS (SELECT *, rn <= total * 80 // 100 AS in_train FROM ranked),
sweep0 AS (
  SELECT symbol, date, rn, in_train, close AS label, {_centred('open', 'z1')}, {_centred('high', 'z2')},
         {_centred('low', 'z3')}, {_centred('volume', 'z4')}, {_centred('close', 'e')} FROM parts),
{_sweep(1)}, {_sweep(2)}, {_sweep(3)}, {_sweep(4)},
fitted AS (
  SELECT symbol, date, rn, in_train, label, round(label - e, 4) AS prediction FROM sweep4)"""


def _parts(spark, sf_dir):
    train, test = chrono_split(bar_table(spark, sf_dir))
    return serve.labelled(train, serve.BAR_FEATURES), serve.labelled(test, serve.BAR_FEATURES)


def _plain(scored):
    return scored.select("symbol", "date", "label", F.round("prediction", 4).alias("prediction"))


@query(
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""
)
def linear_fit_coefficients(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
        F.col("l_extendedprice").alias("close"),
    )
    model = tune.linear().fit(serve.labelled(rows, ["l_quantity"]))
    found = [(float(model.coefficients[0]), float(model.intercept))]
    return spark.createDataFrame(found, "slope double, intercept double").select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept")
    )


@query(f"WITH {OLS} SELECT symbol, date, label, prediction FROM fitted WHERE NOT in_train")
def linear_predictions(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return _plain(tune.linear().fit(train).transform(test))


@query()
def tree_predictions(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    chosen = {"maxDepth": 10, "maxBins": 128, "minInstancesPerNode": 3, "minInfoGain": 0.0}
    return _plain(tune.tree(**chosen).fit(train).transform(test))


@query()
def pipeline_predictions(spark, sf_dir):
    train, test = chrono_split(bar_table(spark, sf_dir))
    pipeline = build_pipeline(
        tune.linear(regParam=0.01), "close", num=serve.BAR_FEATURES, cat=["symbol"]
    )
    scored = pipeline.fit(train).transform(test)
    return _plain(scored.withColumn("label", F.col("close")))


@query(
    f"""WITH {BARS}, {RANKED},
means AS (SELECT symbol, avg(open) AS mx, avg(close) AS my FROM ranked WHERE rn <= total * 80 // 100 GROUP BY symbol),
slope AS (SELECT sum((open - mx) * (close - my)) / sum((open - mx) * (open - mx)) AS b
          FROM ranked JOIN means USING (symbol) WHERE rn <= total * 80 // 100)
SELECT symbol, date, close AS label, round(my + b * (open - mx), 4) AS prediction
FROM ranked JOIN means USING (symbol), slope WHERE rn > total * 80 // 100"""
)
def pipeline_within_groups(spark, sf_dir):
    """One number and one slot per series without a penalty: a regression inside the series."""
    train, test = chrono_split(bar_table(spark, sf_dir))
    pipeline = build_pipeline(tune.linear(fitIntercept=False), "close", num=["open"], cat=["symbol"])
    scored = pipeline.fit(train).transform(test)
    return _plain(scored.withColumn("label", F.col("close")))


TREE_VALUES = """
vals AS (SELECT l_quantity AS q, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
upto AS (SELECT q, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st
         FROM vals WINDOW w AS (ORDER BY q)),
cut AS (SELECT arg_max(q, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS c FROM upto WHERE nl < nt),
sides AS (SELECT q, n, s, q > c AS side FROM vals, cut),
upto2 AS (SELECT q, side, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS nt, sum(s) OVER a AS st
          FROM sides WINDOW w AS (PARTITION BY side ORDER BY q), a AS (PARTITION BY side)),
cut2 AS (SELECT side, arg_max(q, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS c2
         FROM upto2 WHERE nl < nt GROUP BY side),
leaves AS (SELECT q, n, s, side, coalesce(q > c2, FALSE) AS leaf FROM sides LEFT JOIN cut2 USING (side))"""


@query(
    f"""WITH {TREE_VALUES}
SELECT q AS l_quantity, n AS n_rows, round(sum(s) OVER w / sum(n) OVER w, 2) AS prediction
FROM leaves WINDOW w AS (PARTITION BY side, leaf)"""
)
def tree_two_levels(spark, sf_dir):
    """A regression tree of depth 2 on the 50 quantities of the line items."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_quantity",
        F.col("l_extendedprice").alias("close"),
    )
    found = tune.tree(maxDepth=2, maxBins=64).fit(serve.labelled(rows, ["l_quantity"]))
    scored = found.transform(serve.labelled(rows, ["l_quantity"]))
    return scored.groupBy(vector_to_array("features")[0].alias("l_quantity")).agg(
        F.count("*").alias("n_rows"), F.round(F.max("prediction"), 2).alias("prediction")
    )


def _simple(spark, sf_dir):
    return serve.labelled(bar_table(spark, sf_dir), ["open"])


INTERCEPTS = {"fitIntercept": [True, False]}


@query(
    f"""WITH {BARS}, {RANKED},
parts AS (SELECT open AS x, close AS y, rn, total * 80 // 100 AS cut FROM ranked),
halves AS (SELECT x, y, CASE WHEN rn <= cut * 80 // 100 THEN 'train' ELSE 'valid' END AS split
           FROM parts WHERE rn <= cut),
trials AS (
  SELECT 0 AS trial, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM halves WHERE split = 'train'
  UNION ALL SELECT 1, sum(x * y) / sum(x * x), 0 FROM halves WHERE split = 'train')
SELECT trial, split, round(sqrt(avg((y - a - b * x) ** 2)), 4) AS rmse,
       round(avg(abs(y - a - b * x)), 4) AS mae,
       round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 8) AS r2
FROM halves, trials GROUP BY trial, split"""
)
def grid_search_table(spark, sf_dir):
    train = chrono_split(bar_table(spark, sf_dir)).train
    head, tail = (serve.labelled(p, ["open"]) for p in chrono_split(train))
    model = tune.linear()
    found = tune.grid_search(head, tail, model, tune.param_maps(model, INTERCEPTS)).trials
    return (
        found.groupBy("trial", "split")
        .pivot("metric", ["rmse", "mae", "r2"])
        .agg(F.first("value"))
        .select(
            "trial", "split", *[F.round(m, d).alias(m) for m, d in (("rmse", 4), ("mae", 4), ("r2", 8))]
        )
    )


@query()
def tree_grid_search(spark, sf_dir):
    train = chrono_split(bar_table(spark, sf_dir)).train
    head, tail = (serve.labelled(p, serve.BAR_FEATURES) for p in chrono_split(train))
    model = tune.tree()
    return tune.grid_search(head, tail, model, tune.param_maps(model, tune.TREE_GRID)).trials


@query()
def cv_avg_metrics(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    grid = tune.param_maps(tune.linear(), tune.LINEAR_GRID)
    return tune.mean_metrics(gram.cross_validate(train, len(serve.BAR_FEATURES), grid, folds=3))


@query(
    f"""WITH {BARS}, {RANKED},
train AS (SELECT open AS x, close AS y, {bucket_sql(["date", "symbol"], 42, 3)} AS fold
          FROM ranked WHERE rn <= total * 80 // 100),
folds AS (SELECT DISTINCT fold FROM train),
fits AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x * y) / sum(x * x) AS b0
         FROM folds f JOIN train t ON t.fold <> f.fold GROUP BY f.fold),
scores AS (SELECT fold, sqrt(avg((y - a - b * x) ** 2)) AS m1, sqrt(avg((y - b0 * x) ** 2)) AS m0
           FROM fits JOIN train USING (fold) GROUP BY fold),
means AS (SELECT 0 AS trial, avg(m1) AS m, stddev_samp(m1) AS d FROM scores
          UNION ALL SELECT 1, avg(m0), stddev_samp(m0) FROM scores)
SELECT trial, round(m, 3) AS avg_metric, round(d, 3) AS std_metric,
       row_number() OVER (ORDER BY m, trial) = 1 AS chosen FROM means"""
)
def cv_intercepts(spark, sf_dir):
    """Three folds over the train part, with and without an intercept."""
    train = serve.labelled(chrono_split(bar_table(spark, sf_dir)).train, ["open"])
    model = tune.linear()
    found = tune.mean_metrics(tune.cross_validate(train, model, tune.param_maps(model, INTERCEPTS), folds=3))
    rounded = {m: F.round(m, 3) for m in ("avg_metric", "std_metric")}
    return found.drop("params").withColumns(rounded)


@query(
    f"""WITH {BARS},
days AS (SELECT date, count(*) AS n FROM bars GROUP BY date),
cum AS (SELECT *, sum(n) OVER (ORDER BY date) AS upto, sum(n) OVER () AS total FROM days),
blocks AS (SELECT ((upto - 1) * 4) // total AS block, max(date) AS valid_end FROM cum GROUP BY 1),
cuts AS (SELECT row_number() OVER w - 1 AS fold, lag(valid_end) OVER w AS train_end, valid_end
         FROM blocks WINDOW w AS (ORDER BY block)),
fits AS (
  SELECT fold, train_end, valid_end, regr_slope(close, open) AS b, regr_intercept(close, open) AS a,
         sum(open * close) / sum(open * open) AS b0
  FROM cuts JOIN bars ON date <= train_end GROUP BY ALL),
scored AS (
  SELECT fold, close - a - b * open AS e, close - b0 * open AS e0
  FROM fits JOIN bars ON date > train_end AND date <= valid_end)
SELECT 0 AS trial, fold::INT AS fold, round(sqrt(avg(e * e)), 4) AS rmse FROM scored GROUP BY fold
UNION ALL SELECT 1, fold::INT, round(sqrt(avg(e0 * e0)), 4) FROM scored GROUP BY fold"""
)
def rolling_origin_cv(spark, sf_dir):
    model = tune.linear()
    grid = tune.param_maps(model, INTERCEPTS)
    found = tune.rolling_origin(_simple(spark, sf_dir), model, grid, folds=3)
    return found.trials.select("trial", "fold", F.round("metric", 4).alias("rmse"))


@query()
def train_and_evaluate_metrics(spark, sf_dir):
    found = tune.train_and_evaluate(
        bar_table(spark, sf_dir),
        tune.linear(),
        tune.LINEAR_GRID,
        target="close",
        num=serve.BAR_FEATURES,
        cat=["symbol"],
    )
    return found.metrics


@query(
    f"""WITH {BARS}, {RANKED},
train AS (SELECT * FROM ranked WHERE rn <= total * 80 // 100),
days AS (SELECT date, count(*) AS n FROM train GROUP BY date),
cum AS (SELECT *, sum(n) OVER (ORDER BY date) AS upto, sum(n) OVER () AS total FROM days),
blocks AS (SELECT ((upto - 1) * 6) // total AS block, max(date) AS valid_end FROM cum GROUP BY 1),
cuts AS (SELECT lag(valid_end) OVER w AS train_end, valid_end FROM blocks WINDOW w AS (ORDER BY block)),
fits AS (SELECT train_end, valid_end, regr_slope(close, open) AS b, regr_intercept(close, open) AS a,
                sum(open * close) / sum(open * open) AS b0
         FROM cuts JOIN train ON date <= train_end GROUP BY ALL),
scores AS (SELECT train_end, sqrt(avg((close - a - b * open) ** 2)) AS m1, sqrt(avg((close - b0 * open) ** 2)) AS m0
           FROM fits JOIN train ON date > train_end AND date <= valid_end GROUP BY 1),
choice AS (SELECT avg(m1) <= avg(m0) AS with_intercept FROM scores),
fit AS (SELECT CASE WHEN any_value(with_intercept) THEN regr_slope(close, open)
                    ELSE sum(open * close) / sum(open * open) END AS b,
               CASE WHEN any_value(with_intercept) THEN regr_intercept(close, open) ELSE 0 END AS a
        FROM train, choice),
errors AS (SELECT CASE WHEN rn <= total * 80 // 100 THEN 'train' ELSE 'test' END AS split, close AS y,
                  close - a - b * open AS e FROM ranked, fit)
SELECT split, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae,
       round(1 - sum(e * e) / (var_pop(y) * count(*)), 7) AS r2, round(avg(abs(e) / y), 7) AS mape
FROM errors GROUP BY split"""
)
def train_and_evaluate_simple(spark, sf_dir):
    """The whole course on one feature: five folds of rolling origin, then both parts measured."""
    found = tune.train_and_evaluate(
        bar_table(spark, sf_dir), tune.linear(), INTERCEPTS, target="close", num=["open"]
    )
    wide = found.metrics.groupBy("split").pivot("metric", ["rmse", "mae", "r2", "mape"]).agg(F.first("value"))
    digits = {"rmse": 3, "mae": 3, "r2": 7, "mape": 7}
    return wide.select("split", *[F.round(m, d).alias(m) for m, d in digits.items()])


@query(f"WITH {OLS} SELECT symbol, date, label, prediction, TRUE AS same FROM fitted WHERE NOT in_train")
def model_roundtrip(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    model, path = tune.linear().fit(train), fresh_path(spark, "model")
    serve.save_model(model, path)
    loaded = serve.load_model("linear", path).setPredictionCol("again")
    both = loaded.transform(model.transform(test))
    return both.select(
        "symbol",
        "date",
        "label",
        F.round("prediction", 4).alias("prediction"),
        (F.col("again") == F.col("prediction")).alias("same"),
    )


@query(
    f"""WITH {OLS}
SELECT symbol, date, label, prediction, 'linear' AS model FROM fitted WHERE NOT in_train
ORDER BY rn LIMIT 30"""
)
def backtest_predictions(spark, sf_dir):
    train, test = chrono_split(bar_table(spark, sf_dir))
    model = tune.linear().fit(serve.labelled(train, serve.BAR_FEATURES))
    found = serve.backtest(test, model, serve.horizon_days("30 days"), name="linear").predictions
    return found.withColumn("prediction", F.round("prediction", 4))


@query(
    f"""WITH {OLS},
days AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS no FROM fitted WHERE NOT in_train),
head AS (SELECT label, prediction FROM days WHERE no <= 14)
SELECT 'linear' AS model, 'rmse' AS metric, round(sqrt(avg((label - prediction) ** 2)), 2) AS value FROM head
UNION ALL SELECT 'linear', 'mse', round(avg((label - prediction) ** 2) / 1e6, 2) FROM head
UNION ALL SELECT 'linear', 'mae', round(avg(abs(label - prediction)), 2) FROM head
UNION ALL SELECT 'linear', 'mape', round(avg(abs(label - prediction) / label), 6) FROM head
UNION ALL SELECT 'linear', 'r2', round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) FROM head"""
)
def backtest_metrics_by_symbol_horizon(spark, sf_dir):
    train, test = chrono_split(bar_table(spark, sf_dir))
    model = tune.linear().fit(serve.labelled(train, serve.BAR_FEATURES))
    found = serve.backtest(
        test, model, serve.horizon_days("14 days"), per_series=True, name="linear"
    ).metrics
    value = F.when(F.col("metric").isin("r2", "mape"), F.round("value", 6)).otherwise(
        F.round(F.when(F.col("metric") == "mse", F.col("value") / 1e6).otherwise(F.col("value")), 2)
    )
    return found.withColumn("value", value)


@query(
    f"""WITH {BARS}, {RANKED},
moved AS (SELECT symbol, date, rn, total, close, lag(open) OVER (PARTITION BY symbol ORDER BY date) AS x
          FROM ranked),
rows AS (SELECT *, row_number() OVER (ORDER BY rn) AS no, count(*) OVER () AS n FROM moved WHERE x IS NOT NULL),
fit AS (SELECT regr_slope(close, x) AS b, regr_intercept(close, x) AS a FROM rows WHERE no <= n * 80 // 100)
SELECT symbol, date, close AS label, round(a + b * x, 4) AS prediction FROM rows, fit
WHERE no > n * 80 // 100"""
)
def lead_day_forecast(spark, sf_dir):
    """Tomorrow's close from today's open."""
    rows = stage(serve.with_lead(bar_table(spark, sf_dir), 1, ["open"]), "lead")
    train, test = chrono_split(rows)
    model = tune.linear().fit(serve.labelled(train, ["open"]))
    return _plain(model.transform(serve.labelled(test, ["open"])))


TINY, STEPS = Sizes(hidden=(2, 2, 2), dense=2), 3
SCALED = f"""{BARS}, {RANKED},
edge AS (SELECT min(close) AS lo, max(close) AS hi FROM ranked WHERE rn <= total * 80 // 100),
scaled AS (SELECT symbol, date, close, lo, hi, rn > total * 80 // 100 AS held_out,
                  rn > total * 80 // 100 * 80 // 100 AS valid,
                  (close - lo) / (hi - lo) AS v FROM ranked, edge),
steps AS (SELECT * FROM (
  SELECT *, {', '.join(f'lag(v, {STEPS - t}) OVER w AS x{t}' for t in range(STEPS))}
  FROM scaled WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE x0 IS NOT NULL)"""
NETWORK = f"{SCALED}, {network_sql(TINY, TINY.initial(), STEPS, 'steps')}"


@query(
    f"""WITH {NETWORK}
SELECT symbol, date, close AS label, round(network_output * (hi - lo) + lo, 4) AS prediction, held_out
FROM network"""
)
def seq_score(spark, sf_dir):
    """Saved and loaded weights over every window, in double precision for the comparison."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), STEPS)
    path = fresh_path(spark, "weights")
    sequence.save_weights(sequence.Weights(TINY, TINY.initial()), spark, path)
    weights = serve.load_model("sequence", path)
    found = sequence.predictions(prepared.samples, prepared.scaler, weights, "float64")
    return found.withColumns({c: F.round(c, 4) for c in ("label", "prediction")})


@query(
    f"""WITH {NETWORK}
SELECT 1 AS epoch, round(avg((network_output - v) ** 2) FILTER (WHERE NOT valid), 9) AS train_loss,
       round(avg((network_output - v) ** 2) FILTER (WHERE valid), 9) AS valid_loss
FROM network WHERE NOT held_out"""
)
def seq_first_loss(spark, sf_dir):
    """One full-batch epoch: its losses are those of the start weights."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), STEPS)
    losses = sequence.fit(prepared.samples, TINY, epochs=1).losses
    return losses.withColumns({c: F.round(c, 9) for c in ("train_loss", "valid_loss")})


@query()
def seq_score_full_layers(spark, sf_dir):
    """Network with the full layer sizes over every window of the bars."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), 5)
    sizes = Sizes()
    weights = sequence.Weights(sizes, sizes.initial())
    return sequence.predictions(prepared.samples, prepared.scaler, weights)


@query()
def seq_train_loss(spark, sf_dir):
    prepared = sequence.prepare(bar_table(spark, sf_dir), 5)
    return sequence.fit(prepared.samples, SMALL, epochs=3, rate=0.01).losses


@query()
def seq_minibatch_loss(spark, sf_dir):
    """An epoch of four batches, each sample in one of them."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), 5)
    return sequence.fit(prepared.samples, SMALL, epochs=1, rate=0.01, batches=4).losses


@query()
def seq_hourly_predictions(spark, sf_dir):
    """The network on hourly values per event type, one epoch."""
    rows = stage(hourly(spark, sf_dir).select("symbol", "ts", "value"), "hourly")
    prepared = sequence.prepare(rows, 5, "value", line=HOURLY)
    weights = sequence.fit(prepared.samples, SMALL, epochs=1, rate=0.01, line=HOURLY).weights
    return sequence.predictions(prepared.samples, prepared.scaler, weights, line=HOURLY)


@query()
def seq_backtest(spark, sf_dir):
    """Train briefly, then the measures of the first 30 test days of each series."""
    rows = bar_table(spark, sf_dir)
    prepared = sequence.prepare(rows, 5)
    weights = sequence.fit(prepared.samples, SMALL, epochs=2, rate=0.01).weights
    test = chrono_split(rows).test
    return serve.backtest_sequence(test, prepared.scaler, weights, 5, 30).metrics


def flagship(spark, sf_dir):
    """Bars, split by time, linear fit, back-test of the first 30 test days."""
    return backtest_predictions(spark, sf_dir)
