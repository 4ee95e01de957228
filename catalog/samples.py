"""Queries on windows, scalers, encoders, horizons, joins of predictions, and measures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.tables import (
    BARS,
    RANKED,
    SUPPLIER_BARS,
    bar_table,
    bars,
    lag_sql,
    predictions_by_lag,
    query,
    supplier_bars,
    table,
)
from tsreg.functions import features, metrics
from tsreg.functions.columns import after, up_to
from tsreg.operators import ordering, relations, timeline
from tsreg.plans import sequence, serve
from tsreg.plans.serve import BAR_FEATURES
from tsreg.sources.stage import fresh_path

LENGTH = 30


def _shown(samples, length: int = LENGTH, *others: str, unit: int = 100):
    """A sample by its first, middle and last value, and a sum over all values, in whole units, that
    weighs each by its place."""
    x = F.col("x")
    weighed = F.transform(x, lambda v, k: F.round(v * unit).cast("bigint") * (k + 1))
    return samples.select(
        "symbol",
        "date",
        "i",
        F.size(x).cast("bigint").alias("x_size"),
        x[0].alias("x_first"),
        x[length // 2].alias("x_middle"),
        x[length - 1].alias("x_last"),
        F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("x_check"),
        "y",
        *others,
    )


def _samples_sql(
    length: int = LENGTH, where: str = "", value: str = "close", source: str = "bars", unit: int = 100
) -> str:
    return f"""
windows AS (
  SELECT symbol, date, {value} AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) - {length} AS i,
         count(*) OVER (PARTITION BY symbol) - {length} AS n_samples,
         list({value}) OVER (PARTITION BY symbol ORDER BY date
                             ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING) AS x
  FROM {source}),
samples AS (
  SELECT symbol, date, i, len(x)::BIGINT AS x_size, x[1] AS x_first, x[{length // 2 + 1}] AS x_middle,
         x[{length}] AS x_last,
         list_sum(list_transform(x, lambda v, k: CAST(round(v * {unit}) AS BIGINT) * k))::BIGINT AS x_check, y
  FROM windows WHERE len(x) = {length} {where})"""


@query(f"WITH {SUPPLIER_BARS}, {_samples_sql()} SELECT * FROM samples")
def sequence_samples(spark, sf_dir):
    return _shown(timeline.sequence_samples(supplier_bars(spark, sf_dir, ["close"]), "close", LENGTH))


@query(f"WITH {SUPPLIER_BARS}, {_samples_sql(where='AND i < n_samples')} SELECT * FROM samples")
def sequence_samples_trimmed(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, ["close"])
    return _shown(timeline.sequence_samples(rows, "close", LENGTH, drop_last=True))


@query(
    f"""WITH {SUPPLIER_BARS}, {_samples_sql(1, 'AND i < n_samples AND i <= 14')} SELECT * FROM samples"""
)
def sequence_samples_capped(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, ["close"])
    return _shown(timeline.sequence_samples(rows, "close", 1, drop_last=True, cap=14), 1)


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED},
edge AS (SELECT min(close) AS lo, max(close) AS hi FROM ranked WHERE rn <= total * 80 // 100),
scaled AS (
  SELECT symbol, date, (close - lo) / (hi - lo) AS scaled, rn > total * 80 // 100 AS held_out
  FROM ranked, edge),
{_samples_sql(5, value='scaled', source='scaled', unit=1_000_000)}
SELECT s.symbol, s.date, s.i, s.x_size, round(s.x_first, 9) AS x_first, round(s.x_middle, 9) AS x_middle,
       round(s.x_last, 9) AS x_last, s.x_check, round(s.y, 9) AS y, c.held_out
FROM samples s JOIN scaled c USING (symbol, date)"""
)
def sequence_samples_scaled(spark, sf_dir):
    samples = sequence.prepare(supplier_bars(spark, sf_dir, ["close"]), 5).samples
    rounded = {c: F.round(c, 9) for c in ("x_first", "x_middle", "x_last", "y")}
    return _shown(samples, 5, "held_out", unit=1_000_000).withColumns(rounded)


@query(
    f"""WITH {SUPPLIER_BARS}
SELECT symbol, date, close, volume, {', '.join(
    f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY date) AS {c}_lag_{k}"
    for c in ('close', 'volume') for k in (1, 2, 5))} FROM bars"""
)
def lag_features(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, ["close", "volume"])
    return timeline.add_lags(rows, ["close", "volume"], [1, 2, 5])


@query(
    f"WITH {SUPPLIER_BARS} SELECT symbol, date, open AS f1, high AS f2, low AS f3, volume::DOUBLE AS f4 FROM bars"
)
def assembled_features(spark, sf_dir):
    vectors = features.assembled(bars(spark, sf_dir, "l_suppkey"), BAR_FEATURES)
    parts = [F.col("features_array")[i].alias(f"f{i + 1}") for i in range(4)]
    return vectors.select("symbol", "date", *parts)


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED},
edge AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in BAR_FEATURES)}
         FROM ranked WHERE rn <= total * 80 // 100)
SELECT symbol, date, {', '.join(
    f'round(({c} - {c}_lo) / ({c}_hi - {c}_lo), 9) AS {c}_scaled' for c in BAR_FEATURES)}
FROM ranked, edge"""
)
def minmax_scaled(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, BAR_FEATURES)
    fitted = features.fit_scaler(ordering.chrono_split(rows).train, BAR_FEATURES, "minmax")
    names = [f"{c}_scaled" for c in BAR_FEATURES]
    found = features.scaled_columns(fitted, rows, names)
    return found.select("symbol", "date", *[F.round(n, 9).alias(n) for n in names])


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED},
edge AS (SELECT min(close) AS lo, max(close) AS hi FROM ranked WHERE rn <= total * 80 // 100)
SELECT symbol, date, round((close - lo) / (hi - lo), 9) AS scaled_close, round(close, 6) AS restored
FROM ranked, edge WHERE rn > total * 80 // 100"""
)
def scaler_roundtrip(spark, sf_dir):
    """A saved and loaded scaler on the test part, there and back."""
    train, test = ordering.chrono_split(supplier_bars(spark, sf_dir, ["close"]))
    path = fresh_path(spark, "scaler")
    serve.save_model(features.fit_scaler(train, ["close"], "minmax"), path)
    loaded = serve.load_model("pipeline", path)
    scaled = features.scaled_columns(loaded, test, ["scaled_close"])
    restored = features.inverse_scaled(loaded, scaled, "scaled_close", "restored")
    return restored.select(
        "symbol", "date", F.round("scaled_close", 9).alias("scaled_close"), F.round("restored", 6).alias("restored")
    )


@query(f"WITH {SUPPLIER_BARS} SELECT symbol, date, close, round(close, 6) AS restored FROM bars")
def minmax_inverse(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, ["close"])
    fitted = features.fit_scaler(ordering.chrono_split(rows).train, ["close"], "minmax")
    scaled = features.scaled_columns(fitted, rows, ["scaled_close"])
    restored = features.inverse_scaled(fitted, scaled, "scaled_close", "restored")
    return restored.select("symbol", "date", "close", F.round("restored", 6).alias("restored"))


@query(
    f"""WITH {SUPPLIER_BARS},
edge AS (SELECT {', '.join(f'stddev_samp({c}) AS {c}_sd' for c in BAR_FEATURES)} FROM bars)
SELECT symbol, date, {', '.join(f'round({c} / {c}_sd, 6) AS {c}_scaled' for c in BAR_FEATURES)}
FROM bars, edge"""
)
def standard_scaled(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir, BAR_FEATURES)
    fitted = features.fit_scaler(rows, BAR_FEATURES, "standard")
    names = [f"{c}_scaled" for c in BAR_FEATURES]
    found = features.scaled_columns(fitted, rows, names)
    return found.select("symbol", "date", *[F.round(n, 6).alias(n) for n in names])


INDEX_SQL = """
levels AS (
  SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS no
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


@query(
    f"""WITH {INDEX_SQL}
SELECT o_orderkey, o_orderpriority,
       coalesce(no, (SELECT count(*) FROM levels))::DOUBLE AS priority_index
FROM orders LEFT JOIN levels USING (o_orderpriority)"""
)
def string_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    train = orders.filter(F.col("o_orderstatus") != "P")
    return features.string_index(train, orders, "o_orderpriority", "priority_index").drop("o_orderstatus")


@query(
    """WITH levels AS (
  SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, CAST(p_size AS VARCHAR)) - 1 AS no
  FROM part WHERE p_retailprice < 1500 GROUP BY 1)
SELECT p_partkey, p_size, coalesce(no, (SELECT count(*) FROM levels))::DOUBLE AS size_index
FROM part LEFT JOIN levels USING (p_size)"""
)
def string_index_numeric(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    train = parts.filter("p_retailprice < 1500")
    return features.string_index(train, parts, "p_size", "size_index").drop("p_retailprice")


@query(
    f"""WITH {INDEX_SQL}
SELECT o_orderkey, o_orderpriority, {', '.join(f'(no = {i})::INT::DOUBLE AS slot_{i}' for i in range(5))}
FROM orders LEFT JOIN levels USING (o_orderpriority)"""
)
def one_hot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    train = orders.filter(F.col("o_orderstatus") != "P")
    found = features.one_hot(train, orders, "o_orderpriority", "slots")
    slots = vector_to_array("slots")
    return found.select("o_orderkey", "o_orderpriority", *[slots[i].alias(f"slot_{i}") for i in range(5)])


@query(f"WITH {SUPPLIER_BARS} SELECT symbol, date, close FROM bars ORDER BY date, symbol LIMIT 30")
def top_n_days(spark, sf_dir):
    return ordering.horizon(bars(spark, sf_dir, "l_suppkey").select("symbol", "date", "close"), 30)


@query(
    f"""WITH {SUPPLIER_BARS} SELECT symbol, date, close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) <= 14"""
)
def top_n_days_per_symbol(spark, sf_dir):
    rows = bars(spark, sf_dir, "l_suppkey").select("symbol", "date", "close")
    return ordering.horizon_series(rows, 14)


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED}
SELECT symbol, date, close AS label, open AS f1, high AS f2, low AS f3, volume::DOUBLE AS f4
FROM ranked WHERE rn > total * 80 // 100 ORDER BY date, symbol LIMIT 30"""
)
def horizon_features(spark, sf_dir):
    test = ordering.chrono_split(supplier_bars(spark, sf_dir)).test
    x = vector_to_array("features")
    return serve.horizon_features(test, 30).select(
        "symbol", "date", "label", *[x[i].alias(f"f{i + 1}") for i in range(4)]
    )


def _predicted(spark, sf_dir):
    """Previous-close predictions for the first 30 test days of each series."""
    history = bar_table(spark, sf_dir)
    _, test = ordering.chrono_split(history)
    days = ordering.horizon_series(test.select("symbol", "date"), 30)
    return history, predictions_by_lag(history, 1).join(days, ["symbol", "date"], "left_semi")


PREDICTED = f"""{BARS}, {RANKED}, {lag_sql(1, name='lagged')},
predicted AS (
  SELECT l.* FROM lagged l JOIN (
    SELECT symbol, date FROM ranked WHERE rn > total * 80 // 100
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) <= 30) USING (symbol, date))"""


@query(f"WITH {PREDICTED} SELECT b.* FROM bars b SEMI JOIN predicted p USING (symbol, date)")
def semi_filter(spark, sf_dir):
    return relations.only_predicted(*_predicted(spark, sf_dir))


@query(
    f"""WITH {PREDICTED}
SELECT symbol, date, b.open, b.high, b.low, b.volume, p.prediction AS close_prediction
FROM bars b JOIN predicted p USING (symbol, date)"""
)
def prediction_join(spark, sf_dir):
    history, predicted = _predicted(spark, sf_dir)
    inputs = history.select("symbol", "date", "open", "high", "low", "volume")
    return relations.prediction_join(inputs, predicted)


@query(
    f"""WITH {SUPPLIER_BARS}, {lag_sql(1)}
SELECT b.symbol, b.date, b.close, m.n_matches, m.min_prediction, m.max_prediction
FROM bars b JOIN (
  SELECT label, count(*) AS n_matches, min(prediction) AS min_prediction, max(prediction) AS max_prediction
  FROM predicted GROUP BY label) m ON b.close = m.label"""
)
def value_equijoin(spark, sf_dir):
    history = supplier_bars(spark, sf_dir, ["close"])
    predicted = predictions_by_lag(history, 1)
    return relations.match_on_value(history, predicted, "close", "label", "prediction")


@query(
    f"""WITH {PREDICTED}
SELECT symbol, date, b.close, p.prediction FROM bars b JOIN predicted p USING (symbol, date)"""
)
def actual_vs_predicted(spark, sf_dir):
    return relations.actual_vs_predicted(*_predicted(spark, sf_dir))


@query(
    f"""WITH {PREDICTED}
SELECT symbol, date, b.close, p.prediction FROM bars b LEFT JOIN predicted p USING (symbol, date)"""
)
def history_with_predictions(spark, sf_dir):
    return relations.history_with_predictions(*_predicted(spark, sf_dir))


@query(
    f"""WITH {PREDICTED}, joined AS (
  SELECT symbol, date, b.close, p.prediction FROM bars b LEFT JOIN predicted p USING (symbol, date))
SELECT symbol, date, 'close' AS series, close AS value FROM joined
UNION ALL SELECT symbol, date, 'prediction', prediction FROM joined WHERE prediction IS NOT NULL"""
)
def overlay_long(spark, sf_dir):
    return relations.overlay_long(relations.history_with_predictions(*_predicted(spark, sf_dir)))


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED}, {lag_sql(1)}
SELECT symbol, date, r.close,
       CASE WHEN r.rn <= r.total * 80 // 100 THEN p.prediction END AS train_prediction,
       CASE WHEN r.rn > r.total * 80 // 100 THEN p.prediction END AS test_prediction
FROM ranked r LEFT JOIN predicted p USING (symbol, date)"""
)
def prediction_overlay(spark, sf_dir):
    history = supplier_bars(spark, sf_dir, ["close"])
    cut = ordering.time_cut(history)
    predicted = predictions_by_lag(history, 1)
    return relations.overlay(
        history,
        predicted.filter(up_to(ordering.TIME_ORDER, cut)),
        predicted.filter(after(ordering.TIME_ORDER, cut)),
    )


METRICS_SQL = """count(*) AS n, round(avg((label - prediction) ** 2), 0) AS mse,
round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse, round(avg(abs(label - prediction)), 6) AS mae,
round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 8) AS r2,
round(avg(CASE WHEN label <> 0 THEN abs(label - prediction) / abs(label) END), 8) AS mape,
count_if(label = 0)::BIGINT AS n_zero_label"""


def _rounded(found):
    digits = {"mse": 0, "rmse": 6, "mae": 6, "r2": 8, "mape": 8}
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"WITH {SUPPLIER_BARS}, {lag_sql(1)} SELECT {METRICS_SQL} FROM predicted")
def regression_metrics(spark, sf_dir):
    predicted = predictions_by_lag(supplier_bars(spark, sf_dir, ["close"]), 1)
    return _rounded(metrics.regression_metrics(predicted))


# no mse here: whole cents over few rows often end in .5, where both engines may round apart
@query(
    f"""WITH {SUPPLIER_BARS}, {lag_sql(1)}
SELECT * EXCLUDE (mse) FROM (SELECT symbol, {METRICS_SQL} FROM predicted GROUP BY symbol)"""
)
def regression_metrics_by_symbol(spark, sf_dir):
    predicted = predictions_by_lag(supplier_bars(spark, sf_dir, ["close"]), 1)
    return _rounded(metrics.regression_metrics(predicted, by=["symbol"])).drop("mse")


@query(
    f"""WITH {SUPPLIER_BARS}, {lag_sql(2)},
moves AS (
  SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY date) AS previous FROM predicted)
SELECT count(*) AS n,
       round(avg((sign(prediction - previous) = sign(label - previous))::INT), 8) AS directional_accuracy
FROM moves WHERE previous IS NOT NULL"""
)
def directional_accuracy(spark, sf_dir):
    predicted = predictions_by_lag(supplier_bars(spark, sf_dir, ["close"]), 2, keep_bucket=True)
    found = metrics.directional_accuracy(predicted, bucketed=True)
    return found.withColumn("directional_accuracy", F.round("directional_accuracy", 8))
