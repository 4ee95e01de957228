"""Queries on training at full size: category stages, sums of products, truncated trees, batches, rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import NETWORK, STEPS, TINY
from catalog.tables import BARS, RANKED, SUPPLIER_BARS, bar_table, bucket_sql, query, supplier_bars
from tsreg.functions.features import build_pipeline
from tsreg.functions.network import Sizes
from tsreg.operators.ordering import chrono_split, minibatches
from tsreg.plans import gram, sequence, serve, trees, tune
from tsreg.sources.stage import fresh_path

RIDGE = {"regParam": tune.LINEAR_GRID["regParam"], "elasticNetParam": [0.0]}
FEATURES = serve.BAR_FEATURES


def _ridge_sql(source: str) -> str:
    """CTEs from ``source`` (fold, features, close) to ``lines``: each fold's ridge fits on the others.

    The penalised normal equations in scaled units, solved by elimination, one pivot a step.
    """
    size = range(len(FEATURES))
    sums = [f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(FEATURES)]
    cells = [
        f"covar_pop({x}, {z}) / (stddev_pop({x}) * stddev_pop({z}))"
        + (f" + reg / stddev_pop(close) AS a{i}_{j}" if i == j else f" AS a{i}_{j}")
        for i, x in enumerate(FEATURES)
        for j, z in enumerate(FEATURES)
    ]
    cells += [f"covar_pop({x}, close) / (stddev_pop({x}) * stddev_pop(close)) AS a{i}_{len(FEATURES)}" for i, x in enumerate(FEATURES)]
    ctes = [
        f"""system0 AS (SELECT f.fold, trial, reg, avg(close) AS my, stddev_pop(close) AS sy,
        {', '.join(sums + cells)} FROM (SELECT DISTINCT fold FROM {source}) f
        JOIN {source} t ON t.fold <> f.fold, regs GROUP BY f.fold, trial, reg)"""
    ]
    kept = "fold, trial, reg, my, sy, " + ", ".join(f"m{i}, s{i}" for i in size)
    columns = [*size, len(FEATURES)]
    for k in size:
        new = [
            f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i != k else f"a{i}_{j}"
            for i in size
            for j in columns
        ]
        ctes.append(f"system{k + 1} AS (SELECT {kept}, {', '.join(new)} FROM system{k})")
    last = len(FEATURES)
    betas = [f"a{i}_{last} / a{i}_{i} * sy / s{i} AS b{i}" for i in size]
    ctes.append(f"slopes AS (SELECT {kept}, {', '.join(betas)} FROM system{last})")
    line = " - ".join(["my", *(f"b{i} * m{i}" for i in size)])
    ctes.append(f"lines AS (SELECT *, {line} AS a FROM slopes)")
    return ",\n".join(ctes)


ERROR = "close - a - " + " - ".join(f"b{i} * {x}" for i, x in enumerate(FEATURES))


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED},
train AS (SELECT *, {bucket_sql(["date", "symbol"], 42, 3)} AS fold FROM ranked WHERE rn <= total * 80 // 100),
regs AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1::DOUBLE), (2, 1::DOUBLE)) r(trial, reg)),
{_ridge_sql("train")},
scores AS (SELECT trial, reg, fold, sqrt(avg(({ERROR}) ** 2)) AS m FROM lines JOIN train USING (fold) GROUP BY ALL),
means AS (SELECT trial, any_value(reg) AS reg, avg(m) AS m, stddev_samp(m) AS d FROM scores GROUP BY trial)
SELECT trial, CAST(reg AS DOUBLE) AS reg_param, round(m, 3) AS avg_metric, round(d, 3) AS std_metric,
       row_number() OVER (ORDER BY m, trial) = 1 AS chosen FROM means"""
)
def cv_ridge_points(spark, sf_dir):
    """Parameters, means and choice of a grid over three folds of all suppliers' bars: one scan."""
    train = serve.labelled(chrono_split(supplier_bars(spark, sf_dir, [*FEATURES, "close"])).train, FEATURES)
    grid = tune.param_maps(tune.linear(), RIDGE)
    found = tune.mean_metrics(gram.cross_validate(train, len(FEATURES), grid, folds=3))
    return found.select(
        "trial",
        F.col("params")["regParam"].cast("double").alias("reg_param"),
        *[F.round(m, 3).alias(m) for m in ("avg_metric", "std_metric")],
        "chosen",
    )


@query(
    f"""WITH {SUPPLIER_BARS},
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
SELECT 0 AS trial, fold::INT AS fold, 'True' AS intercept, round(sqrt(avg(e * e)), 3) AS rmse FROM scored GROUP BY fold
UNION ALL SELECT 1, fold::INT, 'False', round(sqrt(avg(e0 * e0)), 3) FROM scored GROUP BY fold"""
)
def rolling_origin_sums(spark, sf_dir):
    """Every origin's fits from running sums over the blocks of days."""
    rows = serve.labelled(supplier_bars(spark, sf_dir, ["open", "close"]), ["open"])
    grid = tune.param_maps(tune.linear(), {"fitIntercept": [True, False]})
    found = gram.rolling_origin(rows, 1, grid, folds=3)
    return found.select(
        "trial", "fold", F.col("params")["fitIntercept"].alias("intercept"), F.round("metric", 3).alias("rmse")
    )


@query(
    f"""WITH {SUPPLIER_BARS}, {RANKED},
means AS (SELECT symbol, avg(open) AS mx, avg(close) AS my FROM ranked WHERE rn <= total * 80 // 100 GROUP BY symbol),
slope AS (SELECT sum((open - mx) * (close - my)) / sum((open - mx) * (open - mx)) AS b
          FROM ranked JOIN means USING (symbol) WHERE rn <= total * 80 // 100)
SELECT symbol, date, close AS label, round(my + b * (open - mx), 3) AS prediction
FROM ranked JOIN means USING (symbol), slope WHERE rn > total * 80 // 100"""
)
def pipeline_within_suppliers(spark, sf_dir):
    """A regression inside each supplier's series, through a pipeline that was saved and loaded."""
    train, test = chrono_split(supplier_bars(spark, sf_dir, ["open", "close"]))
    pipeline = build_pipeline(tune.linear(fitIntercept=False), "close", num=["open"], cat=["symbol"])
    path = fresh_path(spark, "pipeline")
    serve.save_model(pipeline.fit(train), path)
    scored = serve.load_model("pipeline", path).transform(test)
    return scored.select("symbol", "date", F.col("close").alias("label"), F.round("prediction", 3).alias("prediction"))


@query()
def tree_cv_grid(spark, sf_dir):
    """All 81 points on five folds from 45 fits: parameters, means and choice."""
    train = serve.labelled(chrono_split(bar_table(spark, sf_dir)).train, FEATURES)
    return tune.mean_metrics(trees.cross_validate(train, tune.TREE_GRID, folds=5))


def _dealt_sql(epoch: int, rows: int) -> str:
    draw = f"md5(CAST(date AS VARCHAR) || '|' || symbol || '|42|{epoch}')"
    return f"""SELECT symbol, date, {epoch} AS epoch, (row_number() OVER w - 1) // {rows} AS batch,
       (row_number() OVER w - 1) % {rows} AS place
FROM bars WINDOW w AS (ORDER BY {draw}, date, symbol)"""


@query(f"WITH {SUPPLIER_BARS} {_dealt_sql(1, 16)} UNION ALL {_dealt_sql(2, 32)}")
def seq_minibatches(spark, sf_dir):
    """Two epochs of batches, of 16 and of 32 rows: each row is in one batch of an epoch."""
    rows = supplier_bars(spark, sf_dir, [])
    dealt = [
        minibatches(rows, ("date", "symbol"), size, epoch).withColumn("epoch", F.lit(epoch))
        for epoch, size in ((1, 16), (2, 32))
    ]
    return dealt[0].unionByName(dealt[1])


def _gradient_sql() -> str:
    """Sums of the two dense layers' gradients over the training rows of ``network``."""
    w = TINY.unpack(TINY.initial())
    state = [f"h{len(TINY.hidden)}_{STEPS - 1}_{j}" for j in range(TINY.hidden[-1])]
    out = "2 * (network_output - v)"
    back = [f"{out} * ({float(w['fc2', 'weight'][0][r])!r}::DOUBLE) * (d{r} > 0)::INT" for r in range(TINY.dense)]
    cells = [("fc1", "weight", r * len(state) + k, f"{back[r]} * {h}") for r in range(TINY.dense) for k, h in enumerate(state)]
    cells += [("fc1", "bias", r, back[r]) for r in range(TINY.dense)]
    cells += [("fc2", "weight", r, f"{out} * d{r}") for r in range(TINY.dense)] + [("fc2", "bias", 0, out)]
    return " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{name}' AS name, {place} AS place, round(sum({value}), 6) AS value FROM rows_"
        for layer, name, place, value in cells
    )


@query(f"WITH {NETWORK}, rows_ AS (SELECT * FROM network WHERE NOT held_out AND NOT valid) {_gradient_sql()}")
def seq_dense_gradient(spark, sf_dir):
    """One gradient of the network with its start weights: the parts of the two dense layers."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), STEPS)
    found = sequence.gradient(prepared.samples, sequence.Weights(TINY, TINY.initial()))
    return found.filter("layer LIKE 'fc%'").withColumn("value", F.round("value", 6))


@query()
def seq_train_full(spark, sf_dir):
    """The full layers, 200 epochs of batches of 32 at lookback 1, in rounds of ten epochs."""
    prepared = sequence.prepare(bar_table(spark, sf_dir), 1)
    return sequence.fit_by_rounds(prepared.samples, Sizes(), epochs=200, batch_rows=32).losses
