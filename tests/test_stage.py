import os
import subprocess
import sys
import time

import pytest
from helpers import make_bars
from pyspark.sql import functions as F

from tsreg.functions.network import Sizes
from tsreg.plans import sequence, serve, trees, tune
from tsreg.sources.stage import discard, fresh_path, stage, stage_once, staged, work_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def folders(spark):
    fresh_path(spark, "none")
    return set(os.listdir(f"{work_dir(spark)}/tsreg".removeprefix("file:")))


@pytest.fixture(scope="module")
def bars(spark):
    rows = make_bars(spark, {"a": range(120), "b": range(100)})
    return rows.withColumns({"open": F.col("close") + 1, "high": F.col("close") + 2, "low": F.col("close") - 2})


def test_a_block_deletes_its_table(spark):
    before = folders(spark)
    with staged(spark.range(10), "outer") as outer:
        with pytest.raises(ZeroDivisionError), staged(spark.range(5), "inner") as inner:
            assert inner.count() == 5 and len(folders(spark) - before) == 2
            raise ZeroDivisionError
        assert outer.count() == 10 and len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_a_write_that_fails_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(Exception, match="RAISED"), staged(spark.range(3).select(F.raise_error(F.lit("RAISED"))), "x"):
        pass
    assert folders(spark) == before


def test_only_staged_tables_are_discarded(spark, tmp_path):
    with pytest.raises(ValueError):
        discard(spark, str(tmp_path))
    assert tmp_path.exists()
    discard(spark, fresh_path(spark, "never-written"))


def test_equal_plans_are_written_once(spark, tmp_path):
    source = str(tmp_path / "rows")
    spark.range(100).write.parquet(source)

    def plan(least):
        return spark.read.parquet(source).filter(F.col("id") >= least).select((F.col("id") * 2).alias("n"))

    before = folders(spark)
    first = stage_once(plan(10), "once")
    assert stage_once(plan(10), "once") is first
    assert len(folders(spark) - before) == 1
    assert stage_once(plan(11), "once").count() == 89 and first.count() == 90
    assert stage_once(plan(10).withColumnRenamed("n", "m"), "once").columns == ["m"]
    # other files under the same path are another table
    spark.range(50).write.mode("overwrite").parquet(source)
    assert stage_once(plan(10), "once").count() == 40
    # a table that is gone is written again
    (path,) = {os.path.dirname(f) for f in stage_once(plan(10), "once").inputFiles()}
    discard(spark, path.replace("file://", "file:") if work_dir(spark).startswith("file:/") else path)
    assert stage_once(plan(10), "once").count() == 40


def test_searches_and_training_leave_no_table(spark, bars):
    rows = stage(serve.labelled(bars.dropna(), ["open", "high", "low", "volume"]), "bars")
    model = tune.linear()
    grid = tune.param_maps(model, {"regParam": [0.0, 0.5]})
    before = folders(spark)
    early = F.col("date") < F.lit("2020-03-01")
    tried = tune.grid_search(rows.filter(early), rows.filter(~early), model, grid)
    tried = tune.cross_validate(rows, model, grid, folds=2)
    tried = tune.rolling_origin(rows, model, grid, folds=2)
    assert tried.trials.count() == 4 and tried.model.transform(rows).count() == rows.count()
    trees.flatten(tune.tree(maxDepth=2).fit(rows), spark)
    prepared = sequence.prepare(bars.select("symbol", "date", "close"), length=3)
    sizes = Sizes(hidden=(3, 3, 3), dense=2)
    assert sequence.fit(prepared.samples, sizes, epochs=1).losses.count() == 1
    assert sequence.fit_by_rounds(prepared.samples, sizes, epochs=2, per_round=1).losses.count() == 2
    assert folders(spark) == before


def test_the_application_leaves_nothing(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tsreg.sources.stage import stage
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
print(stage(spark.range(7), "left").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "7", done.stderr[-2000:]
    for _ in range(100):  # the JVM outlives the process a little
        if not list(tmp_path.glob("*/tsreg")):
            break
        time.sleep(0.1)
    assert not list(tmp_path.glob("*/tsreg"))
