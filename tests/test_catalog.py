"""Every registered query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import tables
from check import TABLES, rows_of

DATA = entry.SMOKE_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in entry.oracle_sql():
        cursor = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 30 and df.columns == ["symbol", "date", "label", "prediction", "model"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name, columns",
    [
        ("chrono_split_sizes", []),
        ("chrono_split_by_symbol", ["close"]),
        ("directional_accuracy", ["close"]),
        ("minmax_scaled", ["open", "high", "low", "volume"]),
    ],
)
def test_staged_bars_hold_what_is_read(spark, monkeypatch, name, columns):
    """Bars are nearly as many as trades: no column is aggregated, shuffled and written that nobody reads."""
    seen = []
    once = tables.stage_once

    def staged(df, label):
        seen.append(df)
        return once(df, label)

    monkeypatch.setattr(tables, "stage_once", staged)
    entry.queries()[name](spark, DATA).collect()
    assert [df.columns for df in seen] == [["symbol", "date", *columns]]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert ("markdown" in plan, "sum(" in plan) == (False, "volume" in columns)
    assert dict(seen[0].dtypes)["symbol"] == "string"


def test_sparse_trades_are_shuffled_uncombined(spark):
    """Bars of suppliers are the same, with nothing combined in front of the shuffle."""
    sparse = tables.bars(spark, DATA, "l_suppkey")
    plan = sparse._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "RepartitionByExpression" not in tables.bars(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    rows = tables.table(spark, DATA, "lineitem").selectExpr("*", "l_suppkey AS key")
    combined = tables.bars_from_trades(
        rows, F.col("key").cast("string"), "l_shipdate", "l_extendedprice", "l_quantity", tables.sequence_number(), "l_discount"
    )
    assert sorted(sparse.collect()) == sorted(combined.collect())


def test_directional_accuracy_shuffles_its_bars_once(spark):
    """The second lag finds the rows in the buckets of the first."""
    found = entry.queries()["directional_accuracy"](spark, DATA)
    found.collect()
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    wide = [a for a, b in zip(lines, lines[1:]) if "Exchange hash" in a and "partial_collect_list" in b]
    assert len(wide) == 1
