import random

import pytest
from pyspark.sql import functions as F

from tsreg.operators import profile as pf


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [
        (
            rng.gauss(0, 5),
            7.0 if rng.random() < 0.4 else float(rng.randint(0, 20)),
            None if rng.random() < 0.2 else rng.randint(-3, 3),
            "x",
            2.5,
        )
        for _ in range(3000)
    ]
    return spark.createDataFrame(rows, "a double, hot double, k int, s string, flat double").repartition(3).cache()


@pytest.mark.parametrize("exact_rows", [1, 200, 10**6])
def test_percentiles_are_exact(table, exact_rows):
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    cols = ["a", "hot", "k", "flat"]
    want = table.agg(*[F.percentile(c, shares).alias(c) for c in cols]).first()
    got = {(r["column"], r["share"]): r["value"] for r in pf.percentiles(table, cols, shares, exact_rows).collect()}
    for c in cols:
        for share, value in zip(shares, want[c]):
            assert got[c, share] == pytest.approx(value, abs=1e-9), (c, share)


def test_bad_sketch_guesses_do_not_matter(table, monkeypatch):
    monkeypatch.setattr(pf, "SLACK", 0.0)
    monkeypatch.setattr(pf, "SKETCH_ACCURACY", 20)
    want = table.agg(F.percentile("a", [0.25, 0.5, 0.75])).first()[0]
    got = sorted(r["value"] for r in pf.percentiles(table, ["a"], exact_rows=300).collect())
    assert got == pytest.approx(want)


def test_one_sketch_serves_moments_and_proposals(table, monkeypatch):
    scans = []
    for name in ("_first_scan", "_proposed", "_ranged"):
        monkeypatch.setattr(pf, name, lambda *args, _name=name, _run=getattr(pf, name): scans.append(_name) or _run(*args))
    monkeypatch.setattr(pf, "EXACT_ROWS", 600)
    monkeypatch.setattr(pf, "SLACK", 0.01)  # guesses off the ranks, so that their piece is looked up
    got = {r["column"]: r for r in pf.summary(table, ["a", "hot"]).collect()}
    want = table.agg(*[F.percentile(c, list(pf.QUARTILES)).alias(c) for c in ("a", "hot")]).first()
    assert [[got[c][n] for n in pf.QUARTILE_NAMES] for c in ("a", "hot")] == [pytest.approx(list(q)) for q in want]
    assert scans == ["_first_scan", "_ranged", "_ranged"]


def test_summary_matches_spark(table):
    got = {r["column"]: r for r in pf.summary(table).collect()}
    want = {r["summary"]: r for r in table.describe("a", "hot", "k").collect()}
    for c in ("a", "hot", "k"):
        assert got[c]["n"] == int(want["count"][c])
        for mine, theirs in (("mean", "mean"), ("stddev", "stddev"), ("min", "min"), ("max", "max")):
            assert got[c][mine] == pytest.approx(float(want[theirs][c]))
    assert got["flat"]["p50"] == 2.5 and got["flat"]["stddev"] == 0
    rough = {r["column"]: r for r in pf.summary(table, approx=True).collect()}
    assert rough["a"]["p50"] == pytest.approx(got["a"]["p50"], abs=0.05)


def test_shape_nulls_correlation_bounds(table):
    assert table_row(pf.table_shape(table)) == (3000, 5)
    nulls = pf.null_counts(table).first().asDict()
    assert nulls["k"] == table.filter("k is null").count() and nulls["a"] == 0
    got = {r["column"]: r["correlation"] for r in pf.target_correlations(table, "a", ["hot", "k"]).collect()}
    assert got["hot"] == pytest.approx(table.stat.corr("a", "hot"))
    low, high = table_row(pf.bounds(table, "hot"))
    assert (low, high) == (0.0, 20.0)
    assert [tuple(r) for r in pf.schema_table(table).collect()][2] == ("k", "int", True)


def test_empty_table(table):
    empty = table.limit(0)
    assert pf.percentiles(empty, ["a"]).count() == 0
    rows = pf.summary(empty, ["a"]).collect()
    assert rows[0]["n"] == 0 and rows[0]["mean"] is None


def table_row(df):
    return tuple(df.first())
