"""Small hand-made series and brute-force counterparts."""

import datetime as dt
import random

DAY0 = dt.date(2020, 1, 1)


def make_bars(spark, series, seed=1, null_share=0.0):
    """``series``: name -> list of day offsets. Prices are random, closes sometimes null."""
    rng = random.Random(seed)
    rows = []
    for name, offsets in series.items():
        for day in offsets:
            close = None if rng.random() < null_share else round(rng.uniform(10, 99), 2)
            rows.append((name, DAY0 + dt.timedelta(days=day), close, rng.randint(1, 1000)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume bigint").repartition(3)


def uneven_series(seed=3):
    rng = random.Random(seed)
    return {
        "dense": list(range(300)),
        "gappy": sorted(rng.sample(range(3000), 90)),
        "short": [5, 6, 900],
        "one": [40],
    }


def by_series(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r["symbol"], r["date"])):
        out.setdefault(row["symbol"], []).append(row)
    return out
