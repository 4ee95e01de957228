"""Column-level helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_FEATURES = ("symbol", "date", "close", "adj_close")


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks as underscores (``Adj Close`` → ``adj_close``)."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def feature_columns(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns of ``df`` outside ``exclude``, in schema order."""
    skipped = set(exclude)
    return [
        field.name
        for field in df.schema.fields
        if field.name not in skipped and isinstance(field.dataType, T.NumericType)
    ]


def parse_date(text: str | Column) -> Column:
    """Date of an ISO text, null where it does not parse."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("date")


def label_and_features(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Keys, feature columns and the target under the name ``label``."""
    return df.select("symbol", "date", *features, F.col(label).alias("label"))


def minmax_inverse(
    scaled: str | Column, lowest: float, highest: float, smin: float = 0.0, smax: float = 1.0
) -> Column:
    """Back to the original unit of a column scaled from [lowest, highest] to [smin, smax]."""
    value = F.col(scaled) if isinstance(scaled, str) else scaled
    share = (value - F.lit(float(smin))) / F.lit(float(smax - smin))
    return share * F.lit(float(highest - lowest)) + F.lit(float(lowest))


def key_literals(df: DataFrame, order: Sequence[str], key: Sequence[object]) -> list[Column]:
    """Literals of a collected key, in the types of its columns."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return [
        F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
        if isinstance(kinds[name], T.TimestampNTZType)
        else F.lit(value)
        for name, value in zip(order, key)
    ]


# The comparisons below follow the ascending lexicographic order of the columns ``order``. They are
# spelled out on plain columns and literals, so they reach the parquet scan as pushed filters.


def before(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Whether a row stands before ``key``."""
    name, value = order[0], key[0]
    if len(order) == 1:
        return F.col(name) < value
    return (F.col(name) < value) | ((F.col(name) == value) & before(order[1:], key[1:]))


def up_to(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Whether a row stands before ``key`` or on it."""
    name, value = order[0], key[0]
    if len(order) == 1:
        return F.col(name) <= value
    return (F.col(name) < value) | ((F.col(name) == value) & up_to(order[1:], key[1:]))


def after(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Whether a row stands behind ``key``."""
    name, value = order[0], key[0]
    if len(order) == 1:
        return F.col(name) > value
    return (F.col(name) > value) | ((F.col(name) == value) & after(order[1:], key[1:]))


def on_key(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Whether a row has exactly ``key``."""
    matched = F.col(order[0]) == key[0]
    for name, value in zip(order[1:], key[1:]):
        matched = matched & (F.col(name) == value)
    return matched
