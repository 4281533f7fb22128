"""Column helpers that decide how often an expression is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f(value), with the value computed once a row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def not_null(df: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """The rows (key, value) whose value isn't null; the value is computed once, not once more to filter by it."""
    return df.select(*key, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))
