"""Prefix scans of functions: state machines as window plans, in as many rounds as the longest run has binary digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounds_for(rows: DataFrame, keys: list[str]) -> int:
    """Doublings that reach over the longest run."""
    longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    return (longest - 1).bit_length()


def prefix_composed(rows: DataFrame, keys: list[str], order: list[str], column: str, compose: Callable[[Column, Column], Column], rounds: int) -> DataFrame:
    """Replaces each row's function by that of all rows up to it. compose(f, g): first f, then g.

    Each round joins a row's function, of 2^k rows, with that of the 2^k rows before: all on one partitioning and order.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    for k in range(rounds):
        rows = rows.withColumn("_before", F.lag(column, 1 << k).over(window))
        rows = rows.withColumn(column, F.when(F.col("_before").isNull(), F.col(column)).otherwise(compose(F.col("_before"), F.col(column)))).drop("_before")
    return rows
