"""Ordered behaviour: carry-forward, stopping, budgets, nearest ends, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str]) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def in_section(df: DataFrame, opens: Column, closes: Column, name: str, partition: list[str], order: list[str]) -> DataFrame:
    """Whether the last marker so far opened a section."""
    return carry_forward(df, F.when(opens, True).when(closes, False), name, partition, order).withColumn(name, F.coalesce(name, F.lit(False)))


def until_first(df: DataFrame, flag: Column, partition: list[str], order: list[str], inclusive: bool = True) -> DataFrame:
    """Rows up to the first flagged one."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if inclusive else 0)
    return df.withColumn("stopped", F.coalesce(F.max(F.when(flag, 1).otherwise(0)).over(w), F.lit(0))).where("stopped = 0").drop("stopped")


def within_budget(df: DataFrame, cost: Column, limit: float, partition: list[str], order: list[str]) -> DataFrame:
    """Rows while the running cost is at most the limit."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= limit)


def best(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """The first row of each partition in an order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where("place = 1").drop("place")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in the order of their first position."""
    return df.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)
