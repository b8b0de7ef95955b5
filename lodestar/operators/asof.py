"""As-of joins in source order, as running windows: one shuffle by the group, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(df: DataFrame, group: list[str], order: list[str], is_producer: Column, value: Column, name: str) -> DataFrame:
    """Each row with the value of the latest producer before it in its group; null without one."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_producer, value), ignorenulls=True).over(w))


def later_consumers(df: DataFrame, group: list[str], order: list[str], is_producer: Column, is_consumer: Column, key: str) -> DataFrame:
    """Pairs of a producer and each consumer after it in the same group, counted without pairing rows: (group, producer, n_later)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("n_later", F.coalesce(F.sum(F.when(is_consumer, 1).otherwise(0)).over(w), F.lit(0)).cast("bigint")).where(is_producer).select(*group, F.col(key).alias("producer"), "n_later")
