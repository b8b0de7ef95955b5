"""Interval joins. An equality on a key (a file) makes each a hash join with a residual condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _inside(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, how: str) -> DataFrame:
    p, s = points.alias("p"), spans.alias("s")
    on = (F.col(f"p.{point}") >= F.col(f"s.{start}")) & (F.col(f"p.{point}") <= F.col(f"s.{end}"))
    for k in keys:
        on &= F.col(f"p.{k}") == F.col(f"s.{k}")
    return p.join(s, on, how).select("p.*", *(F.col(f"s.{c}").alias(f"span_{c}") for c in spans.columns))


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], point: str, start: str, end: str, tie: list[str]) -> DataFrame:
    """Each point with the span around it that starts last (then the first by ``tie``); without one, nulls."""
    found = _inside(points, spans, keys, point, start, end, "left")
    w = Window.partitionBy(*point_id).orderBy(F.col(f"span_{start}").desc_nulls_last(), *(F.col(f"span_{t}") for t in tie))
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def narrowest_unique(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], point: str, start: str, end: str) -> DataFrame:
    """Points with the narrowest span around them, where only one is that narrow."""
    found = _inside(points, spans, keys, point, start, end, "inner").withColumn("_size", F.expr(f"span_{end} - span_{start}"))
    w = Window.partitionBy(*point_id)
    found = found.withColumn("_least", F.min("_size").over(w)).where("_size = _least").withColumn("_n", F.count("*").over(w))
    return found.where("_n = 1").drop("_size", "_least", "_n")


def overlapping(spans: DataFrame, ranges: DataFrame, start: str, end: str, range_start: str, range_end: str, keys: list[str] = ()) -> DataFrame:
    """Spans that overlap some range: a semi-join."""
    a, b = spans.alias("a"), ranges.alias("b")
    on = (F.col(f"a.{start}") <= F.col(f"b.{range_end}")) & (F.col(f"b.{range_start}") <= F.col(f"a.{end}"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, on, "left_semi")
