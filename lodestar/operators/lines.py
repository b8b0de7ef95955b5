"""Text search by lines, attributed to spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import checked_pattern, lines


def explode_lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line, text), lines from 1."""
    return df.select(key, F.posexplode(lines(F.col(text_col))).alias("_at", "text")).select(key, (F.col("_at") + 1).alias("line"), "text")


def grep(source_lines: DataFrame, pattern: str, ignore_case: bool = False, fixed: bool = False, ascii_words: bool = False) -> DataFrame:
    """One row for each line that has a match."""
    return source_lines.where(F.rlike("text", F.lit(checked_pattern(pattern, ignore_case, fixed, ascii_words))))


def with_context(df: DataFrame, key: str, text_col: str, hit: Callable[[Column], Column], before: int, after: int) -> DataFrame:
    """(key, line, at, text): each line that meets ``hit``, with its neighbours, clipped to the text.

    Hits are found inside the array of a text's lines and take their neighbours with them, so the context needs no self-join and no copy
    of the array goes out with a line.
    """
    d = df.select(key, lines(F.col(text_col)).alias("_lines"))
    places = F.filter(F.transform("_lines", lambda x, k: F.when(hit(x), k)), lambda k: k.isNotNull())
    first = lambda k: F.greatest(F.lit(0), k - before)
    around = F.transform(places, lambda k: F.struct((k + 1).alias("line"), first(k).alias("first"), F.slice("_lines", first(k) + 1, F.lit(after + 1) + k - first(k)).alias("texts")))
    d = d.select(key, F.explode(around).alias("_h"))
    return d.select(key, "_h.line", F.col("_h.first").alias("_first"), F.posexplode("_h.texts").alias("_k", "text")).select(key, "line", (F.col("_first") + F.col("_k") + 1).alias("at"), "text")


def slice_lines(df: DataFrame, key: str, text_col: str, first: int, last: int) -> DataFrame:
    """(key, first_line, last_line, text) of the asked lines that a text has; texts that end before are left out."""
    all_lines = lines(F.col(text_col))
    last_line = F.least(F.lit(last), F.size(all_lines))
    d = df.where(F.size(all_lines) >= first)
    return d.select(key, F.lit(first).alias("first_line"), last_line.alias("last_line"), F.array_join(F.slice(all_lines, F.lit(first), last_line - first + 1), "\n").alias("text"))
