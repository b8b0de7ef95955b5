"""Ranked fuzzy lookup over any table with a name column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.similarity import effective_threshold, name_score


def ranked(df: DataFrame, name_col: str, terms: list[str], threshold: float = 0.85) -> DataFrame:
    """Rows whose name matches some term at the threshold, with ``score``, the best over the terms."""
    t = effective_threshold(terms, threshold)
    scores = [name_score(F.lit(term), F.col(name_col), t) for term in terms]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return df.withColumn("score", best).where(F.col("score").isNotNull())


def exact_suppresses(df: DataFrame, relation_col: str | None = None) -> DataFrame:
    """Where a relation has a hit of score 1, its other hits go."""
    if relation_col:  # one row for each relation is joined
        best = df.groupBy(relation_col).agg(F.max("score").alias("_best"))
        kept = df.join(best, relation_col)
    else:
        kept = df.withColumn("_best", df.agg(F.max("score")).scalar())
    return kept.where((F.col("_best") < 1.0) | (F.col("score") == 1.0)).select(*df.columns)


def ranked_tiers(df: DataFrame, key_cols: list[str], tiers: list[tuple[str, str]], terms: list[str], threshold: float = 0.85) -> DataFrame:
    """Hits by name, then by signature, then by path: ``tiers`` are (match kind, column) in order, and a row counts for its first.

    Each row is scored against every tier in one scan, so nothing is shuffled.
    """
    t = effective_threshold(terms, threshold)
    score, kind = F.lit(None).cast("double"), F.lit(None).cast("string")
    for tag, col in reversed(tiers):
        scores = [name_score(F.lit(term), F.col(col), t) for term in terms]
        best = scores[0] if len(scores) == 1 else F.greatest(*scores)
        score, kind = F.coalesce(best, score), F.when(best.isNotNull(), F.lit(tag)).otherwise(kind)
    return df.withColumn("score", score).withColumn("match_kind", kind).where(F.col("score").isNotNull()).select(*key_cols, "score", "match_kind")


def did_you_mean(df: DataFrame, name_col: str, term: str, threshold: float, least: float = 0.5, limit: int = 5) -> DataFrame:
    """The distinct names most like a term that missed: similarity from ``least`` up to the threshold, best first, then by name."""
    from lodestar.functions.similarity import fuzzy_similarity

    names = df.select(F.col(name_col).alias("name")).distinct()
    found = names.withColumn("similarity", fuzzy_similarity(F.lit(term), F.col("name"))).where((F.col("similarity") >= least) & (F.col("similarity") < threshold))
    return found.orderBy(F.desc("similarity"), "name").limit(limit)


def relaxed(df: DataFrame, name_col: str, terms: list[str], threshold: float = 0.85, fallback: float = 0.7, limit: int = 5) -> DataFrame:
    """Hits at the threshold; without any, for a term of four characters or more, the best few at the lower one."""
    hits = ranked(df, name_col, terms, threshold)
    if threshold == 0.85 and all(len(t) >= 4 for t in terms) and hits.isEmpty():
        return ranked(df, name_col, terms, fallback).orderBy(F.desc("score"), name_col).limit(limit)
    return hits
