"""Name similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuzzy_similarity(query: Column, name: Column) -> Column:
    """1 if one string is part of the name, else 1 - edits / longer byte length; case is ignored. Two empty strings give 1."""
    q, n = F.lower(query), F.lower(name)
    longest = F.greatest(F.octet_length(q), F.octet_length(n))
    return F.when(F.contains(n, q), F.lit(1.0)).otherwise(1.0 - F.levenshtein(q, n) / longest)


def name_score(query: Column, name: Column, threshold: float) -> Column:
    """Tiers: exact 1, prefix from 0.95, substring from 0.85, else the edit similarity; null below the threshold."""
    q, n = F.lower(query), F.lower(name)
    part = F.octet_length(q) / F.octet_length(n)
    score = (
        F.when(q == n, F.lit(1.0))
        .when(F.startswith(n, q), 0.95 + 0.05 * part)
        .when(F.contains(n, q), 0.85 + 0.05 * part)
        .otherwise(fuzzy_similarity(query, name))
    )
    return F.when(score >= threshold, score)


def effective_threshold(terms: list[str], threshold: float) -> float:
    """A single term of at most three bytes must match exactly."""
    return max(1.0, threshold) if len(terms) == 1 and len(terms[0].encode()) <= 3 else threshold
