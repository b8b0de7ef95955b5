"""Roll-ups, capped rankings and set operations over any relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_counts(df: DataFrame, key: str, kind: str, kinds: list[str], every: DataFrame | None = None) -> DataFrame:
    """A row for each key with a count for each kind; keys of ``every`` without rows have zeros."""
    found = df.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))
    if every is not None:
        found = every.select(key).distinct().join(found, key, "left").fillna(0)
    return found


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; the cut is made before the shuffle too."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def budget_cap(sections: list[DataFrame], order: list, cap: int) -> DataFrame:
    """Rows of sections in turn until the shared budget is spent: each section gets what those before it left."""
    rows = None
    for k, s in enumerate(sections):
        s = s.withColumn("section", F.lit(k)).orderBy(*order).limit(cap)
        rows = s if rows is None else rows.unionByName(s)
    return rows.orderBy("section", *order).limit(cap)


def minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def usages(callers: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Callers, and the references that no caller covers."""
    return callers.withColumn("section", F.lit("callers")).unionByName(minus(refs, callers, keys).withColumn("section", F.lit("refs")))


def alias_expand(sites: DataFrame, aliases: DataFrame, base: str, kind: str) -> DataFrame:
    """Sites, and a copy under the target's name of each whose base is an alias."""
    copies = sites.join(aliases, sites[base] == aliases["alias"]).withColumn(base, F.col("target")).withColumn(kind, F.concat(kind, F.lit("_via_alias")))
    return sites.unionByName(copies.select(*sites.columns))


def unreferenced(items: DataFrame, references: DataFrame, key: str, ref_key: str, is_test: Column) -> DataFrame:
    """Items without a reference outside tests, with their counts."""
    counts = references.groupBy(F.col(ref_key).alias(key)).agg(F.count_if(~is_test).alias("n_live"), F.count_if(is_test).alias("n_test"))
    return items.join(counts, key, "left").fillna(0, ["n_live", "n_test"]).where("n_live = 0")


def first_reason(cases: list[tuple[str, Column]]) -> Column:
    """The name of the first case that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def degree_roles(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node, n_in, n_out, role): entry, transit, endpoint or isolated."""
    ends = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    d = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    role = F.when((F.col("n_in") > 0) & (F.col("n_out") > 0), "transit").when(F.col("n_out") > 0, "entry").when(F.col("n_in") > 0, "endpoint").otherwise("isolated")
    return d.withColumn("role", role)


def shared_vocabulary(df: DataFrame, owner: str, name: str, literal: str, least: int = 2, most: int = 16) -> DataFrame:
    """Names whose declarations use one and the same set of literals: (name, vocabulary, n_declarations)."""
    # the set of each declaration is bounded: a declaration with more literals than ``most`` can't share one
    few = df.select(owner, name, literal).distinct().groupBy(owner, name).agg(F.count("*").alias("n"))
    few = few.where(F.col("n").between(least, most)).select(owner, name)
    sets = df.join(few, [owner, name]).groupBy(owner, name).agg(F.array_join(F.array_sort(F.collect_set(literal)), "|").alias("vocabulary"))
    return sets.groupBy(F.lower(name).alias("name"), "vocabulary").agg(F.count("*").alias("n_declarations")).where("n_declarations >= 2")


def region_states(regions: DataFrame, owner: str, region: list[str], executed: Column) -> DataFrame:
    """(owner, n_executed, n_regions, state): a region counts as run if any of its copies was; an owner is observed if any region was."""
    once = regions.groupBy(owner, *region).agg(F.bool_or(executed).alias("ran"))
    d = once.groupBy(owner).agg(F.count_if("ran").alias("n_executed"), F.count("*").alias("n_regions"))
    return d.withColumn("state", F.when(F.col("n_executed") > 0, "observed").otherwise("not_observed"))
