"""Resolution of names to targets by cascades of rules that each accept a unique hit only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import shuffle_partitions

BLOCK_SITES = 1000  # sites of one key that meet its targets in one block


def cascade(candidates: DataFrame, site: list[str], target: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(site, target, rule) for each site: the first rule that exactly one candidate meets decides, and no rule leaves it open.

    ``candidates`` has a row for each site and possible target (a null target for none). One aggregation on the site.
    """
    flags = []
    for k, (_, condition) in enumerate(rules):
        ok = condition & F.col(target).isNotNull()
        flags += [F.count_if(ok).alias(f"_n{k}"), F.max(F.when(ok, F.col(target))).alias(f"_t{k}")]
    found = candidates.groupBy(*site).agg(*flags)
    chosen = F.coalesce(*(F.when(F.col(f"_n{k}") == 1, F.col(f"_t{k}")) for k in range(len(rules))))
    rule = F.coalesce(*(F.when(F.col(f"_n{k}") == 1, F.lit(name)) for k, (name, _) in enumerate(rules)))
    return found.select(*site, chosen.alias("target"), F.coalesce(rule, F.lit("unresolved")).alias("rule"))


def keyed_cascade(sites: DataFrame, site: list[str], asked: Column, targets: DataFrame, target: str, offered: Column) -> DataFrame:
    """(site, target, rule) of the sites that a rule decides, where every rule is an equality.

    ``asked`` is an array of (rank, rule, key) and ``offered`` an array of a target's keys; entries with a null key don't count. A key of one
    target only answers, and of a site's answers the lowest rank decides. Targets are counted by key before the join, so that a name that
    many targets share gives one row and no product of sites and targets.
    """
    lookup = targets.select(F.col(target).alias("target"), F.explode(F.array_distinct(F.array_compact(offered))).alias("_key"))
    lookup = lookup.groupBy("_key").agg(F.count("*").alias("_n"), F.max("target").alias("target")).where("_n = 1").drop("_n")
    open_keys = sites.select(*site, F.explode(F.filter(asked, lambda a: a["key"].isNotNull())).alias("_a"))
    found = open_keys.withColumn("_key", F.col("_a.key")).join(lookup, "_key")
    best = found.groupBy(*site).agg(F.min(F.struct(F.col("_a.rank").alias("rank"), F.col("_a.rule").alias("rule"), "target")).alias("_best"))
    return best.select(*site, "_best.target", "_best.rule")


def strict_or_all(candidates: DataFrame, site: list[str], strict: Column) -> DataFrame:
    """Candidates that meet the strict condition; all of a site's if none does. ``mode`` says which."""
    hit = F.max(F.coalesce(strict, F.lit(False))).over(Window.partitionBy(*site))
    d = candidates.withColumn("_strict", F.coalesce(strict, F.lit(False))).withColumn("_any", hit)
    return d.where(F.col("_strict") | ~F.col("_any")).withColumn("mode", F.when(F.col("_any"), "strict").otherwise("fell_back")).drop("_strict", "_any")


@dataclass(frozen=True)
class Near:
    """That a site's and a target's value differ by less than a distance."""

    site_value: str
    target_value: str
    within: float

    def pair(self, site: Column, target: Column) -> Column:
        return F.abs(site - target) < self.within

    def met(self, targets: str) -> Column:
        """The structs with a ``value`` near to the site's."""
        return F.filter(targets, lambda t: self.pair(F.col(self.site_value), t["value"]))

    def cell(self, value: Column) -> Column:
        """The cell of the number line that a value lies in, of the largest power of two below the distance, so that the division is exact.

        Values of one cell are near, and near values are at most two cells apart. So of a cell's targets in order of value, a site is near
        to all, to the first few, to the last few or to none.
        """
        return F.rint(value.cast("double") / 2.0 ** (math.ceil(math.log2(self.within)) - 1)) + F.lit(0.0)  # no -0.0

    def around(self, cell: Column) -> Column:
        return F.array_distinct(F.transform(F.array(*(F.lit(float(k)) for k in range(-2, 3))), lambda k: cell + k))

    def sites(self, sites: DataFrame) -> DataFrame:
        """Sites with their cell as a string: on doubles, which Spark normalises first, a join would not take a repartition by the same columns as its own."""
        return sites.withColumn("_cell", self.cell(F.col(self.site_value)).cast("string"))

    def targets(self, targets: DataFrame) -> DataFrame:
        """Targets with their cell; those that are near to nothing are left out."""
        return targets.where(F.abs(self.target_value) < float("inf")).withColumn("_cell", self.cell(F.col(self.target_value)))

    def spread(self, by_cell: DataFrame) -> DataFrame:
        """Rows of a cell as rows of each cell around it, as a string."""
        return by_cell.withColumn("_cell", F.explode(F.transform(self.around(F.col("_cell")), lambda c: c.cast("string"))))


def _near_ends(targets: DataFrame, target: str, keys: list[str], near: Near) -> DataFrame:
    """(keys, _cell, _ends): the two lowest and the two highest targets of each cell around. One of all targets is near to a site if one of these is, and two if two are."""
    d = near.targets(targets.select(*keys, target, near.target_value))
    cell, row = [*keys, "_cell"], F.struct(F.col(near.target_value).alias("value"), F.col(target).alias("target"))
    ends = d.groupBy(*cell).agg(F.count("*").alias("_n"))
    ends = ends.select(*cell, "_n", F.lit(0).alias("_k"), F.lit(True).alias("_low"), F.lit(None).cast(d.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    for low, order in ((True, F.asc), (False, F.desc)):  # the cut is made before the shuffle too
        k = F.row_number().over(Window.partitionBy(*cell).orderBy(order(near.target_value), order(target)))
        ends = ends.unionByName(d.withColumn("_k", k).where("_k <= 2").select(*cell, F.lit(0).cast("bigint").alias("_n"), "_k", F.lit(low).alias("_low"), row.alias("_row")))
    ends = ends.groupBy(*cell).agg(F.sum("_n").alias("_n"), F.collect_list(F.when(F.col("_k") > 0, F.struct("_k", "_low", "_row"))).alias("_rows"))
    once = F.filter("_rows", lambda r: r["_low"] | (r["_k"] <= F.col("_n") - 2))  # a row of a small cell is at both ends
    ends = near.spread(ends.select(*cell, F.transform(once, lambda r: r["_row"]).alias("_ends")))
    return ends.groupBy(*cell).agg(F.flatten(F.collect_list("_ends")).alias("_ends"))


def paired_cascade(sites: DataFrame, site: list[str], targets: DataFrame, target: str, keys: list[str], rules: list[tuple[str, Near | tuple[Column, Column]]]) -> DataFrame:
    """``cascade`` over all pairs of a site and a target with equal ``keys``, without the pairs.

    A rule is a ``Near``, or a condition of sites and one of targets. For the latter targets are counted by key before the join; for
    ``Near`` each cell of values keeps the few targets that can tell one near target from none or more.
    """
    sides = [(k, *rule) for k, (_, rule) in enumerate(rules) if not isinstance(rule, Near)]
    d = sites
    if sides:
        flags = []
        for k, _, condition in sides:
            flags += [F.count_if(condition).alias(f"_n{k}"), F.max(F.when(condition, F.col(target))).alias(f"_t{k}")]
        d = d.join(targets.groupBy(*keys).agg(*flags), keys, "left")
        for k, condition, _ in sides:
            d = d.withColumn(f"_n{k}", F.when(condition, F.col(f"_n{k}"))).withColumn(f"_t{k}", F.when(condition, F.col(f"_t{k}")))
    for k, (_, rule) in enumerate(rules):
        if isinstance(rule, Near):
            d = rule.sites(d).join(_near_ends(targets, target, keys, rule), [*keys, "_cell"], "left").withColumn("_hits", rule.met("_ends"))
            d = d.withColumn(f"_n{k}", F.size("_hits")).withColumn(f"_t{k}", F.get("_hits", F.lit(0))["target"]).drop("_cell", "_ends", "_hits")
    totals = [f(f"_{c}{k}").alias(f"_{c}{k}") for k in range(len(rules)) for c, f in (("n", F.sum), ("t", F.max))]
    d = d.groupBy(*site).agg(*totals)
    answers = [F.when(F.col(f"_n{k}") == 1, F.col(f"_t{k}")) for k in range(len(rules))]
    rule = F.coalesce(*(F.when(a.isNotNull(), F.lit(name)) for a, (name, _) in zip(answers, rules, strict=True)), F.lit("unresolved"))
    return d.select(*site, F.coalesce(*answers).alias("target"), rule.alias("rule"))


def near_modes(sites: DataFrame, site: list[str], targets: DataFrame, keys: list[str], near: Near) -> DataFrame:
    """Sites with ``mode``: strict if some target with equal ``keys`` is near, else fell_back. Only each cell's lowest and highest value is compared."""
    spans = near.targets(targets.select(*keys, near.target_value)).groupBy(*keys, "_cell").agg(F.min(near.target_value).alias("low"), F.max(near.target_value).alias("high"))
    spans = near.spread(spans).groupBy(*keys, "_cell").agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    value = F.col(near.site_value)
    hit = F.coalesce(F.exists("_spans", lambda t: near.pair(value, t["low"]) | near.pair(value, t["high"])), F.lit(False))
    d = near.sites(sites).join(spans, [*keys, "_cell"], "left").withColumn("_any", F.max(hit).over(Window.partitionBy(*site)))
    return d.withColumn("mode", F.when(F.col("_any"), "strict").otherwise("fell_back")).select(*sites.columns, "mode")


def _block_join(sites: DataFrame, site: list[str], targets: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal columns where a hot key's sites are dealt into blocks, each of which meets all of the key's targets: no task has all pairs of a key."""
    n = shuffle_partitions(sites.sparkSession)
    blocks = sites.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK_SITES).alias("_blocks"))
    left = sites.join(blocks, on, "left").withColumn("_block", F.pmod(F.xxhash64(*site), F.coalesce("_blocks", F.lit(1)))).drop("_blocks")
    right = targets.join(blocks, on).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    # both sides by number and merged: few small rows may give many, so that neither their size nor a broadcast says how to deal them
    return left.repartition(n, *on, "_block").join(right.repartition(n, *on, "_block").hint("merge"), [*on, "_block"], how)


def near_or_all(sites: DataFrame, site: list[str], targets: DataFrame, keys: list[str], near: Near) -> DataFrame:
    """``strict_or_all`` over all pairs of a site and a target with equal ``keys``: the near targets of each site, or all if none is.

    Near targets are sought in the cells around a site's only, so that the pairs compared grow as those that come out.
    """
    d = near_modes(sites, site, targets, keys, near)
    strict = near.sites(d.where("mode = 'strict'")).where(F.abs(near.site_value) < float("inf"))
    strict = _block_join(strict, site, near.spread(near.targets(targets)), [*keys, "_cell"], "inner").where(near.pair(F.col(near.site_value), F.col(near.target_value)))
    rest = _block_join(d.where("mode = 'fell_back'"), site, targets, keys, "left")
    return strict.drop("_cell", "_block").unionByName(rest.drop("_block"))


def mode_shares(df: DataFrame, mode: str) -> DataFrame:
    """(mode, n, percent) with whole percents."""
    counts = df.groupBy(mode).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(mode, "n", F.expr("n * 100 div total").alias("percent"))  # one row


def first_edge(sites: DataFrame, src: str, dst: str, order: list[str]) -> DataFrame:
    """The first site, in source order, of each pair."""
    return sites.groupBy(src, dst).agg(F.min(F.struct(*order)).alias("_first")).select(src, dst, *(F.col(f"_first.{c}").alias(c) for c in order))
