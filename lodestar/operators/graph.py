"""Graph walks as loops of frontier joins; each level is written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialise


def bfs(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", max_depth: int | None = None, mark: list[str] = ()) -> DataFrame:
    """(node, dist, marks): fewest steps from the seeds, which have ``node`` and the ``mark`` columns; walks of different marks are separate."""
    mark = list(mark)
    keys = ["node", *mark]
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("_next")).distinct()
    frontier = materialise(seeds.select(*keys).distinct().withColumn("dist", F.lit(0)), "frontier")
    visited, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, "node").select(F.col("_next").alias("node"), *mark).distinct()
        frontier = materialise(reached.join(visited, keys, "left_anti").withColumn("dist", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def neighbourhood(edges: DataFrame, root: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, dist) of what is 1 to ``depth`` steps away; the root itself if a cycle leads back to it. Depths are small, so the joins are unrolled."""
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("_next")).distinct()
    level, out = root.select("node"), None
    for k in range(1, depth + 1):
        level = level.join(step, "node").select(F.col("_next").alias("node")).distinct()
        part = level.withColumn("dist", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.min("dist").alias("dist"))


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_nodes: int = 8, limit: int | None = 10, max_expansions: int | None = 100_000) -> tuple[DataFrame, dict]:
    """((path, length) shortest first, then by node ids; {search_truncated, expansions}) of simple paths from sources to targets.

    A path ends at the first target after its start. Nodes that can't reach a target in the steps left are pruned by their
    distance to the targets, found by a backward walk. The budget counts the states put in line; one that a level exceeds stops the search.
    """
    step = edges.select("src", "dst").distinct()
    dist = materialise(bfs(step, targets.select("node"), src="dst", dst="src", max_depth=max_nodes - 1).select("node", F.col("dist").alias("left")), "dist")
    goal = targets.select(F.col("node"), F.lit(True).alias("goal")).distinct()
    level = sources.select("node").distinct().join(dist, "node").where(F.col("left") + 1 <= max_nodes).select(F.col("node"), F.array("node").alias("path"))
    level = materialise(level, "paths")
    expansions, found, n, truncated = level.count(), None, 1, False
    while n < max_nodes:
        if max_expansions is not None and expansions > max_expansions:
            truncated = True
            break
        n += 1
        nxt = level.join(step, level["node"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        nxt = materialise(nxt.join(dist, "node").where(F.col("left") + n <= max_nodes).join(goal, "node", "left").select("node", "path", F.coalesce("goal", F.lit(False)).alias("goal")), "paths")
        count = nxt.count()
        if not count:
            break
        expansions += count
        done = nxt.where("goal").select("path", F.lit(n).alias("length"))
        found = done if found is None else found.unionByName(done)
        level = nxt.where("NOT goal").select("node", "path")
    if found is None:
        found = level.select("path", F.lit(1).alias("length")).limit(0)
    ordered = found.orderBy("length", "path")
    return (ordered.limit(limit) if limit is not None else ordered), {"search_truncated": truncated, "expansions": min(expansions, max_expansions or expansions)}


def fixpoint(edges: DataFrame, flagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes flagged, or all of whose successors (one at least) are: repeated until nothing changes. (node, flagged)."""
    step = edges.select("src", "dst").distinct()
    now = materialise(flagged.select("node").distinct(), "flags")
    count = now.count()
    while True:
        state = step.join(now.withColumn("ok", F.lit(1)), step["dst"] == F.col("node"), "left").groupBy("src").agg(F.count("*").alias("n"), F.count("ok").alias("k"))
        new = materialise(now.unionByName(state.where("n = k").select(F.col("src").alias("node"))).distinct(), "flags")
        more = new.count()
        now = new
        if more == count:
            break
        count = more
    return nodes.select("node").distinct().join(now.withColumn("f", F.lit(True)), "node", "left").select("node", F.coalesce("f", F.lit(False)).alias("flagged"))


def reachable_tests(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, n_tests): how many of the tests reach a node, themselves included."""
    return bfs(edges, tests.select("node", F.col("node").alias("root")), mark=["root"]).groupBy("node").agg(F.count("*").alias("n_tests"))
