"""Properties of the graph and resolver operators."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, resolve, rollup


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    return sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(34)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src int, dst int")


def all_paths(edges, start, goal, most):
    out, todo = [], [[start]]
    while todo:
        p = todo.pop()
        for a, b in edges:
            if a == p[-1] and b not in p and len(p) < most:
                (out if b == goal else todo).append([*p, b])
    return sorted(out, key=lambda p: (len(p), p))


def test_paths_are_all_simple_paths_shortest_first(spark, edges):
    node = lambda k: spark.createDataFrame([(k,)], "node int")
    for goal in (3, 7, 11):
        found, info = graph.paths(frame(spark, edges), node(0), node(goal), max_nodes=5, limit=None)
        assert [r.path for r in found.collect()] == all_paths(edges, 0, goal, 5)
        assert not info["search_truncated"]


def test_distance_is_the_length_of_a_shortest_path(spark, edges):
    got = {r.node: r.dist for r in graph.bfs(frame(spark, edges), spark.createDataFrame([(0,)], "node int")).collect()}
    for goal in range(1, 14):
        paths = all_paths(edges, 0, goal, 14)
        assert got.get(goal) == (len(paths[0]) - 1 if paths else None)


def test_a_budget_truncates(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 2)], "src int, dst int")
    node = lambda k: spark.createDataFrame([(k,)], "node int")
    found, info = graph.paths(e, node(0), node(2), max_expansions=0)
    assert info["search_truncated"] and not found.collect()


def test_the_resolver_gives_at_most_one_target(spark):
    rows = [(1, 10, True, True), (1, 11, True, False), (2, 12, False, False), (3, 13, True, True), (3, 13, True, True), (4, None, True, True)]
    d = spark.createDataFrame(rows, "site int, target int, loose boolean, tight boolean")
    got = {r.site: (r.target, r.rule) for r in resolve.cascade(d, ["site"], "target", [("tight", F.col("tight")), ("loose", F.col("loose"))]).collect()}
    assert got == {1: (10, "tight"), 2: (None, "unresolved"), 3: (None, "unresolved"), 4: (None, "unresolved")}


def test_caps_do_not_change_totals(spark):
    d = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    assert rollup.budget_cap([d.where("g = 1"), d.where("g = 2")], ["k"], 20).count() == 20
    assert rollup.top_per_group(d, ["g"], ["k"], 3).count() == 21 and d.count() == 100
