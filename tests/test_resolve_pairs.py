"""The resolvers that make no pairs give what all pairs give, and examine few."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import resolve
from lodestar.plans import catalogue

NAN, INF = float("nan"), float("inf")


def accounts(seed, sites, targets):
    """Values on and beside the distances, repeated, far, empty or no number; keys empty or without targets; a site twice."""
    rng = random.Random(seed)

    def value():
        odd = [None, NAN, INF, -INF, 1e300, -0.0, 0.0, 50.0, 149.99999999999997, 150.0, 550.0, -450.0, 549.9999999999999, 2.0**62, 2.0**62 + 1024]
        return rng.choice(odd) if rng.random() < 0.3 else round(rng.uniform(-9000, 9000), 2) if rng.random() < 0.6 else rng.randrange(-40, 40) * 25.0

    key = lambda n: rng.choice([None, *range(n)])
    a = [(rng.randrange(sites), key(9), value()) for _ in range(sites)] + [(sites, 7, 100.0), (None, 1, 3.0)]
    return a, [(k, key(7), value()) for k in range(targets)] + [(targets + k, 2, 10.0) for k in range(9)]


def frames(spark, a, b):
    return spark.createDataFrame(a, "site long, k int, x double"), spark.createDataFrame(b, "target long, k int, y double")


def all_pairs(a, b):
    b = b.withColumnRenamed("k", "k2")
    return a.join(b, a["k"] == b["k2"], "left")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_the_cascade_without_pairs(spark, seed):
    a, b = frames(spark, *accounts(seed, 120, 60))
    near, both, rich = resolve.Near("x", "y", 100), (F.col("x") < 0, F.col("y").between(-9000, -7500)), (F.lit(True), F.col("y").between(8000, 9000))
    got = resolve.paired_cascade(a, ["site"], b, "target", ["k"], [("near", near), ("both", both), ("rich", rich)])
    rules = [("near", F.abs(F.col("x") - F.col("y")) < 100), ("both", both[0] & both[1]), ("rich", rich[1])]
    want = rows(resolve.cascade(all_pairs(a, b), ["site"], "target", rules))
    assert rows(got) == want and {r[2] for r in want} >= {"near", "unresolved"} and {r[2] for r in want} & {"both", "rich"}


@pytest.mark.parametrize("within", [500, 512, 100])
def test_near_or_all(spark, within, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_SITES", 7)
    a, b = frames(spark, *accounts(within, 120, 60))
    got = resolve.near_or_all(a, ["site"], b, ["k"], resolve.Near("x", "y", within)).select("site", "target", "mode")
    want = rows(resolve.strict_or_all(all_pairs(a, b), ["site"], F.abs(F.col("x") - F.col("y")) < within).select("site", "target", "mode"))
    assert rows(got) == want and {r[2] for r in want} == {"strict", "fell_back"}
    modes = rows(resolve.near_modes(a, ["site"], b, ["k"], resolve.Near("x", "y", within)).select("site", "mode").distinct())
    assert modes == Counter({r[::2] for r in want})


@pytest.mark.parametrize("name", ["strict_vs_loose", "resolve_cascade", "resolution_stats"])
def test_no_node_makes_all_pairs(spark, name, tmp_path):
    n, m = 600, 400
    spark.createDataFrame([(k, 3, k * 10.0) for k in range(n)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 3, k * 15.0) for k in range(m)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    df.collect()
    tree = [df._jdf.queryExecution().executedPlan()]
    most = 0
    while tree:
        p = tree.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            tree.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            tree.append(p.plan())
        found = p.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        tree += [p.children().apply(k) for k in range(p.children().size())]
    assert 0 < most < n * m / 4
