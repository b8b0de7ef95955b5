"""The queries over all pairs of nations equal brute force on a graph whose nodes have more than three successors."""

import random

import pytest
from test_operators import all_paths

from lodestar.plans import catalogue

FLAGGED = {0, 2, 4, 5, 8, 11, 13, 16, 19, 21, 24}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    out = {(rng.randrange(25), rng.randrange(25)) for _ in range(110)} | {(0, k) for k in range(5, 12)} | {(3, k) for k in range(12, 18)} | {(23, 0), (23, 2), (23, 4), (23, 5), (23, 8)}
    return sorted((a, b) for a, b in out if a != b and (a != 23 or b in FLAGGED))


@pytest.fixture(scope="module")
def folder(spark, pairs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nations"))
    for name, rows, ddl in (
        ("nation", [(k,) for k in range(25)], "n_nationkey int"),
        ("customer", [(k, k) for k in range(25)], "c_custkey int, c_nationkey int"),
        ("supplier", [(k, k) for k in range(25)], "s_suppkey int, s_nationkey int"),
        ("orders", [(k, a) for k, (a, _) in enumerate(pairs)], "o_orderkey int, o_custkey int"),
        ("lineitem", [(k, b) for k, (_, b) in enumerate(pairs)], "l_orderkey int, l_suppkey int"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    return path


def reached(pairs, start):
    """Fewest steps from the start."""
    dist, level = {start: 0}, [start]
    while level:
        level = sorted({b for a, b in pairs if a in level} - set(dist))
        dist |= dict.fromkeys(level, max(dist.values()) + 1)
    return dist


def rows(spark, folder, name):
    return {tuple(r) for r in catalogue.queries()[name](spark, folder).collect()}


def test_walks(spark, folder, pairs):
    assert rows(spark, folder, "bfs_distance") == set(reached(pairs, 0).items())
    one = {b for a, b in pairs if a == 3}
    two = {b for a, b in pairs if a in one} - one
    assert rows(spark, folder, "neighborhood_k2") == {(k, 1) for k in one} | {(k, 2) for k in two}
    tests = [reached(pairs, k) for k in (1, 7, 20)]
    assert rows(spark, folder, "reach_sets") == {(k, n) for k in range(25) if (n := sum(k in t for t in tests))}


def test_degrees(spark, folder, pairs):
    want = set()
    for k in {x for p in pairs for x in p}:
        n_in, n_out = sum(b == k for _, b in pairs), sum(a == k for a, _ in pairs)
        want.add((k, n_in, n_out, "transit" if n_in and n_out else "entry" if n_out else "endpoint"))
    assert any(r[0] % 2 and r[2] > 3 for r in want)
    assert rows(spark, folder, "degree_roles") == want


def test_paths(spark, folder, pairs):
    assert rows(spark, folder, "bounded_paths") == {(">".join(map(str, p)), len(p)) for p in all_paths(pairs, 0, 3, 6)}
    goals = {3, 11, 17}
    want = {(">".join(map(str, p)), len(p)) for g in goals for p in all_paths(pairs, 0, g, 6) if not goals & set(p[:-1])}
    assert rows(spark, folder, "paths_to_module") == want


def test_fixpoint(spark, folder, pairs):
    flagged, more = set(), set(FLAGGED)
    while more != flagged:
        flagged = more
        more = flagged | {a for a, _ in pairs if all(b in flagged for x, b in pairs if x == a)}
    assert 23 in flagged
    assert rows(spark, folder, "fixpoint_sink") == {(k, k in flagged) for k in range(25)}
