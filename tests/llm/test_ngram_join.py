"""PartEnum join against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from lodestar.llm import ngram_join as J
from lodestar.operators.components import connected_components

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.55:
            w = list(rng.choice(docs)[1].split())
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            if w and rng.random() < 0.3:
                w = w[: rng.randint(max(1, int(len(w) * 0.8)), len(w))]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 14, 40, 90, 300]))]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return docs


def test_classes_equal_brute_force(spark):
    docs = corpus(3, 260) + [(1000, None), (1001, "  \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_large_runs_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    docs = corpus(5, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_left_out_pairs_are_compared_if_the_first_pass_has_none_to_try(spark, monkeypatch):
    runs = J._runs

    def one_run(batches):  # all share one run, so only its smallest member has been compared with the others
        names = ["doc_id", "n", "digest_a", "digest_b", "sketch", "run", "members"]
        for batch in runs(batches):
            yield batch.filter(pa.array([r is None for r in batch.column(5).to_pylist()], pa.bool_()))
        none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([1]), pa.array([[0, 1, 2]], pa.list_(pa.int64()))], names)

    monkeypatch.setattr(J, "_runs", one_run)
    monkeypatch.setattr(J, "FIRST_PAIRS", 0)
    words = [f"w{k}" for k in range(100)]
    far = [f"x{k}" if k in (10, 30, 50, 70) else w for k, w in enumerate(words)]
    docs = [(0, " ".join(far)), (1, " ".join(words)), (2, " ".join([*words[:-1], "end"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[2][1] == 1


def test_hot_pivots_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "SLICE", 16)
    docs = corpus(6, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_rows_that_share_an_id_are_compared_each(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    a, b = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (7, a + " tail"), (8, b + " tail"), (8, b + " tail"), (9, "alone"), (None, a), (6, None)]
    expected = [(5, 56, 5), (5, 56, 5), (6, 0, 6), (7, 57, 5), (8, 57, 5), (8, 57, 5), (9, 1, 9), (None, 56, None)]
    for kind, name in (("long", lambda x: x), ("string", lambda x: None if x is None else f"d{x}")):
        docs = spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = sorted(map(str, (tuple(r) for r in J.link_classes(docs).collect())))
        assert got == sorted(map(str, [(name(i), n, name(c)) for i, n, c in expected]))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [1, 4, 5, 6, 7, 9, 12, 20, 50, 133, 400]:
        for _ in range(40):
            a = np.sort(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            for drop in range(0, n // 5 + 1, max(1, n // 15)):
                b = np.sort(np.r_[a[drop:], rng.integers(0, 2**63, max(0, drop // 3), dtype=np.int64).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if 5 * both >= 4 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(J.all_signatures(a), J.all_signatures(b))), (n, drop)
                    assert J.may_link(len(a), len(b), J.sketch_difference(J.sketch(a), J.sketch(b)))


def test_empty_table_and_odd_rows(spark, odd_docs):
    assert J.link_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = J.link_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 1 and by[2].n_shingles == 0 and by[2].component_id == 2 and by[4].n_shingles == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_sets_are_made_of_the_documents_of_pairs_only(spark, monkeypatch):
    keep, kept = J.Scratch.keep, []

    def counted(self, df, name):
        stored = keep(self, df, name)
        if name == "sets":
            kept.append({r.doc_id for r in stored.select("doc_id").collect()})
        return stored

    monkeypatch.setattr(J.Scratch, "keep", counted)
    rng = random.Random(8)
    docs = corpus(7, 120)
    base = [f"v{k}" for k in range(60)]
    for i in range(200, 240):  # two thirds in common: some signatures are shared, no pair may link
        docs.append((i, " ".join(base[:44] + [f"u{rng.randrange(10**6)}" for _ in range(16)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert len(set().union(*kept) & set(range(200, 240))) < 4  # false hits of the filter
