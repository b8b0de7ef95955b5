"""Base counts against brute force, and the divergence verdicts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestar.llm import quality_rules as Q


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for k, v in enumerate(windows):
        if n[v] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, odd_docs):
    rng = random.Random(2)
    parts = ["a", "b", "the", "\n", " ", " ", "\t", "é😀", "#", "|x", "<>", "\r\n", "a b c d e", "\x0b", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    rows = Q.judge(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    for d in docs.collect():
        r, want = by[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d.text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_no_words_run_plan_has_no_python(spark, odd_docs):
    plan = Q.counts(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_jensen_shannon_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(0.5 * sum(a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + 0.5 * sum(b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b))
    got = spark.range(1).select(Q.jensen_shannon(F.array(*map(F.lit, p)), q).alias("d")).first().d
    assert abs(got - want) < 1e-12


def test_diverging_documents_go_and_short_or_clean_ones_stay(spark):
    rng = random.Random(5)
    words = "the of and to in is that it was for house garden river stone cloud winter summer morning letter bread window".split()
    clean = [(k, " ".join(rng.choice(words) for _ in range(80)), "en") for k in range(40)]
    junk = [(900, " | ".join(f"zq{k}" for k in range(90)), "en"), (901, " ".join(f"X{k}Z!!" for k in range(90)).upper(), "en")]
    short = [(902, "zq1 zq2 zq3 zq4 zq5 zq6 zq7 zq8 zq9 zqa zqb zqc", None)]
    kept = {r.doc_id for r in Q.judge(spark.createDataFrame(clean + junk + short, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == {k for k, *_ in clean} | {902}


def test_every_language_has_a_reference(spark):
    text = " ".join(["the house and garden of stone is in winter"] * 30)
    docs = [(k, f"{text} {'more ' * (70 - k)}", f"l{k}") for k in range(66)]
    found = spark.createDataFrame([(k, lang, len(t.split()), [1] * (len(Q.CLASSES) + 2), [1] * (len(Q.COMMON) + 1)) for k, t, lang in docs], "doc_id long, lang string, n_words long, classes array<long>, common array<long>")
    assert sorted(name for name, *_ in Q.references(found)) == sorted(lang for *_, lang in docs)


def test_empty_table_and_no_languages(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    r = Q.judge(spark.createDataFrame([(1, "a b c d e f g h i j k", None)], "doc_id long, text string, lang string")).first()
    assert r.kept and r.nearest_language is None
