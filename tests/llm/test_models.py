"""Language ID, the additive model, language-model scores and decontamination."""

import collections
import math
import random
import re

import numpy as np
import pytest

from lodestar.llm import decontam, langid, ngram_lm, quality_gam

SYLLABLES = {"aa": ["the", "ing", "ion", "and", "er", "th"], "bb": ["sch", "der", "ung", "ein", "ich", "ß"], "cc": ["eau", "les", "que", "é", "ou", "ment"]}


def text_of(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(1)
    return [(k, text_of(lang, rng), lang) for k, lang in enumerate([*SYLLABLES] * 60)]


def test_language_accuracy_rejection_and_odd_rows(spark, languages, odd_docs):
    df = spark.createDataFrame(languages, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb", "cc"]
    rng = random.Random(9)
    test = spark.createDataFrame([(k, text_of(lang, rng), lang) for k, lang in enumerate([*SYLLABLES] * 30)], "doc_id long, text string, lang string")
    rows = langid.identify(test, model, pass_cols=("doc_id", "lang")).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    odd = langid.identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    by = {r.doc_id: r for r in odd}
    for k in (2, 3, 4, 7):
        assert by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected
    assert by[5].lang_pred in model.languages and 0 <= by[5].score <= 1


def test_language_scores_do_not_depend_on_batches(languages):
    import pyarrow as pa

    model = langid.fit([t for _, t, _ in languages], [x for *_, x in languages])
    texts = [t for _, t, _ in languages[:20]]
    raw, bounds, _ = langid.text_buffers(pa.array(texts))
    whole = model.logits(raw, bounds)
    for k, t in enumerate(texts):
        one, b, _ = langid.text_buffers(pa.array([t]))
        assert np.allclose(model.logits(one, b)[0], whole[k], atol=1e-5)


def test_untrained_language_model(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty)
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]
    assert langid.identify(empty, model).collect() == []


def test_samples_are_bounded_and_hold_the_smallest_hashes(spark):
    from lodestar.llm.sampling import stratified_ids

    rows = [(k, "a" if k % 10 else "b") for k in range(20_000)] + [(None, "a"), (5, None)] + [(k, "c") for k in range(20_000, 20_010)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = {(r.id, r.label) for r in stratified_ids(df, "id", "label", 1500).collect()}
    hashed = df.selectExpr("id", "label", "xxhash64('sample', id) AS h").where("id IS NOT NULL AND label IS NOT NULL").collect()
    want = set()
    for label in "abc":
        want |= {(r.id, r.label) for r in sorted((r for r in hashed if r.label == label), key=lambda r: r.h)[:500]}
    assert got == want and len(got) == 1010


def plain_language(model, text):
    """The definition in plain loops: the mean embedding of all runs of three and four bytes, a linear layer and a softmax."""
    clean = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    total, count = [0.0] * langid.DIMENSIONS, 0
    for size, factor, first in ((3, 2654435761, 0), (4, 2246822519, langid.BUCKETS)):
        for k in range(len(clean) - size + 1):
            if clean[k : k + 3] != [32, 32, 32]:
                key = sum(c << 8 * j for j, c in enumerate(clean[k : k + size]))
                bucket = first + ((key * factor) % 2**32 >> 32 - int(math.log2(langid.BUCKETS)))
                total = [t + float(v) for t, v in zip(total, model.vectors[bucket], strict=True)]
                count += 1
    logits = [(float(model.bias[j]) + sum(t / max(1, count) * float(model.weights[i, j]) for i, t in enumerate(total))) / model.temperature for j in range(len(model.languages))]
    e = [math.exp(x - max(logits)) for x in logits]
    return model.languages[e.index(max(e))], max(e) / sum(e)


def test_language_equals_a_plain_implementation(spark, languages):
    model = langid.train(spark.createDataFrame(languages, "doc_id long, text string, lang string"))
    rng = random.Random(4)
    texts = ["a", "Ab", "abc", "éa ß", "x  1   y", "HeLLo, wörld!"] + [text_of(rng.choice([*SYLLABLES]), rng, rng.randint(1, 30)) + rng.choice(["", " 12 -- ", "\n\n"]) for _ in range(60)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        lang, score = plain_language(model, t)
        assert abs(got[k].score - score) < 1e-4 and (got[k].lang_pred == lang or score < 0.5001), t
        assert got[k].rejected == (got[k].score < model.threshold)


def test_additive_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality_gam.fit(x[:2000], y[:2000])
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    flat = quality_gam.fit(x[:10], np.ones(10))
    assert flat.score(x).min() > 0.9 and quality_gam.fit(x[:0], y[:0]).score(x).tolist()[0] == pytest.approx(0.5, abs=0.01)


def test_quality_on_documents(spark, odd_docs):
    rng = random.Random(3)
    good = [(k, text_of("aa", rng, 60) + ".", 1) for k in range(150)]
    bad = [(1000 + k, " | ".join(text_of("bb", rng, 1) for _ in range(60)), 0) for k in range(80)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality_gam.train(docs.select("doc_id", "text"), docs.where("doc_id % 4 <> 2").select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality_gam.score(docs, model).collect()}
    assert all((got[k] >= 0.7) == (q == 1) for k, _, q in good + bad if k % 4 == 2)
    odd = quality_gam.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality_gam.score(odd_docs.limit(0), model).collect() == []


def plain_features(text):
    """The statistics of a text, each by its own definition."""
    raw = text.encode()
    share = lambda ok: sum(map(ok, raw)) / max(1, len(raw))
    kind = lambda b: "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "mark" if chr(b) in ".,;:!?'\"()-" else "white" if b in (32, 9, 10, 11, 12, 13) else "other" if b >= 128 else "symbol"
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [x.encode() for x in re.findall(r"[^\x09-\x0D]+", text)]
    n, sizes = len(words), [len(w) for w in words]
    windows = [tuple(words[k : k + 5]) for k in range(n - 4)]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    of = lambda k: share(lambda b: kind(b) == k)
    return [
        math.log1p(n), mean(sizes), math.sqrt(mean([(x - mean(sizes)) ** 2 for x in sizes])), math.log1p(max(sizes, default=0)),
        of("symbol"), of("upper"), of("digit"), of("mark"), of("other"), of("white"),
        len(set(words)) / n if n else 0, sum(x == y for x, y in zip(words, words[1:])) / n if n else 0, 1 - len(set(windows)) / len(windows) if windows else 0,
        math.log1p(len(lines)), math.log1p(mean([len(x) for x in lines])), 1 - len(set(lines)) / len(lines) if lines else 0,
        sum(x == 1 for x in sizes) / n if n else 0, sum(65 <= w[0] <= 90 for w in words) / n if n else 0, raw.count(b"|") / max(1, n), raw.count(b".") / max(1, n),
    ]


def test_quality_equals_a_plain_implementation(spark):
    rng = random.Random(5)
    parts = ["the", "The", "a", "12", "É", "|", "...", "x,y", "\n", "the a the a b", "\t", "word word"]
    texts = ["", " ", "a", "\n\n", "A b. A b. A b. A b. A b."] + [rng.choice(["", " ", "\n"]).join([]) + " ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, int(t.count("|") * 3 < len(t.split())) if k % 3 else None) for k, t in enumerate(texts)], "doc_id long, text string, quality int")
    model = quality_gam.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert len(model.pairs) == quality_gam.PAIRS
    got = {r.doc_id: r.score for r in quality_gam.score(docs, model).collect()}
    bin_of = lambda cuts, x: sum(c <= x + 1e-12 for c in cuts)
    for k, t in enumerate(texts):
        x = plain_features(t)
        z = model.base + sum(float(table[bin_of(cuts, v)]) for table, cuts, v in zip(model.tables, model.cuts, x, strict=True))
        z += sum(float(table[bin_of(model.pair_cuts[a], x[a]), bin_of(model.pair_cuts[b], x[b])]) for a, b, table in model.pairs)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9, t


def test_of_conflicting_labels_the_smaller_counts(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, text_of("aa" if k % 2 else "bb", rng)) for k in range(120)], "doc_id long, text string")
    once = [(k, k % 2) for k in range(120)]
    both = once + [(k, 1) for k in range(0, 120, 4)] + [(k, None) for k in range(9)]
    scores = []
    for rows in (once, both):
        model = quality_gam.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        scores.append({r.doc_id: r.score for r in quality_gam.score(docs, model).collect()})
    assert scores[0] == scores[1]


def brute_scores(docs):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))) for i, t in docs]
    count = [None] + [collections.Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, out = sum(count[1].values()), []
    for i, w in words:
        s = 0.0
        for k in range(len(w)):
            g = [tuple(w[max(0, k - n + 1) : k + 1]) for n in (1, 2, 3)]
            if k >= 2 and count[3][g[2]] >= 2:
                s += math.log(count[3][g[2]] / count[2][tuple(w[k - 2 : k])])
            elif k >= 1 and count[2][g[1]] >= 2:
                s += math.log(count[2][g[1]] / count[1][(w[k - 1],)]) + math.log(0.4) * (min(k, 2) - 1)
            else:
                s += math.log(count[1][g[0]] / total) + math.log(0.4) * min(k, 2)
        out.append((i, len(w), s))
    return sorted(out)


def test_backoff_scores_equal_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_WORDS", 500)
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("a b c d E e the of x y z".split()) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs += [(d.doc_id, d.text) for d in odd_docs.collect() if d.doc_id not in (None, 5)]
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in ngram_lm.backoff_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = brute_scores(docs)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 * max(1, abs(w[2])) for g, w in zip(got, want, strict=True))


def test_backoff_scores_odd_rows(spark, odd_docs):
    rows = {r.doc_id: r for r in ngram_lm.backoff_scores(odd_docs).collect()}
    assert rows[2].n_words == 0 and rows[2].log_score == 0 and rows[2].mean_log_score is None and rows[5].n_words == 240_000
    assert ngram_lm.backoff_scores(odd_docs.limit(0)).collect() == []


def test_backoff_counts_rows_without_an_id(spark):
    docs = [(None, "a b c d"), ("x", "a b c d"), (None, "a b"), ("y", None)]
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 9)) for r in ngram_lm.backoff_scores(spark.createDataFrame(docs, "doc_id string, text string")).collect())
    want = sorted((str(i), n, round(s, 9)) for i, n, s in brute_scores([(str(i), t) for i, t in docs]))
    assert got == want and len(got) == 4


BENCH = [(1, "If Alice buys 12 apples and sells 5 apples to Bob, how many apples does Alice keep at home?"), (2, "the quick brown fox jumps over the lazy dog near the old river bank today"), (3, "one two three four five six"), (4, None), (5, "tiny")]


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}


def test_verbatim_and_reparameterised_items(spark):
    filler = "some clean words stand around here and say nothing at all of note "
    got = found(
        spark,
        filler + BENCH[1][1] + " " + filler,
        "so if Carol buys 30 apples and sells 7 apples to Dave, how many apples does Carol keep at home?",
        "so if Carol buys 30 apples and sells 7 apples to Carol, how many apples does Dave keep at home?",
        filler * 5,
        "one two three four five six",
        BENCH[1][1].upper(),
    )
    assert set(got) == {(0, 2), (1, 1), (4, 3), (5, 2)}
    assert got[1, 1].reparameterised and not got[0, 2].reparameterised


def test_short_and_dense_items_are_found_verbatim(spark):
    items = ["What is 12 + 7 + 30 + 4 + 9 + 15?", "What is 3 + 4?", "Name Anna Berta Carl Dora Emil Fritz Gerd Hans Ida and Karl", "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 to the sum of all the other given numbers", "Zyx"]
    filler = "Some clean words stand around here, and say nothing at all of note."
    texts = [f"{filler} {t} {filler}" for t in items] + [f"{filler} {t.upper()}" for t in items[:2]]
    texts += [filler * 3, "What is 3 + 5? What is 4 + 3?", "What is 12 + 7 + 30 + 4 + 9 + 16?", f"Zyx and zyx again. {items[1]} {items[1]}", items[0].replace(" + ", "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, k) for k in range(5)} | {(5, 0), (6, 1), (10, 1), (10, 4), (11, 0)} and len(rows) == 10
    assert all(r.coverage == 1.0 and not r.reparameterised for r in rows)
    assert {(r.doc_id, r.item_id): r.at_token for r in rows}[1, 1] == 13


def test_no_case_hides_an_item_with_names(spark):
    item = BENCH[0][1]
    far = "Then a cyclist rode 30 Miles past Anna and Bert along the river bank, at noon."
    texts = [item.upper(), item.lower(), item.title(), item.upper().replace("12", "30"), item.upper().replace("5 APPLES TO BOB", "7 PEARS WITH BERT"), far.upper(), far.lower()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, far)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert {(0, 1), (1, 1), (2, 1), (3, 1), (5, 2), (6, 2)} <= set(got) <= {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)}
    assert all(got[k].coverage == 1.0 for k in ((0, 1), (1, 1), (2, 1), (5, 2), (6, 2)))
    assert got[3, 1].reparameterised and not got[0, 1].reparameterised


def test_case_of_accented_letters_is_folded(spark):
    text = "Éai éonleeau pour an êonqueé ñivi äi Ж éenaitre oiaux"
    docs = spark.createDataFrame([(0, text.upper()), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {0, 1}


def test_templates():
    raw = b"He paid 30 euros to Mary Ann Smith in Paris. Then 3.5 kg left"
    hashed, kind, _, at = decontam.template(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert kind.tolist() == [0, 0, 1, 3, 0, 2, 0, 2, 0, 1, 3, 0] and at.tolist() == [0, 12]
    assert hashed[2] == hashed[9] and hashed[5] == hashed[7]


def test_decontamination_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.contaminated(odd_docs, bench).collect() == []
    assert decontam.contaminated(odd_docs, bench.limit(0)).collect() == []
    assert decontam.contaminated(odd_docs.limit(0), bench).collect() == []
