"""Tree concatenation against the library."""

import hashlib
import json
import random

import numpy as np
import pytest

from lodestar.llm.bpe import WHOLE, TreeEncoder, encode_decode
from lodestar.llm.queries import tokenizer_path

ALPHABET = ["a", "b", "é", "é", " ", "\n", "'s", "'", "1", "!", ",", ".", "<|endoftext|>", "日", "👩", "‍", "ﬁ", "Σ", "İ", "the", " ", "\x1c", "Don't"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    out += ["a" * 5000, "é" * 3000 + "x", "ab'sab're" * 300, "x<|endoftext|>y" * 200, "日本語" * 500, "", " " * 1000, "İΣ" * 300, "ẹ́" * 400, "word, " * 4000]
    return out


def test_ids_equal_the_library(texts):
    tree = TreeEncoder(tokenizer_path(), leaf_chars=40, window_chars=4)
    for t, got, want in zip(texts, tree.encode(texts), tree.model.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, t[:50]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("leaf", [7, 40, 512])
def test_ids_equal_the_library_for_each_kind_of_model(texts, name, leaf):
    tree = TreeEncoder(tokenizer_path(name), leaf_chars=leaf, window_chars=3, threads=2)
    for t, got, want in zip(texts, tree.encode(texts), tree.model.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, t[:50]
    assert tree.decode([np.array(w.ids) for w in tree.model.encode_batch(texts[:20])]) == [tree.model.decode(w.ids, skip_special_tokens=False) for w in tree.model.encode_batch(texts[:20])]


def test_other_models_encode_texts_whole(texts, tmp_path):
    file = json.load(open(tokenizer_path("byte_bpe_50k.json")))
    file["normalizer"], file["pre_tokenizer"]["add_prefix_space"] = {"type": "Lowercase"}, True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    tree = TreeEncoder(str(path), leaf_chars=8)
    assert tree.kind == WHOLE
    assert [x.tolist() for x in tree.encode(texts[:60])] == [e.ids for e in tree.model.encode_batch(texts[:60], add_special_tokens=False)]


def test_long_texts_are_spliced_from_windows(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr("lodestar.llm.bpe.LEAF_WORDS", 3)
    texts = [" ".join("".join(rng.choice("abcé'1.") for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in (4, 7, 50, 333)]
    tree = TreeEncoder(tokenizer_path())
    windows = []
    halved = tree._halved
    monkeypatch.setattr(tree, "_halved", lambda t: windows.extend(t) or halved(t))
    assert [x.tolist() for x in tree.encode(texts)] == [e.ids for e in tree.model.encode_batch(texts, add_special_tokens=False)]
    assert len(windows) > 100


def test_windows_replace_what_the_halves_have_wrong(monkeypatch):
    """Words whose remembered ids are wrong beside a join are mended by its window."""
    rng = random.Random(3)
    monkeypatch.setattr("lodestar.llm.bpe.LEAF_WORDS", 4)
    for _ in range(100):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))).encode() for _ in range(rng.randint(5, 40))]
        tree = TreeEncoder(tokenizer_path())
        ids = [tree.unsplit(w.decode()).astype("<u4").tobytes() for w in words]
        cuts, todo = [], [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo > 4:
                cuts.append((lo + hi) // 2)
                todo += [(lo, cuts[-1]), (cuts[-1], hi)]
        wrong = list(ids)
        at = rng.choice(cuts) - rng.randint(0, 1)
        wrong[at] += b"\1\0\0\0"
        assert b"".join(tree._tree(words, wrong, 0, len(words))) == b"".join(ids)


def test_joins_are_exact_at_every_leaf_size():
    text = "supercalifragilistic" * 40 + "éèê" * 50 + "12ab" * 60
    for leaf in (7, 33, 100, 1000):
        tree = TreeEncoder(tokenizer_path(), leaf_chars=leaf, window_chars=1)
        assert tree.unsplit(text).tolist() == tree.model.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr("lodestar.llm.bpe.MEMORY", 5)
    tree = TreeEncoder(tokenizer_path())
    got = [x.tolist() for x in tree.encode(texts[:40])]
    assert got == [e.ids for e in tree.model.encode_batch(texts[:40], add_special_tokens=False)]


def test_operator_with_odd_rows(spark, odd_docs):
    rows = encode_decode(odd_docs, tokenizer_path(), digests=True).collect()
    tree = TreeEncoder(tokenizer_path())
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    for d in odd_docs.collect():
        want = tree.model.encode(d.text or "", add_special_tokens=False).ids
        r = by[d.doc_id]
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded == tree.model.decode(want, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_decode(odd_docs.limit(0), tokenizer_path()).collect() == []
