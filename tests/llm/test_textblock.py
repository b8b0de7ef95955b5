import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import bloom
from lodestar.llm.textblock import text_buffers, word_hashes, word_spans

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0bab.AÉé日", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_regex(texts):
    raw, bounds, null = text_buffers(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
    for k, t in enumerate(texts):
        assert null[k] == (t is None)
        got = [raw[s:e].tobytes().decode() for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_hashes_depend_on_the_bytes_only():
    data = np.frombuffer(b"abc x abc ABC abd", np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    h, low = word_hashes(data, s, e), word_hashes(data, s, e, lower=True)
    assert h[0] == h[2] != h[3] and len(set(h.tolist())) == 4
    assert low[0] == low[2] == low[3] != low[4]


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = np.arange(20_000, dtype=np.int64) * 7919
    words = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", bloom.size_for(len(keys)))
    assert bloom.might_contain(words, keys).all()
    assert bloom.might_contain(words, keys + 1).mean() < 0.05
    assert not bloom.might_contain(bloom.build(spark.createDataFrame([], "k long"), "k", bloom.size_for(0)), keys).any()
