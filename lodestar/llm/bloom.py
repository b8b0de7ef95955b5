"""A blocked Bloom filter over 64-bit keys, built by tasks and merged by slices.

Each key sets a few bits of one 512-bit block. The size is bounded (``MOST_BYTES``): with more keys the filter lets more
false hits pass, never fewer true ones, and an exact join behind it removes them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20
BITS_A_KEY = 12
HASHES = 6
_SLICE = 1 << 16
_WORDS = 8  # 64-bit words a block


def size_for(keys: int) -> int:
    """Number of blocks: a power of two, bounded by MOST_BYTES."""
    want = max(1, keys) * BITS_A_KEY // 512 + 1
    return min(1 << (want - 1).bit_length(), MOST_BYTES // (8 * _WORDS))


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Index of each key's block and, for each hash, of the bit in it."""
    k = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(32)
    block = (k % np.uint64(blocks)).astype(np.int64)
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return block, [((k >> np.uint64(9 * h + 1)) & np.uint64(511)).astype(np.int64) for h in range(HASHES)]


def add(words: np.ndarray, keys: np.ndarray) -> None:
    block, bits = _bits(keys, len(words) // _WORDS)
    for bit in bits:
        np.bitwise_or.at(words, block * _WORDS + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))


def might_contain(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, bits = _bits(keys, len(words) // _WORDS)
    hit = np.ones(len(keys), bool)
    left = np.arange(len(keys))
    for bit in bits:
        at = bit[left]
        ok = (words[block[left] * _WORDS + (at >> 6)] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        hit[left[~ok]] = False
        left = left[ok]
    return hit


def build(df: DataFrame, key_col: str, blocks: int) -> np.ndarray:
    """The filter of all non-null keys (bigint) of ``df``. Tasks send only the slices that they have set."""

    def run(batches):
        words = np.zeros(blocks * _WORDS, np.uint64)
        for batch in batches:
            add(words, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        step = _SLICE // 8
        rows = [(k, words[k : k + step]) for k in range(0, len(words), step) if words[k : k + step].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w.tobytes() for _, w in rows], pa.binary())], ["at", "bits"])

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(bits, np.uint64)
                whole[at] = whole[at] | new if at in whole else new
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int64()), pa.array([w.tobytes() for w in whole.values()], pa.binary())], ["at", "bits"])

    slices = max(1, blocks * _WORDS * 8 // _SLICE)
    parts = df.select(F.col(key_col).cast("bigint")).where(F.col(key_col).isNotNull()).mapInArrow(run, "at bigint, bits binary")
    merged = parts.repartition(min(slices, 64), "at").mapInArrow(merge, "at bigint, bits binary")
    words = np.zeros(blocks * _WORDS, np.uint64)
    table = merged.toArrow()
    for at, bits in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        part = np.frombuffer(bits, np.uint64)
        words[at : at + len(part)] = part
    return words


def among(keys: DataFrame, key_col: str, count: int) -> Callable[[str], Column]:
    """A condition on columns of the type of ``key_col``, which has about ``count`` values: false only for what is not among them, nulls too.
    Workers get hashes alone; the rest of a row stays in the JVM."""
    blocks = size_for(count)
    words = keys.sparkSession.sparkContext.broadcast(build(keys.where(F.col(key_col).isNotNull()).select(F.xxhash64(key_col).alias("h")), "h", blocks))

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        return pa.array(might_contain(words.value, h.to_numpy(zero_copy_only=False)), pa.bool_())

    return lambda column: hit(F.xxhash64(column))


def without(df: DataFrame, gone: DataFrame, key_col: str) -> DataFrame:
    """The rows of ``df`` whose ``key_col`` is not in ``gone``; a null is in no table. Only rows that a filter of ``gone`` lets pass are shuffled, for
    the exact join; the others stay where they are."""
    hit = among(gone, key_col, gone.count())
    return df.where(~hit(key_col)).unionByName(df.where(hit(key_col)).join(gone.select(key_col), key_col, "left_anti").select(*df.columns))
