"""Language-model scoring with stupid backoff over the corpus's own n-gram counts, as joins of hashed tables.

Documents are held in blocks: a word table and word numbers. Each block explodes its documents to n-grams, adds up equal ones, and
sends hashes and counts to the partition that owns the hash. There the count table of all blocks is made and joined
back to each block's n-grams, and the block sums the scores of each document's words. Trigrams are only exchanged if both of their
bigrams reach the count cut-off, as others can't reach it.

score(w | u v) = c(u v w) / c(u v) if c(u v w) >= MIN_COUNT, else BACKOFF * score(w | v); score(w | v) = c(v w) / c(v) if
c(v w) >= MIN_COUNT, else BACKOFF * c(w) / N. At a document's start the shorter contexts are used without penalty.
Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; counts are over all documents, whole texts.
The cut-off is part of the model: the corpus is scored by its own counts, in which each of its n-grams occurs at least once, so that with a cut-off
of 1 nothing would ever back off; ``min_count=1`` gives that model.

Null texts and texts without words have 0 words, log_score 0 and a null mean. Repeated rows count as they come, each with a
row of its own; so do rows with a null id. Ids may be of any type. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.textblock import U64, mix, pieces, text_buffers, word_hashes, word_spans
from lodestar.session import document_batches, materialise, shuffle_partitions

BACKOFF = 0.4
MIN_COUNT = 2
#: Words of a block, unless one document has more.
BLOCK_WORDS = 1_500_000
#: Words of the corpus for each task of an exchange, so that what a task holds does not grow with the corpus.
TASK_WORDS = 4_000_000

_BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("first", pa.binary()), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
_BLOCKS_DDL = "block bigint, words bigint, ids binary, first binary, vocabulary binary, tokens binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKED_DDL = "bucket int, block bigint, n int, keys binary, counts binary"
_TOTAL = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
_TOTAL_DDL = "block bigint, n int, bucket int, totals binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, kind) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(b[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).ravel().view(kind)


def pack_ids(ids: list[pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], ["id"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_ids(b: bytes) -> pa.Array:
    return pa.ipc.open_stream(b).read_next_batch().column(0)


def _blocks(batches):
    part, serial = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids: list[pa.Array] = []
    words: list[np.ndarray] = []
    size = 0

    def close():
        nonlocal serial
        hashes = np.concatenate(words) if words else np.zeros(0, U64)
        vocabulary, token, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        first = np.cumsum([0, *(len(w) for w in words)]).astype(np.int64)
        row = [(part << 32) + serial, len(hashes), pack_ids(ids), pack(first), pack(vocabulary[order]), pack(rank[token])]
        serial += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    for batch in batches:
        raw, bounds, _ = text_buffers(batch.column(1))
        for lo, hi in pieces(bounds):
            data = raw[bounds[lo] : bounds[hi]]
            starts, ends, first = word_spans(data, bounds[lo : hi + 1] - bounds[lo])
            hashed = word_hashes(data, starts, ends, lower=True)
            for k in range(hi - lo):
                ids.append(batch.column(0).slice(lo + k, 1))
                words.append(hashed[first[k] : first[k + 1]].copy())
                size += len(words[-1])
                if size >= BLOCK_WORDS:
                    yield close()
                    ids, words, size = [], [], 0
    if ids:
        yield close()


class Block:
    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, self.first = unpack_ids(row["ids"]), unpack(row["first"], np.int64)
        self.vocabulary, self.tokens = unpack(row["vocabulary"], U64), unpack(row["tokens"], np.uint32)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, hash) of all n-grams inside documents."""
        size = len(self.tokens) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        word = self.vocabulary[self.tokens]
        h = np.zeros(size, U64)
        for k in range(n):
            h += mix(word[k : k + size] + U64(n * 1000 + k + 1))
        ok = np.ones(size, bool)
        for k in range(1, n):
            cut = self.first[1:-1] - k
            ok[cut[(cut >= 0) & (cut < size)]] = False
        at = np.flatnonzero(ok)
        return at + n - 1, mix(h)[at]


def _asked(block: int, n: int, keys: np.ndarray, buckets: int):
    """Rows that ask for the totals of a block's distinct n-grams; a bucket owns a range of hashes."""
    distinct, counts = np.unique(keys, return_counts=True)
    edge = np.searchsorted((distinct >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))
    for b in range(buckets):
        if edge[b + 1] > edge[b]:
            mine = distinct[edge[b] : edge[b + 1]]
            yield (b, block, n, pack(np.diff(mine, prepend=U64(0))), pack(counts[edge[b] : edge[b + 1]].astype(np.uint32)))


def _batches(rows, schema, size: int = 256):
    rows = iter(rows)
    while part := [r for _, r in zip(range(size), rows)]:  # noqa: B905
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _ask_one_two(buckets: int):
    def run(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row)
                    for n in (1, 2):
                        yield from _asked(b.block, n, b.keys(n)[1], buckets)

        yield from _batches(rows(), _ASKED)

    return run


def _count(batches):
    """Adds up what all blocks have sent to one partition, bucket by bucket and length by length, and answers each block."""
    asked: dict[tuple[int, int], list] = {}
    for batch in batches:
        for bucket, block, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            asked.setdefault((n, bucket), []).append((block, keys, counts))

    def rows():
        for n, bucket in sorted(asked):
            mine = asked.pop((n, bucket))
            keys = [np.cumsum(unpack(k, U64), dtype=U64) for _, k, _ in mine]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([unpack(c, np.uint32) for *_, c in mine]))[inverse].astype(np.uint32)
            at = 0
            for (block, *_), k in zip(mine, keys, strict=True):
                yield (block, n, bucket, pack(total[at : at + len(k)]))
                at += len(k)

    yield from _batches(rows(), _TOTAL)


def _answers(table: pa.Table, n: int) -> np.ndarray:
    """Totals of a block's distinct n-grams, by hash."""
    mine = sorted((r["bucket"], r["totals"]) for r in table.select(["n", "bucket", "totals"]).to_pylist() if r["n"] == n)
    return np.concatenate([unpack(t, np.uint32) for _, t in mine]) if mine else np.zeros(0, np.uint32)


def _at_words(b: Block, n: int, totals: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Count of the n-gram that ends at each word; 0 where there is none or it was not asked for."""
    out = np.zeros(len(b.tokens), np.uint32)
    at, keys = b.keys(n)
    if keep is not None:
        at, keys = at[keep[at]], keys[keep[at]]
    if len(at):
        out[at] = totals[np.unique(keys, return_inverse=True)[1]]
    return out


def _frequent(two: np.ndarray, min_count: int) -> np.ndarray:
    """Whether both bigrams of the trigram that ends at a word reach the cut-off."""
    ok = two >= min_count
    out = ok.copy()
    out[1:] &= ok[:-1]
    out[:1] = False
    return out


def _ask_three(buckets: int, min_count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            b = Block(row)
            keep = _frequent(_at_words(b, 2, _answers(right, 2)), min_count)
            at, keys = b.keys(3)
            rows += _asked(b.block, 3, keys[keep[at]], buckets)
        return pa.Table.from_batches(_batches(rows, _ASKED), schema=_ASKED)

    return run


def _score(total_words: int, min_count: int, backoff: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            b = Block(row)
            one, two = (_at_words(b, n, _answers(right, n)).astype(np.float64) for n in (1, 2))
            three = _at_words(b, 3, _answers(right, 3), _frequent(two, min_count)).astype(np.float64)
            n = len(one)
            place = np.arange(n) - np.repeat(b.first[:-1], np.diff(b.first))
            before_one, before_two = np.r_[1.0, one[:-1]][:n], np.r_[1.0, two[:-1]][:n]
            best = np.minimum(place, 2)
            log = np.log(one / max(1, total_words)) + np.log(backoff) * best
            use = (place >= 1) & (two >= min_count)
            log[use] = np.log(two[use] / before_one[use]) + np.log(backoff) * (best[use] - 1)
            use = (place >= 2) & (three >= min_count)
            log[use] = np.log(three[use] / before_two[use])
            count = np.diff(b.first)
            filled = np.flatnonzero(count)
            total = np.zeros(len(count))
            if len(filled):
                total[filled] = np.add.reduceat(log, b.first[:-1][filled])
            parts.append(pa.RecordBatch.from_arrays([b.ids, pa.array(count, pa.int64()), pa.array(total)], ["id", "n_words", "log_score"]))
        return pa.Table.from_batches(parts)

    return run


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of each row: the sum and mean of the natural logarithms of its words' scores."""
    spark = df.sparkSession
    document_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col))
    id_type = docs.schema["id"].dataType
    blocks = materialise(docs.mapInArrow(_blocks, _BLOCKS_DDL), "lm-blocks")
    words = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    parts = max(shuffle_partitions(spark), -(-words // TASK_WORDS))
    answer = lambda asked: asked.repartition(parts, "bucket").mapInArrow(_count, _TOTAL_DDL)
    by_block = lambda rows: rows.repartition(parts, "block").groupBy("block")
    low = materialise(answer(blocks.mapInArrow(_ask_one_two(2 * parts), _ASKED_DDL)), "lm-counts")
    asked = by_block(blocks).cogroup(by_block(low.where("n = 2"))).applyInArrow(_ask_three(2 * parts, min_count), _ASKED_DDL)
    totals = low.unionByName(answer(asked))
    scored = by_block(blocks).cogroup(by_block(totals)).applyInArrow(_score(words, min_count, backoff), f"id {id_type.simpleString()}, n_words bigint, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"))
