"""Language identification: averaged hashed subword embeddings with a linear softmax.

Letters are lower-cased (A-Z), other ASCII bytes count as spaces. Every run of three and of four bytes is hashed to a
bucket; a text is the mean of its buckets' embeddings, and a linear softmax on it gives the language. Embeddings and
weights are learned together by stochastic gradient descent in numpy on a bounded sample. A part of the sample is kept
from it to set the softmax's temperature and the score under which a text is rejected.

A null text, or one without a letter, is ``und`` with score 0, and rejected. Very long texts are read whole. Repeated rows give
repeated results; the columns' names are free, and extra ones are not read. Without any labelled row every text with a
letter is ``und``. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.sampling import stratified_ids
from lodestar.llm.textblock import pieces, release_memory, text_buffers
from lodestar.session import document_batches

#: The bound of the sample that is learned from, in rows.
SAMPLE_ROWS = 2400
BUCKETS = 1 << 15
DIMENSIONS = 12
EPOCHS = 6
#: Share of calibration texts that may be rejected, and a rejection threshold that is never exceeded.
REJECTED = 0.001
MOST_THRESHOLD = 0.5

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_PIECE = 1 << 20


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each byte, of the three and the four bytes from there; ``2 * BUCKETS`` where a document ends first
    or there are only spaces."""
    n = len(data)
    clean = np.zeros(n + 3, np.uint32)
    clean[:n] = _CLEAN[data]
    key = clean[:n] | (clean[1 : n + 1] << np.uint32(8)) | (clean[2 : n + 2] << np.uint32(16))
    shift = np.uint32(32 - int(BUCKETS).bit_length() + 1)
    blank = key == 0x202020
    three = ((key * np.uint32(2654435761)) >> shift).astype(np.int32)
    key |= clean[3 : n + 3] << np.uint32(24)
    four = ((key * np.uint32(2246822519)) >> shift).astype(np.int32) + BUCKETS
    three[blank] = four[blank] = 2 * BUCKETS
    for k, out in ((1, four), (1, three), (2, four), (2, three), (3, four)):
        at = bounds[1:] - k
        out[at[at >= bounds[:-1]]] = 2 * BUCKETS
    return three, four


@dataclass
class LanguageModel:
    """``vectors``: a row for each bucket and a last one of zeros; scores are softmax((mean @ weights + bias) / temperature)."""

    languages: list
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self) -> None:
        folded = self.vectors @ self.weights if self.languages and len(self.languages) <= self.vectors.shape[1] else None
        self.table = np.ascontiguousarray(folded if folded is not None else self.vectors, np.float32)
        self.folded = folded is not None

    def logits(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bounds) - 1, self.table.shape[1]))
        count = np.zeros(len(bounds) - 1)
        for lo, hi in pieces(bounds, _PIECE):
            for a in range(int(bounds[lo]), int(bounds[hi]), 2 * _PIECE):  # a very long text comes in parts
                b = min(int(bounds[hi]), a + 2 * _PIECE)
                part = np.clip(bounds[lo : hi + 1] - a, 0, b - a)
                filled = np.flatnonzero(part[1:] > part[:-1])
                if not len(filled):
                    continue
                for k in features(raw[a:b], part):
                    total[lo + filled] += np.add.reduceat(self.table[k], part[:-1][filled], axis=0)
                    count[lo + filled] += np.add.reduceat((k < 2 * BUCKETS).astype(np.int32), part[:-1][filled])
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.folded else mean @ self.weights) + self.bias

    def predict(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, calibrated score) of each text."""
        p = softmax(self.logits(raw, bounds) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str | None], labels: list, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over the texts; every fifth is kept for calibration."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((2 * BUCKETS + 1, 1), np.float32), np.zeros((1, 0)), np.zeros(0))
    y = np.array([names.index(x) for x in labels])
    column = pa.array(texts, pa.large_string())
    raw, bounds, _ = text_buffers(column)
    rows = []
    for k in range(len(texts)):
        one = raw[bounds[k] : bounds[k + 1]]
        found = np.concatenate(features(one, np.array([0, len(one)])))
        bucket, n = np.unique(found[found < 2 * BUCKETS], return_counts=True)
        rows.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = np.zeros((2 * BUCKETS + 1, DIMENSIONS), np.float32)
    vectors[:-1] = rng.normal(0, 0.1, (2 * BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.3, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    learn = np.flatnonzero(np.arange(len(texts)) % 5 != 4) if len(texts) >= 20 else np.arange(len(texts))
    size, steps = 16, 0
    total = EPOCHS * max(1, -(-len(learn) // size))
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            bucket = np.concatenate([rows[k][0] for k in batch])
            share = np.concatenate([rows[k][1] for k in batch])[:, None]
            owner = np.repeat(np.arange(len(batch)), [len(rows[k][0]) for k in batch])
            mean = np.zeros((len(batch), DIMENSIONS), np.float32)
            np.add.at(mean, owner, vectors[bucket] * share)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            rate = 1.0 - steps / total
            steps += 1
            slope = error @ weights.T
            weights -= (0.2 * rate * (mean.T @ error)).astype(np.float32)
            bias -= (0.02 * rate * error.sum(0)).astype(np.float32)
            np.add.at(vectors, bucket, -(40.0 * rate) * share * slope[owner])
    model = LanguageModel(names, vectors, weights, bias)
    kept = np.setdiff1d(np.arange(len(texts)), learn)
    if len(kept):
        part = column.take(pa.array(kept))
        logits = model.logits(*text_buffers(part)[:2])
        truth = y[kept]
        grid = np.geomspace(0.2, 10, 40)
        loss = [-np.log(softmax(logits / t)[np.arange(len(kept)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        score = softmax(logits / model.temperature).max(1)
        model.threshold = float(min(MOST_THRESHOLD, np.quantile(score, REJECTED)))
    return model


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from at most about ``rows`` rows of ``df`` that have a text and a language, as many of each language."""
    df = df.where(F.col(text_col).isNotNull())
    ids = stratified_ids(df, id_col, lang_col, rows)
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").orderBy(F.xxhash64(F.lit("order"), "id"), "id").toArrow()
    return fit(found.column("text").to_pylist(), found.column("label").to_pylist())


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", pass_cols: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``pass_cols`` of each row, with the predicted language, its score and whether the text is rejected (too little certainty, or
    no letter), under these ``names``."""
    document_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out_schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in pass_cols] + [f"{n} {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True)])
    text_at = len(pass_cols)

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(text_at)
            raw, bounds, _ = text_buffers(column)
            has = np.zeros(len(bounds) - 1, bool)
            for lo, hi in pieces(bounds, _PIECE):
                filled = lo + np.flatnonzero(bounds[lo + 1 : hi + 1] > bounds[lo:hi])
                if len(filled):
                    has[filled] = np.logical_or.reduceat(_ASCII_LETTER[raw[bounds[lo] : bounds[hi]]], bounds[filled] - bounds[lo])
            for k in np.flatnonzero(~has & (bounds[1:] > bounds[:-1])):
                has[k] = any(c.isalpha() for c in column[int(k)].as_py())
            if m.languages:
                best, score = m.predict(raw, bounds)
                score = np.where(has, score, 0.0)
                labels = [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                labels, score = ["und"] * len(has), np.zeros(len(has))
            rejected = ~has | (score < m.threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(text_at)), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*pass_cols, *names])
        release_memory()

    return df.select(*[F.col(f"`{c}`") for c in pass_cols], F.col(text_col).alias("_text")).mapInArrow(run, out_schema)
