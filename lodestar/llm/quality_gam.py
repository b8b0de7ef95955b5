"""Quality classifier: a generalised additive model with pairwise interactions.

A text is a few dozen statistics. Shallow trees are boosted feature by feature, round after round, each on one feature's
bins; their sum is a table for each feature. Then the pairs of features whose coarse grids still explain most of the
residual get tables of their own, boosted in the same way. A score is the sigmoid of one table entry for each feature and
pair: vectorised additions of looked-up bins.

Statistics come from the text alone. Null and empty texts have the statistics 0 and get a score like any other. Very
long texts are measured whole. Repeated rows give repeated results. Extra columns are not read. Without labels, or with one label
only, every score is that label's share (0.5 without any). An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.sampling import stratified_ids
from lodestar.llm.textblock import pieces, text_buffers, window_hashes, word_hashes, word_spans
from lodestar.session import document_batches

#: The bound of the labelled sample that is learned from, in rows.
SAMPLE_ROWS = 6000
ROUNDS, RATE, BINS, DEPTH = 120, 0.12, 24, 2
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 40
FEATURES = (
    "words", "mean_word", "spread_word", "longest_word", "symbols", "upper", "digits", "marks", "other_bytes", "white",
    "distinct_words", "repeated_next", "repeated_windows", "lines", "mean_line", "repeated_lines", "single_byte_words", "capital_words", "pipes", "stops",
)

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 mark, 5 symbol, 6 white, 7 other
_KIND[:] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[0x20, 9, 10, 11, 12, 13]] = 6
_KIND[128:] = 7


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(bounds) - 1, len(FEATURES)))
    for lo, hi in pieces(bounds):
        data, part = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        if not len(data):
            continue
        size = np.maximum(np.diff(part), 1)
        kind = _KIND[data]
        share = np.empty((hi - lo, 8))
        for k in range(1, 8):
            total = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind == k, out=total[1:])
            share[:, k] = (total[part[1:]] - total[part[:-1]]) / size
        pipe = np.r_[0, np.cumsum(data == 124, dtype=np.int32)]
        stop = np.r_[0, np.cumsum(data == 46, dtype=np.int32)]
        starts, ends, first = word_spans(data, part)
        hashed = word_hashes(data, starts, ends)
        length = ends - starts
        line_data = np.where(data == 10, np.uint8(10), np.where(data == 32, np.uint8(95), data))  # lines as words: only line feeds cut
        l_starts, l_ends, l_first = word_spans(line_data, part)
        l_hashed = word_hashes(line_data, l_starts, l_ends)
        capital = np.r_[0, np.cumsum(_KIND[data[starts]] == 2, dtype=np.int32)]
        single = np.r_[0, np.cumsum(length == 1, dtype=np.int32)]
        for k in range(hi - lo):
            a, b = first[k], first[k + 1]
            n, row = b - a, out[lo + k]
            row[[4, 5, 6, 7, 8, 9]] = share[k, [5, 2, 3, 4, 7, 6]]
            row[18] = (pipe[part[k + 1]] - pipe[part[k]]) / max(1, n)
            row[19] = (stop[part[k + 1]] - stop[part[k]]) / max(1, n)
            if n:
                w, one = hashed[a:b], length[a:b]
                row[0], row[1], row[2], row[3] = np.log1p(n), one.mean(), one.std(), np.log1p(one.max())
                row[10] = len(np.unique(w)) / n
                row[11] = np.count_nonzero(w[1:] == w[:-1]) / n
                five = window_hashes(w, 5)
                row[12] = 1 - len(np.unique(five)) / len(five) if len(five) else 0.0
                row[16], row[17] = (single[b] - single[a]) / n, (capital[b] - capital[a]) / n
            c, d = l_first[k], l_first[k + 1]
            if d > c:
                row[13], row[14] = np.log1p(d - c), np.log1p((l_ends[c:d] - l_starts[c:d]).mean())
                row[15] = 1 - len(np.unique(l_hashed[c:d])) / (d - c)
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the bins of a depth-limited regression tree on the bins' sums (Newton steps)."""
    out = np.zeros(len(gradient))

    def grow(lo: int, hi: int, left: int) -> None:
        g, w = gradient[lo:hi].sum(), weight[lo:hi].sum()
        best, at = 1e-9, None
        if left and hi - lo > 1:
            cg, cw = np.cumsum(gradient[lo:hi])[:-1], np.cumsum(weight[lo:hi])[:-1]
            ok = (cw > 1.0) & (w - cw > 1.0)
            gain = np.where(ok, cg**2 / (cw + 1) + (g - cg) ** 2 / (w - cw + 1) - g**2 / (w + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                at = lo + k + 1
        if at is None:
            out[lo:hi] = g / (w + 1)
        else:
            grow(lo, at, left - 1)
            grow(at, hi, left - 1)

    grow(0, len(gradient), depth)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree on two features' grid: the best cut of one, then in each half the best cut of the other."""
    best, value = -1.0, np.zeros_like(gradient)
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for cut in range(1, g.shape[0]):
            out = np.empty_like(g)
            gain = 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                leaf = _tree(g[rows].sum(0), w[rows].sum(0), 1)
                out[rows] = leaf
                gain += float((leaf * g[rows].sum(0)).sum())
            if gain > best:
                best, value = gain, out if axis == 0 else out.T.copy()
    return value


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return AdditiveModel(base=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    model = AdditiveModel(base=float(np.log(y.mean() / (1 - y.mean()))))
    n = x.shape[1]
    quantiles = lambda k, bins: np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins))
    model.cuts = [quantiles(k, BINS) for k in range(n)]
    model.pair_cuts = [quantiles(k, PAIR_BINS) for k in range(n)]
    bins = [np.searchsorted(model.cuts[k], x[:, k], "right") for k in range(n)]
    coarse = [np.searchsorted(model.pair_cuts[k], x[:, k], "right") for k in range(n)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k in range(n):  # in turn, so that features that say the same share what they say
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], y - p, size), np.bincount(bins[k], p * (1 - p), size), DEPTH)
            model.tables[k] += step
            total += step[bins[k]]
    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(n):
        for b in range(a + 1, n):
            shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
            cell = coarse[a] * shape[1] + coarse[b]
            g, w = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g**2 / (w + 5)).sum()), a, b, shape, cell))
    gains.sort(key=lambda v: -v[0])
    chosen = [(a, b, np.zeros(shape), cell) for _, a, b, shape, cell in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table, cell in chosen:
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(np.bincount(cell, y - p, table.size).reshape(table.shape), np.bincount(cell, p * (1 - p), table.size).reshape(table.shape))
            table += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, table) for a, b, table, _ in chosen]
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learns from at most about ``rows`` labelled documents, as many of each label if there are. The labels' shares are those of all labelled rows."""
    known = labels.groupBy(id_col).agg(F.min(label_col).alias(label_col))  # of conflicting labels the smaller
    share = known.where(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()["p"]
    ids = stratified_ids(known, id_col, label_col, rows)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")

    def measure(batches):
        for batch in batches:
            raw, bounds, _ = text_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(features(raw, bounds)), pa.list_(pa.float64()))], ["id", "label", "x"])

    found = chosen.select(F.col("id").cast("bigint"), "text", F.col("label").cast("double")).mapInArrow(measure, "id bigint, label double, x array<double>").toPandas().sort_values("id")
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    y = found["label"].to_numpy()
    model = fit(np.vstack(found["x"].to_list()), y)
    taken = float(y.mean())
    if share is not None and 0 < taken < 1 and 0 < share < 1:  # equal parts of the labels were taken
        model.base += float(np.log(share / (1 - share)) - np.log(taken / (1 - taken)))
    return model


def score(df: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: 0 to 1, higher where label 1 is likelier."""
    document_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, bounds, _ = text_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(features(raw, bounds)))], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")
