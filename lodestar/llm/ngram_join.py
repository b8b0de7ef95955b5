"""Jaccard self-join of word n-gram sets by PartEnum signatures, and the classes of linked documents.

Two sets link when their Jaccard similarity is at least GAMMA (4/5), compared in integers. Sizes are cut into bands that grow by
1/GAMMA, so that linked sets lie in the same band or in neighbouring ones; a set takes part under its own band and under
the next. Under a band whose largest size is r, linked sets differ in at most k = 2r(1-GAMMA)/(1+GAMMA) elements. The feature domain
(64-bit hashes) is cut into first-level partitions, each into second-level ones, so many that in some first-level
partition linked sets differ in k2 elements at most; there, some subset that leaves out k2 of the second-level
partitions is equal in both. A signature is the hash of a set's elements in such a subset.

Signatures of empty projections are left out: a set that keeps enough non-empty ones finds its links by these; a set
that doesn't enumerates again under a further hash of the domain, and at the last one emits the empty ones too.

Documents with one signature in common form a run. Runs are never expanded to all pairs: first each member is compared
with the run's smallest, and only members that are then still in different components are compared with each other, those first
that look most alike. Parity sketches give an exact lower bound of the difference of two sets, so that most false candidates
end there; the others are compared exactly, by their sets. Equal sets are one node throughout.

A null text, or one without words, has an empty set and is linked with nothing. A text with fewer words than the
n-gram has one element, its whole sequence. Very long texts are read whole. Each row is a document of its own: rows that
repeat an id with other texts are compared each, equal rows get equal results, and each row gives a row. A null id has its
set's size and is linked with nothing. Ids may be of any type that has an order. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bloom
from lodestar.llm.textblock import U64, mix, pieces, release_memory, sorted_groups, text_buffers, window_hashes, word_hashes, word_spans
from lodestar.operators.components import connected_components
from lodestar.session import Scratch, document_batches, drop, shuffle_partitions

WIDTH = 5
#: Similarity of 0.8 or more, as a fraction.
NUM, DEN = 4, 5
LEVELS = 4
#: Runs with one pivot that have more members are compared in blocks of so many, and in slices of about so many rows, which bounds what
#: one group holds.
BLOCK = 1024
SLICE = 1 << 14
#: Cross-component pairs of a member that are compared first.
FIRST_PAIRS = 2
#: Tables of so many rows of a few numbers are broadcast.
MOST_BROADCAST = 100_000
_FLUSH = 1 << 19
_SEEN = 50_000
_LEVEL_SEED = [U64(x) for x in (0, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the windows of a word sequence; of the whole one if it is shorter."""
    if not len(words):
        return np.zeros(0, U64)
    if len(words) < width:
        return window_hashes(words, len(words)) ^ U64(len(words))
    h = np.sort(window_hashes(words, width))
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int = WIDTH):
    """The set of each text, A-Z lower-cased."""
    for lo, hi in pieces(bounds):
        data, part = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        starts, ends, first = word_spans(data, part)
        words = word_hashes(data, starts, ends, lower=True)
        for k in range(hi - lo):
            yield shingle_set(words[first[k] : first[k + 1]], width)


def band_tops(size: int) -> tuple[int, int, int]:
    """(number of the band of ``size``, its largest size, the next band's largest size)."""
    n, low = 0, 1
    while True:
        top = low * DEN // NUM
        if size <= top:
            return n, top, (top + 1) * DEN // NUM
        low, n = top + 1, n + 1


def layout(top: int) -> tuple[int, int, int, int, int]:
    """(k, first-level partitions, second-level ones, k2, spare first-level partitions) of the band with this largest size."""
    k = 2 * top * (DEN - NUM) // (DEN + NUM)
    if k <= 3:
        return k, 1, k + 2, k, 0
    spare = max(1, k // 16)
    return k, k // 2 + 1 + spare, 3, 1, spare


def _subsets(n: int, size: int) -> list[list[int]]:
    from itertools import combinations

    return [list(c) for c in combinations(range(n), size)]


def signatures(elements: np.ndarray, band: int, top: int, level_seeds: list = _LEVEL_SEED) -> np.ndarray:
    """All signatures of a set (sorted hashes) under one band."""
    k, firsts, seconds, k2, spare = layout(top)
    if k == 0:
        return np.zeros(0, U64)  # only equal sets link
    subsets = _subsets(seconds, seconds - k2)
    out = []
    for level, seed in enumerate(level_seeds):
        h = elements if not level else np.sort(mix(elements ^ seed))
        cells = firsts * seconds
        edge = ((np.arange(cells + 1, dtype=np.float64) * (2.0**64 / cells)).astype(np.float64)[1:-1]).astype(U64)
        at = np.concatenate([[0], np.searchsorted(h, edge), [len(h)]])
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
        part = (sums[at[1:]] - sums[at[:-1]]).reshape(firsts, seconds)
        count = (at[1:] - at[:-1]).reshape(firsts, seconds)
        sig = np.empty((firsts, len(subsets)), U64)
        empty = np.empty((firsts, len(subsets)), bool)
        for c, chosen in enumerate(subsets):
            total, number = part[:, chosen[0]].copy(), count[:, chosen[0]].copy()
            for j in chosen[1:]:
                total += part[:, j]
                number += count[:, j]
            sig[:, c] = total + number.astype(U64) * U64(0xD6E8FEB86659FD93)
            empty[:, c] = number == 0
        place = np.arange(firsts, dtype=U64)[:, None] * U64(len(subsets)) + np.arange(len(subsets), dtype=U64)[None, :]
        sig = mix(mix(sig) + mix(place + U64((band << 34) + (level << 32) + 1)))
        enough = int(empty.any(1).sum()) <= spare
        last = level == len(level_seeds) - 1
        out.append(sig[~empty] if enough or not last else sig.ravel())
        if enough:
            break
    return np.concatenate(out)


def all_signatures(elements: np.ndarray) -> np.ndarray:
    n = len(elements)
    band, top, next_top = band_tops(n)
    return np.concatenate([signatures(elements, band, top), signatures(elements, band + 1, next_top)])


def sketch(elements: np.ndarray) -> bytes:
    """Parities of the numbers of elements in a power-of-two number of cells, four times the differences that a link allows."""
    n = len(elements)
    _, _, top = band_tops(n)
    size = max(128, 1 << (4 * layout(top)[0]).bit_length())
    odd = np.bincount((elements & U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """No more than the number of elements that only one of the two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())


def may_link(n_a: int, n_b: int, difference: int) -> bool:
    """Whether sets of these sizes with so many differences, or more, can link: (DEN + NUM) * difference <= (DEN - NUM) * (n_a + n_b)."""
    return (DEN + NUM) * difference <= (DEN - NUM) * (n_a + n_b)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).ravel().view(kind)


_ROW = "bucket int, sigs binary, docs binary, doc_id bigint, n bigint, digest_a bigint, digest_b bigint, sketch binary"


def _signature_rows(buckets: int, width: int):
    names = ["bucket", "sigs", "docs", "doc_id", "n", "digest_a", "digest_b", "sketch"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(sigs: list, docs: list, info: list):
        if sigs:
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            order = np.argsort(sig % U64(buckets), kind="stable")
            sig, doc = sig[order], doc[order]
            edge = np.searchsorted(sig % U64(buckets), np.arange(buckets + 1, dtype=U64))
            for b in range(buckets):
                if edge[b + 1] > edge[b]:
                    part = slice(edge[b], edge[b + 1])
                    yield (b, _planes(sig[part]), _planes(doc[part]), None, None, None, None, None)
        for i in info:
            yield (i[0] % buckets if i[0] is not None else 0, None, None, *i)

    def batch_of(rows_):
        cols = list(zip(*rows_, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        seen: set = set()
        sigs, docs, info, size = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, bounds, _ = text_buffers(batch.column(1))
            for doc_id, s in zip(ids, shingle_sets(raw, bounds, width), strict=True):
                n = len(s)
                if not n or doc_id is None:
                    info.append((doc_id, n, None, None, None))
                    continue
                a = int(np.bitwise_xor.reduce(mix(s + U64(n))).view(np.int64))
                b = int(np.add.reduce(mix(s ^ U64(0x2545F4914F6CDD1D))).view(np.int64))
                info.append((doc_id, n, a, b, sketch(s)))
                if (a, b) not in seen:  # copies within a task are sent once
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add((a, b))
                    sig = all_signatures(s)
                    sigs.append(sig)
                    docs.append(np.full(len(sig), doc_id, np.int64))
                    size += len(sig)
                if size >= _FLUSH:
                    yield batch_of(list(rows(sigs, docs, info)))
                    sigs, docs, info, size = [], [], [], 0
        if info:
            yield batch_of(list(rows(sigs, docs, info)))
        seen.clear()
        release_memory()

    return run


def _runs(batches):
    """Passes on what is known of documents; of the signatures of one task, the distinct sets of documents that share one."""
    sigs, docs = [], []
    names = ["doc_id", "n", "digest_a", "digest_b", "sketch", "run", "members"]

    for batch in batches:
        known = np.asarray(batch.column(1).is_null())
        if known.any():
            part = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3, 8)), pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.list_(pa.int64()))], names)
        for s, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s is not None:
                sigs.append(_unplanes(s, U64))
                docs.append(_unplanes(d, np.int64))
    if not sigs:
        return
    sig, doc = np.concatenate(sigs), np.concatenate(docs)
    del sigs, docs
    order = np.argsort(sig, kind="stable")
    sig, doc = sig[order], doc[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    keep = ~(new & np.r_[new[1:], True])  # signatures that stand alone go
    sig, doc, new = sig[keep], doc[keep], new[keep]
    if not len(sig):
        return
    edge = np.append(np.flatnonzero(new), len(sig))
    first, size = edge[:-1], np.diff(edge)
    two = first[size == 2]
    low, high = np.minimum(doc[two], doc[two + 1]), np.maximum(doc[two], doc[two + 1])
    key = np.add(mix(low.view(U64)), mix(high.view(U64))) ^ U64(2)
    _, once = np.unique(key[low != high], return_index=True)
    low, high, key = (x[low != high][once] for x in (low, high, key))
    found: list = list(zip(key.view(np.int64).tolist(), np.column_stack([low, high]), strict=True))
    done = set(key.tolist())
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        members = np.unique(doc[a : a + n])
        if len(members) > 1:
            k = np.add.reduce(mix(members.view(U64))) ^ U64(len(members))
            if int(k) not in done:
                done.add(int(k))
                found.append((int(k.view(np.int64)), members))
    for lo in range(0, len(found), 1000):
        part = found[lo : lo + 1000]
        none = [pa.nulls(len(part), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([r for r, _ in part], pa.int64()), pa.array([m for _, m in part], pa.list_(pa.int64()))], names)
    del sig, doc, order, new, keep, found, done
    release_memory()


def _sketch_filter(batches):
    """Keeps the pairs (a, b, n_a, n_b, sketch_a, sketch_b) that may link."""
    for batch in batches:
        n_a, n_b, s_a, s_b = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = [may_link(p, q, sketch_difference(x, y)) for p, q, x, y in zip(n_a, n_b, s_a, s_b, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _verify(batches):
    """Keeps the pairs (a, b, set_a, set_b) that link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = np.concatenate([p, q])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(DEN * shared >= NUM * (len(p) + len(q) - shared))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


_GROUP = ["pivot", "x", "y", "slice"]


def _cross_pairs(first: int | None):
    """Of the members of runs (pivot, x, y, slice, run, doc_id, component, n, sketch, block), sorted, two blocks of a slice of the runs with one
    pivot at a time: pairs (a, b) of one run in different components that may link, each once; all, or for each member the ``first`` that
    look most alike. Pivots for which this left some out follow as rows of their own."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pivot", pa.int64())])

    def run(batches):
        for group in sorted_groups(batches, _GROUP):
            pivot, x, y = (group.column(c)[0].as_py() for c in _GROUP[:3])
            key, ids, comp, n, block = (group.column(c).to_numpy() for c in ("run", "doc_id", "component", "n", "block"))
            sketches = group.column("sketch").to_pylist()
            found: dict[tuple[int, int], int] = {}
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(key)) + 1):
                left, right = part[block[part] == x], part[block[part] == y]
                if not len(left) or not len(right):
                    continue
                width = min(len(sketches[k]) for k in part)
                bits = _folded([sketches[k] for k in right], width)
                mine = bits if x == y else _folded([sketches[k] for k in left], width)
                for k, sk in zip(left, mine, strict=True):
                    want = (comp[right] != comp[k]) & (NUM * np.maximum(n[right], n[k]) <= DEN * np.minimum(n[right], n[k]))
                    if x == y:
                        want &= ids[right] > ids[k]
                    at = np.flatnonzero(want)
                    if not len(at):
                        continue
                    diff = np.bitwise_count(bits[at] ^ sk).sum(1, dtype=np.int64)
                    ok = (DEN + NUM) * diff <= (DEN - NUM) * (n[right[at]] + n[k])
                    for other, d in zip(ids[right[at[ok]]].tolist(), diff[ok].tolist(), strict=True):
                        found[min(int(ids[k]), other), max(int(ids[k]), other)] = d
            pairs = sorted(found, key=lambda p: (found[p], p))
            if first is not None:
                seen: dict[int, int] = {}
                near = []
                for a, b in pairs:
                    if seen.get(a, 0) < first or seen.get(b, 0) < first:
                        seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
                        near.append((a, b))
                short, pairs = len(near) < len(pairs), near
                if short:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pivot], pa.int64())], schema=schema)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.nulls(len(pairs), pa.int64())], schema=schema)

    return run


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    while len(x) > width:  # packbits keeps the order, so halves fold on each other
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _folded(sketches, width: int) -> np.ndarray:
    return np.array([_fold(np.frombuffer(s, np.uint8), width) for s in sketches]).reshape(-1, width)


def _own_ids(rows: DataFrame) -> bool:
    """Whether ids are whole numbers, and none comes again."""
    if rows.schema["_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return False
    return rows.where(F.col("_id").isNotNull()).groupBy("_id").count().where("count > 1").isEmpty()


def link_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``df``: the size of its set and the smallest id that links reach from it."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type, scratch = rows.schema["_id"].dataType, Scratch()
    document_batches(df.sparkSession)
    if _own_ids(rows):
        found = _classes(rows.select(F.col("_id").cast("bigint").alias("doc_id"), F.col("_text").alias("text")), width, scratch)
        found = found.select(F.col("doc_id").cast(id_type).alias("_id"), "n", F.col("component_id").cast(id_type).alias("_class"))
    else:  # distinct rows get numbers in the order of their ids, and are written so that the numbers stay
        named = rows.where(F.col("_id").isNotNull()).withColumn("_sha", F.coalesce(F.sha2(F.col("_text"), 256), F.lit("")))
        texts = named.dropDuplicates(["_id", "_sha"]).orderBy("_id", "_sha").withColumn("doc_id", F.monotonically_increasing_id())
        texts = scratch.keep(texts, "texts")
        classes = _classes(texts.select("doc_id", F.col("_text").alias("text")), width, scratch)
        classes = classes.join(texts.select(F.col("doc_id").alias("component_id"), F.col("_id").alias("_class")), "component_id").select("doc_id", "n", "_class")
        found = named.select("_id", "_sha").join(texts.select("_id", "_sha", "doc_id").join(classes, "doc_id"), ["_id", "_sha"]).select("_id", "n", "_class")

        def sizes(batches):
            for batch in batches:
                raw, bounds, _ = text_buffers(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(raw, bounds, width)], pa.int64())], ["n"])

        none = F.lit(None).cast(id_type)
        nameless = rows.where(F.col("_id").isNull()).select("_text").mapInArrow(sizes, "n bigint")
        found = found.unionByName(nameless.select(none.alias("_id"), "n", none.alias("_class")))
    return scratch.result(found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_class").alias("component_id")), "classes")


def _classes(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n, component_id) of rows (doc_id, text), whose ids are unique or null."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    table = docs.mapInArrow(_signature_rows(4 * parts, width), _ROW).repartition(parts, "bucket")
    table = scratch.keep(table.mapInArrow(_runs, "doc_id bigint, n bigint, digest_a bigint, digest_b bigint, sketch binary, run bigint, members array<bigint>"), "partenum")

    known = table.where(F.col("run").isNull()).select("doc_id", "n", "digest_a", "digest_b", "sketch")
    nodes = known.where(F.col("digest_a").isNotNull())
    reps = nodes.groupBy("digest_a", "digest_b", "n").agg(F.min("doc_id").alias("rep"))
    same = nodes.join(reps, ["digest_a", "digest_b", "n"]).select("doc_id", "rep", "n", "sketch")
    same = scratch.keep(same, "same")
    members = table.where(F.col("run").isNotNull()).dropDuplicates(["run"]).select("run", F.explode("members").alias("doc_id"))
    members = members.join(same.select("doc_id", "rep"), "doc_id").select("run", F.col("rep").alias("doc_id")).distinct()
    members = scratch.keep(members.join(members.groupBy("run").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "run"), "members")
    info = same.where("doc_id = rep").select("doc_id", "n", "sketch")

    def may(pairs: DataFrame) -> DataFrame:
        p = pairs.join(info.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        p = p.join(info.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        p = p.where(NUM * F.greatest("n_a", "n_b") <= DEN * F.least("n_a", "n_b"))
        return p.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_sketch_filter, "a bigint, b bigint")

    star = may(members.where("doc_id > pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    star = scratch.keep(star, "star")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link. Sets are made of the pairs' own documents only, and go when these are compared."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        flt = spark.sparkContext.broadcast(bloom.build(ends, "doc_id", bloom.size_for(2 * pairs.count())))

        def sets_of(batches):  # one worker a task for both the filter and the sets
            for batch in batches:
                part = batch.filter(pa.array(bloom.might_contain(flt.value, batch.column(0).to_numpy(zero_copy_only=False)), pa.bool_()))
                if part.num_rows:
                    raw, bounds, _ = text_buffers(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(raw, bounds, width)], pa.binary())], ["doc_id", "elements"])
            release_memory()

        # what the filter lets pass beside them meets no pair
        sets = scratch.keep(docs.where(F.col("doc_id").isNotNull()).mapInArrow(sets_of, "doc_id bigint, elements binary"), "sets")
        p = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
        found = scratch.keep(p.select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint"), "links")
        drop(sets)
        return found

    links = verified(star)
    component = scratch.keep(connected_components(links, "a", "b"), "components")
    larger = members.where("size > 2 AND doc_id <> pivot")  # the pairs with a run's smallest member are decided
    tried = star
    for first in (FIRST_PAIRS, None):
        labelled = larger.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        split = labelled.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("run")
        opened = labelled.join(split, "run").join(info, "doc_id").select("run", "pivot", "doc_id", "component", "n", "sketch")
        opened = scratch.keep(opened, "opened")
        per_member = opened.groupBy("pivot", "doc_id").agg(F.count("*").alias("k"))
        many = per_member.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum("k") / SLICE).cast("int").alias("slices"))
        many = scratch.keep(many.where("blocks > 1 OR slices > 1"), "many")  # has a row for each so many members or rows only
        blocked = opened.join(F.broadcast(many) if many.count() <= MOST_BROADCAST else many, "pivot", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("blocks", "slices")})
        blocked = blocked.withColumn("slice", F.pmod(F.xxhash64("run"), F.col("slices")).cast("int"))
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        blocked = blocked.select("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "slice", "run", "doc_id", "component", "n", "sketch", "block")
        groups = blocked.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP, "run", "doc_id")
        pairs = scratch.keep(groups.mapInArrow(_cross_pairs(first), "a bigint, b bigint, pivot bigint").distinct(), "pairs")
        wanted = scratch.keep(pairs.where(F.col("a").isNotNull()).select("a", "b").join(tried, ["a", "b"], "left_anti"), "wanted")
        if not wanted.isEmpty():
            links = links.unionByName(verified(wanted))
            component = scratch.keep(connected_components(links, "a", "b"), "components")
        elif pairs.where(F.col("pivot").isNotNull()).isEmpty():  # no pivot has pairs left out
            break
        tried = tried.unionByName(pairs.where(F.col("a").isNotNull()).select("a", "b"))
        larger = larger.join(pairs.where(F.col("pivot").isNotNull()).select("pivot").distinct(), "pivot", "left_semi")

    classes = same.select("doc_id", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n").join(classes, "doc_id", "left")
    return out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
