"""BPE encoding and decoding by tree concatenation.

A text is halved until its parts are short, the parts are encoded on their own, and neighbours are joined bottom-up: the
text around each join is encoded again in a window that doubles until it agrees exactly with what both sides have there.

A stretch without white space (a long unsplit word), and any long text of a byte-level model, is halved between characters. There the
window has to share a token with the left part and a token with the right part, each of the same id at the same characters: two
neighbouring tokens of a valid BPE encoding stay neighbours in every valid encoding that has them side by side, so such a splice is the
encoding of the whole. Models that drop white space always end a pre-token there: their texts are halved between words, the window's first and
last word must have the ids that both sides have there, and what is between comes from the window. Words that come again are encoded once
and remembered, so the parts between joins are look-ups. A window that has grown to the whole of both parts is the whole encoding itself.

How a model splits and normalises is read from its file. One that is neither of these two kinds encodes each text whole.
Parts are encoded in parallel on the cores of a task (``spark.task.cpus``).

Nulls and empty texts have no tokens and decode to the empty string. Repeated rows give repeated results; extra columns
stay out of the way because only the named ones are read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.textblock import pieces, release_memory, text_buffers
from lodestar.session import document_batches

#: Unsplit stretches with more characters are halved.
LEAF_CHARS = 512
WINDOW_CHARS = 48
#: Texts with more words are halved, and windows between words begin with so many.
LEAF_WORDS = 1024
WINDOW_WORDS = 2
#: Words that a task remembers; beyond it starts anew.
MEMORY = 500_000
#: Texts are handled in batches of about so many bytes, which bounds a worker's memory.
BATCH_CHARS = 1_000_000

_MARK = re.compile(rb"(?<=[a-z])([,.;:!?])")

# How the two kinds of models normalise and split.
_WORD_RULES = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
WORDS, BYTES, WHOLE = range(3)


def kind_of(file: dict) -> int:
    """Whether a model drops white space and lower-cases (WORDS), splits bytes as they are (BYTES), or does anything else."""
    normal, split = file.get("normalizer"), file.get("pre_tokenizer") or {}
    if split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and normal is None:
        return BYTES
    steps = split.get("pretokenizers") or [{}]
    regex = (steps[0].get("pattern") or {}).get("Regex"), steps[0].get("behavior"), steps[0].get("invert")
    if (normal or {}).get("normalizers") == _WORD_RULES[0] and regex == (_WORD_RULES[1], "Removed", True) and [x.get("type") for x in steps[1:]] == ["ByteLevel"]:
        return WORDS
    return WHOLE


Node = tuple[np.ndarray, np.ndarray, np.ndarray]


class TreeEncoder:
    """Encodes with the tokenizers library's model at ``path``; special-token handling, truncation and padding unused."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        parts = {k: getattr(self.model, k) for k in ("normalizer", "pre_tokenizer")}
        self.kind = kind_of({k: json.loads(x.__getstate__()) if x is not None else None for k, x in parts.items()})
        self.model.no_truncation()
        self.model.no_padding()
        self.leaf, self.window = max(1, leaf_chars), max(1, window_chars)
        self.known: dict[bytes, bytes] = {}
        self.longest_added = max([0, *(len(t.content) for t in self.model.get_added_tokens_decoder().values())])

    def _nodes(self, parts: list[str], at: list[int]) -> list[Node]:
        nodes = []
        for e, start in zip(self.model.encode_batch(parts, add_special_tokens=False), at, strict=True):
            spans = np.array(e.offsets, np.int64).reshape(-1, 2) + start
            nodes.append((np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1]))
        return nodes

    def _cuts(self, text: str) -> list[int]:
        """Bounds of the leaves: halves of halves, each cut moved to white space if there is some close by."""
        out = [0]

        def halve(lo: int, hi: int) -> None:
            if hi - lo <= self.leaf:
                out.append(hi)
                return
            mid = (lo + hi) // 2
            near = min(256, self.leaf // 4)
            found = text.rfind(" ", max(lo + 1, mid - near), mid)
            mid = found if found > lo else mid
            halve(lo, mid)
            halve(mid, hi)

        halve(0, len(text))
        return out

    @staticmethod
    def _alone(node: Node) -> np.ndarray:
        """Whether a token shares no character with its neighbours, so that id and span name it."""
        _, s, e = node
        free = e > s
        free[1:] &= s[1:] >= e[:-1]
        free[:-1] &= e[:-1] <= s[1:]
        return free

    def _shared(self, part: Node, window: Node, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
        """Indices in part and window of a token that both have within the characters lo to hi."""
        ids, s, e = part
        a, b = np.searchsorted(s, lo), np.searchsorted(s, hi)
        free, other = self._alone(part), self._alone(window)
        known = {(int(window[0][k]), int(window[1][k]), int(window[2][k])): k for k in np.flatnonzero(other)}
        order = range(a, b) if not last else range(b - 1, a - 1, -1)
        for k in order:
            if free[k] and e[k] <= hi and (w := known.get((int(ids[k]), int(s[k]), int(e[k])))) is not None:
                return k, w
        return None

    def _join(self, text: str, left: Node, right: Node, lo: int, mid: int, hi: int) -> Node:
        width = max(self.window, 2 * self.longest_added)
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            window = self._nodes([text[a:b]], [a])[0]
            if a == lo and b == hi:
                return window
            margin = self.longest_added  # an added token is matched before the text is split, so it must be clear of the rims
            x = (0, 0) if a == lo else self._shared(left, window, a + margin, mid, last=False)
            y = (len(right[0]), len(window[0])) if b == hi else self._shared(right, window, mid, b - margin, last=True)
            if x and y and x[1] <= y[1]:
                return tuple(np.concatenate([p[: x[0]], w[x[1] : y[1]], q[y[0] :]]) for p, w, q in zip(left, window, right, strict=True))
            width *= 2

    def _merge(self, text: str, nodes: list[Node], cuts: list[int]) -> Node:
        """Joins neighbours level by level."""
        while len(nodes) > 1:
            joined, bounds = [], [cuts[0]]
            for k in range(0, len(nodes) - 1, 2):
                joined.append(self._join(text, nodes[k], nodes[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]))
                bounds.append(cuts[k + 2])
            if len(nodes) % 2:
                joined.append(nodes[-1])
                bounds.append(cuts[-1])
            nodes, cuts = joined, bounds
        return nodes[0]

    def _halved(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, whose parts are encoded together."""
        cuts = [self._cuts(t) for t in texts]
        parts = [(t[p:q], p) for t, c in zip(texts, cuts, strict=True) for p, q in zip(c, c[1:], strict=False)]
        nodes: list[Node] = []
        group = max(1, BATCH_CHARS // self.leaf)
        for j in range(0, len(parts), group):
            nodes += self._nodes(*map(list, zip(*parts[j : j + group], strict=True)))
        out, at = [], 0
        for t, c in zip(texts, cuts, strict=True):
            out.append(self._merge(t, nodes[at : at + len(c) - 1], c)[0] if t else np.zeros(0, np.uint32))
            at += len(c) - 1
        return out

    def unsplit(self, text: str) -> np.ndarray:
        """Ids of one stretch of text, halved between characters if it is long."""
        return self._halved([text])[0]

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words that are not known yet."""
        if len(self.known) + len(words) > MEMORY:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        short = [w for w in fresh if len(w) <= self.leaf]
        single, other = [], []
        for w in short:
            t = w.decode()
            # letters only, before and after the model's own normalisation: one pre-token
            (single if t.isalpha() and (t.isascii() or (t.lower().isalpha() and is_normalized("NFC", t))) else other).append(w)
        for lo in range(0, len(single), 10_000):
            groups = [single[k : k + 500] for k in range(lo, min(lo + 10_000, len(single)), 500)]
            for group, e in zip(groups, self.model.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids, at = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
                edge = np.searchsorted(at, np.arange(len(group) + 1))
                if at[-1] != len(group) - 1:
                    other += group
                    continue
                raw = ids.tobytes()
                self.known.update((w, raw[4 * p : 4 * q]) for w, p, q in zip(group, edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        for lo in range(0, len(other), 20_000):
            part = other[lo : lo + 20_000]
            for w, e in zip(part, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        for w in fresh:
            if len(w) > self.leaf:
                self.known[w] = self.unsplit(w.decode()).astype("<u4").tobytes()

    def _tree(self, words: list[bytes], ids: list[bytes], lo: int, hi: int) -> list[bytes]:
        """Ids of the words lo to hi: halves, and between them those of a window whose rims agree with both."""
        if hi - lo <= LEAF_WORDS:
            return ids[lo:hi]
        mid, width = (lo + hi) // 2, WINDOW_WORDS
        left, right = self._tree(words, ids, lo, mid), self._tree(words, ids, mid, hi)
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            window = self.unsplit(b" ".join(words[a:b]).decode()).astype("<u4").tobytes()
            parts = left[a - lo :] + right[: b - mid]
            if window == b"".join(parts):
                return left + right
            # a rim is a word that has its own ids still, not a part of an earlier window
            first, last = (ids[a] if a > lo else b""), (ids[b - 1] if b < hi else b"")
            rims = (a == lo or first and parts[0] == first) and (b == hi or last and parts[-1] == last)
            if rims and len(first) + len(last) <= len(window) and window.startswith(first) and window.endswith(last):
                inner = window[len(first) : len(window) - len(last)]
                new = [first, inner] + [b""] * (b - a - 3) + [last] if b - a > 2 else [window, b""]
                return left[: a - lo] + new + right[b - mid :]
            width *= 2

    def _split(self, text: bytes) -> list[bytes]:
        """Words between ASCII white space (they can hold other white space); a mark after an ASCII letter, where a pre-token always
        ends, is set apart, and A-Z are lower-cased, as the model does itself, unless they might belong to an added token."""
        if b"<|" not in text:
            text = text.lower()
        return _MARK.sub(rb" \1", text).split()

    def encode_bytes(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
        if self.kind == WHOLE:
            return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if self.kind == BYTES:
            return [x.astype("<u4").tobytes() for x in self._halved([t.decode() for t in texts])]
        split = [self._split(t) for t in texts]
        self._learn({w for words in split for w in words} - self.known.keys())
        out = []
        for words in split:
            try:
                ids = list(map(self.known.__getitem__, words))
            except KeyError:  # the memory was emptied in between
                self._learn(set(words))
                ids = list(map(self.known.__getitem__, words))
            out.append(b"".join(self._tree(words, ids, 0, len(words))))
        return out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BATCH_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            for ids in self.encode_bytes([(t or "").encode() for t in texts[lo:hi]]):
                yield np.frombuffer(ids, "<u4")
            lo = hi

    def decode(self, many: list[np.ndarray]) -> list[str]:
        return self.model.decode_batch([x.tolist() for x in many], skip_special_tokens=False)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True, digests: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row for each row of ``df``: the id, ``n_tokens`` and, as asked for, ``ids`` (array<int>), ``decoded`` and their SHA-256 digests.

    ``tokenizer`` is the path of the model's JSON file on every executor.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    cols = [f"`{id_col}` {id_type}", "n_tokens bigint"] + ["ids array<int>"] * keep_ids + ["decoded string"] * keep_decoded + ["ids_sha256 string", "decoded_sha256 string"] * digests
    document_batches(df.sparkSession)
    threads = int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))
    source = df.select(id_col, text_col)

    def run(batches):
        coder = TreeEncoder(tokenizer, leaf_chars, threads=threads)
        for batch in batches:
            raw, bounds, _ = text_buffers(batch.column(1))
            for lo, hi in pieces(bounds, BATCH_CHARS):
                coded = coder.encode_bytes([raw[bounds[k] : bounds[k + 1]].tobytes() for k in range(lo, hi)])
                ids = [np.frombuffer(x, "<u4") for x in coded]
                out = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64())]
                text = coder.decode(ids) if keep_decoded or digests else []
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                if keep_decoded:
                    out.append(pa.array(text, pa.string()))
                if digests:
                    out.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()))
                    out.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [id_col, "n_tokens"] + ["ids"] * keep_ids + ["decoded"] * keep_decoded + ["ids_sha256", "decoded_sha256"] * digests)
        del coder
        release_memory()  # the worker lives on and serves other operators

    return source.mapInArrow(run, ", ".join(cols))
