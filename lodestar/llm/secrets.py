"""Secret scanning with one combined deterministic automaton.

The rules, a small regex dialect over bytes, are compiled to one NFA; subset construction and Moore minimisation give
one transition array for "some rule has matched so far". A batch of texts is cut into lanes at bytes that send every
state back to the start, and all lanes advance together, one array lookup a byte, whatever the number of rules. Only
the lanes that end in the accepting state are looked at again, by one small automaton for each rule, for the exact
leftmost, longest, non-overlapping spans.

Nulls and empty texts have no secrets. Long texts are scanned whole, whatever their length. Repeated rows give repeated
results; extra columns are not read, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.textblock import code_points, pieces, text_buffers
from lodestar.session import document_batches

LANE = 192


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` has literals, classes, groups, alternation and ? * + {n,}; ``search`` is what must
    occur somewhere in a span that is kept: the pattern with repeat counts, lower than those needed, as each count
    multiplies the states. A span is kept if it has ``least``
    characters after the text that ``head`` matches at its start."""

    kind: str
    pattern: str
    search: str
    least: int = 0
    head: str = ""
    fold: bool = False


# The three base kinds of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{4,}", 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{12,}", 24),
)
# Further kinds, from public documentation of the issuers' token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{4,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{4,}", 15),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Nfa:
    """Thompson's construction. A state is a list of (set of bytes or None, target)."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, a: int, label: frozenset[int] | None, b: int) -> None:
        self.moves[a].append((label, b))

    def build(self, node: tuple, fold: bool) -> tuple[int, int]:
        kind = node[0]
        a, b = self.state(), self.state()
        if kind == "set":
            chars = set(node[1])
            if fold:
                chars |= {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
            self.add(a, frozenset(chars), b)
        elif kind == "seq":
            at = a
            for part in node[1]:
                x, y = self.build(part, fold)
                self.add(at, None, x)
                at = y
            self.add(at, None, b)
        elif kind == "or":
            for part in node[1]:
                x, y = self.build(part, fold)
                self.add(a, None, x)
                self.add(y, None, b)
        else:  # ("many", part, least, unbounded)
            at = a
            for _ in range(node[2]):
                x, y = self.build(node[1], fold)
                self.add(at, None, x)
                at = y
            if node[3] is None:
                x, y = self.build(node[1], fold)
                self.add(at, None, x)
                self.add(y, None, x)
                self.add(y, None, b)
            elif node[3]:
                x, y = self.build(node[1], fold)
                self.add(at, None, x)
                self.add(y, None, b)
            self.add(at, None, b)
        return a, b

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += [t for label, t in self.moves[s] if label is None]
        return frozenset(seen)


def parse(pattern: str) -> tuple:
    """The tree of a pattern: ("set", bytes), ("seq", parts), ("or", parts) or ("many", part, least, most more: None, 1 or 0)."""
    pos = 0

    def char() -> int:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c != "\\":
            return ord(c)
        c = pattern[pos]
        pos += 1
        if c == "x":
            pos += 2
            return int(pattern[pos - 2 : pos], 16)
        return ord(c)

    def either() -> tuple:
        nonlocal pos
        parts = [sequence()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence() -> tuple:
        nonlocal pos
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            if pattern[pos] == "(":
                pos += 1
                part = either()
                pos += 1
            elif pattern[pos] == "[":
                pos += 1
                found: set[int] = set()
                while pattern[pos] != "]":
                    c = char()
                    if pattern[pos] == "-" and pattern[pos + 1] != "]":
                        pos += 1
                        found |= set(range(c, char() + 1))
                    else:
                        found.add(c)
                pos += 1
                part = ("set", frozenset(found))
            else:
                part = ("set", frozenset([char()]))
            if pos < len(pattern) and pattern[pos] in "?*+":
                part = ("many", part, int(pattern[pos] == "+"), 1 if pattern[pos] == "?" else None)
                pos += 1
            elif pos < len(pattern) and pattern[pos] == "{":
                close = pattern.index("}", pos)
                low, _, high = pattern[pos + 1 : close].partition(",")
                part = ("many", part, int(low), None if "," in pattern[pos:close] and not high else 0)
                pos = close + 1
            parts.append(part)
        return ("seq", parts)

    tree = either()
    if pos != len(pattern):
        raise ValueError(f"unbalanced pattern: {pattern}")
    return tree


def _classes(nfa: _Nfa) -> np.ndarray:
    """Number of the class of each byte: bytes that no move tells apart share one."""
    labels = {label for moves in nfa.moves for label, _ in moves if label is not None}
    number = np.zeros(256, np.int64)
    for label in labels:
        member = np.isin(np.arange(256), list(label)).astype(np.int64)
        number = np.unique(number * 2 + member, return_inverse=True)[1]
    return number.astype(np.uint8)


def determinise(patterns: list[tuple[str, bool]], anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, transition array [state, class], accepting) of the minimal automaton; state 0 is the start.

    ``anywhere``: accepts, for good, once some pattern has matched at any place. Else it matches from the first byte and
    the last state is dead.
    """
    nfa = _Nfa()
    start, final = nfa.state(), nfa.state()
    for pattern, fold in patterns:
        a, b = nfa.build(parse(pattern), fold)
        nfa.add(start, None, a)
        nfa.add(b, None, final)
    byte_class = _classes(nfa)
    samples = [int(np.flatnonzero(byte_class == k)[0]) for k in range(int(byte_class.max()) + 1)]
    first = nfa.closure([start])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        here = todo.pop(0)
        row = []
        for byte in samples:
            if anywhere and final in here:
                to = here
            else:
                to = nfa.closure({t for s in here for label, t in nfa.moves[s] if label and byte in label} | ({start} if anywhere else set()))
                if anywhere and final in to:
                    to = frozenset([final])
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table, accept = np.array(rows), np.array([final in s for s in number])
    part = accept.astype(np.int64)
    while True:  # Moore: split blocks until their members move alike
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    seen: list[int] = []
    for s, p in enumerate(part):
        if order[p] < 0:
            order[p] = len(seen)
            seen.append(s)
    return byte_class, order[part[table[seen]]], accept[seen]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        byte_class, table, accept = determinise([(r.search, r.fold) for r in rules], anywhere=True)
        self.width = 1 << int(table.shape[1] - 1).bit_length()
        padded = np.zeros((len(table), self.width), np.int32)
        padded[:, : table.shape[1]] = table * self.width
        self.byte_class, self.moves = byte_class, padded.ravel()
        self.hit = int(np.flatnonzero(accept)[0]) * self.width
        live = [s for s in range(len(table)) if not accept[s]]
        back = np.array([np.all(table[live, k] == table[0, k]) for k in range(table.shape[1])])
        self.resets = back[byte_class]
        self.single = [(determinise([(r.pattern, r.fold)], False), determinise([(r.head, r.fold)], False) if r.head else None) for r in rules]
        for (c, t, a), _ in self.single:
            if a[0]:
                raise ValueError("a rule must not match the empty string")

    def lanes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of lanes: documents, and the first byte after a reset in each stretch of LANE bytes."""
        reset = np.flatnonzero(self.resets[data]) + 1
        if len(reset):
            block = reset // LANE
            reset = reset[np.r_[True, block[1:] != block[:-1]]]
        starts = np.unique(np.concatenate([bounds[:-1], reset]))
        return starts[starts < len(data)]

    def suspects(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lanes in which some rule matches."""
        starts = self.lanes(data, bounds)
        ends = np.append(starts[1:], len(data))
        order = np.argsort(starts - ends, kind="stable")
        s, size = starts[order], (ends - starts)[order]
        classes = self.byte_class[data]
        state = np.zeros(len(s), np.int32)
        step, active = 0, len(s)
        shortest = size[::-1]
        while active:
            active = len(s) - int(np.searchsorted(shortest, step, "right"))
            if active < 48:
                break
            now = state[:active]
            now += classes[s[:active] + step]
            state[:active] = self.moves[now]
            step += 1
        if active:
            moves, hit = self.moves.tolist(), self.hit
            for k in range(active):
                at = int(state[k])
                for c in classes[s[k] + step : s[k] + size[k]].tolist():
                    at = moves[at + c]
                    if at == hit:
                        break
                state[k] = at
        found = np.sort(order[state == self.hit])
        return starts[found], ends[found]

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of all kept spans of one lane: leftmost, longest, non-overlapping within a rule."""
        out = []
        for r, ((classes, table, accept), head) in enumerate(self.single):
            row, ok, name = table.tolist(), accept.tolist(), classes.tolist()
            dead = [not ok[s] and all(t == s for t in row[s]) for s in range(len(row))]
            begin = [not dead[row[0][name[b]]] for b in range(256)]
            pos = 0
            while pos < len(raw):
                if not begin[raw[pos]]:
                    pos += 1
                    continue
                state, end, k = 0, -1, pos
                while k < len(raw):
                    state = row[state][name[raw[k]]]
                    if dead[state]:
                        break
                    k += 1
                    if ok[state]:
                        end = k
                if end < 0:
                    pos += 1
                    continue
                body = pos + (self._prefix(head, raw, pos, end) if head else 0)
                if end - body >= self.rules[r].least:
                    out.append((pos, end, r))
                pos = end
        return out

    @staticmethod
    def _prefix(head: tuple, raw: bytes, pos: int, end: int) -> int:
        """Length of the longest head that leaves at least one byte for the value."""
        classes, table, accept = head
        state, best = 0, 0
        for k in range(pos, end - 1):
            state = int(table[state, classes[raw[k]]])
            if accept[state]:
                best = k + 1 - pos
        return best

    def byte_spans(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each document with secrets its spans (start, end in bytes of it, rule), by start, then rule."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if len(data):
            for a, b in zip(*(x.tolist() for x in self.suspects(data, bounds)), strict=True):
                doc = int(np.searchsorted(bounds, a, "right")) - 1
                shift = a - int(bounds[doc])
                if spans := self.spans(data[a:b].tobytes()):
                    found.setdefault(doc, []).extend((s + shift, e + shift, r) for s, e, r in spans)
        for spans in found.values():
            spans.sort(key=lambda x: (x[0], x[2]))
        return found

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document its spans (start, end in code points, rule), by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
        for doc, spans in self.byte_spans(data, bounds).items():
            points = code_points(data[bounds[doc] : bounds[doc + 1]])
            out[doc] = [(int(points[s]), int(points[e]), r) for s, e, r in spans]
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``df``: its id and ``secrets``, an array of (kind, start, end), code points, end exclusive,
    by start, then by the rules' order."""
    document_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        scan, names = scanner(rules), [r.kind for r in rules]
        for batch in batches:
            raw, bounds, _ = text_buffers(batch.column(1))
            found: list = []
            for lo, hi in pieces(bounds):
                found += scan.scan(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            spans = [[{"kind": names[r], "start": s, "end": e} for s, e, r in doc] for doc in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "secrets"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


MASK = b"[secret]"


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with each secret in its text replaced by MASK, overlapping ones by one, and the length column, if there is one, brought in line.

    All columns are passed on as they are, so clashing names can't arise.
    """
    document_batches(df.sparkSession)
    names = df.columns
    at, long_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            raw, bounds, _ = text_buffers(batch.column(at))
            changed: dict[int, bytes] = {}
            for lo, hi in pieces(bounds):
                data, part = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                for k, spans in scan.byte_spans(data, part).items():
                    text, out, done = data[part[k] : part[k + 1]].tobytes(), [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            out += [text[done:s], MASK]
                        done = max(done, e)
                    changed[lo + k] = b"".join([*out, text[done:]])
            if changed:
                columns = list(batch.columns)
                texts = columns[at].to_pylist()
                for k, t in changed.items():
                    texts[k] = t.decode()
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if long_at >= 0:
                    sizes = columns[long_at].to_pylist()
                    for k in changed:
                        sizes[k] = len(texts[k]) if sizes[k] is not None else None
                    columns[long_at] = pa.array(sizes, batch.schema.field(long_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return df.mapInArrow(run, df.schema)
