"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names (capitalised words inside a sentence, several in a row as one) and
units after a number are typed placeholders, other words are themselves in lower case (of one- and two-byte characters). Windows of WIDTH tokens with
enough literal words are hashed; windows of the corpus that a blocked Bloom filter of the benchmark's windows lets pass are
hash-joined with them. A document and an item match if the matching windows on one alignment cover enough of the item
and its slots are filled consistently: equal slot values of the item stand for equal ones of the document, and different ones
for different ones. So re-parameterised questions are found as well as verbatim ones.

All windows are also taken with names as literal words, which no change of case hides; the better alignment counts.
Items that are short, or have windows with too few literal words, also give windows of their single words as they are (in lower case), which
match exact copies at any length and any number of slots; so a one-word item matches each text that has the word. In scripts that
don't set words apart (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is a word.

The windows of one document, item and alignment are judged together; an item's length bounds them, however often a text repeats the item.
The best alignment of an id and an item is then an aggregate. Of equally good ones, that by templates counts, then the one with more
windows, then the first.

Null and empty texts match nothing. An item with fewer than WIDTH tokens is one window of its own length: of template tokens if it has
SHORTEST of them at least, and of single words. Long texts are read whole. Rows that repeat an id with other texts are judged each; an id
(null too) and an item give one row. Ids may be of any type. Extra columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bloom
from lodestar.llm.textblock import U64, pieces, sorted_groups, text_buffers, window_hashes, word_hashes
from lodestar.session import document_batches, shuffle_partitions

WIDTH = 8
SHORTEST = 5
#: Literal words that a window must have.
LITERALS = 4
#: Share of an item's tokens that matching windows must cover.
COVERAGE = 0.5

# Units of measure that follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds usd eur degree degrees hz khz mhz ghz kb mb gb tb w kw v".split()

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True
#: Between two words of one sentence there may be spaces, commas, hyphens and apostrophes only.
_ENDS = np.ones(256, bool)
_ENDS[[ord(c) for c in " \t,-'&/"]] = False

#: Second bytes of the characters of scripts without spaces, by first byte.
_UNSPACED = {0xE0: [(0xB8, 0xBB)], 0xE1: [(0x80, 0x82), (0x9E, 0x9F)], 0xE3: [(0x81, 0xBF)], **{lead: [(0x80, 0xBF)] for lead in range(0xE4, 0xEA)}}

#: Lower case of the two-byte code points, where it has two bytes too.
_FOLD = np.arange(0x800)
_FOLD[0x80:] = [ord(x) if len(x := chr(c).lower()) == 1 and 0x80 <= ord(x) < 0x800 else c for c in range(0x80, 0x800)]

LITERAL, NUMBER, NAME, UNIT = range(4)
#: Kinds of windows.
TEMPLATE, VERBATIM, FOLDED = range(3)
_PLACE = {NUMBER: U64(0x4E554D4245523031), NAME: U64(0x4E414D45303030F1), UNIT: U64(0x554E495430303031)}
_unit_hashes = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
        _unit_hashes = np.sort(word_hashes(data, ends - [len(u) for u in UNITS], ends))
    return _unit_hashes


def fold_case(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with upper-case two-byte characters in lower case, and whether an upper-case letter begins at each byte."""
    upper = _UPPER[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF)) if len(data) > 1 else np.zeros(0, np.int64)
    if len(lead):
        point = (data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
        low = _FOLD[point]
        change = low != point
        if change.any():
            data, at, low = data.copy(), lead[change], low[change]
            data[at], data[at + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
            upper[at] = True
    return data, upper


def _unspaced(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where a character of a script without spaces begins. Marks of these scripts are no words any more."""
    at = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] <= 0xEF)) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return at
    lead, second, third = data[at], data[at + 1], data[at + 2]
    wide = (lead == 0xEF) & (second == 0xBC) & (((third >= 0x81) & (third <= 0x8F)) | (third >= 0x9A) & (third <= 0xA0))
    for mark in at[wide | ((lead == 0xE3) & (second == 0x80))]:
        word[mark : mark + 3] = False
    alone = np.zeros(len(at), bool)
    for first, ranges in _UNSPACED.items():
        for lo, hi in ranges:
            alone |= (lead == first) & (second >= lo) & (second <= hi)
    return at[alone]


def single_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, value hash, whether a sentence begins) of all words, and for each document the index of its first (one more at the end)."""
    word = _ALNUM[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        word[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    alone = _unspaced(data, word)
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[alone] = last[alone + 2] = True
        before, after = alone[alone > 0] - 1, alone[alone + 3 < len(data)] + 3
        last[before], first[after] = word[before], word[after]
        filled = bounds[1:] > bounds[:-1]
        head, tail = bounds[:-1][filled], bounds[1:][filled] - 1
        first[head], last[tail] = word[head], word[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, bounds)
    folded, upper = fold_case(data)
    value = word_hashes(folded, starts, ends, lower=True)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int8), value, np.zeros(0, bool), at
    kind = np.zeros(n, np.int8)
    kind[_DIGIT[data[starts]]] = NUMBER
    doc_first = np.zeros(n, bool)
    doc_first[at[:-1][at[1:] > at[:-1]]] = True
    ending = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_ENDS[data] & ~word, out=ending[1:])
    fresh = doc_first.copy()
    fresh[1:] |= ending[starts[1:]] > ending[ends[:-1]]
    lower = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_LOWER[data], out=lower[1:])
    high = upper[starts]
    kind[high & ~fresh & (lower[ends] > lower[starts]) & (kind == LITERAL)] = NAME
    after = np.zeros(n, bool)
    after[1:] = (kind[:-1] == NUMBER) & ~doc_first[1:]
    if after.any():
        unit = np.flatnonzero(after & (kind == LITERAL))
        kind[unit[np.isin(value[unit], _units())]] = UNIT
    return kind, value, fresh, at


def folded_template(kind: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, kind) of words whose names are literals, so that both are the same in any case."""
    after = np.zeros(len(kind), bool)
    after[1:] = kind[:-1] == NUMBER
    after[at[:-1][at[1:] > at[:-1]]] = False
    unit = np.flatnonzero(after & (kind == NAME))
    kind = np.where(kind == NAME, np.int8(LITERAL), kind)
    kind[unit[np.isin(value[unit], _units())]] = UNIT
    hashed = value.copy()
    for k in (NUMBER, UNIT):
        hashed[kind == k] = _PLACE[k]
    return hashed, kind


def joined_names(kind: np.ndarray, value: np.ndarray, fresh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``template`` of words, and the index of each token's first word."""
    n = len(kind)
    group = np.arange(n)
    again = np.zeros(n, bool)
    again[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~fresh[1:]
    if again.any():
        group = np.flatnonzero(~again)
        step = (np.arange(n) - np.maximum.accumulate(np.where(again, 0, np.arange(n)))).astype(np.uint64)
        value = np.add.reduceat(value * (step * U64(2) + U64(1)), group)
        kind = kind[group]
        at = np.searchsorted(group, at)
    hashed = value.copy()
    for k, place in _PLACE.items():
        hashed[kind == k] = place
    return hashed, kind, value, at, group


def template(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, kind, value hash) of all tokens, and for each document the index of its first (one more at the end)."""
    return joined_names(*single_words(data, bounds))[:4]


def windows(hashed: np.ndarray, kind: np.ndarray, at: np.ndarray, width: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first token, hash) of the windows inside documents that have enough literal words, or ``least``."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    literal = np.zeros(len(kind) + 1, np.int32)
    np.cumsum(kind == LITERAL, out=literal[1:])
    ok = literal[width:] - literal[:-width] >= (min(LITERALS, width - 1) if least is None else least)
    for k in range(1, width):  # windows that would run into the next document
        cut = at[1:] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    found = np.flatnonzero(ok)
    return found, window_hashes(hashed, width)[found] ^ U64(width)


_HIT = pa.schema([("h", pa.int64()), ("pos", pa.int32()), ("token", pa.int32()), ("slots", pa.binary()), ("kind", pa.int32()), ("width", pa.int32()), ("tokens", pa.int32())])
_HIT_DDL = "h bigint, pos int, token int, slots binary, kind int, width int, tokens int"


def _sparse(count: np.ndarray, n_words: np.ndarray, found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an item is short, or has a template window with too few literal words."""
    owner = np.searchsorted(at, found, "right") - 1
    return (n_words <= WIDTH) | (count < WIDTH) | (np.bincount(owner, minlength=len(count)) < count - WIDTH + 1)


def _rows(batches, shapes, words):
    """One row for each window: its document's id and key, hash, position in tokens of its kind and in template tokens, and slot values (8 bytes
    a token, 0 for literals). ``shapes``: the (kind, width) to look for. ``words``: a Bloom filter's, or None for all windows of items."""
    for batch in batches:
        raw, bounds, _ = text_buffers(batch.column(2))
        for lo, hi in pieces(bounds):
            single, plain, fresh, first = single_words(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            hashed, kind, value, at, group = joined_names(single, plain, fresh, first)
            slot = np.where(kind == LITERAL, U64(0), value | U64(1))
            count = at[1:] - at[:-1]
            folded, case_kind = folded_template(single, plain, first)
            if words is None:
                sparse = _sparse(count, first[1:] - first[:-1], windows(hashed, kind, at, WIDTH)[0], at)
            for form, width in shapes:
                if form == TEMPLATE:
                    begin, n, slots, (found, h) = at, count, slot, windows(hashed, kind, at, width)
                else:
                    shown = (case_kind == NUMBER) | ((case_kind == UNIT) & (form == FOLDED))
                    begin, n, slots = first, first[1:] - first[:-1], np.where(shown, plain | U64(1), U64(0))
                    found, h = windows(folded, case_kind, first, width) if form == FOLDED else windows(plain, single, first, width, 0)
                h = h ^ U64(form << 8)
                if words is not None and len(found):
                    keep = bloom.might_contain(words, h.view(np.int64))
                    found, h = found[keep], h[keep]
                owner = np.searchsorted(begin, found, "right") - 1
                if words is None:  # an item has windows of WIDTH, or one of its own length
                    keep = (n[owner] == width) if width < WIDTH else np.ones(len(found), bool)
                    if form == VERBATIM:
                        keep &= sparse[owner]
                    found, h, owner = found[keep], h[keep], owner[keep]
                elif form == VERBATIM and width < WIDTH and len(found):  # whole items: the first copy in a document says it all
                    keep = np.sort(np.unique(np.stack([owner.astype(U64), h], axis=1), axis=0, return_index=True)[1])
                    found, h, owner = found[keep], h[keep], owner[keep]
                if not len(found):
                    continue
                token = found if form == TEMPLATE else np.searchsorted(group, found, "right") - 1
                mine = pa.array(lo + owner)
                values = [h.view(np.int64), found - begin[owner], token - at[owner], [slots[f : f + width].tobytes() for f in found.tolist()], np.full(len(found), form), np.full(len(found), width), n[owner]]
                columns = [pa.array(v, t.type) if isinstance(v, list) else pa.array(v).cast(t.type) for v, t in zip(values, _HIT, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), batch.column(1).take(mine), *columns], ["id", "doc", *_HIT.names])


def _consistent(pairs: list[tuple[int, int]]) -> bool:
    """Whether the (item value, document value) pairs are a one-to-one mapping."""
    one, other = {}, {}
    return all(one.setdefault(a, b) == b and other.setdefault(b, a) == a for a, b in pairs)


_ALIGNED = ["doc", "item", "align", "by_word"]
_JUDGED = pa.schema([("coverage", pa.float64()), ("n_windows", pa.int64()), ("at_token", pa.int64()), ("reparameterised", pa.bool_()), ("by_word", pa.int32()), ("align", pa.int32())])


def _judge(batches):
    """Of the matching windows, sorted by alignment, the alignments that are good enough."""
    for group in sorted_groups(batches, _ALIGNED):
        covered: set[int] = set()
        pairs = set()
        places, widths = group.column("item_pos").to_pylist(), group.column("width").to_pylist()
        for p, w, a, b in zip(places, widths, group.column("item_slots").to_pylist(), group.column("slots").to_pylist(), strict=True):
            covered.update(range(p, p + w))
            if a.strip(b"\0"):
                x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
                pairs |= {(int(x[k]), int(y[k])) for k in np.flatnonzero(x)}
        share = len(covered) / group.column("item_tokens")[0].as_py()
        if share >= COVERAGE and _consistent(sorted(pairs)):
            row = (share, len(set(places)), min(group.column("token").to_pylist()), any(a != b for a, b in pairs), group.column("by_word")[0].as_py(), group.column("align")[0].as_py())
            columns = [pa.array([v], t.type) for v, t in zip(row, _JUDGED, strict=True)]
            yield pa.RecordBatch.from_arrays([group.column("id").chunk(0).slice(0, 1), group.column("item_id").chunk(0).slice(0, 1), *columns], ["id", "item_id", *_JUDGED.names])


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, coverage, n_windows, at_token, reparameterised) of each document and benchmark item that match."""
    spark = df.sparkSession
    document_batches(spark)
    id_type, item_type = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()

    def keyed(rows: DataFrame, i: str, t: str) -> DataFrame:
        return rows.select(F.col(i).alias("id"), F.xxhash64(i, t).alias("doc"), F.col(t).alias("text"))

    shapes = [(k, w) for k in (TEMPLATE, FOLDED) for w in range(SHORTEST, WIDTH + 1)] + [(VERBATIM, w) for w in range(1, WIDTH + 1)]
    items = keyed(benchmark, item_id_col, item_text_col).mapInArrow(lambda b: _rows(b, shapes, None), f"id {item_type}, doc bigint, {_HIT_DDL}")
    items = items.select(F.col("id").alias("item_id"), F.col("doc").alias("item"), "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"), F.col("kind").alias("item_kind"), F.col("width").alias("item_width"))
    found = items.agg(F.count("*").alias("n"), F.collect_set(F.struct("item_kind", "item_width")).alias("w")).first()
    words = spark.sparkContext.broadcast(bloom.build(items, "h", bloom.size_for(found["n"])))
    present = sorted(tuple(x) for x in found["w"]) or [(TEMPLATE, WIDTH)]
    hits = keyed(df, id_col, text_col).mapInArrow(lambda b: _rows(b, present, words.value), f"id {id_type}, doc bigint, {_HIT_DDL}")
    joined = hits.join(items, (hits["h"] == items["h"]) & (F.col("kind") == F.col("item_kind")) & (F.col("width") == F.col("item_width")))
    joined = joined.select("id", "doc", "item_id", "item", (F.col("pos") - F.col("item_pos")).alias("align"), (F.col("kind") != TEMPLATE).cast("int").alias("by_word"), "item_pos", "width", "item_slots", "slots", "item_tokens", "token")
    aligned = joined.repartition(shuffle_partitions(spark), *_ALIGNED).sortWithinPartitions(*_ALIGNED)
    good = aligned.mapInArrow(_judge, f"id {id_type}, item_id {item_type}, coverage double, n_windows bigint, at_token bigint, reparameterised boolean, by_word int, align int")
    best = F.max_by(F.struct("coverage", "n_windows", "at_token", "reparameterised"), F.struct(F.col("coverage"), -F.col("by_word"), F.col("n_windows"), -F.col("align"), -F.col("at_token"), "reparameterised"))
    return good.groupBy("id", "item_id").agg(best.alias("best")).select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), "best.*")
