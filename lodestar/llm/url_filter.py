"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list has entries of a host and the beginning of a path, written together (``example.net/en/``): rules, which are taken as they are, and
listed URLs, which are brought to a canonical form, as are the pages' URLs that are compared with them. An entry fits its host and all
subdomains, if the path begins with the entry's. So each URL stands for the entries of its host and every parent domain (no more labels than
an entry has), each with the beginnings of its path that are as long as some entry's. Their hashes are made in one pass over the URL; the
Bloom filter drops nearly all that are not listed before anything is shuffled, and the exact join on host and path removes its
false positives. Rules come before listed URLs; among rules, and among listed URLs, the longest entry wins, then the one with the longer host.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on from there up to ``?``, ``#`` or the
end. The canonical host has no user info, port, escapes or final dots and is in lower case; the canonical path has no escapes of unreserved
characters, other escapes in upper case, and no ``.`` and ``..`` segments; an empty one is ``/``.

A null URL or one without ``://`` has an empty host and path, and is allowed. Long URLs are taken whole. Repeated rows
get a verdict each; of an entry that a list has more than once the smallest action counts (allow before block). Extra columns of the table
are not read. With empty tables the result is empty; with an empty list all is allowed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bloom
from lodestar.llm.textblock import U64, mix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNRESERVED = _UPPER + _LOWER + "0123456789-._~"
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_PORT = re.compile(r":\d*$")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: str) -> str:
    host = _ESCAPES.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), host.rpartition("@")[2])
    return _PORT.sub("", host).rstrip(".").lower()


def _unescape(m: re.Match) -> str:
    codes = m[0][1:].split("%")
    return "".join(c if (c := chr(int(x, 16))) in UNRESERVED else f"%{x.upper()}" for x in codes)


def canonical_path(path: str) -> str:
    path = _ESCAPES.sub(_unescape, path)
    if "/." in path:
        out: list[str] = []
        segments = path.split("/")[1:]
        for s in segments:
            if s == "..":
                del out[-1:]
            elif s != ".":
                out.append(s)
        path = "".join(f"/{s}" for s in out) + ("/" if segments[-1] in (".", "..") else "")
    return path or "/"


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode())


def _keys(hosts: list[int], paths: list[int]) -> np.ndarray:
    """Keys of entries with these hashes of hosts and paths."""
    return mix(mix(np.array(hosts, U64)) + np.array(paths, U64)).view(np.int64)


def _entries(batches):
    for batch in batches:
        hosts, paths, actions, rules = (c.to_pylist() for c in batch.columns)
        pairs = [(h, p) if r else (canonical_host(h), canonical_path(p)) for h, p, r in zip(hosts, paths, rules, strict=True)]
        keys = _keys([_host_hash(h) for h, _ in pairs], [xxhash.xxh64_intdigest(p.encode()) for _, p in pairs])
        columns = [pa.array([h for h, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()), pa.array(actions, pa.string()), pa.array(rules, pa.bool_()), pa.array(keys)]
        yield pa.RecordBatch.from_arrays(columns, ["e_host", "e_path", "action", "is_rule", "k"])


def candidates(host: str, path: str, labels: int, lengths: list[int]) -> tuple[list[str], list[int], list[int], list[int]]:
    """(hosts, their hashes, lengths of path beginnings, their hashes) of the entries that would fit."""
    hosts, at = [], len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, at)
        hosts.append(host[at + 1 :])
        if at < 0:
            break
    running, last, sizes, hashes = xxhash.xxh64(), 0, [], []
    for size in lengths:
        if size > len(path):
            break
        running.update(path[last:size].encode())
        last = size
        sizes.append(size)
        hashes.append(running.intdigest())
    return hosts, [_host_hash(h) for h in hosts], sizes, hashes


_HITS = pa.schema([(c, pa.string()) for c in ("host", "path", "e_host", "e_path")] + [("is_rule", pa.bool_())])


def _possible(words, shapes: dict[bool, tuple[int, list[int]]]):
    """The entries that a URL's (host, path) may have, as far as the filter can tell. ``shapes``: most labels and path lengths of rules and others."""

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            hosts: list[int] = []
            paths: list[int] = []
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for is_rule, (labels, lengths) in shapes.items():
                    h, p = (host, path) if is_rule else (canonical_host(host), canonical_path(path))
                    for name, a in zip(*(c := candidates(h, p, labels, lengths))[:2], strict=True):
                        found += [(host, path, name, p, size, is_rule) for size in c[2]]
                        hosts += [a] * len(c[2])
                        paths += c[3]
            hit = np.flatnonzero(bloom.might_contain(words.value, _keys(hosts, paths))) if found else []
            rows = [found[k] for k in hit]
            if rows:
                cut = [(host, path, name, p[:size], is_rule) for host, path, name, p, size, is_rule in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*cut, strict=True), _HITS, strict=True)], schema=_HITS)

    return run


def listed_urls(urls: DataFrame, url_col: str = "url", action: str = "block") -> DataFrame:
    """Entries of a table of listed URLs. URLs without a host are left out."""
    host, path = host_and_path(F.col(url_col))
    return urls.select(host.alias("host"), path.alias("path"), F.lit(action).alias("action"), F.lit(False).alias("is_rule")).where("host <> ''")


def verdicts(df: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, listed, verdict) of each row. ``entries`` has host, path, action (allow or block) and is_rule."""
    spark = df.sparkSession
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    listed = entries.select("host", "path", "action", "is_rule").mapInArrow(_entries, "e_host string, e_path string, action string, is_rule boolean, k bigint")
    listed = listed.groupBy("e_host", "e_path", "is_rule").agg(F.min("action").alias("action"), F.first("k").alias("k"))
    kinds = listed.groupBy("is_rule").agg(F.count("*").alias("n"), F.max(F.size(F.split("e_host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.char_length("e_path"))).alias("lengths")).collect()
    words = spark.sparkContext.broadcast(bloom.build(listed, "k", bloom.size_for(sum(r["n"] for r in kinds))))
    shapes = {r["is_rule"]: (r["labels"], r["lengths"]) for r in kinds}

    distinct = pages.where(F.col("host") != "").select("host", "path").distinct()
    hits = distinct.mapInArrow(_possible(words, shapes), "host string, path string, e_host string, e_path string, is_rule boolean")
    fit = hits.join(listed.select("e_host", "e_path", "is_rule", "action", F.concat("e_host", "e_path").alias("entry")), ["e_host", "e_path", "is_rule"])

    def best(which):
        return F.max_by(F.struct("entry", "action"), F.when(which, F.struct(F.char_length("entry"), F.char_length("e_host"))))

    decided = fit.groupBy("host", "path").agg(best(F.col("is_rule")).alias("rule"), best(~F.col("is_rule")).alias("other"))
    out = pages.join(decided, ["host", "path"], "left")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", F.col("rule.entry").alias("rule"), F.col("other.entry").alias("listed"),
        F.coalesce("rule.action", "other.action", F.lit("allow")).alias("verdict"),
    )
