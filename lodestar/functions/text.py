"""Expressions on source text, identifiers, callees and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


_WORD = "[A-Za-z0-9_]"
ASCII_BOUNDARIES = {"\\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "\\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def checked_pattern(pattern: str, ignore_case: bool = False, fixed: bool = False, ascii_words: bool = False) -> str:
    """A pattern in the common part of regex dialects: look-around and back-references are refused, and only a line feed ends a line.

    With ``ascii_words`` word boundaries are those of ASCII words, as in SQL; else Java's, to which other letters are of words too.
    """
    if fixed:
        pattern = re.sub(r"([^\w\s])", r"\\\1", pattern)
    elif re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    elif ascii_words:
        pattern = re.sub(r"(?s)\\Q.*?(?:\\E|$)|\\.", lambda m: ASCII_BOUNDARIES.get(m[0], m[0]), pattern)
    return f"(?di){pattern}" if ignore_case else f"(?d){pattern}"


def tokens(text: Column) -> Column:
    """The identifier tokens of a text."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def mentions(text: Column, name: Column) -> Column:
    return F.array_contains(tokens(text), name)


def callee_base(callee: Column) -> Column:
    """Last segment of a callee after ``::`` or ``.``, without a macro's ``!``."""
    return F.regexp_extract(F.regexp_replace(callee, r"!$", ""), r"([^:.]*)$", 1)


def type_qualifier(callee: Column) -> Column:
    """The segment before the last ``::`` or ``.`` if it starts with an upper-case letter; null if not."""
    found = F.regexp_extract(callee, r"([A-Za-z0-9_]+)(?:::|\.)[^:.]*$", 1)
    return F.when(F.rlike(found, F.lit("^[A-Z]")), found)


def module_segments(callee: Column) -> Column:
    """Lower-case path segments before the last; none for dotted callees, ``crate``, ``self`` and ``super`` left out."""
    parts = F.slice(F.split(callee, "::"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(callee, "::")) - 1))
    good = F.filter(parts, lambda p: F.rlike(p, F.lit("^[a-z_]")) & ~p.isin("crate", "self", "super"))
    return F.when(F.contains(callee, F.lit(".")), F.array().cast("array<string>")).otherwise(good)


def module_path(path: Column) -> Column:
    """Module segments of a file: the part after src, tests, benches or examples without a lib, main or mod stem."""
    inner = F.regexp_replace(path, r"^(?:.*/)?(?:src|tests|benches|examples)/", "")
    parts = F.split(F.regexp_replace(inner, r"\.rs$", ""), "/")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last.isin("lib", "main", "mod"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def crate_key(path: Column) -> Column:
    """What stands before the src, tests, benches or examples folder."""
    return F.regexp_extract(path, r"^(?:(.*)/)?(?:src|tests|benches|examples)/", 1)


def ends_with(segments: Column, suffix: Column) -> Column:
    """Whether an array ends with another, which is not empty."""
    n = F.size(suffix)
    return (n > 0) & (F.size(segments) >= n) & (F.slice(segments, F.greatest(F.size(segments) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == suffix)


def truncated(text: Column, most: int = 80) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


# Keywords of the six boundary families, and of the roles source and sink.
BOUNDARIES = {
    "http": ["http", "request", "response", "route", "handler", "endpoint", "axum", "actix", "rocket", "warp"],
    "database": ["db", "database", "sql", "query", "insert", "update", "delete", "select", "transaction", "sqlx", "diesel", "postgres", "mysql", "sqlite"],
    "queue": ["queue", "kafka", "rabbit", "nats", "sqs", "pubsub", "topic", "consumer", "producer"],
    "file": ["file", "fs", "path", "open", "read", "write", "serialize"],
    "network": ["socket", "tcp", "udp", "grpc", "rpc", "websocket", "net"],
    "cache": ["cache", "redis", "memcache"],
}
SOURCES = ["read", "load", "fetch", "get", "receive", "consume", "pull", "input", "parse", "decode"]
SINKS = ["write", "save", "insert", "update", "delete", "publish", "send", "emit", "store", "push", "output", "persist"]


def boundary_hits(low: Column, family: str) -> Column:
    """A family's keywords inside a text that is in lower case: a column of its own, or it is lowered again for each keyword."""
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in BOUNDARIES[family])))


def boundary_confidence(hits: Column) -> Column:
    """Grows by a tenth for each keyword, 0.95 at most; null without any."""
    return F.when(F.size(hits) > 0, F.least(F.lit(0.95), 0.45 + 0.1 * F.size(hits)))


def boundary_role(text: Column) -> Column:
    """source, sink, or transit where the text has words of both or of neither."""
    low = F.lower(text)
    source = F.exists(F.array(*(F.lit(k) for k in SOURCES)), lambda k: F.contains(low, k))
    sink = F.exists(F.array(*(F.lit(k) for k in SINKS)), lambda k: F.contains(low, k))
    return F.when(source & ~sink, "source").when(sink & ~source, "sink").otherwise("transit")


# Last parts of names that call for a type, with the suggestion and its confidence, the first that fits.
SEMANTIC_NAMES = [
    ("path", "PathBuf", 0.74), ("ip_addr", "IpAddr", 0.80), ("ip_address", "IpAddr", 0.80), ("socket_addr", "SocketAddr", 0.80),
    ("url", "Url", 0.82), ("uuid", "Uuid", 0.82), ("uri", "Uri", 0.78), ("version", "Version", 0.74),
]
SEMANTIC_WHOLE_NAMES = [("ip", "IpAddr", 0.80), ("bind_addr", "SocketAddr", 0.80), ("listen_addr", "SocketAddr", 0.80)]


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, "_"), lambda x: x != ""), lambda x: F.initcap(x)), "")


def semantic_name(name: Column) -> tuple[Column, Column]:
    """(suggestion, confidence) by the end of a snake-case name; null for other names."""
    low = F.lower(F.regexp_replace(name, "^r#", ""))
    kind = F.when(F.endswith(low, F.lit("_id")), pascal_case(low))
    sure = F.when(F.endswith(low, F.lit("_id")), F.lit(0.72))
    whole = [(low == word, suggestion, confidence) for word, suggestion, confidence in SEMANTIC_WHOLE_NAMES]
    ends = [((low == word) | F.endswith(low, F.lit(f"_{word}")), suggestion, confidence) for word, suggestion, confidence in SEMANTIC_NAMES]
    for hit, suggestion, confidence in reversed(ends + whole):
        kind, sure = F.when(hit, F.lit(suggestion)).otherwise(kind), F.when(hit, F.lit(confidence)).otherwise(sure)
    return kind, sure


# Roles of free text, names that say nothing, and first segments of filesystem paths.
OPEN_TEXT = ["help", "label", "message", "description", "reason", "text", "what", "name", "field", "preview", "placeholder", "example", "sample"]
VAGUE_NAMES = ["s", "s1", "s2", "arg", "args", "input", "raw", "str", "string", "text"]
ROOTS = ["bin", "boot", "dev", "etc", "home", "lib", "lib64", "media", "mnt", "opt", "proc", "root", "run", "sbin", "srv", "sys", "tmp", "usr", "var"]


def enum_token(literal: Column) -> Column:
    """Whether a literal may name a case of an enumeration: 1 to 64 bytes, no white space, some letter or digit."""
    return (literal != "") & (F.octet_length(literal) <= 64) & ~F.rlike(literal, F.lit(r"\s")) & F.rlike(literal, F.lit(r"[\p{L}\p{N}]"))


def literal_shape(literal: Column) -> Column:
    """HTTP status line, absolute filesystem path or absolute endpoint; null for others."""
    single = F.rlike(literal, F.lit("^/[^/]"))
    return (
        F.when(F.rlike(literal, F.lit(r"^[1-5][0-9][0-9]($|\s+\S)")), "status")
        .when(single & F.rlike(literal, F.lit(f"^(?i)/({'|'.join(ROOTS)})(/|$)")), "filesystem")
        .when(single & (F.octet_length(literal) <= 256) & ~F.rlike(literal, F.lit(r"\s")), "endpoint")
    )


def bare_type(ty: Column) -> Column:
    """A type without references and one layer each of Option, Result, Vec and Box: what flows."""
    t = F.regexp_replace(F.trim(ty), r"^(?:&(?:'\w+ ?)?(?:mut )?)+", "")
    for _ in range(2):
        t = F.regexp_replace(t, r"^(?:Option|Result|Vec|Box)<([^,<>]+(?:<[^<>]*>)?)(?:,.*)?>$", "$1")
    return F.regexp_replace(t, r"^(?:&(?:'\w+ ?)?(?:mut )?)+", "")


def edge_semantics(callee_return: Column, callee_takes: Column) -> Column:
    """Struct (kind, from_type, to_type) of a call: pass_through where the types agree, transform where they differ, side_effect without a result."""
    a, b = bare_type(callee_takes), bare_type(callee_return)
    kind = F.when(callee_return.isNull(), "side_effect").when(callee_takes.isNull(), "unknown").when(a == b, "pass_through").otherwise("transform")
    return F.struct(kind.alias("kind"), a.alias("from_type"), b.alias("to_type"))


def cfg_annotation(predicates: Column) -> Column:
    """``[cfg(a && b)]``, or nothing without predicates."""
    return F.when(F.size(predicates) > 0, F.concat(F.lit("[cfg("), F.array_join(predicates, " && "), F.lit(")]"))).otherwise(F.lit(""))


def provenance(path: Column, head: Column) -> Column:
    """generated, vendored or project, by parts of the path and marks in a file's first lines."""
    return (
        F.when(F.rlike(path, F.lit(r"(^|/)(generated|gen|target)(/|$)")) | F.rlike(F.lower(head), F.lit("@generated|do not edit|automatically generated|autogenerated|code generated")), "generated")
        .when(F.rlike(path, F.lit(r"(^|/)(vendor|vendored|third_party)(/|$)")), "vendored")
        .otherwise("project")
    )
