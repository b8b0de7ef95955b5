"""What the commands find, as users read it: fallbacks, caps with totals, sites gathered by function, counts, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.similarity import effective_threshold
from lodestar.operators import rollup, search
from lodestar.plans import commands
from lodestar.sources.code import CodeIndex

RELAXED, RELAXED_ROWS, SUGGESTIONS, LEAST_SUGGESTION = 0.7, 5, 5, 0.5

# Methods and macros that a graph of external calls leaves out, and callees that say nothing when they stay unresolved.
HIDDEN_METHODS = [
    "to_string", "clone", "len", "is_empty", "iter", "collect", "map", "filter", "push", "pop", "bold", "italic", "dimmed", "bright_green", "bright_red",
    "bright_blue", "bright_yellow", "bright_cyan", "bright_magenta", "bright_purple", "white", "cyan", "green",
]
HIDDEN_MACROS = ["format!", "println!", "eprintln!"]
LOW_SIGNAL = ["Ok", "Err", "Some", "None"]


def capped(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in an order, each with ``n_total``, how many there are, and whether some are not shown. 0 is no limit."""
    total = rows.count()
    shown = rows.orderBy(*order)
    shown = shown.limit(limit) if limit else shown
    return shown.withColumn("n_total", F.lit(total).cast("bigint")).withColumn("truncated", F.lit(bool(limit) and total > limit))


def find_with_fallbacks(code: CodeIndex, query: str, threshold: float = 0.85, **filters) -> DataFrame:
    """(step, symbol_kind, name, score, file_path, start_line): hits; a short single term must fit exactly, but kinds of symbols where it fits none
    are searched at the asked-for threshold (``rescued``). Without any hit a term of four characters or more gives the best few at a lower
    threshold (``relaxed``), else the names most like it (``suggested``)."""
    terms = [t for t in query.split("|") if t]
    symbols = commands._filtered(code.symbols, **filters)
    cols = ["symbol_kind", "name", "score", "file_path", "start_line"]
    strict = search.ranked(symbols, "name", terms, threshold)
    if len(terms) == 1:
        strict = search.exact_suppresses(strict, "symbol_kind")
    found = strict.select(F.lit("found").alias("step"), *cols)
    if effective_threshold(terms, threshold) > threshold:
        scored = search.ranked(symbols, "name", terms * 2, threshold)  # two terms are not cut to exact hits
        rescued = scored.join(strict.select("symbol_kind").distinct(), "symbol_kind", "left_anti")
        found = found.unionByName(rescued.select(F.lit("rescued").alias("step"), *cols))
    if not found.isEmpty():
        return found
    if threshold == 0.85 and all(len(t) >= 4 for t in terms):
        lower = search.ranked(symbols, "name", terms, RELAXED).orderBy(F.desc("score"), "file_path", "start_line").limit(RELAXED_ROWS)
        if not lower.isEmpty():
            return lower.select(F.lit("relaxed").alias("step"), *cols)
    near = search.did_you_mean(symbols, "name", query, threshold, LEAST_SUGGESTION, SUGGESTIONS).withColumnRenamed("name", "like")
    near = symbols.join(near, F.col("name") == F.col("like"))
    return near.select(F.lit("suggested").alias("step"), "symbol_kind", "name", F.col("similarity").alias("score"), "file_path", "start_line")


def _sites(*fields: str) -> Column:
    return F.sort_array(F.collect_set(F.struct(*fields)))


def refs_by_function(hits: DataFrame) -> DataFrame:
    """(enclosing_function, n, is_test, places): references by the name of the function around; homonyms are one."""
    return hits.groupBy("enclosing_function").agg(F.count("*").alias("n"), F.bool_or("is_test").alias("is_test"), F.transform(_sites("file_path", "line", "col"), lambda x: F.concat_ws(":", x["file_path"], x["line"], x["col"])).alias("places"))


def member_sites(code: CodeIndex, struct: str, limit: int = 50) -> DataFrame:
    """(field, n_accesses, truncated, places) of a struct's fields; fields that nothing reads have 0. The places are the first ``limit``."""
    fields = commands.members(code, struct).select("field")
    seen = code.relation("occurrences").where("kind = 'field'").join(F.broadcast(fields), F.col("ident") == F.col("field")).select("field", "file_path", "line", "col").distinct()
    total = seen.groupBy("field").agg(F.count("*").alias("n_accesses"))
    first = seen if not limit else rollup.top_per_group(seen, ["field"], ["file_path", "line", "col"], limit)
    places = first.groupBy("field").agg(F.transform(_sites("file_path", "line", "col"), lambda x: F.concat_ws(":", x["file_path"], x["line"], x["col"])).alias("places"))
    d = fields.join(total, "field", "left").join(places, "field", "left")
    n = F.coalesce("n_accesses", F.lit(0))
    return d.select("field", n.cast("bigint").alias("n_accesses"), ((n > limit) & F.lit(limit > 0)).alias("truncated"), F.coalesce("places", F.array().cast("array<string>")).alias("places"))


def caller_sites(code: CodeIndex, name: str, target_in: str | None = None, callers_in: str | None = None, exclude_tests: bool = False) -> DataFrame:
    """(target, caller, places, n_target): direct callers with the places of their calls, and how many calls each target has in all."""
    edges = commands.resolved_edges(code, exclude_tests).select("src", "dst", "file_path", "line", "column").distinct()
    targets = code.functions.where(F.col("name") == name).select(F.col("fn_id").alias("dst"), F.col("file_path").alias("target_file"))
    if target_in:
        targets = targets.where(F.contains("target_file", F.lit(target_in)))
    edges = edges.join(targets, "dst")
    if callers_in:
        edges = edges.where(F.contains("file_path", F.lit(callers_in)))
    by_caller = edges.groupBy(F.col("dst").alias("target"), F.col("src").alias("caller")).agg(F.transform(_sites("line", "column"), lambda x: F.concat_ws(":", x["line"], x["column"])).alias("places"))
    total = edges.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n_target"))
    return by_caller.join(total, "target")


def search_symbols(code: CodeIndex, part: str = "", limit: int = 0, **filters) -> DataFrame:
    """Symbols whose name has a part, any case, by file, line and name; 0 is no limit."""
    d = commands._filtered(code.symbols, **filters).where(F.contains(F.lower("name"), F.lit(part.lower())))
    d = d.select("symbol_kind", "name", "file_path", "start_line").orderBy("file_path", "start_line", "name")
    return d.limit(limit) if limit else d


def shown_external(callee: Column) -> Column:
    """Whether a graph shows a call that leads out of the project."""
    method = F.regexp_extract(callee, r"^receiver\.(.*)$", 1)
    return F.when(F.startswith(callee, F.lit("receiver.")), ~method.isin(HIDDEN_METHODS)).when(F.contains(callee, F.lit("::")), ~F.contains(callee, F.lit(".")) | F.rlike(callee, F.lit(r"^std::|^serde|^syn::|::(new|parse|read|write)"))).otherwise(~callee.isin(HIDDEN_MACROS))


def external_calls(code: CodeIndex) -> DataFrame:
    """(src, callee) of calls that no function of the project answers, without those that a graph hides."""
    inside = commands.loose_candidates(code).select("caller_id", "callee").distinct()
    calls = code.call_sites.where("caller_id IS NOT NULL").select("caller_id", "callee").distinct().where(shown_external(F.col("callee")))
    return calls.join(inside, ["caller_id", "callee"], "left_anti").select(F.col("caller_id").alias("src"), "callee")


def edge_counts(code: CodeIndex) -> DataFrame:
    """(n_internal, n_external): calls inside functions that some function of the project may answer, and the others."""
    inside = commands.loose_candidates(code).select("caller_id", "callee", "file_path", "line", "column").distinct().withColumn("inside", F.lit(True))
    calls = code.call_sites.where("caller_id IS NOT NULL").select("caller_id", "callee", "file_path", "line", "column")
    d = calls.join(inside, ["caller_id", "callee", "file_path", "line", "column"], "left")
    return d.agg(F.count_if(F.col("inside").isNotNull()).alias("n_internal"), F.count_if(F.col("inside").isNull()).alias("n_external"))


def unresolved_names(code: CodeIndex) -> DataFrame:
    """(callee_base, n) of calls without a target, but for those whose name says nothing."""
    proven = commands.resolved_edges(code).select("file_path", "line", "column", "callee").distinct()
    d = code.call_sites.where("call_kind = 'function' AND caller_id IS NOT NULL").where(~F.col("callee_base").isin(LOW_SIGNAL))
    return d.join(proven, ["file_path", "line", "column", "callee"], "left_anti").groupBy("callee_base").agg(F.count("*").alias("n"))


def stringly_counts(findings: DataFrame) -> DataFrame:
    """(origin, n, n_sure) of the findings, where a confidence of 0.85 or more is sure."""
    return findings.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.85).alias("n_sure"))


def ambiguous_names(code: CodeIndex) -> DataFrame:
    """(symbol, n_unresolved, n_candidates, locations): names of several public functions that calls outside tests give without telling which."""
    candidates = code.functions.where("is_pub AND NOT is_test AND kind_tag IN ('function', 'method')")
    place = F.concat_ws(":", "file_path", "start_line")
    several = candidates.groupBy(F.col("name").alias("symbol")).agg(F.count("*").alias("n_candidates"), F.slice(F.sort_array(F.collect_list(place)), 1, 12).alias("locations")).where("n_candidates > 1")
    tests = code.functions.where("is_test").select(F.col("fn_id").alias("caller_id"))
    proven = commands.resolved_edges(code).select("file_path", "line", "column", "callee").distinct()
    open_calls = code.call_sites.join(tests, "caller_id", "left_anti").join(proven, ["file_path", "line", "column", "callee"], "left_anti").groupBy(F.col("callee_base").alias("symbol")).agg(F.count("*").alias("n_unresolved"))
    return several.join(open_calls, "symbol").select("symbol", "n_unresolved", "n_candidates", "locations").orderBy(F.desc("n_unresolved"), "symbol")


def display_module(path: Column) -> Column:
    """``crate::a::b`` of a file's path."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"^(?:.*/)?src/", "")
    parts = F.filter(F.split(F.regexp_replace(inner, r"\.rs$", ""), "/"), lambda p: ~p.isin("lib", "main", "mod"))
    return F.array_join(F.concat(F.array(F.lit("crate")), parts), "::")


def project_slug(path: str) -> str:
    return path.replace("/", "-")


def write_json(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, written by the tasks that have them."""
    rows.write.mode("overwrite").json(folder)


def write_text(lines: DataFrame, folder: str) -> None:
    """A rendering of one string column, written by the tasks that have it."""
    lines.write.mode("overwrite").text(folder)
