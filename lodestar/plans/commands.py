"""The user-level queries over a CodeIndex, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import graph, intervals, lines, resolve, rollup, search
from lodestar.sources.code import CodeIndex


def _filtered(d: DataFrame, within: str | None = None, exclude_tests: bool = False, public_only: bool = False, kinds: list[str] = ()) -> DataFrame:
    if within:
        d = d.where(F.contains("file_path", F.lit(within)))
    if exclude_tests:
        d = d.where(~F.col("is_test"))
    if public_only:
        d = d.where("is_pub")
    return d.where(F.col("symbol_kind").isin(list(kinds))) if kinds else d


def inventory(code: CodeIndex, **filters) -> DataFrame:
    return _filtered(code.symbols, **filters).select("symbol_id", "symbol_kind", "name", "kind", "signature", "file_path", "start_line", "end_line", "is_pub", "is_test")


def find(code: CodeIndex, query: str, threshold: float = 0.85, exact: bool = False, match_signature: bool = False, limit: int = 50, **filters) -> DataFrame:
    """Symbols by name; terms are separated by ``|``. An exact hit of a single term hides the others of its kind."""
    terms = [t for t in query.split("|") if t]
    if not terms or any(c.isspace() for c in query):
        raise ValueError("a query has terms without white space, separated by |")
    d = _filtered(code.symbols, **filters)
    if exact:
        return d.where(F.lower("name").isin([t.lower() for t in terms])).withColumn("score", F.lit(1.0)).withColumn("match_kind", F.lit("name"))
    tiers = [("name", "name")] + ([("sig", "signature"), ("path", "file_path")] if match_signature else [])
    found = search.ranked_tiers(d, ["symbol_id", "symbol_kind", "name", "file_path", "start_line"], tiers, terms, threshold)
    if len(terms) == 1:
        found = search.exact_suppresses(found, "symbol_kind")
    return found.orderBy(F.desc("score"), "file_path", "start_line").limit(limit)


def definition(code: CodeIndex, name: str, **filters) -> DataFrame:
    return _filtered(code.symbols, **filters).where(F.col("name") == name)


def tree(code: CodeIndex) -> DataFrame:
    kinds = ["function", "struct", "enum", "const", "trait", "alias"]
    d = code.symbols.select("file_path", F.when(F.startswith("symbol_kind", F.lit("static")), "const").otherwise(F.col("symbol_kind")).alias("k"))
    return rollup.kind_counts(d, "file_path", "k", kinds, every=code.files)


def _joined(*parts) -> Column:
    """One key of several parts; null if one of them is."""
    return F.concat(*(x for k, p in enumerate(parts) for x in ([F.lit("\x01")] if k else []) + [F.lit(p) if not isinstance(p, Column) else p]))


def _offered_keys(functions: DataFrame) -> Column:
    """What calls may name a function by: name and kind, with owner, file or crate, and for plain functions each end of the module path."""
    name, file = F.col("name"), F.col("file_path")
    plain = F.col("kind_tag") == "function"
    shape = F.when(plain, "plain").otherwise("member")
    module = F.col("module_path")
    ends = F.when(F.size(module) > 0, F.transform(F.sequence(F.lit(1), F.size(module)), lambda k: F.array_join(F.slice(module, k, F.size(module)), "::"))).otherwise(F.array(F.lit("")))
    paths = F.when(plain, F.transform(ends, lambda e: _joined("path", name, e))).otherwise(F.array().cast("array<string>"))
    member = F.when(~plain, F.col("owner_type"))
    return F.concat(paths, F.array(_joined("any", name), _joined("name", name, shape), _joined("file", name, shape, file), _joined("crate", name, shape, F.col("crate_key")), _joined("owner", name, member), _joined("owner_file", name, member, file)))


def resolved_edges(code: CodeIndex, exclude_tests: bool = False, sole_first: bool = False) -> DataFrame:
    """(src, dst, file_path, line, column, callee, call_kind, rule): the conservative resolver. A call resolves only where one rule has one hit.

    With ``sole_first`` the only function of a name is taken whatever its kind.
    """
    fns = code.functions.where(~F.col("is_test")) if exclude_tests else code.functions
    caller = fns.select(F.col("fn_id").alias("caller_id"), F.col("module_path").alias("c_module"), F.col("crate_key").alias("c_crate"), F.col("owner_type").alias("c_owner"))
    sites = code.call_sites.where(F.col("call_kind").isin("function", "method", "framework", "function_via_alias", "method_via_alias", "framework_via_alias"))
    site = ["caller_id", "callee", "call_kind", "file_path", "line", "column"]
    parts = F.split("callee", "::")
    d = sites.select(*site, "callee_base").distinct().join(caller, "caller_id").withColumn("_prefix", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    owner = F.try_element_at("_prefix", F.lit(-1))
    d = d.withColumn("_method", F.startswith("call_kind", F.lit("method"))).withColumn("_typed", F.coalesce(F.rlike(owner, F.lit("^[A-Z]")), F.lit(False)))
    d = d.withColumn("_owner", F.when(F.col("_typed"), F.when(owner == "Self", F.col("c_owner")).otherwise(owner)))
    # crate, self and super in front of a path
    d = d.withColumn("_clean", F.filter("_prefix", lambda p: ~p.isin("crate", "self", "super")))
    clean, supers = F.col("_clean"), F.size(F.filter("_prefix", lambda p: p == "super"))
    base = F.slice("c_module", F.lit(1), F.greatest(F.size("c_module") - supers, F.lit(0)))
    path = F.when(F.array_contains("_prefix", F.lit("self")) | (supers > 0), F.concat(base, clean)).otherwise(clean)
    qualified = ~F.col("_method") & ~F.col("_typed") & (F.size("_prefix") > 0)
    bare = F.col("_method") | (~F.col("_typed") & (F.size("_prefix") == 0))
    name, file = F.col("callee_base"), F.col("file_path")
    shape = F.when(F.col("_method"), "member").otherwise("plain")
    under = lambda segments: _joined("path", name, F.array_join(segments, "::"))
    whole = F.concat("c_module", clean)
    rules = [
        ("owner", _joined("owner", name, F.col("_owner"))),
        ("owner_in_file", _joined("owner_file", name, F.col("_owner"), file)),
        ("path", F.when(qualified, under(path))),
        ("caller_module_path", F.when(qualified & (F.size(whole) > 0), under(whole))),
        ("path_without_crate", F.when(qualified & (F.size(clean) > 1), under(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(1)))))),
        ("last_segment", F.when(qualified, _joined("path", name, F.try_element_at(clean, F.lit(-1))))),
        ("only_one", F.when(bare, _joined("name", name, shape))),
        ("same_file", F.when(bare, _joined("file", name, shape, file))),
        ("same_crate", F.when(bare, _joined("crate", name, shape, F.col("c_crate")))),
    ]
    if sole_first:
        rules.insert(0, ("sole", _joined("any", name)))
    asked = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(rule).alias("rule"), key.alias("key")) for k, (rule, key) in enumerate(rules)))
    found = resolve.keyed_cascade(d, site, asked, fns, "fn_id", _offered_keys(fns))
    return found.select(F.col("caller_id").alias("src"), F.col("target").alias("dst"), "file_path", "line", "column", "callee", "call_kind", "rule")


def project_calls(code: CodeIndex) -> DataFrame:
    """(src, dst, rule) of plain calls and handlers for context bundles: the only function of a name is the target, whatever its kind."""
    d = resolved_edges(code, sole_first=True).where("call_kind IN ('function', 'framework')")
    return d.groupBy("src", "dst").agg(F.min("rule").alias("rule"))


def callers(code: CodeIndex, name: str, depth: int = 1, exclude_tests: bool = False) -> DataFrame:
    """(target, caller, distance, n_sites): who calls the functions of this name, over up to ``depth`` steps."""
    edges = resolved_edges(code)
    targets = code.functions.where(F.col("name") == name).select(F.col("fn_id").alias("node"))
    seeds = targets.withColumn("target", F.col("node"))
    reached = graph.bfs(edges, seeds, src="dst", dst="src", max_depth=depth, mark=["target"]).where("dist > 0")
    sites = edges.select("src", "dst", "line", "column").distinct().groupBy("src", "dst").agg(F.count("*").alias("n_sites"))
    out = reached.select("target", F.col("node").alias("caller"), F.col("dist").alias("distance"))
    out = out.join(sites.select(F.col("src").alias("caller"), F.col("dst").alias("target"), "n_sites"), ["target", "caller"], "left")
    if exclude_tests:
        out = out.join(code.functions.where("is_test").select(F.col("fn_id").alias("caller")), "caller", "left_anti")
    return out


_PRIORITY = ["call", "method", "struct", "variant", "assoc_call", "pattern", "field", "type", "macro", "path"]


def refs(code: CodeIndex, name: str, kinds: list[str] = (), within: str | None = None) -> DataFrame:
    """References of an identifier, one for each place, the most telling kind first; with the innermost function around."""
    d = code.relation("occurrences").where((F.col("ident") == name))
    enums = code.of_kind("enum").select(F.col("name").alias("ident"), F.lit("variant").alias("as_kind"))
    structs = code.of_kind("struct").select(F.col("name").alias("ident"), F.lit("assoc_call").alias("as_kind"))
    owner = enums.unionByName(structs).dropDuplicates(["ident"])
    d = d.join(owner, "ident", "left").withColumn("kind", F.when(F.col("kind") == "second_last", F.coalesce("as_kind", F.lit("path"))).otherwise(F.col("kind")))
    if kinds:
        d = d.where(F.col("kind").isin(list(kinds)))
    if within:
        d = d.where(F.contains("file_path", F.lit(within)))
    rank = F.array_position(F.array(*(F.lit(k) for k in _PRIORITY)), F.col("kind"))
    d = rollup.top_per_group(d.withColumn("_rank", rank), ["file_path", "line", "col"], ["_rank"], 1)
    spans = code.functions.select("file_path", "start_line", "end_line", F.col("name").alias("fn_name"), "is_test", "ordinal")
    found = intervals.innermost(d, spans, ["file_path"], ["file_path", "line", "col"], "line", "start_line", "end_line", ["ordinal"])
    return found.select("file_path", "line", "col", "kind", F.col("span_fn_name").alias("enclosing_function"), F.coalesce("span_is_test", F.lit(False)).alias("is_test"))


def refs_by_function(hits: DataFrame) -> DataFrame:
    return hits.groupBy("enclosing_function").agg(F.count("*").alias("n"), F.bool_or("is_test").alias("is_test"))


def usages(code: CodeIndex, name: str) -> DataFrame:
    """Callers' sites, then the references that no such site covers: (file_path, line, section)."""
    edges = resolved_edges(code)
    sites = edges.join(code.functions.where(F.col("name") == name).select(F.col("fn_id").alias("dst")), "dst", "left_semi").select("file_path", "line").distinct()
    return rollup.usages(sites, refs(code, name).select("file_path", "line").distinct(), ["file_path", "line"])


def members(code: CodeIndex, struct: str) -> DataFrame:
    """(field, n_accesses) by field name; fields that are never read have 0."""
    fields = code.of_kind("struct").where(F.col("name") == struct).select(F.explode("fields").alias("f")).select(F.regexp_extract("f", r"(\w+)\s*:", 1).alias("field")).where("field <> ''")
    hits = code.relation("occurrences").where("kind = 'field'").groupBy(F.col("ident").alias("field")).agg(F.count("*").alias("n_accesses"))
    return fields.join(hits, "field", "left").fillna(0)


def impls(code: CodeIndex, trait: str, kind: str | None = None) -> DataFrame:
    d = code.relation("impls").where((F.col("trait_name") == trait) | (F.col("trait_path") == trait))
    return d.where(F.col("impl_kind") == kind) if kind else d


def grep(code: CodeIndex, pattern: str, ignore_case: bool = False, fixed: bool = False, within: str | None = None, exclude_tests: bool = False) -> DataFrame:
    """Matching lines with the innermost function around each."""
    d = code.source_lines if not within else code.source_lines.where(F.contains("file_path", F.lit(within)))
    hits = lines.grep(d, pattern, ignore_case, fixed)
    spans = code.functions.select("file_path", "start_line", "end_line", "fn_id", F.col("name").alias("fn_name"), "is_test", "ordinal")
    found = intervals.innermost(hits, spans, ["file_path"], ["file_path", "line"], "line", "start_line", "end_line", ["ordinal"])
    found = found.select("file_path", "line", "text", F.col("span_fn_id").alias("fn_id"), F.col("span_fn_name").alias("fn_name"), F.coalesce("span_is_test", F.lit(False)).alias("is_test"))
    return found.where(~F.col("is_test")) if exclude_tests else found


def grep_by_function(hits: DataFrame) -> DataFrame:
    """Counts by function; the row with a null function counts lines outside of any."""
    return hits.groupBy("fn_id").agg(F.count("*").alias("n"))


def paths_between(code: CodeIndex, source: str, target: str, max_nodes: int = 8, limit: int = 10, max_expansions: int = 100_000, exclude_tests: bool = False) -> tuple[DataFrame, dict]:
    edges = resolved_edges(code, exclude_tests)
    named = lambda n: code.functions.where(F.col("name") == n).select(F.col("fn_id").alias("node"))
    return graph.paths(edges, named(source), named(target), max_nodes, limit, max_expansions)


def call_graph(code: CodeIndex, root: str, depth: int = 3, include_callers: bool = False) -> DataFrame:
    """(src, dst) of the resolved calls among what the root reaches, and what reaches it if asked for."""
    edges = resolved_edges(code).select("src", "dst").distinct()
    seeds = code.functions.where(F.col("name") == root).select(F.col("fn_id").alias("node"))
    kept = graph.bfs(edges, seeds, max_depth=depth or None).select("node")
    if include_callers:
        kept = kept.unionByName(graph.bfs(edges, seeds, src="dst", dst="src", max_depth=depth or None).select("node")).distinct()
    a, b = kept.withColumnRenamed("node", "src"), kept.withColumnRenamed("node", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def dot(edges: DataFrame) -> DataFrame:
    """The graph as DOT, a line a row."""
    return edges.select(F.concat(F.lit('  "'), F.replace("src", F.lit('"'), F.lit('\\"')), F.lit('" -> "'), F.replace("dst", F.lit('"'), F.lit('\\"')), F.lit('";')).alias("value")).distinct()


# Marks of attributes that make a runtime call a function, and trait methods that others call by contract.
RUNTIME_MARKS = [
    "no_mangle", "export_name", "panic_handler", "global_allocator", "alloc_error_handler", "wasm_bindgen", "tauri::command", "napi", "pyfunction",
    "tokio::main", "async_std::main", "actix_web::main", "actix_web::get", "actix_web::post", "actix_web::put", "actix_web::delete", "actix_web::patch",
    "actix_web::head", "actix_web::options", "actix_web::route", "rocket::get", "rocket::post", "rocket::put", "rocket::delete", "rocket::patch",
    "rocket::head", "rocket::options", "rocket::route", "proc_macro", "proc_macro_derive", "proc_macro_attribute", "proc_macro_hack",
]
_COMMON_TRAIT_METHODS = ["fmt", "from", "into", "try_from", "default", "clone", "eq", "cmp", "partial_cmp", "hash", "drop", "deref", "next", "poll", "from_str", "as_ref", "borrow", "index", "add", "serialize", "deserialize"]


def dead_code(code: CodeIndex, external_refs: DataFrame | None = None) -> DataFrame:
    """Public functions that nothing outside tests calls: (fn_id, n_live, n_test, reason); ``reason`` tells why a candidate is left out of the verdict.

    ``external_refs`` (fn_id) may bring references from a language server.
    """
    fns = code.functions.where("is_pub AND kind_tag IN ('function', 'method') AND name <> 'main' AND NOT is_test")
    tests = code.functions.select(F.col("fn_id").alias("caller_id"), F.col("is_test").alias("from_test"))
    sites = code.call_sites.join(tests, "caller_id", "left").select("callee_base", F.coalesce("from_test", F.lit(False)).alias("from_test"))
    counts = sites.groupBy(F.col("callee_base").alias("name")).agg(F.count_if(~F.col("from_test")).alias("n_live"), F.count_if("from_test").alias("n_test"))
    mentioned = code.relation("occurrences").where("kind IN ('call', 'method', 'path')").join(tests.withColumnRenamed("caller_id", "fn_id"), "fn_id", "left")
    mentioned = mentioned.groupBy(F.col("ident").alias("name")).agg(F.count_if(~F.coalesce("from_test", F.lit(False))).alias("m_live"), F.count_if("from_test").alias("m_test"))
    exported = code.relation("reexports").select(F.try_element_at(F.split("target_path", "::"), F.lit(-1)).alias("name"), F.lit(True).alias("exported")).distinct()
    handlers = code.call_sites.where(F.startswith("call_kind", F.lit("framework"))).select(F.col("callee_base").alias("name"), F.lit(True).alias("handled")).distinct()
    same = Window.partitionBy("name")
    d = fns.withColumn("homonyms", F.count("*").over(same)).join(counts, "name", "left").join(mentioned, "name", "left").join(exported, "name", "left").join(handlers, "name", "left")
    if external_refs is not None:
        d = d.join(external_refs.groupBy("fn_id").agg(F.count("*").alias("ext")), "fn_id", "left")
    else:
        d = d.withColumn("ext", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumn("n_live", F.greatest(zero("n_live"), zero("m_live")) + zero("ext")).withColumn("n_test", F.greatest(zero("n_test"), zero("m_test")))
    reason = rollup.first_reason([
        ("framework_handler", F.coalesce("handled", F.lit(False))),
        ("re_exported", F.coalesce("exported", F.lit(False))),
        ("cfg_test", F.exists("cfg_attrs", lambda c: c == "test")),
        ("runtime_entry", F.exists("attributes", lambda a: F.rlike(F.regexp_replace(F.lower(a), r"\s", ""), F.lit("|".join(RUNTIME_MARKS))))),
        ("common_trait_method", (F.col("kind_tag") == "method") & F.col("name").isin(_COMMON_TRAIT_METHODS)),
        ("ambiguous", (F.col("homonyms") > 1) & (F.col("n_live") > 0)),
    ])
    return d.withColumn("reason", reason).where((F.col("n_live") == 0) | (F.col("reason") == "ambiguous")).select("fn_id", "name", F.col("n_live").cast("bigint").alias("n_live"), F.col("n_test").cast("bigint").alias("n_test"), "reason")


def lifecycle(code: CodeIndex, type_name: str) -> DataFrame:
    """(node, n_in, n_out, role) of the functions that mention a type, by resolved calls and by the order of calls in one caller."""
    name = F.lit(type_name)
    said = F.concat_ws(" ", "signature", "kind", F.array_join("parameters", " "), F.coalesce("return_type", F.lit("")))
    fns = code.functions.withColumn("mentions", text.mentions(said, name)).where("mentions")
    fns = fns.withColumn("produces", text.mentions(F.coalesce("return_type", F.lit("")), name)).withColumn("consumes", text.mentions(F.concat_ws(" ", F.array_join("parameters", " "), "kind"), name))
    edges = resolved_edges(code)
    nodes = fns.select(F.col("fn_id").alias("node"))
    inside = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    made = edges.join(fns.where("produces").select(F.col("fn_id").alias("dst")), "dst", "left_semi").select("src", F.col("dst").alias("a"), F.col("line").alias("la"), F.col("column").alias("ca"))
    used = edges.join(fns.where("consumes").select(F.col("fn_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("s2"), F.col("dst").alias("b"), F.col("line").alias("lb"), F.col("column").alias("cb"))
    handed = made.join(used, (F.col("src") == F.col("s2")) & ((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("ca") < F.col("cb"))))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return rollup.degree_roles(inside.unionByName(handed.where("src <> dst")).distinct(), "src", "dst", nodes)


def value_flow(code: CodeIndex) -> DataFrame:
    """(fn_id, variable, producer, producer_line, consumer, consumer_line): the latest producer of each variable that a call is given.

    Parameters are producers at the function's first line; ``x = f(..)`` makes f the producer of x from there on.
    """
    fns = code.functions
    params = fns.select("fn_id", F.explode("parameters").alias("p"), F.col("start_line").alias("line")).select("fn_id", F.regexp_extract("p", r"(\w+)\s*:", 1).alias("variable"), "line", F.lit(-1).alias("column"), F.lit("<param>").alias("producer")).where("variable <> ''")
    sites = code.call_sites.where("call_kind = 'function' AND caller_id IS NOT NULL").select(F.col("caller_id").alias("fn_id"), "callee_base", "file_path", "line", "column", "args")
    sites = sites.join(code.source_lines, ["file_path", "line"])
    bound = F.regexp_extract("text", r"(?:let\s+(?:mut\s+)?)?(\w+)\s*(?::[^=]*)?=\s*(?:\w+::)*(\w+)\s*\(", 1)
    maker = F.regexp_extract("text", r"=\s*(?:\w+::)*(\w+)\s*\(", 1)
    made = sites.where(maker == F.col("callee_base")).select("fn_id", bound.alias("variable"), "line", (F.col("column") + 10000).alias("column"), F.col("callee_base").alias("producer")).where("variable <> ''")
    words = F.array_distinct(F.flatten(F.transform("args", lambda a: text.tokens(a))))
    used = sites.select("fn_id", F.explode(words).alias("variable"), "line", "column", F.col("callee_base").alias("consumer"))
    events = params.unionByName(made).withColumn("producer_line", F.col("line")).withColumn("consumer", F.lit(None).cast("string"))
    events = events.unionByName(used.withColumn("producer", F.lit(None).cast("string")).withColumn("producer_line", F.lit(None).cast("int")).select(*events.columns))
    w = Window.partitionBy("fn_id", "variable").orderBy("line", "column").rowsBetween(Window.unboundedPreceding, -1)
    d = events.withColumn("p", F.last("producer", ignorenulls=True).over(w)).withColumn("pl", F.last("producer_line", ignorenulls=True).over(w))
    return d.where("consumer IS NOT NULL AND p IS NOT NULL").select("fn_id", "variable", F.col("p").alias("producer"), F.col("pl").alias("producer_line"), "consumer", F.col("line").alias("consumer_line")).distinct()


def boundaries(code: CodeIndex, least: float = 0.0) -> DataFrame:
    """(fn_id, family, role, confidence, evidence) by keywords in a function's name, signature and callees."""
    callees = code.call_sites.groupBy(F.col("caller_id").alias("fn_id")).agg(F.array_join(F.array_sort(F.collect_set("callee")), " ").alias("callees"))
    d = code.functions.join(callees, "fn_id", "left").withColumn("corpus", F.concat_ws(" ", "name", "signature", F.coalesce("callees", F.lit(""))))
    d = d.select("fn_id", text.boundary_role(F.col("corpus")).alias("role"), F.lower("corpus").alias("low"))
    found = [F.struct(F.lit(f).alias("family"), text.boundary_hits(F.col("low"), f).alias("hits")) for f in text.BOUNDARIES]
    d = d.select("fn_id", "role", F.explode(F.array(*found)).alias("b")).select("fn_id", "role", "b.family", "b.hits")
    d = d.withColumn("confidence", text.boundary_confidence(F.col("hits"))).where(F.col("confidence") >= max(least, 1e-9))
    return d.select("fn_id", "family", "role", "confidence", F.slice("hits", 1, 6).alias("evidence"))


def ensemble(code: CodeIndex, name: str, depth: int = 2) -> dict[str, DataFrame]:
    """Sections of a function's context, each computed only if it is read."""
    fns = code.functions.where(F.col("name") == name)
    root = fns.select(F.col("fn_id").alias("node"))
    edges = resolved_edges(code)
    return {
        "function": fns,
        "upstream": graph.neighbourhood(edges, root, depth, src="dst", dst="src"),
        "downstream": graph.neighbourhood(edges, root, depth),
        "call_sites": edges.join(root.withColumnRenamed("node", "dst"), "dst", "left_semi"),
        "structs": code.relation("occurrences").join(fns.select("fn_id"), "fn_id", "left_semi").select(F.col("ident").alias("name")).distinct().join(code.of_kind("struct"), "name"),
        "value_flow": value_flow(code).join(fns.select("fn_id"), "fn_id", "left_semi"),
        "boundaries": boundaries(code).join(fns.select("fn_id"), "fn_id", "left_semi"),
    }


def stringly(code: CodeIndex, least: float = 0.85, exclude_tests: bool = True) -> DataFrame:
    """(site_id, role, suggestion, origin, confidence, n_literals): string-typed declarations that call for a type, best finding each."""
    sites = code.relation("string_sites")
    if exclude_tests:
        sites = sites.where(~F.col("is_test"))
    lit = code.relation("literals").where(text.enum_token(F.col("literal")))
    name = F.coalesce(F.nullif(F.regexp_extract("before", r"(\w+)(?:\.as_str\(\))?\s*(?:==|!=)$", 1), F.lit("")), F.nullif(F.regexp_extract("after", r"^(?:==|!=)\s*\*?(\w+)", 1), F.lit("")))
    compared = lit.select("file_path", name.alias("name"), "literal").where("name IS NOT NULL").groupBy("file_path", "name").agg(F.countDistinct("literal").alias("n_literals"), F.count("*").alias("n_seen"))
    parsed = code.call_sites.where("call_kind = 'method' AND callee_base = 'parse'").select("file_path", F.regexp_extract("callee", r"(\w+)\.parse$", 1).alias("name"), F.lit(True).alias("parsed")).distinct()
    made = code.call_sites.where(F.col("callee_base").isin("from_str", "try_from", "parse_str")).select("file_path", F.try_element_at(text.tokens(F.get("args", F.lit(0))), F.lit(-1)).alias("name"), F.regexp_extract("callee", r"(\w+)::\w+$", 1).alias("into")).distinct()
    d = sites.join(compared, ["file_path", "name"], "left").join(parsed, ["file_path", "name"], "left").join(made, ["file_path", "name"], "left")
    semantic, sure = text.semantic_name(F.col("name"))
    options = [
        F.when(F.coalesce(F.nullif("into", F.lit("")), F.when(F.col("parsed"), F.lit("parsed type"))).isNotNull(), F.struct(F.lit(0.99).alias("confidence"), F.lit(4).alias("priority"), F.coalesce(F.nullif("into", F.lit("")), F.lit("parsed type")).alias("suggestion"), F.lit("conversion").alias("origin"))),
        F.when((F.col("n_literals") >= 2) & ~F.lower("name").isin(text.OPEN_TEXT), F.struct(F.when(F.col("n_seen") >= 3, F.lit(0.86)).otherwise(F.lit(0.8)).alias("confidence"), F.lit(3).alias("priority"), text.pascal_case(F.col("name")).alias("suggestion"), F.lit("literals").alias("origin"))),
        F.when(semantic.isNotNull(), F.struct(sure.alias("confidence"), F.lit(2).alias("priority"), semantic.alias("suggestion"), F.lit("name").alias("origin"))),
    ]
    d = d.withColumn("best", F.greatest(*options, F.lit(None).cast("struct<confidence:double,priority:int,suggestion:string,origin:string>")))
    return d.where(F.col("best.confidence") >= least).select("site_id", "role", "best.suggestion", "best.origin", "best.confidence", F.coalesce("n_literals", F.lit(0)).alias("n_literals"))


def test_coverage(code: CodeIndex, test_filter: str | None = None, include_ignored: bool = False) -> DataFrame:
    """(fn_id, n_tests): how many tests reach each function over resolved plain calls; functions that none reaches have 0."""
    tests = code.functions.where(F.exists("attributes", lambda a: F.rlike(a, F.lit(r"^([\w:]*::)?test(\(|$)"))))
    if not include_ignored:
        tests = tests.where(~F.exists("attributes", lambda a: F.startswith(a, F.lit("ignore"))))
    if test_filter:
        tests = tests.where(F.contains("fn_id", F.lit(test_filter)))
    deferred = code.relation("flow").where("fact = 'deferred'").select("file_path", "line").distinct()
    edges = resolved_edges(code).where("call_kind = 'function'").join(deferred, ["file_path", "line"], "left_anti")
    reached = graph.reachable_tests(edges, tests.select(F.col("fn_id").alias("node")))
    return code.functions.where(~F.col("is_test")).select("fn_id").join(reached.withColumnRenamed("node", "fn_id"), "fn_id", "left").fillna(0)


def blind_spots(code: CodeIndex) -> DataFrame:
    """(file_path, line, column, callee, reason) of calls that the coverage map can't follow."""
    sites = code.call_sites.where("NOT call_kind LIKE '%via_alias' AND call_kind <> 'framework'")
    proven = resolved_edges(code).select("file_path", "line", "column", "callee").distinct().withColumn("proven", F.lit(True))
    deferred = code.relation("flow").where("fact = 'deferred'").select("file_path", "line").distinct().withColumn("deferred", F.lit(True))
    d = sites.join(proven, ["file_path", "line", "column", "callee"], "left").join(deferred, ["file_path", "line"], "left")
    reason = rollup.first_reason([
        ("outside_function", F.col("caller_id").isNull()),
        ("deferred", F.coalesce("deferred", F.lit(False))),
        ("indirect", F.col("callee_base") == "complex_call"),
        ("method", F.col("call_kind") == "method"),
        ("macro", F.col("call_kind") == "macro"),
        ("unresolved", F.col("proven").isNull()),
    ])
    return d.withColumn("reason", reason).where("reason IS NOT NULL").select("file_path", "line", "column", "callee", "reason").distinct()


def runtime_coverage(code: CodeIndex, regions: DataFrame) -> DataFrame:
    """(fn_id, n_executed, n_regions, state): code regions of a coverage export put to the narrowest function around, if only one is."""
    once = regions.groupBy("file_path", "start_line", "start_col", "end_line", "end_col").agg(F.bool_or(F.col("count") > 0).alias("ran"))
    spans = code.functions.select("file_path", "start_line", "end_line", "fn_id")
    key = ["file_path", "start_line", "start_col", "end_line", "end_col"]
    found = intervals.narrowest_unique(once.withColumn("line", F.col("start_line")), spans, ["file_path"], key, "line", "start_line", "end_line")
    seen = rollup.region_states(found.select(F.col("span_fn_id").alias("fn_id"), *key, "ran"), "fn_id", key, F.col("ran"))
    out = code.functions.select("fn_id").join(seen, "fn_id", "left")
    return out.select("fn_id", F.coalesce("n_executed", F.lit(0)).alias("n_executed"), F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("state", F.lit("not_measured")).alias("state"))


def changed(code: CodeIndex, ranges: DataFrame) -> DataFrame:
    """Symbols whose span overlaps a changed range of their file."""
    return intervals.overlapping(code.symbols, ranges, "start_line", "end_line", "range_start", "range_end", ["file_path"])


def lookup(code: CodeIndex, query: str) -> DataFrame:
    """Functions by ``[fn:]path:line:name``, by ``path:line`` or ``path#Lline`` (innermost first), or by exact name."""
    import re

    q = query.removeprefix("fn:")
    if m := re.fullmatch(r"(.+\.rs):(\d+):(\w+)", q):
        d = code.functions.where(F.endswith("file_path", F.lit(m[1])) & (F.col("start_line") == int(m[2])) & (F.col("name") == m[3])).withColumn("score", F.lit(1.0))
    elif m := re.fullmatch(r"(.+\.rs)(?::|#L)(\d+)", q):
        line = F.lit(int(m[2]))
        d = code.functions.where(F.endswith("file_path", F.lit(m[1])) & line.between(F.col("start_line"), F.col("end_line"))).withColumn("score", 1.0 / (F.col("end_line") - F.col("start_line") + 1))
    else:
        d = code.functions.where(F.col("name") == q).withColumn("score", F.lit(1.0))
    return d.orderBy(F.desc("score"), "file_path", "start_line")


def loose_candidates(code: CodeIndex, strict: bool = False) -> DataFrame:
    """(caller_id, callee, line, column, target, mode): the loose resolver. By type qualifier, then by module of the path, then methods for
    receivers; where the type qualifier fits nothing, all homonyms, or none if ``strict``."""
    target = code.functions.select(F.col("fn_id").alias("target"), F.col("name").alias("t_name"), F.regexp_replace("owner_type", r"<.*", "").alias("t_owner"), F.col("kind_tag").alias("t_kind"), F.col("file_path").alias("t_file"))
    sites = code.call_sites.where("caller_id IS NOT NULL").select("caller_id", "callee", "callee_base", "file_path", "line", "column").distinct()
    d = sites.join(target, sites["callee_base"] == target["t_name"])
    key = ["caller_id", "callee", "file_path", "line", "column"]
    kind = text.type_qualifier(F.col("callee"))
    d = d.withColumn("q", kind).withColumn("typed", F.col("q").isNull() | (F.col("t_owner") == F.col("q")))
    site = Window.partitionBy(*key)
    d = d.withColumn("any_typed", F.bool_or(F.coalesce("typed", F.lit(False))).over(site))
    d = d.where(F.coalesce("typed", F.lit(False)) | (F.lit(not strict) & ~F.col("any_typed"))).withColumn("mode", F.when(F.col("any_typed"), "strict").otherwise("fell_back"))
    last = F.try_element_at(text.module_segments(F.col("callee")), F.lit(-1))
    in_module = F.contains("t_file", F.concat(F.lit("/"), last, F.lit("/"))) | F.contains("t_file", F.concat(F.lit("/"), last, F.lit(".")))
    d = resolve.strict_or_all(d.withColumnRenamed("mode", "how"), key, F.coalesce(in_module, F.lit(False))).drop("mode")
    dotted = F.rlike("callee", F.lit(r"^(receiver|[a-z_]\w*)\.\w+$"))
    d = resolve.strict_or_all(d, key, ~dotted | (F.col("t_kind") != "function")).drop("mode")
    return d.select("caller_id", "callee", "file_path", "line", "column", "target", F.col("how").alias("mode"))


def callee_lists(code: CodeIndex) -> DataFrame:
    """(caller_id, callees): what each function calls, in source order, duplicates kept."""
    d = code.call_sites.where("caller_id IS NOT NULL").groupBy("caller_id").agg(F.sort_array(F.collect_list(F.struct("line", "column", "callee"))).alias("c"))
    return d.select("caller_id", F.transform("c", lambda x: x["callee"]).alias("callees"))


def reverse_suggestion(code: CodeIndex, source: str, target: str, limit: int = 3) -> DataFrame:
    """Paths the other way round, for when there are none from source to target."""
    return paths_between(code, target, source, limit=limit)[0]


def parameter_literals(code: CodeIndex) -> DataFrame:
    """(fn_id, position, literal): string literals that calls pass to a parameter, where the callee's name and position name one site only."""
    sites = code.relation("string_sites").where("role = 'parameter'").select(F.col("owner").alias("fn_id"), F.col("owner_name").alias("callee_base"), "position")
    alone = sites.withColumn("n", F.count("*").over(Window.partitionBy("callee_base", "position"))).where("n = 1")
    given = code.call_sites.where("call_kind = 'function'").select("callee_base", F.posexplode("args").alias("position", "arg"))
    literal = F.regexp_extract("arg", r'^(?:String::from ?\()?"((?:[^"\\]|\\.)*)"\)?(?:\.(?:to_string|to_owned|into)\(\))?$', 1)
    return given.withColumn("literal", literal).where("literal <> ''").join(alone, ["callee_base", "position"]).select("fn_id", "position", "literal").distinct()


def call_semantics(code: CodeIndex) -> DataFrame:
    """(src, dst, semantics) of resolved calls: what the callee takes first and what it gives."""
    f = code.functions.select(F.col("fn_id").alias("dst"), "return_type", F.regexp_extract(F.try_element_at(F.filter("parameters", lambda p: F.contains(p, F.lit(":"))), F.lit(1)), r":\s*(.*)$", 1).alias("takes"))
    return resolved_edges(code).select("src", "dst").distinct().join(f, "dst").select("src", "dst", text.edge_semantics(F.col("return_type"), F.nullif("takes", F.lit(""))).alias("semantics"))


def file_provenance(code: CodeIndex) -> DataFrame:
    """(file_path, provenance) of each file."""
    head = F.array_join(F.slice(text.lines(F.col("content")), 1, 40), "\n")
    return code.files.select("file_path", text.provenance(F.col("file_path"), head).alias("provenance"))


def snapshot_mismatches(code: CodeIndex, snapshot: DataFrame) -> DataFrame:
    """Paths of a coverage snapshot (file_path, content) that are missing here or differ: these make its figures void."""
    here = code.files.select("file_path", F.col("content").alias("here"))
    return snapshot.join(here, "file_path", "left").where(F.col("here").isNull() | (F.col("here") != F.col("content"))).select("file_path")


def call_tree(edges: DataFrame, root: str, depth: int = 3) -> str:
    """A call graph (bounded by its scope) as an indented text, each function expanded at its first place."""
    follow: dict[str, list[str]] = {}
    for r in edges.orderBy("src", "dst").toLocalIterator():
        follow.setdefault(r["src"], []).append(r["dst"])
    out, seen, todo = [], set(), [(root, 0)]
    while todo:
        node, level = todo.pop()
        again = node in seen
        out.append("  " * level + node + (" (above)" if again else ""))
        if not again and level < depth:
            seen.add(node)
            todo += [(n, level + 1) for n in reversed(follow.get(node, []))]
    return "\n".join(out)
