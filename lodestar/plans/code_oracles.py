"""DuckDB counterparts of the queries over the fixture crate.

What the parser and the resolver must find there is written down by hand, read off the sources: functions, types, resolved calls and string-typed
declarations. All else is SQL over these and over the text of the files.
"""

from __future__ import annotations

from lodestar.plans import fixture


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


LIB, STORE, WEB = fixture.FILES
# name, kind, signature, file, first line, last line, public, test
FUNCTIONS = [
    ("fmt", "method(Event)", "fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result", LIB, 15, 15, False, False),
    ("parse", "function", "pub fn parse(line: &str) -> Option<Event>", LIB, 18, 21, True, False),
    ("split", "function", "fn split(line: &str) -> Vec<String>", LIB, 23, 23, False, False),
    ("build", "function", "fn build(parts: Vec<String>) -> Option<Event>", LIB, 25, 28, False, False),
    ("step", "function", "pub fn step(event: Event) -> Event", LIB, 30, 33, True, False),
    ("pipe", "function", "pub fn pipe(line: &str)", LIB, 35, 39, True, False),
    ("never_called", "function", "pub fn never_called(mode: &str) -> bool", LIB, 41, 41, True, False),
    ("parses", "function", "fn parses()", LIB, 47, 47, False, True),
    ("helper", "function", "fn helper(_: Option<Event>)", LIB, 48, 48, False, True),
    ("put", "trait_fn(Store)", "fn put(&mut self, event: Event)", STORE, 3, 3, False, False),
    ("flush", "trait_fn(Store)", "fn flush(&self)", STORE, 3, 3, False, False),
    ("put", "method(Memory)", "fn put(&mut self, event: Event)", STORE, 5, 5, False, False),
    ("save", "function", "pub fn save(event: Event)", STORE, 6, 6, True, False),
    ("open", "function", "fn open() -> Memory", STORE, 7, 7, False, False),
    ("list", "function", "pub fn list()", WEB, 1, 1, True, False),
    ("app", "function", "pub fn app()", WEB, 2, 2, True, False),
    ("save", "function", "pub fn save()", WEB, 3, 3, True, False),
]
# prefix of the id, kind, name, signature, file, line, public
TYPES = [
    ("struct", "struct", "Event", "pub struct Event", LIB, 9, True),
    ("enum", "enum", "Level", "pub enum Level", LIB, 11, True),
    ("const", "const", "LIMIT", "pub const LIMIT: usize", LIB, 12, True),
    ("const", "static mut", "COUNT", "static mut COUNT: u32", STORE, 2, False),
    ("trait", "trait", "Store", "pub trait Store", STORE, 3, True),
    ("struct", "struct", "Memory", "pub struct Memory", STORE, 4, True),
]
_PARSE, _SPLIT, _BUILD, _STEP, _PIPE = f"{LIB}:18:parse", f"{LIB}:23:split", f"{LIB}:25:build", f"{LIB}:30:step", f"{LIB}:35:pipe"
_TEST, _HELPER, _SAVE, _OPEN, _LIST, _APP = f"{LIB}:47:parses", f"{LIB}:48:helper", f"{STORE}:6:save", f"{STORE}:7:open", f"{WEB}:1:list", f"{WEB}:2:app"
# caller, callee, line, the callee's name, whether a framework calls it; ``m.put`` has two targets and resolves to none
CALLS = [
    (_PARSE, _SPLIT, 19, "split", False), (_PARSE, _BUILD, 20, "build", False), (_PIPE, _PARSE, 36, "parse", False), (_PIPE, _STEP, 37, "step", False),
    (_PIPE, _SAVE, 38, "save", False), (_TEST, _PARSE, 47, "parse", False), (_TEST, _HELPER, 47, "helper", False), (_SAVE, _OPEN, 6, "open", False),
    (_APP, _PIPE, 2, "pipe", False), (_APP, _LIST, 2, "list", True),
]
# what other calls there are: file, line, how the call expression begins, the callee, why the coverage map can't follow
BLIND = [
    (LIB, 15, "write!", "write!", "macro"), (LIB, 23, "line.split", "line.split", "method"), (LIB, 23, "line.split", "receiver.map", "method"), (LIB, 23, "line.split", "receiver.collect", "method"),
    (LIB, 26, "parts.len", "parts.len", "method"), (LIB, 27, "Some(", "Some", "unresolved"), (LIB, 27, "String::new", "String::new", "unresolved"), (LIB, 36, "parse(", "receiver.unwrap", "method"),
    (STORE, 5, "self.events", "receiver.push", "method"), (STORE, 6, "m.put", "m.put", "method"), (STORE, 7, "Vec::new", "Vec::new", "unresolved"), (STORE, 7, "String::new", "String::new", "unresolved"),
    (WEB, 2, "Router::new", "Router::new", "unresolved"), (WEB, 2, "Router::new", "receiver.route", "method"), (WEB, 2, "get(", "get", "unresolved"),
]

BASE = f"""WITH RECURSIVE src(file_path, content) AS (VALUES {_values(fixture.FILES.items())}),
 txt AS (SELECT file_path, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM (SELECT file_path, string_split(rtrim(content, chr(10)), chr(10)) AS l FROM src)),
 fn AS (SELECT file_path || ':' || start_line || ':' || name AS fn_id, k AS ordinal, * EXCLUDE (k) FROM (VALUES {_values((k, *f) for k, f in enumerate(FUNCTIONS))}) AS t(k, name, kind, signature, file_path, start_line, end_line, is_pub, is_test)),
 ty AS (SELECT p || ':' || file_path || ':' || start_line || ':' || name AS symbol_id, * EXCLUDE (p) FROM (VALUES {_values(TYPES)}) AS t(p, symbol_kind, name, signature, file_path, start_line, is_pub)),
 calls(src, dst, line, callee, framework) AS (VALUES {_values(CALLS)}),
 edge AS (SELECT DISTINCT src, dst FROM calls)"""
#: Each line with the function around it that starts last, of several the first.
_AROUND = "a AS (SELECT x.*, fn_id, name AS fn_name, coalesce(is_test, false) AS is_test FROM {of} x LEFT JOIN fn ON fn.file_path = x.file_path AND x.line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY x.file_path, x.line{key} ORDER BY start_line DESC NULLS LAST, ordinal) = 1)"
_SYMBOLS = "s AS (SELECT fn_id AS symbol_id, 'function' AS symbol_kind, name, kind, signature, file_path, start_line, end_line, is_pub, is_test FROM fn UNION ALL SELECT symbol_id, symbol_kind, name, symbol_kind, signature, file_path, start_line, start_line, is_pub, false FROM ty)"
_REACH = "b(root, node, dist) AS (SELECT fn_id, fn_id, 0 FROM fn WHERE name = '{name}' UNION SELECT b.root, e.{to}, dist + 1 FROM b JOIN edge e ON e.{of} = b.node WHERE dist < {depth})"
_DOT = "'  \"' || src || '\" -> \"' || dst || '\";'"

_REFS = """w AS (SELECT file_path, line, unnest(range(1, len(string_split_regex(text, '\\bEvent\\b')))) AS k, string_split_regex(text, '\\bEvent\\b') AS p, text FROM txt),
 o AS (SELECT file_path, line, (len(array_to_string(p[:k], 'Event')))::INT AS col, p[k] AS before, p[k + 1] AS after FROM w),
 r AS (SELECT file_path, line, col, CASE WHEN starts_with(after, ' { id') THEN 'struct' ELSE 'type' END AS kind FROM o WHERE NOT regexp_matches(before, '(struct |^use .*)$')),
 """


def oracle_sql() -> dict[str, str]:
    tests = "b(root, node) AS (SELECT fn_id, fn_id FROM fn WHERE name = 'parses' UNION SELECT b.root, dst FROM b JOIN calls ON src = b.node WHERE NOT framework), cover AS (SELECT fn_id, file_path, count(DISTINCT root) AS n_tests FROM fn LEFT JOIN b ON node = fn_id WHERE NOT is_test GROUP BY fn_id, file_path)"
    style = "CASE WHEN n_tests > 0 THEN 'style=filled, fillcolor=palegreen' ELSE 'style=dashed' END"
    named = "regexp_matches(signature || ' ' || kind, '\\bEvent\\b')"
    gives, takes = "regexp_matches(regexp_extract(signature, '-> (.*)$', 1), '\\bEvent\\b')", "regexp_matches(regexp_replace(signature, '-> .*$', '') || ' ' || kind, '\\bEvent\\b')"
    queries = {
        "inventory": f", {_SYMBOLS} SELECT * FROM s",
        "tree": """ SELECT src.file_path, (SELECT count(*) FROM fn WHERE fn.file_path = src.file_path) AS n_function, """
        + ", ".join(f"(SELECT count(*) FROM ty WHERE ty.file_path = src.file_path AND symbol_kind IN ({k})) AS n_{n}" for n, k in (("struct", "'struct'"), ("enum", "'enum'"), ("const", "'const', 'static', 'static mut'"), ("trait", "'trait'"), ("alias", "'alias'")))
        + " FROM src",
        "find": f", {_SYMBOLS} SELECT symbol_id, symbol_kind, name, file_path, start_line, 1.0::DOUBLE AS score, 'name' AS match_kind FROM s WHERE name = 'save'",
        "definition": f", {_SYMBOLS} SELECT *, []::VARCHAR[] AS cfg_attrs FROM s WHERE name = 'Event'",
        "callers": ", " + _REACH.format(name="save", to="src", of="dst", depth=2) + ", f AS (SELECT root AS target, node AS caller, min(dist)::INT AS distance FROM b WHERE dist > 0 GROUP BY ALL) SELECT f.*, (SELECT nullif(count(*), 0) FROM calls c WHERE c.src = caller AND c.dst = target) AS n_sites FROM f",
        "refs": f", {_REFS}" + _AROUND.format(of="r", key=", col") + " SELECT file_path, line, col, kind, fn_name AS enclosing_function, is_test FROM a",
        "usages": ", r AS (SELECT file_path, line FROM txt WHERE regexp_matches(text, '\\bparse\\(') AND NOT regexp_matches(text, 'fn parse\\(')), c AS (SELECT DISTINCT regexp_extract(src, '^[^:]*') AS file_path, line::INT AS line FROM calls WHERE dst LIKE '%:parse') SELECT *, 'callers' AS section FROM c UNION ALL SELECT *, 'refs' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_path = r.file_path AND c.line = r.line)",
        "members": ", f AS (SELECT unnest(regexp_extract_all(text, '(\\w+): \\w', 1)) AS field FROM txt WHERE starts_with(text, 'pub struct Event ')) SELECT field, (SELECT sum(len(regexp_extract_all(text, '\\w\\.' || field || '\\b(?!\\()'.replace('(?!\\()', '')))) FROM txt)::BIGINT AS n_accesses FROM f",
        "impls": " SELECT regexp_extract(text, 'for (\\w+)', 1) AS type_name, 'Store' AS trait_path, 'Store' AS trait_name, 'handwritten' AS impl_kind, file_path, line FROM txt WHERE starts_with(text, 'impl Store ')",
        "grep": ", g AS (SELECT * FROM txt WHERE contains(text, 'event')), " + _AROUND.format(of="g", key="") + " SELECT * FROM a",
        "dead": ", q AS (SELECT callee, src FROM calls) SELECT fn_id, name, 0::BIGINT AS n_live, (SELECT count(*) FROM q JOIN fn t ON t.fn_id = q.src WHERE q.callee = fn.name AND t.is_test) AS n_test, NULL::VARCHAR AS reason FROM fn WHERE is_pub AND NOT is_test AND kind = 'function' AND NOT EXISTS (SELECT 1 FROM q JOIN fn t ON t.fn_id = q.src WHERE q.callee = fn.name AND NOT t.is_test)",
        "paths": ", p(node, path) AS (SELECT fn_id, [fn_id] FROM fn WHERE name = 'app' UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN edge ON node = src WHERE NOT list_contains(path, dst) AND len(path) < 8 AND node NOT LIKE '%:open') SELECT path, len(path)::INT AS length FROM p WHERE node LIKE '%:open'",
        "lifecycle": f", m AS (SELECT fn_id, {gives} AS gives, {takes} AS takes FROM fn WHERE {named}), i AS (SELECT src, dst FROM edge WHERE src IN (SELECT fn_id FROM m) AND dst IN (SELECT fn_id FROM m) UNION SELECT p.dst, c.dst FROM calls p JOIN calls c ON p.src = c.src JOIN m mp ON mp.fn_id = p.dst AND mp.gives JOIN m mc ON mc.fn_id = c.dst AND mc.takes JOIN txt t ON t.line = p.line AND t.file_path = regexp_extract(p.src, '^[^:]*') JOIN txt u ON u.line = c.line AND u.file_path = regexp_extract(c.src, '^[^:]*') WHERE p.dst <> c.dst AND (p.line < c.line OR p.line = c.line AND instr(t.text, p.callee || '(') < instr(u.text, c.callee || '('))), d AS (SELECT fn_id AS node, (SELECT count(*) FROM i WHERE dst = fn_id) AS n_in, (SELECT count(*) FROM i WHERE src = fn_id) AS n_out FROM (SELECT DISTINCT fn_id FROM m)) SELECT *, CASE WHEN n_in > 0 AND n_out > 0 THEN 'transit' WHEN n_out > 0 THEN 'entry' WHEN n_in > 0 THEN 'endpoint' ELSE 'isolated' END AS role FROM d",
        "value_flow": f" SELECT fn_id, variable, producer, producer_line::INT AS producer_line, consumer, consumer_line::INT AS consumer_line FROM (VALUES {_values([(_PARSE, 'line', '<param>', 18, 'split', 19), (_PARSE, 'parts', 'split', 19, 'build', 20), (_PIPE, 'line', '<param>', 35, 'parse', 36), (_PIPE, 'event', 'parse', 36, 'step', 37), (_PIPE, 'next', 'step', 37, 'save', 38)])}) AS t(fn_id, variable, producer, producer_line, consumer, consumer_line)",
        "boundaries": f" SELECT fn_id, family, role, 0.55::DOUBLE AS confidence, [word] AS evidence FROM (VALUES {_values([(f'{LIB}:15:fmt', 'file', 'sink', 'write'), (_SAVE, 'file', 'sink', 'open'), (_OPEN, 'file', 'transit', 'open'), (_APP, 'http', 'source', 'route')])}) AS t(fn_id, family, role, word)",
        "stringly": f" SELECT site_id, role, suggestion, origin, confidence::DOUBLE AS confidence, n_literals::BIGINT AS n_literals FROM (VALUES {_values([(f'{LIB}:41:mode', 'parameter', 'Mode', 'literals', 0.86, 3), (f'{LIB}:9:kind', 'field', 'Kind', 'literals', 0.8, 2), (f'{LIB}:9:source_url', 'field', 'Url', 'name', 0.82, 0), (f'{STORE}:4:home_path', 'field', 'PathBuf', 'name', 0.74, 0)])}) AS t(site_id, role, suggestion, origin, confidence, n_literals)",
        "coverage": f", {tests} SELECT fn_id, n_tests FROM cover",
        # a call is where its expression begins: a chain of calls where its first receiver does
        "blind_spots": f", n(file_path, line, start, callee, reason) AS (VALUES {_values(BLIND)}), y AS (SELECT n.file_path, n.line::INT AS line, callee, reason, start, string_split(text, start) AS p FROM n JOIN txt ON txt.file_path = n.file_path AND txt.line = n.line) SELECT file_path, line, (list_sum([len(z) for z in p[:k]]) + (k - 1) * len(start))::INT AS \"column\", callee, reason FROM (SELECT *, unnest(range(1, len(p))) AS k FROM y)",
        "coverage_dot": f", {tests} SELECT 0 AS part, '  subgraph \"cluster_' || file_path || '\" {{' || chr(10) || '    label=\"' || file_path || '\";' || chr(10) || string_agg('    \"' || fn_id || '\" [' || {style} || '];', chr(10) ORDER BY fn_id) || chr(10) || '  }}' AS value FROM cover GROUP BY file_path UNION ALL SELECT DISTINCT 1, {_DOT} FROM edge",
        "slice": ", z AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY file_path ORDER BY line) AS e FROM txt) SELECT file_path, line, text, (e - 1 - strlen(text))::BIGINT AS start_byte, (e - 1)::BIGINT AS end_byte FROM z WHERE file_path = 'src/lib.rs' AND line BETWEEN 3 AND 9",
        "summary": f", {_SYMBOLS} SELECT symbol_kind AS kind, count(*) AS n FROM s GROUP BY symbol_kind UNION ALL SELECT 'file', count(*) FROM src UNION ALL SELECT 'parse_error', 0",
    }
    queries |= {
        "find_short": f", {_SYMBOLS} SELECT 'rescued' AS step, symbol_kind, name, 0.95 + 0.05 * 2 / len(name) AS score, file_path, start_line FROM s WHERE starts_with(lower(name), 'pa')",
        "find_relaxed": f", {_SYMBOLS}, z AS (SELECT *, 1 - levenshtein(lower(name), 'pasre') / greatest(5, len(name))::DOUBLE AS score FROM s) SELECT 'suggested' AS step, symbol_kind, name, score, file_path, start_line FROM z WHERE score >= 0.5 ORDER BY score DESC, name LIMIT 5",
        "refs_by_function": f", {_REFS}" + _AROUND.format(of="r", key=", col") + " SELECT fn_name AS enclosing_function, count(*) AS n, bool_or(is_test) AS is_test, list(file_path || ':' || line || ':' || col ORDER BY file_path, line, col) AS places FROM a GROUP BY fn_name",
        "member_sites": ", f AS (SELECT unnest(regexp_extract_all(text, '(\\w+): \\w', 1)) AS field FROM txt WHERE starts_with(text, 'pub struct Event ')), q AS (SELECT field, file_path, line, string_split(text, '.' || field) AS p, field AS g FROM txt, f WHERE regexp_matches(text, '\\w\\.' || field || '\\b')), h AS (SELECT field, file_path || ':' || line || ':' || (list_sum([len(z) for z in p[:k]]) + (k - 1) * (len(field) + 1) + 1) AS place, line, k FROM (SELECT *, unnest(range(1, len(p))) AS k FROM q)) SELECT field, count(place) AS n_accesses, false AS truncated, coalesce(list(place ORDER BY line, k) FILTER (WHERE place IS NOT NULL), []) AS places FROM f LEFT JOIN h USING (field) GROUP BY field",
        "caller_sites": ", c AS (SELECT dst AS target, src AS caller, c.line, (instr(text, regexp_extract(text, '((?:\\w+::)*)' || callee || '\\(', 1) || callee || '(') - 1) AS col FROM calls c JOIN txt ON txt.line = c.line AND txt.file_path = regexp_extract(src, '^[^:]*') WHERE callee IN ('parse', 'save')) SELECT target, caller, list(line || ':' || col ORDER BY line, col) AS places, (SELECT count(*) FROM c d WHERE d.target = c.target) AS n_target FROM c WHERE target LIKE '%:parse' GROUP BY target, caller",
        "symbols": f", {_SYMBOLS} SELECT symbol_kind, name, file_path, start_line FROM s WHERE contains(lower(name), 'e') AND is_pub",
        "stringly_counts": " SELECT origin, n::BIGINT AS n, n_sure::BIGINT AS n_sure FROM (VALUES ('literals', 2, 1), ('name', 2, 0)) AS t(origin, n, n_sure)",
        "modules": " SELECT file_path, CASE file_path WHEN 'src/lib.rs' THEN 'crate' ELSE 'crate::' || regexp_extract(file_path, '(\\w+)\\.rs$', 1) END AS module FROM src",
        "unresolved": " SELECT callee_base, n::BIGINT AS n FROM (VALUES ('new', 5), ('get', 1)) AS t(callee_base, n)",
        # ``line.split`` may be the project's split, as far as receivers tell
        "external": f" SELECT src, callee FROM (VALUES {_values([(f'{LIB}:15:fmt', 'write!'), (_BUILD, 'parts.len'), (_BUILD, 'Some'), (_BUILD, 'String::new'), (_PIPE, 'receiver.unwrap'), (_OPEN, 'Vec::new'), (_OPEN, 'String::new'), (_APP, 'Router::new'), (_APP, 'receiver.route'), (_APP, 'get')])}) AS t(src, callee)",
    }
    down, up = _REACH.format(name="pipe", to="dst", of="src", depth=3), _REACH.format(name="pipe", to="src", of="dst", depth=3).replace("b(", "u(").replace("b.", "u.").replace("FROM b", "FROM u")
    kept = f", {down}, {up}, k AS (SELECT node FROM b{{also}}) SELECT {{shown}} FROM edge WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)"
    queries["call_graph"] = kept.format(also=" UNION SELECT node FROM u", shown="src, dst")
    queries["call_graph_dot"] = kept.format(also="", shown=f"{_DOT} AS value")
    return {f"code_{name}": BASE + sql for name, sql in queries.items()}
