"""The commands on small source trees with known answers."""

import pytest

from lodestar.plans import commands as C
from lodestar.sources.code import CodeIndex, dependencies, llvm_regions, parse_hunks
from lodestar.sources.rust_items import cfg_enables_test, extract
from lodestar.sources.rust_tokens import RustSyntaxError, tokenize


def names(df, *cols):
    return sorted(tuple(r) if len(cols) != 1 else r[0] for r in df.select(*cols).collect())


LIB = """
//! docs
pub mod p; pub mod q;
use std::fmt as formatting;
pub use inner::t as r;
/// A point.
#[derive(Debug, Clone)]
pub struct Point { pub x: f64, y: f64, host: String }
pub enum Shape { Dot(Point), Line { a: Point, b: Point }, Unit = 3 }
pub const MAX: usize = 10;
static mut COUNT: u32 = 0;
pub trait Area: Sized { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
type Points<K> = Vec<K>;
impl Area for Point { fn area(&self) -> f64 { self.x * self.y } }
impl Point {
    pub const ORIGIN: usize = 0;
    pub async fn go(&self, n: usize) -> Result<Point, String> { helper(n); Ok(Point { x: self.x, y: 1.0, host: String::new() }) }
}
pub fn helper(n: usize) -> usize { if n > 1 { n - 1 } else { 0 } }
fn x() { p::run(); }
fn y() { q::run(); }
pub fn unused<'a>(s: &'a str) -> char { 'c' }
fn main() { let v = helper(3); println!("{}", v); x(); y(); let s = r#"no "call()" here"#; /* nested /* deep() */ */ }
#[cfg(test)]
mod tests {
    use super::*;
    #[test]
    fn test_helper() { assert_eq!(helper(2), 1); let z = helper(5); only_test(); }
    fn only_test() {}
}
"""
TREE = {
    "src/lib.rs": LIB,
    "src/p.rs": "pub fn run() { deep(); }\nfn deep() {}\n",
    "src/q.rs": "pub fn run() {}\npub struct Q;\nimpl Q { pub fn go(&self) {} }\n",
    "src/bad.rs": "fn broken( {",
    "src/web.rs": 'pub fn list() {}\npub fn app() { Router::new().route("/x", get(list)); }\n',
}


@pytest.fixture(scope="module")
def code(spark):
    return CodeIndex.from_strings(spark, TREE)


def test_tokens_tell_lifetimes_raw_strings_and_nested_comments_apart():
    t = tokenize("fn f<'a>(x: &'a str) { 'x'; '\\n'; r#\"a\"b\"#; /* a /* b */ c */ 1..2; 1.5e3 } // end")
    assert [x.text for x in t if x.kind in ("life", "char", "str", "num")] == ["'a", "'a", "'x'", "'\\n'", 'r#"a"b"#', "1", "2", "1.5e3"]
    with pytest.raises(RustSyntaxError):
        tokenize("/* open")


def test_cfg_predicates():
    assert cfg_enables_test("test") and cfg_enables_test("all(unix, any(test, windows))")
    assert not cfg_enables_test("not(test)") and not cfg_enables_test('feature = "test"')


def test_items(code):
    fns = {r.name: r for r in code.functions.where("file_path = 'src/lib.rs'").collect()}
    assert fns["go"].kind == "method(Point)" and fns["go"].is_async and fns["go"].is_pub
    assert fns["area"].owner_type in ("Area", "Point") and fns["helper"].parameters == ["n: usize"] and fns["helper"].return_type == "usize"
    assert fns["test_helper"].is_test and fns["only_test"].is_test and not fns["helper"].is_test
    assert fns["unused"].generics == ["'a"] and fns["twice"].kind == "trait_fn(Area)" and not fns["twice"].is_pub
    types = {(r.symbol_kind, r.name): r for r in code.types.where("file_path = 'src/lib.rs'").collect()}
    assert types["struct", "Point"].fields == ["pub x: f64", "y: f64", "host: String"]
    assert [(v.name, v.fields, v.discriminant) for v in types["enum", "Shape"].variants] == [("Dot", ["Point"], None), ("Line", ["a: Point", "b: Point"], None), ("Unit", [], "3")]
    assert types["const", "MAX"].ty == "usize" and types["static mut", "COUNT"].ty == "u32" and types["const", "ORIGIN"].kind == "const(Point)"
    assert types["alias", "Points"].rhs == "Vec<K>" and "= 10" not in types["const", "MAX"].signature


def test_bad_file_is_recorded_and_the_rest_loads(code):
    assert names(code.parse_errors, "file_path") == ["src/bad.rs"]


def test_inventory_tree_and_definition(code):
    assert names(C.inventory(code, kinds=["enum"]), "name") == ["Shape"]
    tree = {r.file_path: r for r in C.tree(code).collect()}
    assert tree["src/bad.rs"].n_function == 0 and tree["src/lib.rs"].n_const == 3 and tree["src/q.rs"].n_struct == 1
    assert names(C.definition(code, "run"), "file_path") == ["src/p.rs", "src/q.rs"]


def test_find(code):
    assert names(C.find(code, "helper", kinds=["function"]), "name") == ["helper"]
    assert set(names(C.find(code, "run|deep"), "name")) == {"run", "deep"}
    assert names(C.find(code, "POINT", exact=True), "name") == ["Point"]
    with pytest.raises(ValueError):
        C.find(code, "two words")


def test_homonyms_resolve_by_module(code):
    e = {(r.src.split(":")[-1], r.dst) for r in C.resolved_edges(code).collect()}
    assert ("x", "src/p.rs:1:run") in e and ("y", "src/q.rs:1:run") in e
    assert ("x", "src/q.rs:1:run") not in e and ("y", "src/p.rs:1:run") not in e


def test_external_and_dotted_calls_have_no_phantom_edges(spark):
    c = CodeIndex.from_strings(spark, {"src/lib.rs": "fn spawn() {}\nfn e() { ext::spawn(w()); }\nstruct S; impl S { fn go(&self) {} }\nfn go() {}\nfn caller(s: S) { s.go(); }\n"})
    e = {(r.src.split(":")[-1], r.dst) for r in C.resolved_edges(c).collect()}
    assert ("e", "src/lib.rs:1:spawn") not in e and ("caller", "src/lib.rs:4:go") not in e and ("caller", "src/lib.rs:3:go") in e


def test_callers_paths_and_call_graph(code):
    assert {r.caller.split(":")[-1] for r in C.callers(code, "deep", depth=3).collect()} == {"run", "x", "main"}
    found, info = C.paths_between(code, "main", "deep")
    assert [[n.split(":")[-1] for n in r.path] for r in found.collect()] == [["main", "x", "run", "deep"]] and not info["search_truncated"]
    assert not C.paths_between(code, "main", "deep", max_nodes=3)[0].collect()
    assert ("main", "x") in {(r.src.split(":")[-1], r.dst.split(":")[-1]) for r in C.call_graph(code, "main").collect()}


def test_renamed_reexport_gives_an_edge(spark):
    c = CodeIndex.from_strings(spark, {"src/lib.rs": "mod inner { pub fn t() {} }\npub use inner::t as r;\nfn e() { r(); }\n"})
    assert ("e", "t") in {(r.src.split(":")[-1], r.dst.split(":")[-1]) for r in C.resolved_edges(c).collect()}


def test_refs_members_impls_and_usages(code):
    kinds = {r.kind for r in C.refs(code, "Point").collect()}
    assert {"type", "struct"} <= kinds
    assert dict(names(C.members(code, "Point"), "field", "n_accesses")) == {"x": 2, "y": 1, "host": 0}
    assert names(C.impls(code, "Debug"), "type_name", "impl_kind") == [("Point", "derive")]
    assert names(C.impls(code, "Area"), "type_name", "impl_kind") == [("Point", "handwritten")]
    use = names(C.usages(code, "helper"), "section", "line")
    assert ("callers", 17) in use and len({u[1] for u in use}) == len(use)


def test_grep_attributes_lines(code):
    hits = C.grep(code, r"helper\(")
    by = {r.fn_id and r.fn_id.split(":")[-1]: r.n for r in C.grep_by_function(hits).collect()}
    assert by["main"] == 1 and by["test_helper"] == 1
    assert "test_helper" not in names(C.grep(code, "helper", exclude_tests=True).where("fn_name IS NOT NULL"), "fn_name")
    with pytest.raises(ValueError):
        C.grep(code, r"(a)\1")


def test_dead_code(code):
    got = {r.name: r for r in C.dead_code(code).collect()}
    assert "unused" in got and got["unused"].reason is None
    assert "helper" not in got
    assert "list" not in got or got["list"].reason == "framework_handler"


def test_lifecycle_roles_and_value_flow(spark):
    c = CodeIndex.from_strings(spark, {"src/lib.rs": "struct Ev;\nfn parse(s: &str) -> Ev { Ev }\nfn step(e: Ev) -> Ev { e }\nfn save(e: Ev) {}\nfn pipe(s: &str) {\n let e = parse(s);\n let f = step(e);\n save(f);\n}\nfn entry() { pipe(\"a\"); }\n"})
    roles = {r.node.split(":")[-1]: r.role for r in C.lifecycle(c, "Ev").collect()}
    assert roles["parse"] == "entry" and roles["step"] == "transit" and roles["save"] == "endpoint"
    flow = {(r.variable, r.producer, r.consumer) for r in C.value_flow(c).collect()}
    assert {("s", "<param>", "parse"), ("e", "parse", "step"), ("f", "step", "save")} <= flow
    parts = C.ensemble(c, "pipe")
    assert {r.node.split(":")[-1] for r in parts["downstream"].collect()} == {"parse", "step", "save"}
    assert {r.node.split(":")[-1] for r in parts["upstream"].collect()} == {"entry"}


def test_coverage(code):
    got = {r.fn_id.split(":")[-1]: r.n_tests for r in C.test_coverage(code).collect()}
    assert got["helper"] == 1 and got["unused"] == 0
    assert {"method", "unresolved"} <= {r.reason for r in C.blind_spots(code).collect()}


def test_runtime_coverage(spark, code, tmp_path):
    line = code.functions.where("name = 'helper'").first().start_line
    f = tmp_path / "cov.json"
    f.write_text('{"type":"llvm.coverage.json.export","version":"3.0.1","data":[{"functions":[{"filenames":["src/lib.rs"],"regions":[[%d,1,%d,9,0,0,0,0],[%d,1,%d,9,4,0,0,0],[%d,2,%d,9,4,0,0,4]]}]}]}' % ((line,) * 6))
    got = {r.fn_id.split(":")[-1]: (r.n_executed, r.n_regions, r.state) for r in C.runtime_coverage(code, llvm_regions(spark, str(f))).collect()}
    assert got["helper"] == (1, 1, "observed") and got["unused"] == (0, 0, "not_measured")


def test_stringly(spark):
    src = 'struct Conf { host: String, homepage_url: String, mode: String }\nfn f(mode: &str, addr: &str) -> bool { let a: IpAddr = addr.parse().unwrap(); mode == "fast" || mode == "slow" || mode == "off" }\n'
    got = {(r.role, r.site_id.split(":")[-1]): r for r in C.stringly(CodeIndex.from_strings(spark, {"src/lib.rs": src}), least=0.8).collect()}
    assert got["parameter", "addr"].origin == "conversion" and got["parameter", "mode"].origin == "literals" and got["field", "homepage_url"].suggestion == "Url"


def test_changed_and_sources(spark, code, tmp_path):
    diff = "--- a/src/p.rs\n+++ b/src/p.rs\n@@ -2,0 +2 @@\n+x\n@@ -9,3 +8,0 @@\n"
    assert parse_hunks(diff) == [("src/p.rs", 2, 2), ("src/p.rs", 8, 8)]
    r = spark.createDataFrame(parse_hunks(diff), "file_path string, range_start int, range_end int")
    assert names(C.changed(code, r), "name") == ["deep"]
    assert names(dependencies(spark, '[dependencies]\nurl2 = {package = "url"}\nserde-json = "1"\n'), "alias", "package") == [("serde_json", "serde-json"), ("url2", "url")]
    for p, t in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "target").mkdir()
    (tmp_path / "target/gen.rs").write_text("fn generated() {}")
    (tmp_path / ".gitignore").write_text("target/\n")
    found = names(CodeIndex.from_path(spark, str(tmp_path)).functions, "name")
    assert "helper" in found and "generated" not in found


def test_extract_is_total_on_odd_code():
    out = extract("a.rs", "macro_rules! m { ($x:expr) => { $x } }\nm!{ fn z() {} }\nextern \"C\" { fn c(x: i32); }\nunion U { a: u8 }\nimpl<T> Tr<T> for &'a S<T> where T: X { type O = T; }\nconst _: () = { call(); };\n")
    assert [f["name"] for f in out.functions] == ["c"] and out.impls[0]["type_name"] == "S" or out.impls


def test_lookup_by_id_line_and_name(code):
    assert names(C.lookup(code, "src/p.rs:1:run"), "fn_id") == ["src/p.rs:1:run"] == names(C.lookup(code, "fn:p.rs:1:run"), "fn_id")
    assert [r.name for r in C.lookup(code, "p.rs#L2").collect()] == ["deep"]
    assert names(C.lookup(code, "run"), "fn_id") == ["src/p.rs:1:run", "src/q.rs:1:run"]


def test_loose_resolver_narrows_by_qualifier(spark):
    src = "struct A; struct B;\nimpl A { fn new() {} fn go(&self) {} }\nimpl B { fn new() {} }\nfn go() {}\nfn f(a: A) { A::new(); a.go(); C::new(); }\n"
    c = CodeIndex.from_strings(spark, {"src/lib.rs": src})
    got = {(r.callee, r.target, r.mode) for r in C.loose_candidates(c).collect()}
    assert ("A::new", "src/lib.rs:2:new", "strict") in got and ("A::new", "src/lib.rs:3:new", "strict") not in got
    assert {t for k, t, _ in got if k == "a.go"} == {"src/lib.rs:2:go"}
    assert {(t, m) for k, t, m in got if k == "C::new"} == {("src/lib.rs:2:new", "fell_back"), ("src/lib.rs:3:new", "fell_back")}
    assert not [r for r in C.loose_candidates(c, strict=True).collect() if r.callee == "C::new"]


def test_smaller_relations(spark, code):
    lists = {r.caller_id.split(":")[-1]: r.callees for r in C.callee_lists(code).collect()}
    assert lists["x"] == ["p::run"] and lists["main"] == ["helper", "x", "y"]
    assert C.reverse_suggestion(code, "deep", "main").count() == 1
    c = CodeIndex.from_strings(spark, {"src/gen/a.rs": 'fn year(y: &str) {}\nfn f() { year("1999"); year("2001"); }\n', "src/v.rs": "// @generated\nfn make(n: u32) -> Option<u32> { None }\nfn g() { make(1); }\n"})
    assert names(C.parameter_literals(c), "literal") == ["1999", "2001"]
    assert dict(names(C.file_provenance(c), "file_path", "provenance")) == {"src/gen/a.rs": "generated", "src/v.rs": "generated"}
    kinds = {r.dst.split(":")[-1]: r.semantics.kind for r in C.call_semantics(c).collect()}
    assert kinds == {"year": "side_effect", "make": "pass_through"}
    snap = spark.createDataFrame([("src/v.rs", "other"), ("src/none.rs", "")], "file_path string, content string")
    assert names(C.snapshot_mismatches(c, snap), "file_path") == ["src/none.rs", "src/v.rs"]
    assert C.call_tree(C.call_graph(code, "x"), names(C.lookup(code, "x"), "fn_id")[0]).splitlines()[1] == "  src/p.rs:1:run"
