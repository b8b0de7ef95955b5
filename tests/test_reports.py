from lodestar.plans import commands as C
from lodestar.plans import fixture, reports
from lodestar.sources.code import CodeIndex
from lodestar.streaming.ingest import ingest, read_index, stream_files


def test_slices_profiles_and_renderings(spark, tmp_path):
    code = CodeIndex.from_strings(spark, {"src/a.rs": "fn é() {\r\n}\nstruct S;\n", **fixture.FILES})
    rows = [(r.line, r.text, r.start_byte, r.end_byte) for r in reports.source_slice(code, "src/a.rs", 1, 3).orderBy("line").collect()]
    assert rows == [(1, "fn é() {", 0, 9), (2, "}", 11, 12), (3, "struct S;", 13, 22)]
    assert [r.text for r in reports.symbol_slice(code, "src/a.rs:1:é").orderBy("line").collect()] == ["fn é() {", "}"]
    text = reports.tree_text(C.tree(code))
    assert text.startswith("src/\n  a.rs  (1 function, 1 struct)")
    (tmp_path / "x.rs").write_text("// c\nfn a() {}\n/* b\n */\n")
    (tmp_path / "Cargo.toml").write_text("# c\n[package]\n")
    (tmp_path / "y.py").write_text("# c\nx = 1\ny = 2\n")
    assert [tuple(r) for r in reports.language_profile(spark, str(tmp_path)).collect()] == [("rust", 1, 1), ("python", 1, 2), ("toml", 1, 1)]
    assert {r.kind: r.n for r in reports.project_summary(code).collect()}["file"] == 4


def test_incremental_ingestion_equals_one_parse(spark, tmp_path):
    for p, t in fixture.FILES.items():
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text(t)
    ingest(stream_files(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    code = CodeIndex.from_strings(spark, fixture.FILES)
    got = read_index(spark, str(tmp_path / "out"), code.files)
    assert sorted(r.name for r in got.functions.collect()) == sorted(r.name for r in code.functions.collect())
