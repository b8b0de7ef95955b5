"""Rust source trees as DataFrames: one parse of each file, then a relation for each kind of fact."""

from __future__ import annotations

import fnmatch
import json
import subprocess
import tomllib
from functools import cached_property
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import crate_key, lines, module_path
from lodestar.session import materialise
from lodestar.sources.rust_items import extract
from lodestar.sources.rust_tokens import RustSyntaxError
from lodestar.sources.schema import EXTRACTED, RELATIONS

# Methods whose first argument, the second for ``on``, is a handler that a framework calls.
HANDLER_ARGUMENT = {**dict.fromkeys("get post put patch delete head options trace any to service from_fn".split(), 0), "on": 1}


def _parse(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["file_path"], pdf["content"], strict=True):
            try:
                found = extract(path, content if isinstance(content, str) else bytes(content).decode())
            except (RustSyntaxError, UnicodeDecodeError, RecursionError, IndexError, KeyError, TypeError, AttributeError) as e:
                rows.append(("parse_errors", json.dumps({"file_path": path, "error": str(e)})))
                continue
            for name in RELATIONS:
                rows += [(name, json.dumps(r)) for r in getattr(found, name)]
        yield pd.DataFrame(rows, columns=["relation", "payload"])


class CodeIndex:
    """The relations of some files (file_path, content, crate_label). The parse is written once, a folder for each relation, and read by all queries."""

    def __init__(self, files: DataFrame, parsed: DataFrame | None = None, expand: bool = True):
        self.files = files
        self._parsed = parsed if parsed is not None else materialise(files.select("file_path", "content").mapInPandas(_parse, EXTRACTED), "code", by=("relation",))
        self._expand = expand

    @classmethod
    def from_strings(cls, spark: SparkSession, sources: dict[str, str], expand: bool = True) -> CodeIndex:
        return cls(spark.createDataFrame([(p, t, "") for p, t in sources.items()], "file_path string, content string, crate_label string"), expand=expand)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, also: list[str] = (), include_ignored: bool = False) -> CodeIndex:
        """All ``*.rs`` files below ``root``; files of the ``also`` roots come under their folder's name."""
        parts = None
        for k, r in enumerate(dict.fromkeys([root, *also])):
            label = "" if not k else Path(r).name
            d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rs").load(r)
            inner = F.expr(f"substring(path, instr(path, '{Path(r).resolve().as_posix()}') + {len(Path(r).resolve().as_posix()) + 1})")
            d = d.select(inner.alias("rel"), "content").where(~F.rlike("rel", F.lit(r"(^|/)\.")))
            if not include_ignored and (ignored := ignore_patterns(r)):
                d = d.where(~F.rlike("rel", F.lit("|".join(ignored))))
            d = d.select(F.concat(F.lit(f"{label}/" if label else ""), "rel").alias("file_path"), F.col("content").cast("string").alias("content"), F.lit(label).alias("crate_label"))
            parts = d if parts is None else parts.unionByName(d)
        return cls(parts)

    def relation(self, name: str) -> DataFrame:
        d = self._parsed.where(F.col("relation") == name).select(F.from_json("payload", RELATIONS[name]).alias("r")).select("r.*")
        return d

    @cached_property
    def functions(self) -> DataFrame:
        d = self.relation("functions")
        full = F.concat(module_path(F.col("file_path")), F.col("module_path"))
        return d.withColumn("module_path", full).withColumn("crate_key", crate_key(F.col("file_path")))

    @cached_property
    def types(self) -> DataFrame:
        return self.relation("types")

    def of_kind(self, kind: str) -> DataFrame:
        kinds = {"struct": ["struct"], "enum": ["enum"], "const": ["const", "static", "static mut"], "trait": ["trait"], "alias": ["alias"]}[kind]
        return self.types.where(F.col("symbol_kind").isin(kinds))

    @cached_property
    def symbols(self) -> DataFrame:
        """Functions and types with their common columns."""
        common = ["name", "signature", "file_path", "start_line", "end_line", "is_pub", "kind", "cfg_attrs"]
        fns = self.functions.select(F.col("fn_id").alias("symbol_id"), F.lit("function").alias("symbol_kind"), *common, "is_test")
        return fns.unionByName(self.types.select("symbol_id", "symbol_kind", *common, F.lit(False).alias("is_test")))

    @cached_property
    def call_sites(self) -> DataFrame:
        """Call sites; with expansion also handlers that frameworks call, and copies under the targets of aliases."""
        sites = self.relation("call_sites")
        if not self._expand:
            return sites
        at = F.coalesce(*(F.when(F.col("callee_base") == k, F.lit(v)) for k, v in HANDLER_ARGUMENT.items()))
        handler = F.get("args", at)
        shape = F.rlike(handler, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)*$"))
        framework = sites.where(F.col("call_kind").isin("function", "method") & shape).withColumn("callee", handler)
        framework = framework.withColumn("callee_base", F.regexp_extract("callee", r"([^:]*)$", 1)).withColumn("call_kind", F.lit("framework"))
        names = self.functions.select(F.col("name").alias("callee_base")).distinct()
        sites = sites.unionByName(framework.join(names, "callee_base", "left_semi").select(*sites.columns))
        alias = self.relation("aliases").select("alias", "target").distinct()
        copies = sites.join(alias, sites["callee_base"] == alias["alias"]).withColumn("callee", F.col("target")).withColumn("callee_base", F.col("target"))
        return sites.unionByName(copies.withColumn("call_kind", F.concat("call_kind", F.lit("_via_alias"))).select(*sites.columns))

    @cached_property
    def source_lines(self) -> DataFrame:
        return self.files.select("file_path", F.posexplode(lines(F.col("content"))).alias("k", "text")).select("file_path", (F.col("k") + 1).alias("line"), "text")

    @property
    def parse_errors(self) -> DataFrame:
        return self._parsed.where("relation = 'parse_errors'").select(F.from_json("payload", "file_path string, error string").alias("r")).select("r.*")


def ignore_patterns(root: str) -> list[str]:
    """Regexes of paths that the root's ignore files exclude."""
    out = []
    for name in (".gitignore", ".ignore"):
        file = Path(root) / name
        for raw in file.read_text().splitlines() if file.is_file() else []:
            p = raw.strip()
            if p and p[0] not in "#!":
                anchored = "/" in p.strip("/")
                body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
                out.append(("^" if anchored else "(^|/)") + f"(?:{body})" + "(/|$)")
    return out


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) of the new side of a unified diff; a hunk of no lines counts as one."""
    import re

    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = line[4:].removeprefix("b/").split("\t")[0]
        elif (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)) and path and path != "/dev/null":
            first, count = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, first, first + max(count, 1) - 1))
    return out


def changed_ranges(spark: SparkSession, root: str, ref: str = "HEAD~1") -> DataFrame:
    """(file_path, range_start, range_end) of what changed since ``ref`` in a git repository."""
    run = subprocess.run(["git", "-C", root, "diff", "--relative", "--unified=0", f"{ref}..HEAD", "--", "*.rs"], capture_output=True, text=True)
    if run.returncode:
        raise ValueError(run.stderr.strip() or "not a git repository")
    return spark.createDataFrame(parse_hunks(run.stdout), "file_path string, range_start int, range_end int")


def dependencies(spark: SparkSession, manifest: str) -> DataFrame:
    """(alias, package) of a Cargo manifest's dependency tables."""
    data = tomllib.loads(manifest)
    tables = [data.get(k, {}) for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables += [t.get(k, {}) for t in data.get("target", {}).values() for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    tables.append(data.get("workspace", {}).get("dependencies", {}))
    rows = {a.replace("-", "_"): (v.get("package", a) if isinstance(v, dict) else a) for t in tables for a, v in t.items()}
    return spark.createDataFrame(sorted(rows.items()), "alias string, package string")


def llvm_regions(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, start_line, start_col, end_line, end_col, count) of code regions of an LLVM coverage export (version 3)."""
    fn = "filenames:array<string>,regions:array<array<bigint>>"
    d = spark.read.schema(f"type string, version string, data array<struct<functions:array<struct<{fn}>>>>").option("multiLine", "true").json(path)
    d = d.where(F.startswith("version", F.lit("3."))).select(F.explode("data").alias("d")).select(F.explode("d.functions").alias("f"))
    d = d.select("f.filenames", F.explode("f.regions").alias("r")).where(F.get("r", F.lit(7)) == 0)
    at = [F.get("r", F.lit(k)) for k in range(6)]
    return d.select(F.get("filenames", at[5].cast("int")).alias("file_path"), *(c.cast("int").alias(n) for c, n in zip(at, ("start_line", "start_col", "end_line", "end_col"), strict=False)), at[4].alias("count"))
