"""Slices, profiles and renderings of what the commands find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources.code import CodeIndex

# Languages by file extension or file name, their comment family, and those that count as manifests or markup.
LANGUAGES = {
    "rs": ("rust", "c"), "py": ("python", "hash"), "js": ("javascript", "c"), "ts": ("typescript", "c"), "go": ("go", "c"), "java": ("java", "c"), "c": ("c", "c"), "cpp": ("cpp", "c"),
    "sh": ("shell", "hash"), "toml": ("toml", "hash"), "yaml": ("yaml", "hash"), "yml": ("yaml", "hash"), "json": ("json", "none"), "md": ("markdown", "none"), "html": ("html", "none"), "css": ("css", "none"), "Dockerfile": ("dockerfile", "hash"),
}
LAST = ["toml", "yaml", "json", "dockerfile", "markdown", "html", "css"]


def source_slice(code: CodeIndex, file_path: str, first: int, last: int) -> DataFrame:
    """(file_path, line, text, start_byte, end_byte) of lines; bytes count line ends as they are in the file."""
    raw = code.files.where(F.col("file_path") == file_path).select("file_path", F.posexplode(F.split("content", "(?<=\n)")).alias("k", "raw"))
    w = Window.partitionBy("file_path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    d = raw.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("raw")).over(w), F.lit(0)))
    d = d.select("file_path", (F.col("k") + 1).alias("line"), F.regexp_replace("raw", r"\r?\n$", "").alias("text"), "start_byte")
    return d.withColumn("end_byte", F.col("start_byte") + F.octet_length("text")).where(F.col("line").between(first, last))


def symbol_slice(code: CodeIndex, symbol_id: str) -> DataFrame:
    """The source lines of a symbol."""
    at = code.symbols.where(F.col("symbol_id") == symbol_id).select("file_path", "start_line", "end_line")
    return code.source_lines.join(at, "file_path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("file_path", "line", "text")


def _code_lines(content, family):
    plain = F.when(family == "c", F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")).when(family == "hash", F.regexp_replace(content, r"(?m)^\s*#[^\n]*", "")).otherwise(content)
    return F.size(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""))


def language_profile(spark: SparkSession, root: str) -> DataFrame:
    """(language, files, code_lines): Rust first if there is a manifest near the root, markup and manifests last, then by size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    table = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[0])))
    family = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[1])))
    key = F.when(name == "Dockerfile", name).otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))
    d = files.where(~F.rlike("path", F.lit(r"/\.[^/]+"))).withColumn("key", key).withColumn("language", F.try_element_at(table, F.col("key"))).where("language IS NOT NULL")
    d = d.select("path", "language", _code_lines(F.col("content").cast("string"), F.try_element_at(family, F.col("key"))).alias("n"))
    out = d.groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("code_lines"))
    rust = (F.col("language") == "rust") & F.lit(bool(d.where(F.endswith("path", F.lit("Cargo.toml"))).take(1)))
    return out.orderBy(rust.desc(), F.col("language").isin(LAST), F.desc("code_lines"), F.desc("files"), "language")


def tree_text(counts: DataFrame) -> str:
    """The files of a tree relation as an indented text."""
    out, open_dirs = [], []
    for r in counts.orderBy("file_path").toLocalIterator():
        *dirs, name = r["file_path"].split("/")
        same = 0
        while same < min(len(dirs), len(open_dirs)) and dirs[same] == open_dirs[same]:
            same += 1
        out += ["  " * k + dirs[k] + "/" for k in range(same, len(dirs))]
        shown = ", ".join(f"{r[c]} {c[2:]}" for c in counts.columns if c.startswith("n_") and r[c])
        out.append("  " * len(dirs) + name + (f"  ({shown})" if shown else ""))
        open_dirs = dirs
    return "\n".join(out)


def coverage_dot(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """A coverage map as DOT lines, (part, value): a cluster for each file; reached functions are filled, others dashed."""
    style = F.when(F.col("n_tests") > 0, "style=filled, fillcolor=palegreen").otherwise("style=dashed")
    node = functions.select(F.regexp_extract("fn_id", r"^(.*):\d+:", 1).alias("file"), F.concat(F.lit('    "'), "fn_id", F.lit('" ['), style, F.lit("];")).alias("line"))
    clusters = node.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    clusters = clusters.select(F.lit(0).alias("part"), F.concat(F.lit('  subgraph "cluster_'), "file", F.lit('" {\n    label="'), "file", F.lit('";\n'), "body", F.lit("\n  }")).alias("value"))
    arrows = edges.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("value")).distinct()
    return clusters.unionByName(arrows).orderBy("part", "value")


def project_summary(code: CodeIndex) -> DataFrame:
    """(kind, n): files, parse errors and symbols of each kind."""
    parts = [code.files.agg(F.count("*").alias("n")).select(F.lit("file").alias("kind"), "n"), code.parse_errors.agg(F.count("*").alias("n")).select(F.lit("parse_error").alias("kind"), "n")]
    return code.symbols.groupBy(F.col("symbol_kind").alias("kind")).agg(F.count("*").alias("n")).unionByName(parts[0]).unionByName(parts[1])
