"""Lines are found as DuckDB finds them where dialects differ: word boundaries beside other letters, and dots at line ends that are no line feeds."""

import duckdb
import pytest

from lodestar.operators import lines
from lodestar.plans import catalogue

TEXTS = ["the \u00e9tion", "the nation", "the tion", "the\u00e9 tion", "The\rTION", "the\u2028tion", "the\u0085tion", "the _tion", "a\nthe 9tion\n\u00fcthe-tion", "bathe tion", "the \u0131tion", "", None]


@pytest.mark.parametrize("pattern", [catalogue._GREP, r"th\B", r"\Btion", r"a\\b|the.tion"])
def test_lines_equal_sql(spark, pattern):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {tuple(r) for r in lines.grep(lines.explode_lines(docs, "doc_id", "text"), pattern, ascii_words=True).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    assert got == set(con.execute(f"SELECT doc_id, line, text FROM {catalogue._LINES} WHERE regexp_matches(text, ?)", [pattern]).fetchall()) and got
