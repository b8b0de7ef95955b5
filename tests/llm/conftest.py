import pytest

CLASH = ["lang_pred", "score", "component_id", "rule", "n_words", "bucket", "_id", "_t"]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = "The long and winding text of the words. " * 30_000
    rows = [(1, "the cat and the dog of the house are in the garden", "en"), (1, "the cat and the dog of the house are in the garden", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", None), (5, long, "en"), (None, "no id here", "de"), (6, "Wörter ünd Ümlaute – und 中文 😀", None), (7, "!!! ??? 123", "xx")]
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in rows], f"doc_id long, text string, lang string, {extra}")
