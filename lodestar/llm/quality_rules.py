"""Quality rules: divergence of a document's character classes and common words from language references. DataFrame functions only.

One pass over the texts gives each document's counts, which are stored; the references are the summed histograms of each
language's documents, over all rows; a document's distance to a language is the Jensen-Shannon distance (base 2, so 0 to 1) of
their shares. A document is judged by the language whose common words are nearest. Documents with fewer words than a guard are
not judged by that histogram, since short texts diverge by chance.

Words are runs of code points other than 0x20 and 0x09-0x0D. Null and empty texts have no words and fail the base rules.
Long texts are counted whole. Repeated rows are judged each; they add to the references as they come. Extra columns are not read. Without any
known language there are no references, distances are null, and the base rules decide. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialise

WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
#: Documents with fewer words are not judged by the histogram.
GUARD_CHAR_WORDS, GUARD_WORD_WORDS = 40, 80
#: Largest distances of a document that is kept.
MOST_CHAR, MOST_WORD = 0.3, 0.31
#: Languages with so many words at least become references.
LEAST_REFERENCE_WORDS = 200

# Common words of some languages.
COMMON = sorted(
    {
        *"the of and to in is that it was for on with as by at be this from are or an have not".split(),
        *"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an".split(),
        *"de la le et les des en un du une que est pour qui dans par sur au avec pas".split(),
        *"el los se del las con por su para como al lo y no es".split(),
    }
)
_WHITE = r"[\x20\x09-\x0D]+"
# Character classes, as what remains when all else is removed; other code points and white space are counted by difference.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-", "symbol": r"#*$%&|<>@^~=+_\\/\[\]{}`"}


def _count(text: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(windows: Column) -> Column:
    """Number of words that lie in windows found twice or more: overlapping windows share words."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(_let(order, _covered))


def _covered(order: Column) -> Column:
    def twin(x, j):
        return F.coalesce(F.get(order, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False))

    at = F.sort_array(F.transform(F.filter(order, twin), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common) of each row."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    d = df.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", _WHITE), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("hits", F.sort_array(F.filter("w", lambda x: x.isin(COMMON))))
    n = F.size("h")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WINDOW))))
    d = d.select(
        "doc_id",
        "lang",
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.char_length("t").cast("bigint").alias("n_chars"),
        _count(F.col("t"), r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.array(*(_count(F.col("t"), c) for c in CLASSES.values())).alias("classes"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        "hits",
        F.array_distinct("hits").alias("kinds"),
    )
    d = d.withColumn("n_repeat_words", _repeated(F.col("windows")).cast("bigint"))
    words = F.array(*(F.lit(w) for w in COMMON))

    def numbers(starts):  # of equal neighbours in the sorted hits
        return F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), F.size("hits").cast("bigint") + 1) - s)

    def spread(number):
        return F.transform(words, lambda x: F.coalesce(F.get(number, F.array_position("kinds", x).cast("int") - 1), F.lit(0).cast("bigint")))

    seen = _let(_let(F.transform("kinds", lambda x: F.array_position("hits", x)), numbers), spread)
    known = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.concat("classes", F.array(F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - known)).alias("classes"),
        F.concat(seen, F.array(F.col("n_words") - F.size("hits"))).alias("common"),
    )


def reference_row(found: DataFrame) -> DataFrame:
    """One row with an array of (language, classes, common): the counts summed over all documents of each language with enough words."""
    n_classes, n_words = len(CLASSES) + 2, len(COMMON) + 1

    def sums(column, n):
        return F.array(*(F.sum(F.get(column, F.lit(k))) for k in range(n))).alias(column)

    total = found.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("words"), sums("classes", n_classes), sums("common", n_words))
    known = total.where(F.col("words") >= LEAST_REFERENCE_WORDS)
    return known.agg(F.collect_list(F.struct(F.col("lang").alias("language"), shares(F.col("classes")).alias("classes"), shares(F.col("common")).alias("common"))).alias("known"))


def references(found: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """The references by language, to look at."""
    return sorted((r["language"], r["classes"], r["common"]) for r in reference_row(found).first()["known"])


def shares(counted: Column) -> Column:
    """An array of counts as shares; null for no counts."""

    def over(total):
        return F.when(total > 0, F.transform(counted, lambda x: x / total))

    return _let(F.aggregate(counted, F.lit(0.0), lambda s, x: s + x), over)


def jensen_shannon(p: Column, reference: Column | list[float]) -> Column:
    """Distance of two arrays of shares."""
    q = reference if isinstance(reference, Column) else F.array(*(F.lit(float(x)) for x in reference))

    def part(a, b):  # a * log2(2a / (a + b)), 0 for a = 0
        return F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Each row's counts, base verdict, nearest language, distances and ``kept``."""
    found = materialise(counts(df, id_col, text_col, lang_col), "quality")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    # the references are one value, the size of a row for each language; no plan holds a literal of them
    found = found.withColumn("common", shares(F.col("common"))).withColumn("classes", shares(F.col("classes"))).withColumn("_known", reference_row(found).scalar())

    def distances(r):
        return F.struct(jensen_shannon(F.col("common"), r["common"]).alias("word_distance"), jensen_shannon(F.col("classes"), r["classes"]).alias("char_distance"), r["language"].alias("language"))

    found = found.withColumn("_near", F.array_min(F.transform("_known", distances)))
    far_chars = (F.col("n_words") >= GUARD_CHAR_WORDS) & (F.col("_near.char_distance") > MOST_CHAR)
    far_words = (F.col("n_words") >= GUARD_WORD_WORDS) & (F.col("_near.word_distance") > MOST_WORD)
    found = found.withColumn("base_failed", base)
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far_chars, F.lit(False)) & ~F.coalesce(far_words, F.lit(False))).alias("kept"),
        F.col("_near.language").alias("nearest_language"), F.col("_near.char_distance").alias("char_distance"), F.col("_near.word_distance").alias("word_distance"),
    )
