"""A training-corpus pipeline of five operators over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each stage's result is written and read again as the next
one's input. Rows with a null id can't be linked with others and pass ``near_duplicates``; all other stages judge them as any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bloom, bpe, decontam, langid, ngram_join, secrets
from lodestar.llm.queries import tokenizer_path
from lodestar.llm.sampling import held_out
from lodestar.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: no letter, or too little certainty."""
    model = langid.train(docs.where(~held_out("doc_id")))
    marks = ("_langid_language", "_langid_score", "_langid_rejected")
    found = langid.identify(docs, model, pass_cols=tuple(docs.columns), names=marks)
    return found.where(~F.col(marks[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each class of near copies; of rows that repeat id and text, one.
    Different texts under one id are documents of their own."""
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        classes = ngram_join.link_classes(docs)
        gone = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return bloom.without(docs, gone, "doc_id")  # the texts of the others are not shuffled
    named = docs.where(F.col("doc_id").isNotNull())
    texts = named.select("doc_id", "text").distinct().orderBy("doc_id", "text")
    texts = materialise(texts.withColumn("_key", F.monotonically_increasing_id()), "texts")  # in the order of the ids
    classes = ngram_join.link_classes(texts, "_key")
    gone = texts.join(classes.where(F.col("_key") != F.col("component_id")).select("_key"), "_key").select(F.col("doc_id").alias("_gone_id"), F.col("text").alias("_gone_text"))
    kept = named.dropDuplicates(["doc_id", "text"]).join(gone, (F.col("doc_id") == F.col("_gone_id")) & F.col("text").eqNullSafe(F.col("_gone_text")), "left_anti")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, verbatim or with other numbers, names or units. Rows without an id of their own are
    numbered, so that each is judged by its own text."""
    columns, key = docs.columns, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        key = "_pipeline_row"
        docs = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return docs.join(found.select(key).distinct(), key, "left_anti").select(*columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts."""
    return secrets.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokenise", tokenise),
]

#: The stages hold trained models and automata; tests/llm compares them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
