"""Bounded, repeatable samples of labelled rows: the only thing that fits on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts of so many labels at most are broadcast.
MOST_LABELS = 100_000


def held_out(id_col: str) -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text leaves 2 on division by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def stratified_ids(df: DataFrame, id_col: str, label_col: str, rows: int, least: int = 50) -> DataFrame:
    """(id, label) of at most ``rows`` rows, as many of each label (``least`` at least), the smallest by a hash of the id.

    Labels are counted first, so that the hash alone tells which rows may be among the smallest: little more than the sample is shuffled
    and ranked, however many rows a label has.
    """
    known = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    counts = known.groupBy("label").agg(F.count("*").alias("_n"))
    labels = max(1, counts.count())
    want = max(least, rows // labels)
    hashed = known.withColumn("_h", F.xxhash64(F.lit("sample"), "id")).join(F.broadcast(counts) if labels <= MOST_LABELS else counts, "label")
    # of n rows the want smallest of uniform hashes lie below this share, but for six standard deviations
    near = hashed.where(F.col("_h") / F.lit(2.0**64) + 0.5 <= (want + 6 * want**0.5 + 20) / F.col("_n"))
    order = Window.partitionBy("label").orderBy("_h", "id")
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= want).select("id", "label")
