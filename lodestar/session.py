"""Session helpers shared by every operator: where shared intermediate files go and how they are cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Clusters name it in ``spark.checkpoint.dir``; a fresh local folder is used only where that is unset (tests).
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        else:
            raise ValueError("a cluster needs a shared folder for intermediate tables: set spark.checkpoint.dir")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``by`` names columns of few values to keep in folders of their own, which come last then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def drop(stored: DataFrame) -> None:
    """Deletes the table of a materialised DataFrame that nothing reads any more."""
    path = getattr(stored, "_stored_at", None)
    if path:
        spark = stored.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The intermediate tables of one operator: deleted together once its result is stored."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``materialise``, or a table that is stored already."""
        stored = df if getattr(df, "_stored_at", None) else materialise(df, name)
        self._tables.append(stored)
        return stored

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Stores the result and deletes all that was kept before."""
        stored = materialise(df, name)
        for table in self._tables:
            drop(table)
        self._tables.clear()
        return stored


def document_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows at a time to Python workers: rows are whole documents, and Spark's 10,000 of them fill both sides' memory.

    The setting stays lowered for the session: Spark reads it when a lazy result is run, after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder that the driver has it in. On a cluster it is installed on
    the executors, or sent with ``--py-files``; then this changes nothing."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
