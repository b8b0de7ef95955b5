"""Extension: incremental extraction. A stream of source files is parsed as files arrive; the batch relations read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources.code import CodeIndex, _parse
from lodestar.sources.schema import EXTRACTED

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """(file_path, content, seen) of new files below ``root``."""
    d = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rs").option("maxFilesPerTrigger", files_per_batch).load(root)
    return d.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("seen"))


def ingest(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the relations of arriving files to ``target``; a batch that is tried again writes its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("file_path", "content").mapInPandas(_parse, EXTRACTED).write.mode("overwrite").partitionBy("relation").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, target: str, files: DataFrame) -> CodeIndex:
    """The relations ingested so far, as a CodeIndex."""
    return CodeIndex(files, parsed=spark.read.parquet(target).select("relation", "payload"))
