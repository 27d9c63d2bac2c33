"""Incremental conversion of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import formats
from docframe.operators.convert import convert
from docframe.sources.packages import package_kind

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    """path, content, format of new files; each is seen once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_trigger).load(path)
    return files.select("path", "content", formats.detect(F.col("content"), F.col("path"), package_kind(F.col("content"))).alias("format"))


def convert_stream(spark: SparkSession, path: str, target: str, out: str, checkpoint: str):
    """Writes (path, output, error) of new files as Parquet; the file sink and the checkpoint make each file count once."""
    converted = convert(arriving(spark, path), target, id_col="path")
    return converted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
