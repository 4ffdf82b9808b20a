"""The detection plan over a stream of blocks: an extension, the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection as D


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unseen(files: DataFrame, time: str, within: str = "1 day") -> DataFrame:
    """Files whose content hash didn't come before within the watermark."""
    return files.withWatermark(time, within).dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(blocks: DataFrame, time: str, late: str = "1 hour", window: str = "1 day", **options) -> DataFrame:
    """Matches by type and window; rows later than the watermark are dropped."""
    d = D.detect(blocks.withWatermark(time, late), **options)
    return d.groupBy(F.window(F.col(time), window), "entity_type").agg(F.count("*").alias("n"))
