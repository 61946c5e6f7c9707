"""Segments as they arrive: the line parser and text cleaning on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.jsonl import parse_segments


def stream_segments(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Segments from JSON Lines files that come into ``folder``, with ``clean`` text; stateless, so
    any sink takes it in append mode."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = lines.where(F.length(F.trim("value")) > 0).select("value", F.try_parse_json("value").alias("v"))
    good, _ = parse_segments(parsed)
    return good.withColumn("clean", normalize(F.col("src")))
