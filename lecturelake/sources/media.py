"""Media files and the transcripts of their chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx


def list_media(spark: SparkSession, root: str, endings: Sequence[str] = lx.MEDIA_ENDINGS) -> DataFrame:
    """``video_id`` (the name without ending), ``path, bytes`` and how many files share the name.

    In order of ``path``.  Only metadata is read; empty files are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    media = files.where(F.lower("path").rlike(rf"\.({'|'.join(endings)})$"))
    media = media.withColumn("video_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    same = media.groupBy("video_id").agg(F.count(F.lit(1)).alias("same_name"))
    return media.join(same, "video_id").select("video_id", "path", "bytes", "same_name").orderBy("path")


def plan_chunks(media: DataFrame, segment_time: int = 120) -> DataFrame:
    """``video_id, chunk_idx, start_s`` from ``video_id, duration_s``: one chunk more than fits whole."""
    last = F.floor(F.col("duration_s") / segment_time).cast("long")
    return media.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx")).select(
        "video_id", "chunk_idx", (F.col("chunk_idx") * segment_time).cast("long").alias("start_s")
    )


def rebase_chunks(asr_rows: DataFrame, segment_time: int = 120) -> DataFrame:
    """Segments on lecture time from rows on chunk time; seconds become milliseconds by cutting."""
    shift = F.col("chunk_idx") * segment_time * 1000
    at = lambda c: ((F.col(c) * 1000).cast("long") + shift).cast("long")
    segment = F.concat(F.col("chunk_idx").cast("string"), F.lit("_"), F.lpad(F.col("seg_idx").cast("string"), 5, "0"))
    return asr_rows.select(
        F.sha2(F.concat_ws("|", "video_id", segment), 256).alias("id"),
        "video_id",
        segment.alias("segment_id"),
        at("start_s").alias("start_ms"),
        at("end_s").alias("end_ms"),
        F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("src"),
    )
