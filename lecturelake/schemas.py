"""Tables and their orders.  Times are integer milliseconds from the start of a lecture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENTS = "id string, video_id string, segment_id string, start_ms long, end_ms long, src string"
PARAGRAPHS = "video_id string, paragraph_id long, start_ms long, end_ms long, text string"
ITEM = "struct<start_ms: bigint, end_ms: bigint, text: string>"
CHAPTERS = f"video_id string, chapter_id long, title string, start_ms long, end_ms long, items array<{ITEM}>"
ASR_ROWS = "video_id string, chunk_idx long, seg_idx long, start_s double, end_s double, text string"


def segment_order() -> list[Column]:
    """Start, end, then chunk and number as integers (``10_1`` after ``2_1``)."""
    part = lambda i: F.try_element_at(F.split("segment_id", "_"), F.lit(i)).try_cast("long")
    return [F.col("start_ms"), F.col("end_ms"), part(1), part(2), F.col("segment_id")]


def by_segment() -> W:
    return W.partitionBy("video_id").orderBy(*segment_order())


def by_paragraph() -> W:
    return W.partitionBy("video_id").orderBy("paragraph_id")
