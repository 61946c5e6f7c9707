"""Captions at points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A caption is laid into slices of the coarsest width it fills eight of, at most.
SLICE_MS, WIDER = 10_000, 8


def captions_at(captions: DataFrame, ticks: DataFrame) -> DataFrame:
    """``video_id, t_ms, text``: the first caption with ``start_ms <= t_ms <= end_ms``, else empty text.

    An equi-join on lecture and time slice.  Captions are laid into slices whose width grows with
    their length, so that none is laid into more than nine, and a tick looks at one slice of each
    width in use in its lecture (a logarithm of the longest caption).
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(SLICE_MS))
    level = F.floor(F.log(length / SLICE_MS) / F.log(F.lit(float(WIDER)))).cast("int")
    laid = captions.where("end_ms >= start_ms").select("video_id", "start_ms", "end_ms", "text", level.alias("_level"))
    used = laid.groupBy("video_id").agg(F.collect_set("_level").alias("_levels"))
    width = lambda c: F.pow(F.lit(float(WIDER)), c).cast("long") * SLICE_MS
    laid = laid.withColumn("_w", width(F.col("_level"))).select(
        "*", F.explode(F.sequence(F.floor(F.col("start_ms") / F.col("_w")), F.floor(F.col("end_ms") / F.col("_w")))).alias("_slice")
    )
    asked = ticks.select("video_id", "t_ms").distinct()
    looks = asked.join(used, "video_id").select("video_id", "t_ms", F.explode("_levels").alias("_level"))
    looks = looks.withColumn("_slice", F.floor(F.col("t_ms") / width(F.col("_level"))))
    met = looks.join(laid, ["video_id", "_level", "_slice"]).where("start_ms <= t_ms and t_ms <= end_ms")
    first = met.groupBy("video_id", "t_ms").agg(F.min(F.struct("start_ms", "end_ms", "text"))["text"].alias("text"))
    return ticks.join(first, ["video_id", "t_ms"], "left").select("video_id", "t_ms", F.coalesce("text", F.lit("")).alias("text"))
