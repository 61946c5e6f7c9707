"""Paragraphs cut into titled chapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.scans import KEYS, along, before, block_rows, by_number, deal, inside


def _scored(paragraphs: DataFrame, min_gap_ms: int, min_len_chars: int, phrases: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Dealt paragraphs with ``_before`` (the end before, inside the block) and ``_points`` (the score without
    the pause), and one row per block with where it begins, and the end before it in the lecture."""
    point = lambda c: c.cast("int")
    dealt = deal(paragraphs, by_number())
    points = point(F.length("text") >= min_len_chars) + point(tx.contains_any(F.col("text"), phrases))
    own = dealt.select("*", F.row_number().over(inside("paragraph_id")).alias("_i"), F.lag("end_ms").over(inside("paragraph_id")).alias("_before"), points.alias("_points"))
    return own, own.withColumn("_gap", point(F.col("start_ms") - F.col("_before") >= min_gap_ms))


def _borders(rows: DataFrame, threshold: int, min_gap_ms: int) -> DataFrame:
    """For each block the end before it (``_end``), and how many breaks come before it (``_breaks``)."""
    cut = F.coalesce(F.col("_gap") + F.col("_points") >= threshold, F.lit(False)).cast("long")
    first = lambda c: F.min_by(c, "_i")
    blocks = block_rows(rows, F.sum(cut).alias("_own"), first("start_ms").alias("_start"), first("_points").alias("_first"), F.max_by("end_ms", "_i").alias("_last"))
    blocks = blocks.select("*", F.lag("_last").over(along()).alias("_end"))
    # The first paragraph of a block breaks by the pause since the block before.
    opens = F.coalesce((F.col("_start") - F.col("_end") >= min_gap_ms).cast("int") + F.col("_first") >= threshold, F.lit(False)).cast("long")
    return blocks.withColumn("_all", F.col("_own") + opens).select(*KEYS, "_end", F.coalesce(F.sum("_all").over(before()), F.lit(0)).alias("_breaks"))


def _placed(paragraphs: DataFrame, threshold: int, min_gap_ms: int, min_len_chars: int, phrases: Sequence[str]) -> DataFrame:
    """Dealt paragraphs with ``score`` and ``_breaks``."""
    own, rows = _scored(paragraphs, min_gap_ms, min_len_chars, phrases)
    met = own.join(_borders(rows, threshold, min_gap_ms), KEYS)
    since = F.col("start_ms") - F.when(F.col("_i") == 1, F.col("_end")).otherwise(F.col("_before"))
    return met.withColumn("score", ((since >= min_gap_ms).cast("int") + F.col("_points")).cast("long"))


def score_breaks(paragraphs: DataFrame, min_gap_ms: int = 10000, min_len_chars: int = 100, phrases: Sequence[str] = lx.CHAPTER_PHRASES) -> DataFrame:
    """``score``: a long pause before, a long text, a phrase that opens chapters; null at the start."""
    return _placed(paragraphs, 0, min_gap_ms, min_len_chars, phrases).select(*paragraphs.columns, "score")


def number_chapters(paragraphs: DataFrame, threshold: int = 2, min_gap_ms: int = 10000, min_len_chars: int = 100, phrases: Sequence[str] = lx.CHAPTER_PHRASES, dealt: bool = False) -> DataFrame:
    """Paragraphs with ``score`` and ``chapter_id`` from 1: a new one at each score of ``threshold`` or more.

    ``dealt`` keeps the columns ``KEYS`` by which rows are dealt out, so that summaries can drop what they
    don't show before they shuffle texts.
    """
    cut = F.coalesce(F.col("score") >= threshold, F.lit(False)).cast("long")
    so_far = F.sum(cut).over(inside("paragraph_id").rowsBetween(W.unboundedPreceding, 0))
    rows = _placed(paragraphs, threshold, min_gap_ms, min_len_chars, phrases)
    return rows.select(*paragraphs.columns, "score", (1 + F.col("_breaks") + so_far).alias("chapter_id"), *(KEYS if dealt else []))


def chapter_heads(rows: DataFrame, topics: Sequence[str] = lx.TITLE_TOPICS, phrases: Sequence[str] = lx.CHAPTER_PHRASES) -> DataFrame:
    """One row per chapter of ``rows`` (from ``number_chapters``, the table of items), without its texts: ``title``, times
    and ``paragraphs``, how many it has.

    The title is the topic of the first paragraph that has one, else what follows the first
    opening phrase, else the number.
    """
    return _headed(rows, topics, phrases)


def _headed(rows: DataFrame, topics: Sequence[str], phrases: Sequence[str], *more: Column) -> DataFrame:
    rows = rows.select("*", tx.title_topic(F.col("text"), topics).alias("_topic"), tx.title_tail(F.col("text"), phrases).alias("_tail"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("paragraph_id")))
    return rows.groupBy("video_id", "chapter_id").agg(
        F.coalesce(first("_topic"), first("_tail"), F.concat(F.lit("Chapter "), F.first("chapter_id").cast("string"))).alias("title"),
        F.min(F.struct("paragraph_id", "start_ms"))["start_ms"].alias("start_ms"),
        F.max(F.struct("paragraph_id", "start_ms", "end_ms"))["end_ms"].alias("end_ms"),
        F.count(F.lit(1)).alias("paragraphs"),
        *more,
    )


def nest_chapters(rows: DataFrame, topics: Sequence[str] = lx.TITLE_TOPICS, phrases: Sequence[str] = lx.CHAPTER_PHRASES) -> DataFrame:
    """Chapters of ``rows`` (from ``number_chapters``) with their paragraphs as ``items``: a row holds a whole chapter."""
    item = F.struct("paragraph_id", "start_ms", "end_ms", "text")
    whole = _headed(rows, topics, phrases, F.array_sort(F.collect_list(item)).alias("_items"))
    items = F.transform("_items", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text")))
    return whole.select("video_id", "chapter_id", "title", "start_ms", "end_ms", items.alias("items"))


def segment_chapters(
    paragraphs: DataFrame, threshold: int = 2, phrases: Sequence[str] = lx.CHAPTER_PHRASES, topics: Sequence[str] = lx.TITLE_TOPICS, **how
) -> DataFrame:
    """Titled chapters with their paragraphs as ``items``."""
    return nest_chapters(number_chapters(paragraphs, threshold, phrases=phrases, **how), topics, phrases)


def chapter_sizes(chapters: DataFrame) -> DataFrame:
    """``paragraphs`` and ``duration_ms`` of each chapter, nested or head."""
    count = F.col("paragraphs") if "paragraphs" in chapters.columns else F.size("items")
    return chapters.select("video_id", "chapter_id", count.cast("long").alias("paragraphs"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
