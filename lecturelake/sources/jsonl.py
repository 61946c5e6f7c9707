"""JSON Lines in and out.

A line counts if it is a JSON object with the needed keys; whatever else a file holds goes to a
second frame.  Numbers may come as strings and fractions are cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


#: The lecture of rows that name none.
UNKNOWN = "unknown"


def _parsed(spark: SparkSession, paths: str | Sequence[str], *more: Column) -> DataFrame:
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return lines.where(F.length(F.trim("value")) > 0).select("value", F.try_parse_json("value").alias("v"), *more)


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def _is_object() -> Column:
    return F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))


def _split(rows: DataFrame, good: Column, columns: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(_is_object() & good, F.lit(False))
    return rows.where(good).select(*columns), rows.where(~good).select("value")


def parse_segments(lines: DataFrame, nameless: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments from lines (``value, v``), and the lines that are none; ``nameless`` names the lecture of
    those without one."""
    columns = [
        _field("id", "string").alias("id"),
        F.coalesce(_field("video_id", "string"), F.lit(UNKNOWN) if nameless is None else nameless).alias("video_id"),
        _field("segment_id", "string").alias("segment_id"),
        F.coalesce(_field("start_ms", "bigint"), F.lit(0)).cast("long").alias("start_ms"),
        F.coalesce(_field("end_ms", "bigint"), F.lit(0)).cast("long").alias("end_ms"),
        _field("src", "string").alias("src"),
    ]
    return _split(lines, _field("src", "string").isNotNull(), columns)


def read_segments(spark: SparkSession, paths: str | Sequence[str], by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects with ``src``: ``video_id`` defaults to ``unknown`` and times to 0.  Second: the lines
    left out.

    With ``by_file``, segments without ``video_id`` belong to a lecture of their file, ``unknown:`` and its path:
    otherwise those of a whole corpus are one lecture.
    """
    if not by_file:
        return parse_segments(_parsed(spark, paths))
    lines = _parsed(spark, paths, F.col("_metadata.file_path").alias("_file"))
    return parse_segments(lines, F.concat(F.lit(f"{UNKNOWN}:"), "_file"))


def read_paragraphs(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Objects with ``video_id``, ``start_ms``, ``end_ms`` and ``text``.  Second: the lines left out."""
    kinds = {"video_id": "string", "paragraph_id": "bigint", "start_ms": "bigint", "end_ms": "bigint", "text": "string"}
    good = F.lit(True)
    for name in ("video_id", "start_ms", "end_ms", "text"):
        good = good & _field(name, kinds[name]).isNotNull()
    return _split(_parsed(spark, paths), good, [_field(n, k).alias(n) for n, k in kinds.items()])


def read_chapters(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Objects with ``chapter_id``, ``title`` and ``items``.  Second: the lines left out."""
    kinds = {"video_id": "string", "chapter_id": "bigint", "title": "string", "start_ms": "bigint", "end_ms": "bigint", "items": f"array<{schemas.ITEM}>"}
    good = F.lit(True)
    for name in ("chapter_id", "title", "items"):
        good = good & _field(name, kinds[name]).isNotNull()
    return _split(_parsed(spark, paths), good, [_field(n, k).alias(n) for n, k in kinds.items()])


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One object a line, with null fields; characters stay as they are."""
    df.write.option("ignoreNullFields", False).partitionBy(*partition_by).json(path)


def report_lines(reports: DataFrame, text: str = "report", key: str = "video_id") -> DataFrame:
    """``key, line_no, line``: reports (one string a lecture in ``text``) as a table of lines, from 1."""
    lines = reports.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("_n", "line"))
    return lines.select(key, (F.col("_n") + 1).cast("long").alias("line_no"), "line")


def write_report(reports: DataFrame, path: str, text: str = "report", key: str = "video_id") -> None:
    """Reports as text files, a folder ``key=...`` for each lecture, so that each is found by its lecture.

    Lectures are dealt out by ranges of their names, and lines are written in order as they stream by.
    """
    lines = report_lines(reports, text, key).repartitionByRange(key).sortWithinPartitions(key, "line_no")
    lines.select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)


def read_reports(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """``key, line`` of written reports."""
    return spark.read.schema(f"value string, `{key}` string").text(path).select(key, F.col("value").alias("line"))


def pack_reports(reports: DataFrame, path: str, text: str = "report", key: str = "video_id") -> None:
    """Reports of a whole corpus as text files of many lectures each; ``write_report`` makes a folder and files for every
    lecture, which takes longer than the reports themselves where lectures are many.

    Each line stands behind its lecture's name, as JSON, and a tab.  A report is one row, so its lines stream into one
    file, together and in order, without another shuffle.
    """
    name = F.to_json(F.array(F.col(key).cast("string")))
    named = F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit("\t"))
    lines = reports.select(named.alias("_k"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines.select(F.concat("_k", "line").alias("value")).write.option("lineSep", "\n").text(path)


def read_packed(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """``key, line`` of packed reports."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.instr("value", "\t")
    name = F.from_json(F.concat(F.lit("["), F.left("value", at - 1), F.lit("]")), "array<string>")
    return lines.select(F.get(name, F.lit(0)).alias(key), F.substr("value", at + 1).alias("line"))
