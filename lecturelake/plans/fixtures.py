"""Lecture tables derived from the driver's tables, so that every engine sees the same rows.

Fixed values: the phrases and marks put around each sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

PHRASES = [
    "", "接下来我们讲单调性", "嗯嗯", "[音乐]", "（掌声）", "导数大于0", "就是", "原函数加上任意常数",
    "", "周期", "例如", "定义", "这个不考", "重要", "所以", "总结一下",
]
MARKS = ["", "。", "吗", "！", "？", "呢", "", "，", "?", ""]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_id, segment_id, n, start_ms, end_ms, src``: sentences of documents as timed speech."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("_n", "s")).select("doc_id", F.col("_n").cast("long").alias("n"), "s")
    d, n = F.col("doc_id"), F.col("n")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    src = F.trim(F.concat(pick(PHRASES, d * 31 + n * 17), F.lit(" "), F.col("s"), pick(MARKS, d * 7 + n * 3)))
    rows = rows.select(
        F.concat(F.lit("v"), d.cast("string")).alias("video_id"),
        "n",
        src.alias("src"),
        F.when((n * 7 + d) % 11 == 0, 12000).otherwise(n * 13 % 5 * 400).alias("gap"),
    ).withColumn("dur", (F.length("src") * 40 + 200).cast("long"))
    end = F.sum(F.col("dur") + F.col("gap")).over(W.partitionBy("video_id").orderBy("n"))
    return rows.select(
        "video_id",
        F.concat(F.floor(n / 16).cast("string"), F.lit("_"), (n % 16).cast("string")).alias("segment_id"),
        "n",
        (end - F.col("dur")).cast("long").alias("start_ms"),
        end.cast("long").alias("end_ms"),
        "src",
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segments each."""
    rows = segments(spark, sf_dir).withColumn("paragraph_id", F.floor(F.col("n") / 4).cast("long"))
    own = F.array_sort(F.collect_list(F.struct("n", "src")))
    return rows.groupBy("video_id", "paragraph_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(own, lambda x: x["src"]), " ").alias("text")
    )


def asr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments as rows of 120-second chunks, on chunk time."""
    rows = segments(spark, sf_dir).withColumn("chunk_idx", F.floor(F.col("start_ms") / 120000).cast("long"))
    at = lambda c: (F.col(c) - F.col("chunk_idx") * 120000) / F.lit(1000.0)
    return rows.select(
        "video_id",
        "chunk_idx",
        (F.row_number().over(W.partitionBy("video_id", "chunk_idx").orderBy("n")) - 1).cast("long").alias("seg_idx"),
        at("start_ms").alias("start_s"),
        at("end_ms").alias("end_s"),
        F.col("src").alias("text"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("video_id").agg((F.max("end_ms") / F.lit(1000.0)).alias("duration_s"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in time every seven seconds."""
    last = segments(spark, sf_dir).groupBy("video_id").agg((F.max("end_ms") + 5000).alias("last"))
    return last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(7000).cast("long"))).alias("t_ms"))


def responses(paragraphs: DataFrame) -> DataFrame:
    """Model answers: one in five each missing, right, fenced, an element short, and amid prose or cut."""
    p = F.col("paragraph_id") % 5
    n = F.size(tx.sentences(F.col("text"))) - F.when(p == 3, 1).otherwise(0)
    one = lambda i: F.concat(F.lit('{"text":"s'), i.cast("string"), F.lit('","type":"'), F.when(i % 2 == 0, "key_content").otherwise("meta"), F.lit('"}'))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    body = F.array_join(F.transform(index, one), ",")
    odd = F.substr("video_id", F.lit(2)).cast("long") % 2 == 1
    content = (
        F.when(p == 2, F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
        .when((p == 4) & odd, F.concat(F.lit("["), body))
        .when(p == 4, F.concat(F.lit("ok: ["), body, F.lit("] done")))
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    return paragraphs.where(p != 0).select("video_id", "paragraph_id", content.alias("content"))
