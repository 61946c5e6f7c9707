"""Chapter and lecture summaries, extractive and by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.scans import KEYS


def chapter_texts(chapters: DataFrame, items: DataFrame | None) -> DataFrame:
    """``video_id, chapter_id, pos, text`` from the table of items (of ``number_chapters``; with ``KEYS``, if it has them), or
    from nested chapters."""
    if items is not None:
        return items.select("video_id", "chapter_id", F.col("paragraph_id").alias("pos"), "text", *[k for k in KEYS if k in items.columns])
    return chapters.select("video_id", "chapter_id", F.posexplode("items").alias("pos", "item")).select("video_id", "chapter_id", "pos", F.col("item.text").alias("text"))


def chapter_summaries(chapters: DataFrame, line: int = 80, paragraph: int = 240, items: DataFrame | None = None) -> DataFrame:
    """``one_line`` and ``one_paragraph`` of each chapter.

    ``chapters`` nest their items, or are heads beside a table of ``items``; then no row holds a whole
    chapter, as only texts up to the second sentence are joined.
    """
    if items is None:
        rows = chapters.select("video_id", "chapter_id", "title", F.array_join(F.transform("items", lambda x: x["text"]), "。").alias("_t"))
    else:
        per = first_sentences(chapter_texts(chapters, items), ["video_id", "chapter_id"], ["pos"])
        rows = chapters.select("video_id", "chapter_id", "title").join(per, ["video_id", "chapter_id"])
    return rows.select(
        "video_id", "chapter_id", "title",
        tx.short_summary(F.col("_t"), line).alias("one_line"),
        tx.short_summary(F.col("_t"), paragraph).alias("one_paragraph"),
    )


LISTS = ("exam_points", "pitfalls", "tips")


def exam_flags(exam: bool, words: lx.Lexicon) -> dict[str, Column]:
    """Whether a row's ``text`` meets each exam rule, for ``exam_lists``."""
    own = (words.exam_points, words.exam_pitfalls, words.exam_tips)
    return {f"_{n}{i}": F.col("text").rlike(p) for r, n in zip(own, LISTS, strict=True) for i, (p, _) in enumerate(r)} if exam else {}


def exam_lists(exam: bool, words: lx.Lexicon) -> list[Column]:
    """The exam lists over all rows of a group, from ``exam_flags``; empty where they are not asked for."""
    none = F.array().cast("array<string>")

    def found(rules: Sequence[tuple[str, str]], name: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.bool_or(f"_{name}{i}"), F.lit(x)) for i, (_, x) in enumerate(rules)]))

    own = (words.exam_points, words.exam_pitfalls, words.exam_tips)
    return [(found(r, n) if exam and r else F.first(none)).alias(n) for r, n in zip(own, LISTS, strict=True)]


def first_sentences(rows: DataFrame, group: list[str], order: list[str], *others: Column) -> DataFrame:
    """Per group, ``_t``: its ``text`` in order, joined by 。, up to the second sentence; and ``others``.

    That is all of it that a short summary shows.  Rows that are dealt out by ``KEYS`` are looked through where they are:
    only those texts are shuffled that have fewer than two sentences before them there.
    """
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    count = F.size(F.filter(F.split(F.regexp_replace("text", f"(?U)^{tx.SPACE}+", ""), f"(?U)[。！？]{tx.SPACE}*"), lambda x: x != ""))
    rows = rows.withColumn("_n", F.greatest(count, F.lit(0)))
    if set(KEYS) <= set(rows.columns):
        here = W.partitionBy(*KEYS, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("_kept", F.coalesce(F.sum("_n").over(here), F.lit(0)) < 2).drop(*KEYS)
        # What is left out counts nothing: its block has two sentences before it.  So the next sum stands on this one, after it.
        rows = rows.withColumns({"text": F.when(F.col("_kept"), F.col("text")), "_n": F.when(F.col("_kept"), F.col("_n")).otherwise(0)}).drop("_kept")
    rows = rows.withColumn("_near", F.coalesce(F.sum("_n").over(before), F.lit(0)) < 2)
    own = F.array_sort(F.collect_list(F.when(F.col("_near"), F.struct(*order, "text"))))
    per = rows.groupBy(*group).agg(own.alias("_s"), F.bool_and("_near").alias("_whole"), *others)
    text = F.concat(F.array_join(F.transform("_s", lambda x: x["text"]), "。"), F.when(F.col("_whole"), "").otherwise("。"))
    return per.withColumn("_t", text).drop("_s", "_whole")


def global_summary(chapters: DataFrame, line: int = 100, paragraph: int = 360, exam: bool = False, words: lx.Lexicon = lx.DEFAULT, items: DataFrame | None = None) -> DataFrame:
    """One row per lecture: ``one_paragraph``, ``one_line`` and, with ``exam``, the exam lists over all
    its text (empty lists without).

    A summary uses two sentences at most, so only the items up to the second sentence are joined,
    and rules, which never span items, are looked for item by item.
    """
    rows = chapter_texts(chapters, items).where(F.length("text") > 0).withColumns(exam_flags(exam, words))
    per = first_sentences(rows, ["video_id"], ["chapter_id", "pos"], *exam_lists(exam, words))
    # A lecture whose chapters hold no text still has its row.
    per = chapters.select("video_id").distinct().join(per, "video_id", "left")
    text, none = F.coalesce("_t", F.lit("")), F.array().cast("array<string>")
    return per.select(
        "video_id",
        tx.short_summary(text, paragraph).alias("one_paragraph"),
        tx.short_summary(text, line).alias("one_line"),
        *[F.coalesce(c, none).alias(c) for c in LISTS],
    )


def collapse_items(items: Column, max_len: int = 3000) -> Column:
    """Stripped non-empty item texts joined by 。, up to the one that reaches ``max_len``."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("a"))

    def add(acc: Column, item: Column) -> Column:
        t = tx.strip(item["text"])
        more = F.struct((acc["n"] + F.length(t)).alias("n"), F.concat(acc["a"], F.array(t)).alias("a"))
        return F.when((acc["n"] < max_len) & (t != ""), more).otherwise(acc)

    return F.array_join(F.aggregate(items, start, add)["a"], "。")


def collapsed_texts(chapters: DataFrame, items: DataFrame, max_len: int = 3000) -> DataFrame:
    """``video_id, chapter_id, _t``: what ``collapse_items`` gives, from a table of items."""
    before = W.partitionBy("video_id", "chapter_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = chapter_texts(chapters, items).withColumn("text", tx.strip(F.col("text"))).where(F.length("text") > 0)
    near = rows.withColumn("_n", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_n") < max_len)
    own = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return near.groupBy("video_id", "chapter_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), "。").alias("_t"))


def rule_summaries(chapters: DataFrame, style: str = "exam", max_len: int = 3000, words: lx.Lexicon = lx.DEFAULT, items: DataFrame | None = None) -> DataFrame:
    """``summary_title`` and ``bullets`` of each chapter; for ``exam`` four lists more.  ``items``: as for
    ``chapter_summaries``."""
    if items is None:
        rows = chapters.select("video_id", "chapter_id", "title", collapse_items(F.col("items"), max_len).alias("_t"))
    else:
        rows = chapters.select("video_id", "chapter_id", "title").join(collapsed_texts(chapters, items, max_len), ["video_id", "chapter_id"], "left")
        rows = rows.withColumn("_t", F.coalesce("_t", F.lit("")))
    title, text = F.col("title"), F.col("_t")
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(lx.UNTITLED)
    names = ["exam_points", "question_patterns", "pitfalls", "tips"]
    exam = [c.alias(n) for c, n in zip(tx.chapter_exam(title, text, words.chapter_exam), names, strict=True)] if style == "exam" else []
    return rows.select("video_id", "chapter_id", "title", named.alias("summary_title"), tx.chapter_bullets(title, text, words.chapter_bullets).alias("bullets"), *exam)
