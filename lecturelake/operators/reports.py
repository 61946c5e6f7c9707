"""Readable reports: one string per lecture, lines joined by line feeds.

Fixed values: headings and line forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from .focus import is_key, tenths

RULE, NOTHING = "=" * 60, "暂无数据"


def _lit(*lines: str) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def _title(*lines: str) -> Column:
    return _lit(RULE, *lines, RULE, "")


def _join(*arrays: Column) -> Column:
    """Lines of arrays of strings, without nulls, as one text."""
    return F.array_join(F.array_compact(F.concat(*arrays)), "\n")


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _stack(blocks: DataFrame, order: str, header: Column) -> DataFrame:
    """Blocks of lines (``lines``) of a lecture in order under a header: ``video_id, report``."""
    own = F.array_sort(F.collect_list(F.struct(order, "lines")))
    return blocks.groupBy("video_id").agg(own.alias("_b")).select(
        "video_id", _join(header, F.flatten(F.transform("_b", lambda x: x["lines"]))).alias("report")
    )


def _listed(heading: str, values: Column) -> Column:
    """A heading and bullets, or nothing where the list is empty."""
    lines = F.concat(_lit(heading), F.transform(values, lambda x: _line("   • ", x)), _lit(""))
    return F.when(F.size(values) > 0, lines).otherwise(F.array().cast("array<string>"))


def chapter_report(chapters: DataFrame) -> DataFrame:
    """Chapters with times, and the first three paragraphs of each."""
    c = F.col
    texts = F.transform(F.slice("items", 1, 3), lambda x, i: F.struct(i.alias("i"), tx.strip(x["text"]).alias("t")))
    shown = F.transform(F.filter(texts, lambda x: x["t"] != ""), lambda x: _line((x["i"] + 1).cast("string"), ". ", x["t"]))
    more = F.when(F.size("items") > 3, _line("... (共 ", F.size("items").cast("string"), " 个段落)"))
    head = F.array(
        _line("第 ", c("chapter_id").cast("string"), " 章：", c("title")),
        _line("时间：", tx.clock(c("start_ms")), " - ", tx.clock(c("end_ms"))),
        _line("时长：", tx.clock(c("end_ms") - c("start_ms"))),
        F.lit("-" * 50),
    )
    blocks = chapters.select("video_id", "chapter_id", F.concat(head, shown, F.array(more), _lit("", RULE, "")).alias("lines"))
    return _stack(blocks, "chapter_id", _lit("=== 课程章节分割结果 ===", ""))


def micro_report(micro: DataFrame) -> DataFrame:
    """Windows, numbered, with summary and exam lists."""
    rows = micro.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("window_idx", "start_ms", "end_ms", "summary", "exam_points", "pitfalls", "tips"))).alias("_w"))

    def block(x: Column, i: Column) -> Column:
        inline = lambda heading, values: F.when(F.size(values) > 0, _line(heading, F.array_join(values, "、")))
        return F.array(
            _line("【时间段 ", F.format_string("%02d", i + 1), "】 ", tx.minutes(x["start_ms"]), " - ", tx.minutes(x["end_ms"])),
            _line("📝 摘要：", x["summary"]),
            inline("🎯 考试要点：", x["exam_points"]),
            inline("⚠️ 易错点：", x["pitfalls"]),
            inline("💡 学习建议：", x["tips"]),
            F.lit("-" * 40),
            F.lit(""),
        )

    return rows.select("video_id", _join(_title("📈 微段摘要"), F.flatten(F.transform("_w", block))).alias("report"))


def chapter_summary_report(summaries: DataFrame) -> DataFrame:
    c = F.col
    block = F.array(
        _line("【章节 ", c("chapter_id").cast("string"), "】", c("title")), F.lit("-" * 40),
        F.lit("📝 一句话总结："), _line("   ", c("one_line")), F.lit(""),
        F.lit("📄 详细总结："), _line("   ", c("one_paragraph")), F.lit(""), F.lit(RULE), F.lit(""),
    )
    return _stack(summaries.select("video_id", "chapter_id", block.alias("lines")), "chapter_id", _title("📚 章节摘要"))


def global_report(summary: DataFrame) -> DataFrame:
    c = F.col
    text = F.array(
        F.lit("📝 一句话总结："), _line("   ", c("one_line")), F.lit(""),
        F.lit("📄 详细总结："), _line("   ", c("one_paragraph")), F.lit(""),
    )
    lists = [_listed(h, c(n)) for h, n in (("🎯 考试要点：", "exam_points"), ("⚠️ 易错点：", "pitfalls"), ("💡 学习建议：", "tips"))]
    return summary.select("video_id", _join(_title("🌍 全局摘要"), text, *lists).alias("report"))


def summary_report(lectures: DataFrame, micro: DataFrame, summaries: DataFrame, overall: DataFrame) -> DataFrame:
    """``video_id, micro, chapters, overall`` for each of ``lectures``, and a note where there is nothing."""
    out = lectures.select("video_id").distinct()
    for name, report in (("micro", micro_report(micro)), ("chapters", chapter_summary_report(summaries)), ("overall", global_report(overall))):
        out = out.join(report.withColumnRenamed("report", name), "video_id", "left").withColumn(name, F.coalesce(name, F.lit(NOTHING)))
    return out


def rule_report(rules: DataFrame, style: str = "exam") -> DataFrame:
    """Bullets of chapters, with the exam lists for ``exam``."""
    c = F.col
    head = F.array(_line("【章节 ", c("chapter_id").cast("string"), "】", c("title")), F.lit("-" * 50))
    lists = [("📋 主要内容：", "bullets")]
    if style == "exam":
        lists += [("🎯 考试要点：", "exam_points"), ("📝 题型模式：", "question_patterns"), ("⚠️ 易错点：", "pitfalls"), ("💡 学习建议：", "tips")]
    block = F.concat(head, *[_listed(h, c(n)) for h, n in lists], _lit(RULE, ""))
    title = "📚 章节考试分析报告" if style == "exam" else "📚 章节内容摘要"
    return _stack(rules.select("video_id", "chapter_id", block.alias("lines")), "chapter_id", _title(title))


def focus_report(items: DataFrame) -> DataFrame:
    """Statistics, all key sentences, and the first ten others of each lecture, in one pass over it."""
    c = F.col
    percent = lambda x: F.format_string("%.1f", x)
    top = F.concat(
        _title("🎯 LLM重点分析报告"),
        F.array(
            F.lit("📊 统计信息："),
            _line("   • 总句子数：", c("total").cast("string")),
            _line("   • 重点句子：", c("key_count").cast("string"), " (", percent(c("key_pct")), "%)"),
            _line("   • 非重点句子：", c("non_key_count").cast("string"), " (", percent(c("non_key_pct")), "%)"),
            F.lit(""),
        ),
    )

    so_far = W.partitionBy("video_id").orderBy("paragraph_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = items.where("video_id is not null").withColumn("_k", is_key().cast("long")).withColumn("_number", F.sum("_k").over(so_far))
    rows = rows.withColumn("_number", F.when(c("_k") == 1, c("_number")).otherwise(F.count(F.lit(1)).over(so_far) - c("_number")))

    def stacked(mark: str, lines: list[tuple[str, str]], rule: int, where: Column) -> Column:
        """The lines of the sentences ``where``, in order."""
        head = _line(f"【{mark} ", F.format_string("%02d", c("_number")), "】 ", tx.minutes(c("start_ms")))
        block = F.array(head, *[_line(h, F.coalesce(c(n), F.lit(""))) for h, n in lines], F.lit("-" * rule), F.lit(""))
        own = F.array_sort(F.collect_list(F.when(where, F.struct("_number", block.alias("lines")))))
        return F.flatten(F.transform(own, lambda x: x["lines"]))

    keys = stacked(lx.KEY, [("📝 原句：", "sentence"), ("💎 总结：", "summary"), ("⭐ 重要性：", "importance")], 40, c("_k") == 1)
    others = stacked(lx.NOT_KEY, [("📝 原句：", "sentence"), ("📄 原因：", "reason")], 30, (c("_k") == 0) & (c("_number") <= 10))
    rows = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"), F.sum("_k").alias("key_count"), keys.alias("_keys"), others.alias("_others"))
    rows = rows.withColumn("_t", tenths(c("key_count"), c("total"))).select(
        "*", (c("_t") / 10).alias("key_pct"), ((1000 - c("_t")) / 10).alias("non_key_pct"), (c("total") - c("key_count")).alias("non_key_count")
    )
    none = F.array().cast("array<string>")
    part = lambda title, name: F.when(F.size(name) > 0, F.concat(_lit(title, "=" * 50, ""), c(name))).otherwise(none)
    rest = c("non_key_count") - 10
    more = F.when(rest > 0, F.array(_line("... 还有 ", rest.cast("string"), " 个非重点句子未显示"), F.lit(""))).otherwise(none)
    return rows.select(
        "video_id",
        _join(top, part("🔥 重点内容分析：", "_keys"), part("📝 非重点内容示例（前10个）：", "_others"), more, _lit("✅ 分析完成！建议重点关注标为🔥的内容。")).alias("report"),
    )


def notes_digest(summaries: DataFrame, overall: DataFrame, kpi_field: str | None = None, first: int = 5) -> DataFrame:
    """Study notes: the first chapters' titles and lines under fixed headings.

    ``kpi_field`` names the column of ``overall`` for the opening line; without it the line is empty.
    """
    c = F.col
    lead = overall.select("video_id", (F.coalesce(c(kpi_field), F.lit("")) if kpi_field else F.lit("")).alias("_kpi"))
    own = F.array_sort(F.collect_list(F.struct("chapter_id", "title", "one_line")))
    rows = summaries.groupBy("video_id").agg(F.slice(own, 1, first).alias("_c"))
    lines = F.filter(F.flatten(F.transform("_c", lambda x: F.array(x["title"], x["one_line"]))), lambda x: F.length(x) > 0)
    rows = lead.join(rows, "video_id", "left")
    text = F.concat(F.array(_line("一句话 KPI：", c("_kpi")), F.lit("知识总览")), F.coalesce(lines, F.array().cast("array<string>")))
    return rows.select("video_id", _line("《学习笔记》\n\n", F.array_join(text, "\n")).alias("notes"))
