"""Whole jobs over a corpus of lectures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..lexicon import DEFAULT, Lexicon
from ..operators.chapters import chapter_heads, nest_chapters, number_chapters
from ..operators import reports
from ..operators.focus import align_responses, focus_items, focus_rank, focus_stats, group_items, key_list, non_key_examples
from ..operators.paragraphs import merge_segments
from ..operators.summaries import chapter_summaries, global_summary, rule_summaries
from ..operators.windows import micro_summaries
from ..sources.jsonl import pack_reports, write_jsonl, write_report


def run_pipeline(
    segments: DataFrame,
    min_chars: int = 200,
    min_gap_ms: int = 10000,
    min_len_chars: int = 100,
    threshold: int = 2,
    window_sec: int = 60,
    style: str = "student",
    exam: bool = False,
    focus: bool = False,
    responses: DataFrame | None = None,
    words: Lexicon = DEFAULT,
    hold: Callable[[DataFrame], DataFrame] = DataFrame.persist,
) -> dict[str, DataFrame]:
    """Paragraphs, chapters and all summaries from segments.

    ``exam`` fills the exam lists of minute and lecture summaries.  ``focus`` (or ``responses``, stored
    model answers) adds the results of ``run_focus`` over the paragraphs, as ``focus_items`` and so on.
    ``hold`` keeps what several outputs read (paragraphs and the items of chapters): memory and disk by
    default; pass a function that writes a table where lineage should be cut.  Summaries read the table
    of items; only ``chapters`` itself nests them.
    """
    paragraphs = hold(merge_segments(segments, min_chars, style=style, words=words))
    lists = {"phrases": words.chapter_phrases, "topics": words.title_topics}
    items = hold(number_chapters(paragraphs, threshold, min_gap_ms=min_gap_ms, min_len_chars=min_len_chars, phrases=words.chapter_phrases, dealt=True))
    heads = chapter_heads(items, **lists)
    out = {
        "paragraphs": paragraphs,
        "chapters": nest_chapters(items, **lists),
        "micro_summaries": micro_summaries(segments, window_sec, exam=exam, words=words),
        "chapter_summaries": chapter_summaries(heads, items=items),
        "global_summary": global_summary(heads, exam=exam, words=words, items=items),
        "rules_plain": rule_summaries(heads, "plain", words=words, items=items),
        "rules_exam": rule_summaries(heads, "exam", words=words, items=items),
    }
    if focus or responses is not None:
        out |= {f"focus_{k}": v for k, v in run_focus(paragraphs, responses, hold=hold, words=words).items()}
    return out


#: The tables of a run, and the names they are written under.
OUTPUTS = {
    "paragraphs": "clean_paragraphs", "chapters": "chapters", "micro_summaries": "micro_summary", "chapter_summaries": "chapter_summary",
    "global_summary": "global_summary", "rules_exam": "chapters_summary_exam", "rules_plain": "chapters_summary", "focus_items": "focus_analysis",
}


def report_frames(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``video_id, report`` for every report that ``tables`` (of ``run_pipeline``) hold the rows of."""
    makers = {
        "chapters": reports.chapter_report,
        "micro_summaries": reports.micro_report,
        "chapter_summaries": reports.chapter_summary_report,
        "global_summary": reports.global_report,
        "rules_exam": reports.rule_report,
        "rules_plain": lambda rows: reports.rule_report(rows, "plain"),
        "focus_items": reports.focus_report,
    }
    return {k: make(tables[k]) for k, make in makers.items() if k in tables}


def write_outputs(tables: dict[str, DataFrame], path: str, with_reports: bool = False, form: str = "jsonl", packed: bool = False) -> dict[str, str]:
    """Write the outputs of a run below ``path``; gives the folder of each.

    Tables as JSON Lines, or as Parquet with ``form="parquet"``; focus items are written one row a
    paragraph.  ``with_reports`` adds the readable reports, a folder for each lecture, or ``packed``, many lectures to a file.
    """
    written = {}
    for name, folder in OUTPUTS.items():
        if name in tables:
            rows = group_items(tables[name]) if name == "focus_items" else tables[name]
            written[name] = f"{path}/{folder}"
            if form == "parquet":
                rows.write.parquet(written[name])
            else:
                write_jsonl(rows, written[name])
    for name, lines in (report_frames(tables) if with_reports else {}).items():
        written[f"{name}_report"] = f"{path}/{OUTPUTS[name]}_text"
        (pack_reports if packed else write_report)(lines, written[f"{name}_report"])
    return written


def run_focus(paragraphs: DataFrame, responses: DataFrame | None = None, strict: bool = True, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist, words: Lexicon = DEFAULT) -> dict[str, DataFrame]:
    """Sentence analysis by rule, or by stored answers where they fit, with statistics and ranks."""
    items = focus_items(paragraphs, "category" if strict else "type", words) if responses is None else align_responses(paragraphs, responses, strict, words)
    items = hold(items)
    return {"items": items, "stats": focus_stats(items), "ranked": focus_rank(items), "keys": key_list(items), "others": non_key_examples(items)}
