"""Operators against plain restatements of their rules, and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lecturelake import lexicon
from lecturelake.functions.helpers import greedy_fill, step_windows
from lecturelake.operators import captions, chapters, chat, focus, paragraphs, reports, summaries, windows
from lecturelake.plans.pipeline import run_focus, run_pipeline

SEGMENT = "video_id string, segment_id string, start_ms long, end_ms long, src string"


def segs(spark, rows):
    return spark.createDataFrame([(v, f"0_{i}", a, b, s) for i, (v, a, b, s) in enumerate(rows)], SEGMENT)


def test_order_reads_ids_as_numbers(spark):
    df = spark.createDataFrame([("v", "10_1", 0, 5, "b"), ("v", "2_1", 0, 5, "a"), ("v", None, 0, 4, "c")], SEGMENT)
    assert [r["src"] for r in paragraphs.order_segments(df).orderBy("seq").collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_greedy_fill(spark, batch):
    rng = random.Random(batch)
    rows = [(f"v{v}", i, rng.choice([1, 3, 30, 250])) for v in range(7) for i in range(rng.randint(1, 60))]
    want, held, group, now = {}, 0, 0, None
    for v, i, s in rows:
        if v != now:
            held, group, now = 0, 0, v
        want[v, i] = group
        held += s
        if held >= 100:
            held, group = 0, group + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    df = spark.createDataFrame(rows, "video_id string, i long, size long").repartition(3, "video_id").sortWithinPartitions("video_id", "i")
    got = {(r["video_id"], r["i"]): r["g"] for r in greedy_fill(df, "video_id", "size", 100, "g").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == want


def stepped(rows, width):
    out, now, close = [], 0, None
    for a, b in rows:
        close = a + width if close is None else close
        if b > close:
            now, close = now + 1, close + width
        out.append(now)
    return out


def test_windows_closed_form_and_steps(spark):
    rng, rows, want = random.Random(1), [], {}
    for v in range(30):
        at, own = rng.randint(0, 5000), []
        for _ in range(rng.randint(1, 40)):
            start, at = at, at + rng.choice([500, 3000, 70_000, 400_000])
            own.append((start, at - (rng.choice([0, 60_000]) if v % 2 else 0)))
        own.sort()
        rows += [(f"v{v}", a, b, "x") for a, b in own]
        want[f"v{v}"] = stepped(own, 60_000)
    out = windows.number_windows(segs(spark, rows)).orderBy("video_id", "seq").collect()
    got = {}
    for r in out:
        got.setdefault(r["video_id"], []).append(r["window_idx"])
    assert got == want


def test_step_windows_alone(spark):
    df = segs(spark, [("v", 0, 50_000, "a"), ("v", 1, 200_000, "b"), ("v", 2, 130_000, "c")]).coalesce(1).sortWithinPartitions("start_ms")
    assert [r["w"] for r in step_windows(df, "video_id", "start_ms", "end_ms", 60_000, "w").collect()] == [0, 1, 2]


def test_micro_windows_after_a_pause_and_before_a_long_segment(spark):
    df = segs(spark, [("v", 0, 90_000, "长"), ("v", 600_000, 610_000, "b"), ("v", 610_000, 611_000, "c")])
    out = {r["window_idx"]: (r["start_ms"], r["summary"]) for r in windows.micro_summaries(df).collect()}
    assert out == {0: (0, ""), 1: (60_000, "长"), 2: (120_000, "b"), 3: (180_000, "c")}


def test_merge_segments(spark):
    df = segs(spark, [("v", 0, 1, "a" * 99), ("v", 9000, 9001, "嗯嗯"), ("v", 99_000, 99_001, "b" * 99), ("v", 99_002, 99_003, "好吗"), ("w", 5, 6, "就是"), ("w", 7, 8, None)])
    out = paragraphs.merge_segments(df, style="plain").orderBy("paragraph_id").collect()
    assert [(r["paragraph_id"], r["start_ms"], r["end_ms"]) for r in out] == [(0, 0, 99_001), (1, 99_002, 99_003)]
    assert out[0]["text"] == "a" * 99 + " " + "b" * 99 + "。"
    assert out[1]["text"] == "好吗?"
    assert paragraphs.merge_segments(df, max_gap_ms=0, style="plain").count() == 2
    shuffled = paragraphs.merge_segments(df.repartition(5).orderBy(F.rand(3)), style="plain")
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, out))


PARAGRAPH = "video_id string, paragraph_id long, start_ms long, end_ms long, text string"


def test_chapters(spark):
    long = "长" * 100
    df = spark.createDataFrame(
        [("v", 0, 0, 10, long), ("v", 1, 10_010, 11_000, long + "极限"), ("v", 2, 11_000, 12_000, long), ("v", 3, 12_000, 13_000, "小结 完"), ("v", 4, 13_000, 14_000, "首先我们看" + long), ("w", 0, 5, 6, "")],
        PARAGRAPH,
    )
    out = chapters.segment_chapters(df).orderBy("video_id", "chapter_id").collect()
    assert [(r["video_id"], r["chapter_id"], r["title"], r["start_ms"], r["end_ms"], len(r["items"])) for r in out] == [
        ("v", 1, "Chapter 1", 0, 10, 1), ("v", 2, "极限", 10_010, 13_000, 3), ("v", 3, ("看" + long)[:20], 13_000, 14_000, 1), ("w", 1, "Chapter 1", 5, 6, 1),
    ]


def test_summaries_of_chapters(spark):
    item = "struct<start_ms: bigint, end_ms: bigint, text: string>"
    texts = [["短", "", "第二 "], ["。。", "周期"], []]
    df = spark.createDataFrame([("v", i + 1, "", 0, 0, [(0, 0, t) for t in own]) for i, own in enumerate(texts)], f"video_id string, chapter_id long, title string, start_ms long, end_ms long, items array<{item}>")
    out = {r["chapter_id"]: r["one_line"] for r in summaries.chapter_summaries(df).collect()}
    assert out == {1: "短，第二", 2: "周期", 3: ""}
    plain, whole = summaries.global_summary(df).first(), summaries.global_summary(df, exam=True).first()
    assert (whole["one_line"], whole["exam_points"]) == ("短，第二 ", ["周期性质相互推出需同时条件"])
    assert (plain["one_line"], plain["exam_points"], plain["pitfalls"], plain["tips"]) == ("短，第二 ", [], [], [])
    assert [r["summary_title"] for r in summaries.rule_summaries(df).collect()] == ["本章内容"] * 3
    assert df.select(summaries.collapse_items(F.col("items"), 2)).orderBy("chapter_id").first()[0] == "短。第二"


def test_captions(spark):
    rng = random.Random(5)
    rows = [("v", i, a, a + rng.choice([0, 10, 9_000, 200_000, 90_000_000]), f"c{i}") for i, a in enumerate(rng.sample(range(0, 500_000), 80))]
    ticks = [("v", t) for t in range(0, 600_000, 7_919)] + [("w", 5)]
    caps = spark.createDataFrame(rows, "video_id string, n long, start_ms long, end_ms long, text string")
    got = {(r[0], r[1]): r[2] for r in captions.captions_at(caps, spark.createDataFrame(ticks, "video_id string, t_ms long")).collect()}
    for v, t in ticks:
        there = [(a, b, x) for w, _, a, b, x in rows if w == v and a <= t <= b]
        assert got[v, t] == (min(there)[2] if there else "")


def test_captions_of_nothing(spark):
    caps = spark.createDataFrame([], "video_id string, start_ms long, end_ms long, text string")
    assert captions.captions_at(caps, spark.createDataFrame([("v", 1)], "video_id string, t_ms long")).first()["text"] == ""


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "x"), (1, 2, " assistant ", "b"), (1, 1, "user", "a"), (1, 3, "user", ""), (1, 4, None, "q")], "conv_id long, turn long, role string, text string")
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "conv_id long, prompt string")
    out = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.chat_messages(turns, prompts, "s").collect()}
    assert out == {1: [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "p")], 2: [("system", "s"), ("user", "q")]}


def test_focus(spark):
    df = spark.createDataFrame([("v", 0, 0, 1, "定义一。没事。"), ("v", 1, 1, 2, "考试！"), ("v", 2, 2, 3, "")], PARAGRAPH)
    out = run_focus(df)
    assert [tuple(r) for r in out["stats"].where("video_id = 'v'").collect()] == [("v", 3, 2, 66.7, 1, 33.3)]
    ranked = out["ranked"].orderBy("rank").collect()
    assert [(r["paragraph_id"], r["pos"], r["is_key"]) for r in ranked] == [(0, 0, True), (1, 0, True), (0, 1, False)]
    assert focus.group_items(out["items"]).count() == 2
    assert focus.focus_stats(out["items"].where("false")).count() == 0
    requests = focus.model_requests(df, "s").orderBy("paragraph_id").collect()
    assert len(requests) == 2 and '"句子列表": ["定义一。", "没事。"]' in requests[0]["messages"][1]["content"]


def test_halves_of_percent_go_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (15, 16), (13, 16), (0, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(focus.tenths(F.col("a"), F.col("b"))).collect()] == [62, 188, 938, 812, 0, 333]


def test_align(spark):
    df = spark.createDataFrame([("v", i, 0, 1, "甲。乙。") for i in range(4)], PARAGRAPH)
    full = '[{"句子":"甲。","类别":"重点","总结":"t"},{"句子":"乙。","类别":"非重点"}]'
    answers = spark.createDataFrame([("v", 0, full), ("v", 1, '[{"text":"x","type":"meta"}]'), ("v", 2, "nonsense")], "video_id string, paragraph_id long, content string")
    strict = focus.align_responses(df, answers).orderBy("paragraph_id", "pos").collect()
    assert [(r["paragraph_id"], r["origin"], r["category"]) for r in strict[:3]] == [(0, "model", "重点"), (0, "model", "非重点"), (1, "rule", "非重点")]
    assert len(strict) == 8
    loose = focus.align_responses(df, answers, strict=False).where("origin = 'model'")
    assert sorted((r["paragraph_id"], r["sentence"], r["type"]) for r in loose.collect())[-1] == (1, "x", "meta")


def test_one_answer_a_paragraph_counts(spark):
    """Retries don't multiply sentences: the first answer that fits is used, whatever the order of rows."""
    df = spark.createDataFrame([("v", 0, 0, 1, "甲。乙。"), ("v", 1, 0, 1, "")], PARAGRAPH)
    one = '[{"句子":"a","类别":"重点"},{"句子":"b"}]'
    answers = [("v", 0, "none"), ("v", 0, '[{"句子":"z"}]'), ("v", 0, one.replace("a", "c")), ("v", 0, one), ("v", 0, one), ("v", 1, one), ("v", 0, None)]
    for given in (answers, answers[::-1]):
        frame = spark.createDataFrame(given, "video_id string, paragraph_id long, content string").repartition(3)
        got = focus.align_responses(df, frame).orderBy("paragraph_id", "pos").collect()
        assert [(r["paragraph_id"], r["pos"], r["sentence"], r["origin"]) for r in got] == [(0, 0, "a", "model"), (0, 1, "b", "model")]


def test_exam_lists_are_asked_for(spark):
    df = segs(spark, [("v", 0, 1, "导数"), ("v", 1, 2, "奇函数加常数")])
    plain, exam = windows.micro_summaries(df).first(), windows.micro_summaries(df, exam=True).first()
    assert plain["summary"] == exam["summary"] == "导数，奇函数加常数"
    assert [plain[c] for c in ("exam_points", "pitfalls", "tips")] == [[], [], []]
    assert [len(exam[c]) for c in ("exam_points", "pitfalls", "tips")] == [1, 1, 1]
    out = run_pipeline(df)
    assert "🎯" not in reports.micro_report(out["micro_summaries"]).first()["report"]
    assert "🎯" in reports.micro_report(run_pipeline(df, exam=True)["micro_summaries"]).first()["report"]


def test_windows_of_many_segments(spark):
    """Of a window only what a summary shows is joined; blank texts count nothing."""
    rows = [("v", 0, 1, "。"), ("v", 1, 2, " "), ("v", 2, 3, "甲"), ("v", 3, 4, "乙乙。丙"), *[("v", 4 + i, 5 + i, "丁") for i in range(3000)]]
    r = windows.micro_summaries(segs(spark, rows)).first()
    assert r["summary"] == "甲，乙乙"
    assert windows.micro_summaries(segs(spark, [("v", 0, 1, "。"), ("v", 1, 2, "。")])).first()["summary"] == "。。。"


def test_lexicons_reach_every_step(spark):
    words = lexicon.Lexicon(
        fillers=["um"], sound_tags=["noise"], hesitations="h", question_particles="k", connectives=["so"], chapter_phrases=["next part"], title_topics=["limits"],
        exam_points=[("limit", "P")], exam_pitfalls=[("trap", "F")], exam_tips=[("tip", "T")], chapter_bullets=[("limits", None, "B")],
        chapter_exam=[("limits", "p", "q", "f", "t")], sentence_types=[("definition", ["limits"])], key_words=["trap"],
    )
    df = segs(spark, [("v", 0, 1, "um hhh[noise]limits k"), ("v", 20_000, 30_000, "next part so trap tip 然后")])
    out = run_pipeline(df, min_chars=1, threshold=2, min_len_chars=1, exam=True, focus=True, words=words)
    texts = [r["text"] for r in out["paragraphs"].orderBy("paragraph_id").collect()]
    assert texts == ["limitsk？", "nextpart，sotraptip然后。"]
    spoken = [r["title"] for r in out["chapters"].orderBy("chapter_id").collect()]
    assert spoken[0] == "limits" and out["global_summary"].first()["exam_points"] == ["P"]
    micro = out["micro_summaries"].first()
    assert (micro["exam_points"], micro["pitfalls"], micro["tips"]) == (["P"], ["F"], ["T"])
    exam = out["rules_exam"].orderBy("chapter_id").first()
    assert (exam["bullets"], exam["exam_points"], exam["tips"]) == (["B"], ["p"], ["t"])
    assert [r["category"] for r in out["focus_items"].orderBy("paragraph_id").collect()] == ["非重点", "重点"]
    assert [r["type"] for r in focus.focus_items(out["paragraphs"], "type", words).orderBy("paragraph_id").collect()] == ["definition", "meta"]


def test_focus_is_an_optional_step(spark):
    df = segs(spark, [("v", 0, 1, "定义一"), ("v", 1, 2, "没事")])
    names = {f"focus_{k}" for k in ("items", "stats", "ranked", "keys", "others")}
    assert not names & run_pipeline(df).keys()
    out = run_pipeline(df, focus=True)
    assert names < out.keys() and out["focus_keys"].count() == 1
    answers = spark.createDataFrame([("v", 0, '[{"句子":"x","类别":"重点"}]')], "video_id string, paragraph_id long, content string")
    assert [r["sentence"] for r in run_pipeline(df, responses=answers)["focus_keys"].collect()] == ["x"]


def test_reports_of_nothing(spark):
    df = segs(spark, [("v", 0, 1, "嗯嗯")])
    out = run_pipeline(df)
    row = reports.summary_report(df, out["micro_summaries"], out["chapter_summaries"], out["global_summary"]).first()
    assert row["chapters"] == row["overall"] == "暂无数据"
    assert row["micro"].startswith("=" * 60 + "\n📈 微段摘要\n")


def test_notes(spark):
    sums = spark.createDataFrame([("v", i, f"t{i}", "") for i in range(7)], "video_id string, chapter_id long, title string, one_line string")
    whole = spark.createDataFrame([("v", "k")], "video_id string, one_line string")
    assert reports.notes_digest(sums, whole).first()["notes"] == "《学习笔记》\n\n一句话 KPI：\n知识总览\nt0\nt1\nt2\nt3\nt4"
    assert "一句话 KPI：k\n" in reports.notes_digest(sums, whole, kpi_field="one_line").first()["notes"]


def test_plans_have_no_hidden_single_task(spark, sf_dir):
    from lecturelake.plans.queries import queries

    for name in ("pipeline_chapters", "micro_summaries", "focus_report", "captions_at", "global_summary"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Exchange SinglePartition" not in plan


def test_captions_are_planned_without_a_job(spark):
    """Nothing runs until rows are asked for, and captions of all lengths are found as by comparing all."""
    rng = random.Random(6)
    caps = [(f"v{i % 3}", a := rng.randrange(10**7), a + rng.choice([0, 10, 5000, 10**5, 10**7, 10**10]), f"c{i}") for i in range(200)]
    ticks = [(f"v{i % 4}", rng.randrange(3 * 10**7)) for i in range(300)]
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    out = captions.captions_at(spark.createDataFrame(caps, "video_id string, start_ms long, end_ms long, text string"), spark.createDataFrame(ticks, "video_id string, t_ms long"))
    assert len(jobs.getJobIdsForGroup(None)) == before
    want = {(v, t): min(((a, b, x) for w, a, b, x in caps if w == v and a <= t <= b), default=(0, 0, ""))[2] for v, t in ticks}
    assert {(r["video_id"], r["t_ms"]): r["text"] for r in out.collect()} == want


def test_summaries_of_heads_and_items_are_those_of_nested_chapters(spark, sf_dir):
    from lecturelake.plans import fixtures

    paras = fixtures.paragraphs(spark, sf_dir)
    blank = spark.createDataFrame([("blank", i, i, i + 1, t) for i, t in enumerate(["", " ", "", "x。y", "", "z。" * 900, "tail"])], "video_id string, paragraph_id long, start_ms long, end_ms long, text string")
    paras = paras.unionByName(blank)
    nested, items = chapters.segment_chapters(paras), chapters.number_chapters(paras)
    heads = chapters.chapter_heads(items)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert plain(summaries.chapter_summaries(nested)) == plain(summaries.chapter_summaries(heads, items=items))
    assert plain(summaries.global_summary(nested, exam=True)) == plain(summaries.global_summary(heads, exam=True, items=items))
    for style in ("plain", "exam"):
        assert plain(summaries.rule_summaries(nested, style)) == plain(summaries.rule_summaries(heads, style, items=items))
    assert plain(chapters.chapter_sizes(nested)) == plain(chapters.chapter_sizes(heads))


def test_many_answers_to_one_paragraph(spark):
    """The first in text order that fits counts, with thousands of others about."""
    paras = spark.createDataFrame([("v", 0, 0, 1, "一句。两句。"), ("v", 1, 0, 1, "三句。")], "video_id string, paragraph_id long, start_ms long, end_ms long, text string")
    fit = [f'[{{"text":"s{i}","type":"meta"}},{{"text":"t{i}","type":"meta"}}]' for i in range(2000)]
    rows = [("v", 0, x) for x in [*fit, "[]", "no list", '[{"text":"one","type":"meta"}]', None]] + [("v", 1, "nothing here")]
    answers = spark.createDataFrame(rows, "video_id string, paragraph_id long, content string").repartition(4)
    got = sorted((r["paragraph_id"], r["pos"], r["sentence"], r["origin"]) for r in focus.align_responses(paras, answers).collect())
    assert got == [(0, 0, "s0", "model"), (0, 1, "t0", "model"), (1, 0, "三句。", "rule")]
    got = sorted((r["paragraph_id"], r["pos"], r["sentence"], r["origin"]) for r in focus.align_responses(paras, answers, strict=False).collect())
    assert got == [(1, 0, "三句。", "rule")]  # any list counts, and the empty one comes first


def test_all_outputs_of_a_run_in_one_call(spark, sf_dir, tmp_path):
    from lecturelake.plans import fixtures
    from lecturelake.plans.pipeline import write_outputs
    from lecturelake.sources import jsonl

    seg = fixtures.segments(spark, sf_dir).where("video_id in ('v1', 'v2', 'v3')")
    tables = run_pipeline(seg, exam=True, focus=True)
    written = write_outputs(tables, str(tmp_path / "out"), with_reports=True)
    assert sorted(written) == sorted(["paragraphs", "chapters", "micro_summaries", "chapter_summaries", "global_summary", "rules_exam", "rules_plain", "focus_items",
        "chapters_report", "micro_summaries_report", "chapter_summaries_report", "global_summary_report", "rules_exam_report", "rules_plain_report", "focus_items_report"])
    assert jsonl.read_paragraphs(spark, written["paragraphs"])[0].count() == tables["paragraphs"].count()
    assert jsonl.read_chapters(spark, written["chapters"])[0].count() == tables["chapters"].count()
    whole = {r["video_id"]: r["report"] for r in reports.chapter_report(tables["chapters"]).collect()}
    read = {}
    for r in jsonl.read_reports(spark, written["chapters_report"]).collect():
        read.setdefault(r["video_id"], []).append(r["line"])
    assert {k: "\n".join(v) for k, v in read.items()} == whole and len(whole) == 3
    assert set(write_outputs({"paragraphs": tables["paragraphs"]}, str(tmp_path / "p"), form="parquet")) == {"paragraphs"}
    assert spark.read.parquet(str(tmp_path / "p/clean_paragraphs")).count() == tables["paragraphs"].count()


def test_stored_answers_are_parsed_once_to_count_them(spark):
    """No filter repeats what an answer's number of elements takes."""
    rows = spark.createDataFrame([("v", 1, 0, 5, "a。b。")], "video_id string, paragraph_id long, start_ms long, end_ms long, text string")
    given = spark.createDataFrame([("v", 1, '[{"text":"a"},{"text":"b"}]'), ("v", 1, '{"a":1}')], "video_id string, paragraph_id long, content string")
    for strict in (True, False):
        out = focus.align_responses(rows, given, strict)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(array(size(" in plan
        assert not [x for x in plan.splitlines() if "Filter" in x and "try_variant_get" in x]
        assert [(r["sentence"], r["origin"]) for r in out.orderBy("pos").collect()] == [("a", "model"), ("b", "model")]


def test_stored_answers_of_the_queries_are_made_once(spark, sf_dir):
    from lecturelake.plans.queries import queries

    for name in ("model_align", "model_align_loose"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("documents.parquet") + plan.count("Relation [") <= 2, name


def test_texts_that_no_summary_shows_are_not_shuffled(spark):
    """Dealt items give the summaries of others, and leave texts behind the second sentence where they are."""
    rows = [(f"v{v}", i, i * 1000, i * 1000 + 900, "一句。二句。三" if i % 2 else f"{lexicon.CHAPTER_PHRASES[0]}x" + "y" * 100 * (i % 5 == 0) + " 导数") for v in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "video_id string, paragraph_id long, start_ms long, end_ms long, text string").repartition(3)
    plain, dealt = chapters.number_chapters(df), chapters.number_chapters(df, dealt=True)
    heads = chapters.chapter_heads(plain)
    for make in (lambda x: summaries.global_summary(heads, exam=True, items=x), lambda x: summaries.chapter_summaries(heads, items=x)):
        assert sorted(make(dealt).collect(), key=str) == sorted(make(plain).collect(), key=str)
    plan = summaries.global_summary(heads, items=dealt)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {k: [n for n, x in enumerate(plan) if "Window [sum(_n" in x and k in x] for k in ("__block", "")}
    assert at["__block"] and min(at[""]) < min(at["__block"])  # the sum inside blocks stands below the one along lectures
