"""Sources and sinks on files with defects."""

import json

from lecturelake.sources import jsonl, media
from lecturelake.streaming import stream_segments

LINES = [
    '{"video_id":"a","segment_id":"0_1","start_ms":1,"end_ms":2,"src":"x"}',
    "",
    '{"video_id":"a","src":"x"',
    '[{"src":"x"}]',
    '{"video_id":"a"}',
    '{"src":"no video","start_ms":"12","end_ms":12.7}',
    '{"video_id":"b","src":"no times"}',
    '{"video_id":"c","src":null}',
    "17",
]


def test_segments_with_defects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    good, bad = jsonl.read_segments(spark, str(tmp_path / "x.jsonl"))
    rows = {(r["video_id"], r["start_ms"], r["end_ms"], r["src"]) for r in good.collect()}
    assert rows == {("a", 1, 2, "x"), ("unknown", 12, 12, "no video"), ("b", 0, 0, "no times")}
    assert {r["value"] for r in bad.collect()} == {LINES[i] for i in (2, 3, 4, 7, 8)}


def test_many_inputs(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.jsonl").write_text(LINES[0] + "\n")
    assert jsonl.read_segments(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])[0].count() == 2


def test_paragraphs_and_chapters_need_their_keys(spark, tmp_path):
    (tmp_path / "p").write_text('{"video_id":"a","start_ms":1,"end_ms":2,"text":"t"}\n{"video_id":"a","text":"t"}\n')
    good, bad = jsonl.read_paragraphs(spark, str(tmp_path / "p"))
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "c").write_text('{"chapter_id":1,"title":"t","items":[{"start_ms":1,"end_ms":2,"text":"x"}]}\n{"chapter_id":1,"title":"t"}\n')
    good, bad = jsonl.read_chapters(spark, str(tmp_path / "c"))
    assert good.first()["items"][0]["text"] == "x" and bad.count() == 1


def test_written_lines_keep_nulls_and_characters(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([("好", None)], "a string, b string").coalesce(1), str(tmp_path / "o"))
    line = next((tmp_path / "o").glob("part*.json")).read_text(encoding="utf-8").strip()
    assert line == '{"a":"好","b":null}' and json.loads(line)["b"] is None


def test_media_listing(spark, tmp_path):
    for name in ("a.MP4", "sub/b.mkv", "sub/a.mov", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = media.list_media(spark, str(tmp_path)).collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    assert [(r["video_id"], r["bytes"], r["same_name"]) for r in rows] == [("a", 1, 2), ("a", 1, 2), ("b", 1, 1)]


def test_chunks(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 240.0), ("c", 119.9)], "video_id string, duration_s double")
    assert {r["video_id"]: r["n"] for r in media.plan_chunks(df).groupBy("video_id").count().withColumnRenamed("count", "n").collect()} == {"a": 1, "b": 3, "c": 1}
    rows = spark.createDataFrame([("a", 2, 7, 1.2345, 2.0, " t ")], "video_id string, chunk_idx long, seg_idx long, start_s double, end_s double, text string")
    r = media.rebase_chunks(rows).first()
    assert (r["segment_id"], r["start_ms"], r["end_ms"], r["src"]) == ("2_00007", 241_234, 242_000, "t")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_text("\n".join(LINES))
    q = stream_segments(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("heard").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("heard").count() == 3


def test_nameless_segments_by_file(spark, tmp_path):
    """Many files whose rows name no lecture are as many lectures, if asked; else one."""
    for i in range(12):
        (tmp_path / f"{i}.jsonl").write_text('{"src":"x"}\n{"src":"y","video_id":"named"}\n' * 3)
    one = jsonl.read_segments(spark, str(tmp_path))[0]
    assert {r["video_id"]: r["count"] for r in one.groupBy("video_id").count().collect()} == {"unknown": 36, "named": 36}
    each = {r["video_id"]: r["count"] for r in jsonl.read_segments(spark, str(tmp_path), by_file=True)[0].groupBy("video_id").count().collect()}
    assert each.pop("named") == 36
    assert len(each) == 12 and set(each.values()) == {3} and all(k.startswith("unknown:") and k.endswith(".jsonl") for k in each)


def test_reports_are_found_by_lecture_in_order(spark, tmp_path):
    rows = [(f"v/{i}", "\n".join(f"line {k} of {i}" for k in range(i)), "other") for i in range(1, 40)] + [("12", "a\n\nb", "other")]
    df = spark.createDataFrame(rows, "video_id string, report string, more string").repartition(5)
    jsonl.write_report(df, str(tmp_path / "r"))
    got = {}
    for r in jsonl.read_reports(spark, str(tmp_path / "r")).collect():
        got.setdefault(r["video_id"], []).append(r["line"])
    assert {k: "\n".join(v) for k, v in got.items()} == {v: t for v, t, _ in rows}
    folder = next(tmp_path.glob("r/video_id=12"))
    assert "".join(p.read_text() for p in sorted(folder.glob("part*"))) == "a\n\nb\n"
    jsonl.write_report(df, str(tmp_path / "m"), "more")
    assert {r["line"] for r in jsonl.read_reports(spark, str(tmp_path / "m")).collect()} == {"other"}


def test_packed_reports_of_many_lectures(spark, tmp_path):
    """Every line of every lecture comes back in order from a few files, not from a folder for each lecture."""
    names = [f"v{i}" for i in range(200)] + ["a/b", "t\ta", 'q"\\', "l\nf", "null", "", "名", None]
    rows = [(v, "\n".join(f"{k}\t of {i}" for k in range(i % 7)) + ("\n\r x\n" if i % 3 else ""), "other") for i, v in enumerate(names)]
    df = spark.createDataFrame(rows, "video_id string, report string, more string").repartition(3)
    jsonl.pack_reports(df, str(tmp_path / "r"))
    assert 0 < len([*(tmp_path / "r").glob("**/part-*")]) <= 3
    got = {}
    for r in jsonl.read_packed(spark, str(tmp_path / "r")).collect():
        got.setdefault(r["video_id"], []).append(r["line"])
    assert {k: "\n".join(v) for k, v in got.items()} == {v: t for v, t, _ in rows}


def test_the_report_round_trip_writes_few_files(spark, sf_dir):
    from pathlib import Path

    from lecturelake.plans.queries import queries

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.glob("lectures-*")}
    queries()["report_roundtrip"](spark, sf_dir)
    (made,) = {*shared.glob("lectures-*")} - before
    assert 0 < len([*made.glob("**/part-*")]) <= 8
