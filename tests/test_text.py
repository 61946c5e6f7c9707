"""Text rules, by hand: expected values are written out."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from lecturelake import lexicon as lx
from lecturelake.functions import text as tx


def one(spark, make, *values, names="abcdef"):
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names[: len(values)]))
    return df.select(make(*[F.col(n) for n in names[: len(values)]]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("  a 　 b\u0085c\x1fd ", "a b c d"),
        ("Ａ１（音乐）b", "A1b"),
        ("x·y•z", "xyz"),
        ("[掌声]好", "好"),
        ("嗯嗯啊好", "好"),
        ("嗯 好", "好"),
        ("就是 就是 好", "就是 好"),
        ("然后 就是 x", "x"),
        ("就是 那么", ""),
        ("那么好 就是", "那么好"),
        ("", ""),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, tx.normalize, raw) == clean


@pytest.mark.parametrize("raw, closed", [("", ""), ("好", "好。"), ("好吗", "好吗？"), ("好!", "好!"), ("对吧", "对吧？")])
def test_autopunct(spark, raw, closed):
    assert one(spark, tx.autopunct, raw) == closed


@pytest.mark.parametrize(
    "raw, parts",
    [
        ("", []),
        ("。", ["。"]),
        ("a。 b？c吗", ["a。", "b？", "c吗？"]),
        ("约3.14米", ["约3.", "14米。"]),
        ("…!! ", ["…!", "!"]),
        (" \n ", []),
    ],
)
def test_sentences(spark, raw, parts):
    assert one(spark, tx.sentences, raw) == parts


@pytest.mark.parametrize(
    "raw, styled",
    [
        ("所以好", "，所以好"),
        ("好，所以好", "好，所以好"),
        ("。然后然后，所以所以但是a首先", "。然后，然后，所以，所以，但是a，首先"),
        ("a, b.. c!!", "a，b。c！"),
        ("3.14", "3。14"),
    ],
)
def test_student_style(spark, raw, styled):
    assert one(spark, tx.student_style, raw) == styled


def test_finalize_twice_turns_the_inserted_mark(spark):
    once = one(spark, tx.finalize, "好吗")
    assert once == "好吗?"
    assert one(spark, lambda c: tx.finalize(c, "student"), "好吗") == "好吗？"


@pytest.mark.parametrize(
    "raw, k, cut",
    [
        ("", 60, ""),
        ("。！", 60, "。！"),
        ("短。第二句。三", 60, "短，第二句"),
        ("a. b. c", 60, "a. b. c"),
        ("一二三四五六七八九十一二三四五六七八九十。后", 60, "一二三四五六七八九十一二三四五六七八九十"),
        ("abcdefgh", 5, "abcde…"),
        ("😀😀😀", 2, "😀😀…"),
    ],
)
def test_short_summary(spark, raw, k, cut):
    assert one(spark, lambda c: tx.short_summary(c, k), raw) == cut


def test_rules(spark):
    assert one(spark, tx.exam_points, "单调和周期") == ["导数符号与单调性的对应关系", "周期性质相互推出需同时条件"]
    assert one(spark, tx.exam_pitfalls, "奇函数加常数") == ["奇函数加常数不再为奇；偶函数加常数仍为偶"]
    assert one(spark, tx.exam_tips, "") == []
    assert one(spark, tx.chapter_bullets, "单调性", "d f  > 0") == ["导数>0 ⇒ 函数单调增，导数<0 ⇒ 函数单调减"]
    assert one(spark, tx.chapter_bullets, "", "a。b。c。d。e。f") == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(
    "s, kind",
    [("定义重要", "definition"), ("注意这个重要", "meta"), ("这个不考", "minor_content"), ("重要结论", "key_content"), ("hello", "meta"), ("例如", "example")],
)
def test_sentence_type(spark, s, kind):
    assert one(spark, tx.sentence_type, s) == kind


@pytest.mark.parametrize("ms, clock, minutes", [(0, "00:00", "00:00"), (59999, "00:59", "00:59"), (3_600_000, "01:00:00", "60:00"), (7_325_000, "02:02:05", "122:05")])
def test_clock(spark, ms, clock, minutes):
    df = spark.createDataFrame([(ms,)], "a long")
    assert tuple(df.select(tx.clock(F.col("a")), tx.minutes(F.col("a"))).first()) == (clock, minutes)


def test_title_candidates(spark):
    assert one(spark, tx.title_topic, "讲原函数与导函数和极限") == "原函数与导函数"
    assert one(spark, tx.title_topic, "没有") is None
    assert one(spark, tx.title_tail, "小结。接下来讲，极好的 东西") == "极好的 东西"
    assert one(spark, tx.title_tail, "总结一下。") is None


@pytest.mark.parametrize(
    "raw, n",
    [("[1,2]", 2), ("```json\n[1]\n```", 1), ("ok [1,2,3] done", 3), ("[1,", None), ("none", None), ("", None), ('{"a":1}', None), ("[1] x [2", 1), ("[]", 0)],
)
def test_json_array(spark, raw, n):
    size = one(spark, lambda c: F.when(tx.json_array(c).isNotNull(), F.size(tx.json_array(c))).cast("string"), raw)
    assert size == (None if n is None else str(n))


def test_characters_taken_for_unchanged_are():
    """None changes under NFKC, combines with what is before it, or is reordered."""
    import unicodedata

    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    for a, b in tx.UNCHANGED:
        for c in range(a, b + 1):
            assert unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second, hex(c)


def test_only_texts_that_may_change_leave(spark):
    import unicodedata

    texts = [None, "", "plain", "（掌声）！", "e\u0301", "\u1100\u1161", "ｱｲ", "ﬁ ½", "中文，。", "中文、。《》", "é", "\u3000x", "か\u3099", "a\u00a0b", "①", "Ж", "\x1c", "😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", tx.compatible(F.col("s")).alias("t"), F.col("s").rlike(tx.MAY_CHANGE).alias("leaves")).collect()
    assert [r["t"] for r in rows] == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert {r["s"] for r in rows if r["leaves"] is False} >= {"", "plain", "中文、。《》", "é", "Ж"}


NOISE = ["就是", "嗯", "嗯嗯", " ", "  ", "\t", "　", "[音乐]", "(掌声)", "·", "。", "?", "？", ".", "吗", "呢", "abc", "x y", "，，", "\x00", "\r\n", "\x85", "é", "所以", "。 呢 。", " 呢"]


def mixed(n, seed):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(NOISE) for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["", "a. b c. d", "No noise here. None there", None]


def test_texts_without_noise_are_spared_and_no_others(spark):
    """A text that the look takes for clean is what the chain of replacements would leave."""
    df = spark.createDataFrame([(t,) for t in mixed(3000, 1)], "s string")
    noise = (lx.FILLERS, lx.SOUND_TAGS, lx.HESITATIONS)
    seen = df.select("s", tx.noisy(F.col("s"), *noise).alias("noisy"), tx.drop_noise(F.concat("s", F.lit(" "))).alias("t")).collect()
    assert not [r for r in seen if r["noisy"] is False and r["t"] != r["s"]]
    assert {r["s"] for r in seen if r["noisy"] is False} >= {"", "a. b c. d", "No noise here. None there", "abc"}


def test_finalizing_twice_is_finalizing_what_was_joined(spark):
    own = dataclasses.replace(lx.DEFAULT, fillers=("you know", "x", "呢?"), hesitations="mh", question_particles="ab", sound_tags=("A.", "x y"))
    df = spark.createDataFrame([(t,) for t in mixed(3000, 2)], "s string")
    s = F.col("s")
    for words in (lx.DEFAULT, own):
        noise, particles = (words.fillers, words.sound_tags, words.hesitations), words.question_particles

        def plain(x, noise=noise, particles=particles):
            """Each sentence by itself, with no look at the whole."""
            cut = F.filter(F.transform(F.regexp_extract_all(x, F.lit("[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$"), F.lit(0)), tx.strip), lambda p: p != "")
            clean = F.transform(cut, lambda p: tx.drop_noise(F.translate(tx.autopunct(p, particles), "？", "?"), *noise))
            return F.array_join(F.transform(clean, lambda p: tx.autopunct(p, particles)), "")

        once = df.select("s", plain(tx.squeeze(s)).alias("a"), tx.finalize(s, words=words).alias("once"), tx.finalize(s, words=words, times=2).alias("twice"))
        rows = once.select("s", "a", "once", "twice", plain(tx.squeeze(F.col("a"))).alias("b")).collect()
        assert not [r for r in rows if (r["once"], r["twice"]) != (r["a"], r["b"])][:2]


def test_white_space_is_all_of_it(spark):
    rows = spark.range(0x3400).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'utf-16be')").alias("c"))
    assert {r["c"] for r in rows.where(F.col("c").rlike(f"(?U)^{tx.SPACE}$")).collect()} == set(tx.WHITE)
