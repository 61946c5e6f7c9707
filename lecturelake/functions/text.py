"""Text operators as Column functions.

White space is Unicode-wide: ``(?U)`` makes ``\\s`` so in Java, and U+001C-1F are added.  Lengths
and cuts count code points.  All but ``nfkc`` are built-in expressions.

Texts are mostly clean and mostly ASCII letters, and a pattern costs by the character.  So one look
spares clean texts the chains of replacements, and patterns that begin with other characters say so
first (``ahead``), as one range is tested many times faster than a set or a list of words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicon as lx

SPACE = r"[\s\x1c-\x1f]"
#: The characters of ``SPACE``.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode normalization form KC, a batch at a time."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


#: Ranges of characters that NFKC leaves as they are, next to whatever: ASCII, Latin letters, Cyrillic,
#: punctuation of East Asian texts, kana without the marks that join them, ideographs.
UNCHANGED = [
    (0x00, 0x7F), (0xC0, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x400, 0x45F), (0x2010, 0x2010),
    (0x2012, 0x2016), (0x2018, 0x2023), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x4E00, 0x9FFF),
]
MAY_CHANGE = r"[^\x00-\x7f](?<=[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in UNCHANGED) + "])"


def compatible(s: Column) -> Column:
    """``nfkc``, where only texts with a character that may change leave the JVM; for others a null goes."""
    return F.coalesce(nfkc(F.when(s.rlike(MAY_CHANGE), s)), s)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def squeeze(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(s, f"(?U){SPACE}+", " "))


def any_of(words: Sequence[str]) -> str:
    return "|".join(f"\\Q{w}\\E" for w in words)


def ahead(firsts: Sequence[str]) -> str:
    """What a pattern that begins with one of ``firsts`` may say first: it begins with no printable ASCII character."""
    return "(?=[^ -~])" if all(w and not " " <= w[0] <= "~" for w in firsts) else ""


def contains_any(s: Column, words: Sequence[str]) -> Column:
    return s.rlike(f"{ahead(words)}(?:{any_of(words)})")


def noisy(s: Column, fillers: Sequence[str], tags: Sequence[str], hesitations: str, marks: str = "") -> Column:
    """Whether ``drop_noise`` may change the text, or a sentence of it where ``marks`` end sentences."""
    lone = f"(?<=^|[ {marks}])(?:{any_of(fillers)})(?:$| {f'|(?<=[{marks}])' if marks else ''})"
    firsts = [*fillers, *hesitations, *lx.BULLETS]
    odd = f"(?U){ahead(firsts)}(?:[{lx.BULLETS}]|[{hesitations}]{{2}}|{lone}|{SPACE}(?<! ))"
    tagged = rf"[\[(](?:{any_of(tags)})[\])]"
    return s.contains("  ") | (strip(s) != s) | s.rlike(odd) | s.rlike(tagged)


def drop_noise(s: Column, fillers: Sequence[str] = lx.FILLERS, tags: Sequence[str] = lx.SOUND_TAGS, hesitations: str = lx.HESITATIONS) -> Column:
    """The part of ``normalize`` after NFKC."""
    alone = lambda w: rf"(?:^| )(?:{w})(?:$| )"
    chain = lambda s: reduce(lambda x, w: F.regexp_replace(x, alone(any_of([w])), " "), fillers, s)

    def clean(s: Column) -> Column:
        s = F.regexp_replace(squeeze(s), f"[{lx.BULLETS}]+", "")
        for left, right in (r"\[", r"\]"), (r"\(", r"\)"):
            s = F.regexp_replace(s, f"{left}(?:{any_of(tags)}){right}", "")
        s = F.regexp_replace(s, f"[{hesitations}]{{2,}}", "")
        # Most texts hold no filler that stands alone: one look spares them the chain.
        return squeeze(let(s, lambda x: F.when(x.rlike(alone(any_of(fillers))), chain(x)).otherwise(x)))

    return let(s, lambda x: F.when(noisy(x, fillers, tags, hesitations), clean(x)).otherwise(x))


def normalize(s: Column, **how) -> Column:
    """NFKC, white space, bullets, sound tags, hesitations and lone fillers."""
    return drop_noise(compatible(s), **how)


def ends_with_mark(s: Column) -> Column:
    return _at_end(s, lx.TERMINATORS)


def _at_end(s: Column, characters: str) -> Column:
    """One of ``characters`` at the end, or before a last line break (two characters at most)."""
    return F.right(s, F.lit(3)).rlike(f"[{characters}]$")


def autopunct(s: Column, particles: str = lx.QUESTION_PARTICLES) -> Column:
    """Close an open sentence: with ？ after a question particle, else with 。; empty stays so."""
    asks = _at_end(s, particles)
    return F.when((s == "") | ends_with_mark(s), s).when(asks, F.concat(s, F.lit("？"))).otherwise(F.concat(s, F.lit("。")))


def sentences(s: Column, particles: str = lx.QUESTION_PARTICLES) -> Column:
    """Each mark closes a sentence; an open rest is closed by ``autopunct``."""
    cut = let(let(strip(s), lambda x: autopunct(x, particles)), _cut)
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def _cut(s: Column) -> Column:
    """A text behind each of its marks; a text that holds U+0000 itself goes the slower way."""
    marks, cut = lx.TERMINATORS, "\x00"
    behind = F.split(F.regexp_replace(s, f"([{marks}])", f"$1{cut}"), cut)
    return F.when(s.contains(cut), F.regexp_extract_all(s, F.lit(f"[^{marks}]*[{marks}]|[^{marks}]+$"), F.lit(0))).otherwise(behind)


def full_width(s: Column) -> Column:
    """``? ! , .`` become full-width; runs of ， and of 。 become one."""
    s = F.translate(s, "?!,.", "？！，。")
    return F.regexp_replace(F.regexp_replace(s, "，{2,}", "，"), "。{2,}", "。")


def student_style(s: Column, connectives: Sequence[str] = lx.CONNECTIVES) -> Column:
    """Full-width marks, commas before connectives, no white space, no repeated marks."""
    comma = lambda s: reduce(lambda x, w: F.regexp_replace(x, f"(?<![，。！？])\\Q{w}\\E", f"，{w}"), connectives, s)
    s = let(full_width(s), lambda x: F.when(contains_any(x, connectives), comma(x)).otherwise(x))
    return F.regexp_replace(F.regexp_replace(s, f"(?U){SPACE}+", ""), rf"{ahead('，。！？')}([，。！？])\1+", "$1")


def finalize(s: Column, style: str = "plain", words: lx.Lexicon = lx.DEFAULT, times: int = 1) -> Column:
    """Sentences of a normalized text, cleaned and closed again, joined; ``student`` styles them.  With
    ``times``, what has been joined is taken apart and cleaned again before it is styled.

    The text is NFKC already, so of that form only ？, which closing a sentence may have added, is
    left to change.  Where no sentence has noise, only the spaces between them go, and another time changes nothing.
    """
    noise, particles = (words.fillers, words.sound_tags, words.hesitations), words.question_particles
    closed = lambda s: F.translate(let(squeeze(s), lambda x: autopunct(x, particles)), "？", "?")

    def clean(s: Column) -> Column:
        parts = F.transform(sentences(s, particles), lambda x: drop_noise(x, *noise))
        return F.array_join(F.transform(parts, lambda x: autopunct(x, particles)), "")

    def joined(s: Column) -> Column:
        again = reduce(lambda x, _: clean(closed(x)), range(times - 1), clean(s))
        return F.when(noisy(s, *noise, lx.TERMINATORS), again).otherwise(F.regexp_replace(s, f"([{lx.TERMINATORS}]) ", "$1"))

    out = let(closed(s), joined)
    return student_style(out, words.connectives) if style == "student" else out


def _pieces(s: Column) -> Column:
    return F.filter(F.split(s, f"(?U)[。！？]{SPACE}*"), lambda x: x != "")


def short_summary(text: Column, max_len: int = 120) -> Column:
    """The first sentence, with the second if it is shorter than 20, cut to ``max_len``."""

    def of(text: Column, parts: Column) -> Column:
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        key = F.when((F.length(first) < 20) & second.isNotNull(), F.concat(first, F.lit("，"), second)).otherwise(first)
        cut = let(key, lambda k: F.concat(F.left(k, F.lit(max_len)), F.when(F.length(k) > max_len, "…").otherwise("")))
        return F.when(F.size(parts) == 0, F.left(text, F.lit(max_len))).otherwise(cut)

    return let(squeeze(text), lambda t: let(_pieces(t), lambda p: of(t, p)))


def by_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The sentences of the rules whose pattern is found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(x)) for p, x in rules]))


def exam_points(text: Column, rules: Sequence[tuple[str, str]] = lx.EXAM_POINTS) -> Column:
    return by_rules(text, rules)


def exam_pitfalls(text: Column, rules: Sequence[tuple[str, str]] = lx.EXAM_PITFALLS) -> Column:
    return by_rules(text, rules)


def exam_tips(text: Column, rules: Sequence[tuple[str, str]] = lx.EXAM_TIPS) -> Column:
    return by_rules(text, rules)


def _wide(pattern: str) -> str:
    return "(?U)" + pattern.replace(r"\s", SPACE)


def chapter_bullets(title: Column, text: Column, rules: Sequence[tuple] = lx.CHAPTER_BULLETS) -> Column:
    """Bullets of the topic rules over title and text; without any, the first five sentences."""
    both = F.concat(F.coalesce(title, F.lit("")), text)
    found = F.array_compact(
        F.array(*[F.when(both.rlike(p) & (text.rlike(_wide(q)) if q else F.lit(True)), F.lit(x)) for p, q, x in rules])
    )
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice(_pieces(text), 1, 5)))


def chapter_exam(title: Column, text: Column, rules: Sequence[tuple] = lx.CHAPTER_EXAM) -> list[Column]:
    """Exam points, question patterns, pitfalls and tips."""
    both = F.concat(F.coalesce(title, F.lit("")), text)
    return [by_rules(both, [(r[0], r[i]) for r in rules]) for i in range(1, 5)]


def sentence_type(s: Column, kinds: Sequence[tuple] = lx.SENTENCE_TYPES) -> Column:
    out = F.lit(lx.OTHER_TYPE)
    for name, words in reversed(kinds):
        out = F.when(contains_any(s, words), name).otherwise(out)
    return out


def focus_item(s: Column, words: Sequence[str] = lx.KEY_WORDS, key: Column | None = None) -> list[Column]:
    """``category, summary, importance, reason`` of a sentence, by key words; ``key``: whether it holds one, if known."""
    key = contains_any(s, words) if key is None else key
    both = lambda a, b: F.when(key, a).otherwise(b)
    return [
        both(lx.KEY, lx.NOT_KEY).alias("category"),
        both(F.left(s, F.lit(50)), F.lit("")).alias("summary"),
        both(lx.KEY_REASON, "").alias("importance"),
        both("", lx.NOT_KEY_REASON).alias("reason"),
    ]


def clock(ms: Column) -> Column:
    """``HH:MM:SS`` from one hour on, else ``MM:SS``."""
    s = F.floor(ms / 1000).cast("int")
    h, m, s = F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def minutes(ms: Column) -> Column:
    """``MM:SS`` with minutes running past 59."""
    return F.format_string("%02d:%02d", F.floor(ms / 60000).cast("int"), F.floor(ms % 60000 / 1000).cast("int"))


def title_topic(text: Column, topics: Sequence[str] = lx.TITLE_TOPICS) -> Column:
    """The leftmost topic, or null."""
    return F.nullif(F.regexp_extract(text, f"({any_of(topics)})", 1), F.lit(""))


def title_tail(text: Column, phrases: Sequence[str] = lx.CHAPTER_PHRASES) -> Column:
    """What follows the first phrase (of the list) that something follows, 20 characters at most."""

    def tail(w: str) -> Column:
        at = F.instr(text, w)
        rest = F.substr(text, at + len(w))
        return F.when(at > 0, F.nullif(F.left(strip(F.translate(rest, "，。！？、", " " * 5)), F.lit(20)), F.lit("")))

    return F.coalesce(*[tail(w) for w in phrases])


def json_array(text: Column) -> Column:
    """The JSON array in a model's answer as ``array<variant>``: without code fences, whole or from
    the first ``[`` to the last ``]``; null where there is none."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), "^```json", ""), "```$", ""))
    as_list = lambda x: F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")
    inner = lambda s: as_list(F.nullif(F.regexp_extract(s, r"(?s)\[.*\]", 0), F.lit("")))
    return let(bare, lambda s: F.coalesce(F.when(s.startswith("["), as_list(s)), inner(s)))
