"""Word lists and rules the text operators use by default.

Text functions take single lists as arguments; operators and jobs take a whole ``Lexicon``.

Fixed values: results depend on these words and on their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

#: Spoken fillers, removed when they stand alone, in this order.
FILLERS = ["然后", "就是", "那么", "那个", "这个", "对吧", "你知道", "我觉得", "其实", "好吧", "呃", "嗯", "啊", "嘛", "吧", "呢"]
#: Names of sounds that transcripts put into brackets.
SOUND_TAGS = ["音乐", "掌声", "笑声", "旁白", "杂音"]
#: Sounds of hesitation, removed in runs of two or more.
HESITATIONS = "呃嗯啊"
#: Characters dropped everywhere.
BULLETS = "·•"
#: Marks that end a sentence, and particles that make one a question.
TERMINATORS = "。！？.!?"
QUESTION_PARTICLES = "吗呢吧啊嘛"
#: Connectives that get a comma in front, in this order.
CONNECTIVES = ["所以", "因此", "但是", "不过", "然后", "接着", "首先", "其次", "最后", "总之", "此外"]

#: Phrases that open a chapter, in this order.
CHAPTER_PHRASES = [
    "接下来我们讲", "接下来讲", "接着我们讲", "下一部分是", "下一节是", "这一节我们讲",
    "本章内容", "首先我们", "其次我们", "然后我们", "最后我们", "总结一下", "小结",
]
#: Topics that name a chapter; at one place in a text the earlier of the list wins.
TITLE_TOPICS = ["单调性", "周期性", "连续", "极限", "原函数与导函数", "原函数", "导函数", "积分", "微分", "不等式", "函数性质"]

#: Exam rules of short summaries: pattern and sentence.
EXAM_POINTS = [
    ("导数|单调", "导数符号与单调性的对应关系"),
    ("原函数|导函数|奇偶", "原/导奇偶关系与原函数可加常数"),
    ("周期", "周期性质相互推出需同时条件"),
]
EXAM_PITFALLS = [("奇函数加常数", "奇函数加常数不再为奇；偶函数加常数仍为偶")]
EXAM_TIPS = [("导数", "先判定导数范围与符号，再下单调结论")]

#: Chapter rules: pattern over title and text, pattern over the text (or none), bullet.
CHAPTER_BULLETS = [
    ("单调性", r"导数大于0|d\s*f\s*>\s*0", "导数>0 ⇒ 函数单调增，导数<0 ⇒ 函数单调减"),
    ("单调性", "原函数|导函数", "原函数与导函数奇偶关系：原奇⇒导偶，原偶⇒导奇"),
    ("原函数|导函数", "常数|无数个|加上任意常数", "已知导函数，原函数可加常数形成无穷多解"),
    ("周期", None, "周期结论相互推出需满足同时条件，不可单边推出"),
]
#: Chapter rules for exams: pattern over title and text, then point, question, pitfall and tip.
CHAPTER_EXAM = [
    ("单调性", "导数符号与单调性的对应关系", "给定导数符号判断单调增减", '忽略导数符号，仅凭"单调"字样下结论', "先判定导数范围与符号，再下结论"),
    ("原函数|导函数", "原与导的奇偶关系与可加常数性质", "已知小f判断大F奇偶；已知大F判断小f奇偶", "奇函数加常数不再为奇；偶函数加常数仍为偶", "记忆：原奇⇒导偶，原偶⇒导奇；已知导函数，原函数可加常数"),
    ("周期", "周期性质的相互推出条件", "仅给一侧周期试图推出另一侧周期", "缺少同时条件仍做推出", "周期结论需两侧条件同时满足方可推出"),
]
#: Title of a chapter without one.
UNTITLED = "本章内容"

#: Kinds of sentence, in order of precedence; ``meta`` where none fits.
SENTENCE_TYPES = [
    ("definition", ["定义", "概念", "称为", "是指"]),
    ("example", ["例题", "例子", "例如", "举例", "比如"]),
    ("meta", ["总结", "提醒", "注意", "首先", "其次", "最后", "转场", "接着", "所以"]),
    ("minor_content", ["不考", "简单", "随便看看", "跳过", "略过"]),
    ("key_content", ["定理", "结论", "易错点", "重要", "考试会考", "必须记住"]),
]
OTHER_TYPE = "meta"
#: Words that make a sentence a key one, and the fixed texts of both kinds.
KEY_WORDS = ["定义", "定理", "性质", "公式", "证明", "概念", "结论", "注意", "重点", "考试"]
KEY, NOT_KEY, KEY_TYPE = "重点", "非重点", "key_content"
KEY_REASON, NOT_KEY_REASON = "涉及考试或核心概念", "举例/过渡/非考试范围"

#: Model requests.
TASK, OUTPUT_RULE = "请逐句分析这些教师讲课内容。", "严格输出 JSON 数组，每个元素对应输入句子序号，不得改变顺序。"
LINES_RULE = "请按每句输出一个对象，字段包含 text 与 type，只输出 JSON 数组。"
TUTOR = "你是一名专业的助教，回答要简洁、准确。"

#: File endings of media.
MEDIA_ENDINGS = ["mp4", "mkv", "mov", "avi", "flv"]


@dataclass(frozen=True)
class Lexicon:
    """The lists that operators work with; replace those of another language or subject."""

    fillers: Sequence[str] = tuple(FILLERS)
    sound_tags: Sequence[str] = tuple(SOUND_TAGS)
    hesitations: str = HESITATIONS
    question_particles: str = QUESTION_PARTICLES
    connectives: Sequence[str] = tuple(CONNECTIVES)
    chapter_phrases: Sequence[str] = tuple(CHAPTER_PHRASES)
    title_topics: Sequence[str] = tuple(TITLE_TOPICS)
    exam_points: Sequence[tuple[str, str]] = tuple(EXAM_POINTS)
    exam_pitfalls: Sequence[tuple[str, str]] = tuple(EXAM_PITFALLS)
    exam_tips: Sequence[tuple[str, str]] = tuple(EXAM_TIPS)
    chapter_bullets: Sequence[tuple] = tuple(CHAPTER_BULLETS)
    chapter_exam: Sequence[tuple] = tuple(CHAPTER_EXAM)
    sentence_types: Sequence[tuple] = tuple(SENTENCE_TYPES)
    key_words: Sequence[str] = tuple(KEY_WORDS)


DEFAULT = Lexicon()
