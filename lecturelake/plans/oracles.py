"""DuckDB twins of the lecture queries.

The text patterns are written out for an engine without lookbehind and back-references: a comma
before a connective is inserted everywhere and taken out again after a mark.
"""

from __future__ import annotations

from .. import lexicon as lx
from .fixtures import MARKS, PHRASES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


SEGMENTS = f"""s0 AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS p FROM documents)),
s1 AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS n, trim(s) AS s
  FROM s0 WHERE trim(s) <> ''),
s2 AS (SELECT doc_id, n, trim(concat(list_extract({_list(PHRASES)}, (doc_id*31+n*17) % 16 + 1), ' ', s,
  list_extract({_list(MARKS)}, (doc_id*7+n*3) % 10 + 1))) AS src FROM s1),
s3 AS (SELECT doc_id, n, src, CAST(length(src)*40+200 AS BIGINT) AS dur,
  CASE WHEN (n*7+doc_id) % 11 = 0 THEN 12000 ELSE (n*13 % 5)*400 END AS gap FROM s2),
seg AS (SELECT concat('v', doc_id) AS video_id, concat(n//16, '_', n%16) AS segment_id, n,
  CAST(sum(dur+gap) OVER (PARTITION BY doc_id ORDER BY n) - dur AS BIGINT) AS start_ms,
  CAST(sum(dur+gap) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS end_ms, src FROM s3)"""

PARAGRAPHS = SEGMENTS + """,
par AS (SELECT video_id, n//4 AS paragraph_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  string_agg(src, ' ' ORDER BY n) AS text FROM seg GROUP BY ALL)"""


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def drop_noise(e: str) -> str:
    e = f"regexp_replace({squeeze(e)}, '[{lx.BULLETS}]+', '', 'g')"
    tags = "|".join(lx.SOUND_TAGS)
    e = f"regexp_replace(regexp_replace({e}, '\\[(?:{tags})\\]', '', 'g'), '\\((?:{tags})\\)', '', 'g')"
    e = f"regexp_replace({e}, '[{lx.HESITATIONS}]{{2,}}', '', 'g')"
    for w in lx.FILLERS:
        e = f"regexp_replace({e}, '(?:^|\\s){w}(?:$|\\s)', ' ', 'g')"
    return squeeze(e)


def nfkc(e: str) -> str:
    return f"translate({e}, '（）！？，', '()!?,')"


def autopunct(e: str) -> str:
    return (
        f"CASE WHEN {e} = '' OR regexp_matches({e}, '[{lx.TERMINATORS}]$') THEN {e} "
        f"WHEN regexp_matches({e}, '[{lx.QUESTION_PARTICLES}]$') THEN {e} || '？' ELSE {e} || '。' END"
    )


def sentences(e: str) -> str:
    m = lx.TERMINATORS
    parts = f"list_transform(regexp_extract_all({e}, '[^{m}]*[{m}]|[^{m}]+$'), lambda x: trim(x, e' \\n\\t\\r'))"
    return f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: {autopunct('x')})"


def full_width(e: str) -> str:
    return f"regexp_replace(regexp_replace(translate({e}, '?!,.', '？！，。'), '，{{2,}}', '，', 'g'), '。{{2,}}', '。', 'g')"


def student(e: str) -> str:
    e = full_width(e)
    for w in lx.CONNECTIVES:
        e = f"replace({e}, '{w}', chr(1) || '{w}')"
        for p in "，。！？":
            e = f"replace({e}, '{p}' || chr(1), '{p}')"
        e = f"replace({e}, chr(1), '，')"
    e = f"regexp_replace({e}, '\\s+', '', 'g')"
    for p in "，。！？":
        e = f"regexp_replace({e}, '{p}{{2,}}', '{p}', 'g')"
    return e


def clean_sentences(e: str) -> str:
    inner = drop_noise("translate(x, '？', '?')")
    own = f"list_transform({sentences(squeeze(e))}, lambda x: {inner})"
    return f"array_to_string(list_transform({own}, lambda x: {autopunct('x')}), '')"


def pieces(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '[。！？]\\s*'), lambda x: x <> '')"


def short(e: str, k: int) -> str:
    """Over a column name ``e``."""
    p = pieces(squeeze(e))
    key = f"CASE WHEN length({p}[1]) < 20 AND len({p}) > 1 THEN {p}[1] || '，' || {p}[2] ELSE {p}[1] END"
    return (
        f"CASE WHEN len({p}) = 0 THEN left({squeeze(e)}, {k}) "
        f"ELSE left({key}, {k}) || CASE WHEN length({key}) > {k} THEN '…' ELSE '' END END"
    )


def rules(e: str, pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({e}, '{p}') THEN {_q(x)} END" for p, x in pairs) + "], lambda x: x IS NOT NULL)"


def joined(e: str) -> str:
    return f"array_to_string({e}, '|')"


def has(e: str, words) -> str:
    return f"regexp_matches({e}, '{'|'.join(words)}')"


def clock(e: str) -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    s, m, h = f"({e})//1000%60", f"({e})//60000%60", f"({e})//3600000"
    return f"CASE WHEN {h} > 0 THEN {two(h)} || ':' ELSE '' END || {two(m)} || ':' || {two(s)}"


def minutes(e: str) -> str:
    return f"printf('%02d:%02d', CAST(({e})//60000 AS INTEGER), CAST(({e})%60000//1000 AS INTEGER))"


FILL = """,
norm AS (SELECT video_id, n, start_ms, end_ms, t, row_number() OVER (PARTITION BY video_id ORDER BY n) AS i
  FROM (SELECT *, {clean} AS t FROM seg) WHERE t <> ''),
fill AS (SELECT video_id, i, length(t) + 1 AS held, CAST(0 AS BIGINT) AS paragraph_id FROM norm WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, CASE WHEN f.held >= {least} THEN 0 ELSE f.held END + length(n.t) + 1,
    f.paragraph_id + CASE WHEN f.held >= {least} THEN 1 ELSE 0 END
  FROM fill f JOIN norm n ON n.video_id = f.video_id AND n.i = f.i + 1),
raw AS (SELECT f.video_id, f.paragraph_id, arg_min(start_ms, i) AS start_ms, arg_max(end_ms, i) AS end_ms,
  string_agg(t, ' ' ORDER BY i) || ' ' AS t FROM fill f JOIN norm n USING (video_id, i) GROUP BY ALL),
once AS (SELECT video_id, paragraph_id, start_ms, end_ms, {once} AS t FROM raw)"""


def merged(least: int, styled: bool) -> str:
    text = clean_sentences("t")
    out = "SELECT video_id, paragraph_id, start_ms, end_ms, " + (student("t") if styled else "t") + " AS text FROM twice"
    return (
        "WITH RECURSIVE " + SEGMENTS + FILL.format(clean=drop_noise(nfkc("src")), least=least, once=text)
        + f",\ntwice AS (SELECT video_id, paragraph_id, start_ms, end_ms, {text} AS t FROM once)", out,
    )


def chapter_ctes(table: str) -> str:
    tails = []
    for w in lx.CHAPTER_PHRASES:
        rest = f"substr(text, instr(text, '{w}') + {len(w)})"
        tails.append(f"CASE WHEN instr(text, '{w}') > 0 THEN nullif(left(trim(translate({rest}, '，。！？、', '     '), e' \\n\\t\\r'), 20), '') END")
    return f""",
sc AS (SELECT *, CAST(CASE WHEN lag(end_ms) OVER w IS NULL THEN NULL ELSE
    CASE WHEN start_ms - lag(end_ms) OVER w >= 10000 THEN 1 ELSE 0 END + CASE WHEN length(text) >= 100 THEN 1 ELSE 0 END
    + CASE WHEN {has('text', lx.CHAPTER_PHRASES)} THEN 1 ELSE 0 END END AS BIGINT) AS score,
    nullif(regexp_extract(text, '({"|".join(lx.TITLE_TOPICS)})', 1), '') AS topic, coalesce({", ".join(tails)}) AS tail
  FROM {table} WINDOW w AS (PARTITION BY video_id ORDER BY paragraph_id)),
num AS (SELECT *, CAST(1 + sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END)
    OVER (PARTITION BY video_id ORDER BY paragraph_id) AS BIGINT) AS chapter_id FROM sc),
ch AS (SELECT video_id, chapter_id, coalesce(arg_min(topic, paragraph_id) FILTER (topic IS NOT NULL),
    arg_min(tail, paragraph_id) FILTER (tail IS NOT NULL), 'Chapter ' || chapter_id) AS title,
    arg_min(start_ms, paragraph_id) AS start_ms, arg_max(end_ms, paragraph_id) AS end_ms, count(*) AS n_items,
    list(text ORDER BY paragraph_id) AS texts, string_agg(text, '。' ORDER BY paragraph_id) AS t
  FROM num GROUP BY video_id, chapter_id)"""


CHAPTERS = PARAGRAPHS + chapter_ctes("par")

MICRO = """,
m0 AS (SELECT video_id, n, start_ms, end_ms, src, first_value(start_ms) OVER w AS s, row_number() OVER w - 1 AS i
  FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY n)),
m1 AS (SELECT *, least(i + 1, i + min(greatest(0, (end_ms - s + 59999) // 60000 - 1) - i)
  OVER (PARTITION BY video_id ORDER BY i)) AS window_idx FROM m0),
m2 AS (SELECT video_id, CAST(window_idx AS BIGINT) AS window_idx, s, string_agg(src, '。' ORDER BY i) AS t FROM m1 GROUP BY video_id, window_idx, s
  UNION ALL SELECT video_id, CAST(0 AS BIGINT), s, '' FROM m1 WHERE i = 0 AND window_idx = 1)"""

MICRO_OUT = f"""m3 AS (SELECT video_id, window_idx, s + window_idx * 60000 AS start_ms, s + (window_idx + 1) * 60000 AS end_ms,
  {short('t', 60)} AS summary, {rules('t', lx.EXAM_POINTS)} AS exam_points, {rules('t', lx.EXAM_PITFALLS)} AS pitfalls,
  {rules('t', lx.EXAM_TIPS)} AS tips FROM m2)"""

GLOBAL = f"""g0 AS (SELECT video_id, coalesce(string_agg(t, '。' ORDER BY chapter_id), '') AS t FROM (
    SELECT video_id, chapter_id, array_to_string(list_filter(texts, lambda x: x <> ''), '。') AS t FROM ch) GROUP BY video_id),
g AS (SELECT video_id, {short('t', 360)} AS one_paragraph, {short('t', 100)} AS one_line, {rules('t', lx.EXAM_POINTS)} AS exam_points,
  {rules('t', lx.EXAM_PITFALLS)} AS pitfalls, {rules('t', lx.EXAM_TIPS)} AS tips FROM g0)"""

CHAPTER_SUMS = f"cs AS (SELECT video_id, chapter_id, title, {short('t', 80)} AS one_line, {short('t', 240)} AS one_paragraph FROM ch)"


def collapse(k: int) -> str:
    return f"""co AS (SELECT video_id, chapter_id, coalesce(string_agg(s, '。' ORDER BY p) FILTER (before < {k}), '') AS x FROM (
    SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY video_id, chapter_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT video_id, chapter_id, trim(unnest(texts), e' \\n\\t\\r') AS s, generate_subscripts(texts, 1) AS p FROM ch) WHERE s <> '') GROUP BY ALL),
cx AS (SELECT ch.video_id, ch.chapter_id, ch.title, coalesce(x, '') AS x, ch.title || coalesce(x, '') AS b FROM ch LEFT JOIN co USING (video_id, chapter_id))"""


_BULLETS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(b, '{p}')" + (f" AND regexp_matches(x, '{q}')" if q else "") + f" THEN {_q(x)} END" for p, q, x in lx.CHAPTER_BULLETS
) + "], lambda z: z IS NOT NULL)"
RULES = f"""{collapse(3000)},
rl AS (SELECT video_id, chapter_id, title, CASE WHEN title <> '' THEN title ELSE '{lx.UNTITLED}' END AS summary_title,
  CASE WHEN len({_BULLETS}) > 0 THEN {_BULLETS} ELSE {pieces('x')}[1:5] END AS bullets,
  {", ".join(rules('b', [(r[0], r[i]) for r in lx.CHAPTER_EXAM]) + ' AS ' + n for i, n in enumerate(("exam_points", "question_patterns", "pitfalls", "tips"), 1))}
  FROM cx)"""

_TYPE = "CASE " + " ".join(f"WHEN {has('sentence', w)} THEN '{t}'" for t, w in lx.SENTENCE_TYPES) + f" ELSE '{lx.OTHER_TYPE}' END"
_KEY = has("sentence", lx.KEY_WORDS)
ITEMS = PARAGRAPHS + f""",
st AS (SELECT video_id, paragraph_id, start_ms, end_ms, {sentences('text')} AS ss FROM par),
it0 AS (SELECT video_id, paragraph_id, start_ms, end_ms, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS pos, unnest(ss) AS sentence FROM st),
it AS (SELECT *, CASE WHEN {_KEY} THEN '{lx.KEY}' ELSE '{lx.NOT_KEY}' END AS category, CASE WHEN {_KEY} THEN left(sentence, 50) ELSE '' END AS summary,
  CASE WHEN {_KEY} THEN '{lx.KEY_REASON}' ELSE '' END AS importance, CASE WHEN {_KEY} THEN '' ELSE '{lx.NOT_KEY_REASON}' END AS reason, {_TYPE} AS type FROM it0)"""

RESPONSES = """,
rs AS (SELECT video_id, paragraph_id, ss, paragraph_id % 5 AS p, len(ss) - CASE WHEN paragraph_id % 5 = 3 THEN 1 ELSE 0 END AS k,
  CAST(substr(video_id, 2) AS BIGINT) % 2 AS odd FROM st WHERE len(ss) > 0),
mo AS (SELECT video_id, paragraph_id, ss, p, k, p <> 0 AND NOT (p = 4 AND odd = 1) AS listed FROM rs)"""


def aligned(ok: str, fields: str) -> str:
    category, kind = fields.split(" / ")
    return f"""WITH {ITEMS}{RESPONSES}
SELECT video_id, paragraph_id, CAST(i AS BIGINT) AS pos, 's' || i AS sentence, CAST(NULL AS VARCHAR) AS category,
  CASE WHEN i % 2 = 0 THEN 'key_content' ELSE 'meta' END AS type, 'model' AS origin FROM mo, unnest(range(0, k)) t(i) WHERE {ok}
UNION ALL SELECT video_id, paragraph_id, pos, sentence, {category}, {kind}, 'rule' FROM it JOIN mo USING (video_id, paragraph_id) WHERE NOT ({ok})"""


def tenths(part: str, whole: str) -> str:
    q, r = f"(1000*{part}//greatest({whole},1))", f"(1000*{part}%greatest({whole},1))"
    return f"({q} + CASE WHEN {whole} = 0 THEN 0 WHEN 2*{r} > {whole} OR (2*{r} = {whole} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


_STATS = f"SELECT video_id, total, key_count, {{t}} / 10.0::DOUBLE AS key_pct, total - key_count AS non_key_count, (1000 - {{t}}) / 10.0::DOUBLE AS non_key_pct FROM".replace("{t}", tenths("key_count", "total"))
R60 = "=" * 60


def stats(items: str) -> str:
    counts = f"count(*) AS total, count(*) FILTER (category = '{lx.KEY}') AS key_count FROM {items}"
    return f"{_STATS} (SELECT video_id, {counts} GROUP BY video_id UNION ALL SELECT NULL, {counts})"


def block(*lines: str) -> str:
    """Lines (SQL strings or null) as one text, each followed by a line feed."""
    return " || ".join(f"coalesce({x} || chr(10), '')" for x in lines)


def bullets(heading: str, e: str) -> str:
    return f"CASE WHEN len({e}) > 0 THEN '{heading}' || chr(10) || array_to_string(list_transform({e}, lambda z: '   • ' || z), chr(10)) || chr(10) || chr(10) ELSE '' END"


def report(title: list[str], table: str, order: str, body: str) -> str:
    head = "".join(x + "\n" for x in title)
    return f"SELECT video_id, rtrim_one({_q(head)} || string_agg({body}, '' ORDER BY {order})) AS report FROM {table} GROUP BY video_id".replace("rtrim_one(", "regexp_replace(").replace(")) AS report", "), '\\n$', '') AS report")


MICRO_BLOCK = block(
    f"'【时间段 ' || printf('%02d', CAST(r AS INTEGER)) || '】 ' || {minutes('start_ms')} || ' - ' || {minutes('end_ms')}", "'📝 摘要：' || summary",
    "CASE WHEN len(exam_points) > 0 THEN '🎯 考试要点：' || array_to_string(exam_points, '、') END",
    "CASE WHEN len(pitfalls) > 0 THEN '⚠️ 易错点：' || array_to_string(pitfalls, '、') END",
    "CASE WHEN len(tips) > 0 THEN '💡 学习建议：' || array_to_string(tips, '、') END", _q("-" * 40), "''",
)
SUM_BLOCK = block("'【章节 ' || chapter_id || '】' || title", _q("-" * 40), "'📝 一句话总结：'", "'   ' || one_line", "''", "'📄 详细总结：'", "'   ' || one_paragraph", "''", _q(R60), "''")
CHAPTER_BLOCK = block(
    "'第 ' || chapter_id || ' 章：' || title", f"'时间：' || {clock('start_ms')} || ' - ' || {clock('end_ms')}", f"'时长：' || {clock('end_ms - start_ms')}", _q("-" * 50),
    *[f"CASE WHEN trim(coalesce(texts[{i}], ''), e' \\n\\t\\r') <> '' THEN '{i}. ' || trim(texts[{i}], e' \\n\\t\\r') END" for i in (1, 2, 3)],
    "CASE WHEN len(texts) > 3 THEN '... (共 ' || len(texts) || ' 个段落)' END", "''", _q(R60), "''",
)
EXAM_LISTS = [("📋 主要内容：", "bullets"), ("🎯 考试要点：", "exam_points"), ("📝 题型模式：", "question_patterns"), ("⚠️ 易错点：", "pitfalls"), ("💡 学习建议：", "tips")]


def rule_block(lists) -> str:
    head = block("'【章节 ' || chapter_id || '】' || title", _q("-" * 50))
    return " || ".join([head, *[bullets(h, c) for h, c in lists], block(_q(R60), "''")])


def _focus_report() -> str:
    key = block(f"'【重点 ' || printf('%02d', CAST(r AS INTEGER)) || '】 ' || {minutes('start_ms')}", "'📝 原句：' || sentence", "'💎 总结：' || summary", "'⭐ 重要性：' || importance", _q("-" * 40), "''")
    other = block(f"'【非重点 ' || printf('%02d', CAST(r AS INTEGER)) || '】 ' || {minutes('start_ms')}", "'📝 原句：' || sentence", "'📄 原因：' || reason", _q("-" * 30), "''")
    one = lambda e: f"({e})//10 || '.' || ({e})%10"
    t = tenths("key_count", "total")
    return f"""WITH {ITEMS},
nr AS (SELECT *, category = '{lx.KEY}' AS k, row_number() OVER (PARTITION BY video_id, category ORDER BY paragraph_id, pos) AS r FROM it),
p AS (SELECT video_id, count(*) AS total, count(*) FILTER (k) AS key_count, string_agg({key}, '' ORDER BY r) FILTER (k) AS ks,
  string_agg({other}, '' ORDER BY r) FILTER (NOT k AND r <= 10) AS os FROM nr GROUP BY video_id)
SELECT video_id, {_q(R60 + chr(10) + "🎯 LLM重点分析报告" + chr(10) + R60 + chr(10) * 2)} || {block("'📊 统计信息：'", "'   • 总句子数：' || total",
  f"'   • 重点句子：' || key_count || ' (' || {one(t)} || '%)'", f"'   • 非重点句子：' || (total - key_count) || ' (' || {one('1000-' + t)} || '%)'", "''")}
  || coalesce({_q("🔥 重点内容分析：" + chr(10) + "=" * 50 + chr(10) * 2)} || ks, '') || coalesce({_q("📝 非重点内容示例（前10个）：" + chr(10) + "=" * 50 + chr(10) * 2)} || os, '')
  || CASE WHEN total - key_count > 10 THEN '... 还有 ' || (total - key_count - 10) || ' 个非重点句子未显示' || chr(10) || chr(10) ELSE '' END
  || '✅ 分析完成！建议重点关注标为🔥的内容。' AS report FROM p"""


def oracles() -> dict[str, str]:
    seg, par, chs, its = (f"WITH {x} " for x in (SEGMENTS, PARAGRAPHS, CHAPTERS, ITEMS))
    plain, plain_out = merged(200, False)
    styled, styled_out = merged(120, True)
    job, job_out = merged(200, True)
    job += f", pp AS ({job_out})"
    flat = lambda *names: ", ".join(f"{joined(n)} AS {n}" for n in names)
    global_text = (
        block("'📝 一句话总结：'", "'   ' || one_line", "''", "'📄 详细总结：'", "'   ' || one_paragraph", "''")
        + " || " + " || ".join(bullets(h, c) for h, c in (("🎯 考试要点：", "exam_points"), ("⚠️ 易错点：", "pitfalls"), ("💡 学习建议：", "tips")))
    )
    cut = lambda e: f"regexp_replace({e}, '\\n$', '')"
    heads = {k: _q(f"{R60}\n{t}\n{R60}\n\n") for k, t in (("micro", "📈 微段摘要"), ("chapters", "📚 章节摘要"), ("overall", "🌍 全局摘要"))}
    lines = "list_transform(ss, lambda x, i: i || '. ' || x)"
    json = f"""'{{"任务描述": "{lx.TASK}", "句子列表": [' || array_to_string(list_transform(ss, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || '], "输出要求": "{lx.OUTPUT_RULE}"}}'"""
    return {
        "normalize": seg + f"SELECT video_id, n, {drop_noise(nfkc('src'))} AS clean FROM seg",
        "sentences": its + "SELECT video_id, paragraph_id, pos, sentence FROM it",
        "autopunct": seg + f"SELECT video_id, n, {autopunct('src')} AS closed, regexp_matches(src, '[{lx.TERMINATORS}]$') AS was_closed FROM seg",
        "full_width": seg + f"SELECT video_id, n, {full_width('src')} AS wide FROM seg",
        "student_style": seg + f"SELECT video_id, n, {student('src')} AS styled FROM seg",
        "finalize": seg + f", f AS (SELECT video_id, n, {clean_sentences(nfkc('src'))} AS plain FROM seg) SELECT video_id, n, plain, {student('plain')} AS student FROM f",
        "short_summary": par + f"SELECT video_id, paragraph_id, {short('text', 60)} AS s60, {short('text', 240)} AS s240 FROM par",
        "exam_rules": par + f"SELECT video_id, paragraph_id, {joined(rules('text', lx.EXAM_POINTS))} AS exam_points, {joined(rules('text', lx.EXAM_PITFALLS))} AS pitfalls, {joined(rules('text', lx.EXAM_TIPS))} AS tips FROM par",
        "clocks": seg + f"SELECT video_id, n, {clock('start_ms*7')} AS clock, {minutes('start_ms*7')} AS minutes FROM seg",
        "segment_order": seg + "SELECT video_id, segment_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS seq FROM seg",
        "merged_paragraphs": plain + "\n" + plain_out,
        "merged_paragraphs_student": styled + "\n" + styled_out,
        "break_scores": chs + "SELECT video_id, paragraph_id, score FROM sc",
        "chapter_table": chs + "SELECT video_id, chapter_id, title, start_ms, end_ms, n_items FROM ch",
        "chapter_titles": chs + "SELECT video_id, paragraph_id, topic, tail FROM sc",
        "chapter_sizes": chs + "SELECT video_id, chapter_id, n_items AS paragraphs, end_ms - start_ms AS duration_ms FROM ch",
        "micro_windows": seg[:-1] + MICRO + " SELECT video_id, n, CAST(window_idx AS BIGINT) AS window_idx FROM m1",
        "micro_windows_stepped": f"""WITH RECURSIVE {SEGMENTS},
b AS (SELECT video_id, n, start_ms, CASE WHEN n % 3 = 2 THEN greatest(start_ms, end_ms - 45000) ELSE end_ms + 30000 END AS e FROM seg),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, e) AS i FROM b),
w AS (SELECT video_id, i, n, CASE WHEN e > start_ms + 60000 THEN 1 ELSE 0 END AS k, start_ms AS s FROM o WHERE i = 1
  UNION ALL SELECT o.video_id, o.i, o.n, w.k + CASE WHEN o.e > w.s + (w.k + 1) * 60000 THEN 1 ELSE 0 END, w.s FROM w JOIN o ON o.video_id = w.video_id AND o.i = w.i + 1)
SELECT video_id, n, CAST(k AS BIGINT) AS window_idx FROM w""",
        "micro_summaries": seg[:-1] + MICRO + f", {MICRO_OUT} SELECT video_id, window_idx, start_ms, end_ms, summary, {flat('exam_points', 'pitfalls', 'tips')} FROM m3",
        "micro_summaries_plain": seg[:-1] + MICRO + f", {MICRO_OUT} SELECT video_id, window_idx, start_ms, end_ms, summary, '' AS exam_points, '' AS pitfalls, '' AS tips FROM m3",
        "global_summary_plain": f"{chs[:-1]}, {GLOBAL} SELECT video_id, one_paragraph, one_line, '' AS exam_points, '' AS pitfalls, '' AS tips FROM g",
        "chapter_summaries": f"{chs[:-1]}, {CHAPTER_SUMS} SELECT * FROM cs",
        "global_summary": f"{chs[:-1]}, {GLOBAL} SELECT video_id, one_paragraph, one_line, {flat('exam_points', 'pitfalls', 'tips')} FROM g",
        "collapsed_text": f"{chs[:-1]}, {collapse(600)} SELECT video_id, chapter_id, x AS text FROM cx",
        "chapter_rules_plain": f"{chs[:-1]}, {RULES} SELECT video_id, chapter_id, summary_title, {flat('bullets')} FROM rl",
        "chapter_rules_exam": f"{chs[:-1]}, {RULES} SELECT video_id, chapter_id, summary_title, {flat('bullets', 'exam_points', 'question_patterns', 'pitfalls', 'tips')} FROM rl",
        "sentence_types": its + "SELECT video_id, paragraph_id, pos, type FROM it",
        "focus_items": its + "SELECT video_id, paragraph_id, pos, sentence, category, summary, importance, reason FROM it",
        "focus_groups": its + "SELECT video_id, paragraph_id, start_ms, end_ms, string_agg(category || ':' || sentence, '|' ORDER BY pos) AS items FROM it GROUP BY ALL",
        "focus_stats": its + stats("it"),
        "focus_rank": its + f"SELECT video_id, paragraph_id, pos, k AS is_key, row_number() OVER (PARTITION BY video_id ORDER BY k DESC, paragraph_id, pos) AS rank FROM (SELECT *, category = '{lx.KEY}' OR type = '{lx.KEY_TYPE}' AS k FROM it)",
        "key_list": its + f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY paragraph_id, pos) AS number, start_ms, sentence FROM it WHERE category = '{lx.KEY}'",
        "non_key_top10": its + f"SELECT video_id, number, sentence, rest FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY paragraph_id, pos) AS number, greatest(count(*) OVER (PARTITION BY video_id) - 10, 0) AS rest FROM it WHERE category <> '{lx.KEY}') WHERE number <= 10",
        "model_requests": its + f"SELECT video_id, paragraph_id, 'm' AS model, 0.2::DOUBLE AS temperature, {json} AS prompt FROM st WHERE len(ss) > 0",
        "model_requests_lines": its + f"SELECT video_id, paragraph_id, 'm' AS model, 0.2::DOUBLE AS temperature, array_to_string({lines}, chr(10)) || chr(10) || '{lx.LINES_RULE}' AS prompt FROM st WHERE len(ss) > 0",
        "model_align": aligned("listed AND k = len(ss)", "category / CAST(NULL AS VARCHAR)"),
        "model_align_loose": aligned("listed", "CAST(NULL AS VARCHAR) / type"),
        "captions_at": seg[:-1] + """, k AS (SELECT video_id, unnest(generate_series(0, max(end_ms) + 5000, 7000)) AS t_ms FROM seg GROUP BY video_id)
SELECT k.video_id, k.t_ms, coalesce(arg_min(s.src, s.start_ms), '') AS text FROM k LEFT JOIN seg s ON s.video_id = k.video_id AND s.start_ms <= k.t_ms AND k.t_ms <= s.end_ms GROUP BY ALL""",
        "chat_messages": """SELECT conv_id, 2 + count(*) FILTER (ok) AS n, concat_ws('|', 'system:s', string_agg(trim(role) || ':' || text, '|' ORDER BY turn) FILTER (ok), 'user:q ' || conv_id) AS messages
FROM (SELECT *, trim(role) IN ('user', 'assistant') AND length(text) > 0 AS ok FROM conversations) GROUP BY conv_id""",
        "chunk_plan": seg + "SELECT video_id, chunk_idx, chunk_idx * 120 AS start_s FROM (SELECT video_id, unnest(generate_series(0, CAST(floor(max(end_ms) / 1000.0 / 120) AS BIGINT))) AS chunk_idx FROM seg GROUP BY video_id)",
        "rebase": seg[:-1] + """, a AS (SELECT *, start_ms // 120000 AS c, row_number() OVER (PARTITION BY video_id, start_ms // 120000 ORDER BY n) - 1 AS i FROM seg)
SELECT video_id, c || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS segment_id, CAST(trunc(((start_ms - c*120000) / 1000.0::DOUBLE) * 1000) AS BIGINT) + c*120000 AS start_ms,
  CAST(trunc(((end_ms - c*120000) / 1000.0::DOUBLE) * 1000) AS BIGINT) + c*120000 AS end_ms, src FROM a""",
        "chapter_report": chs + report(["=== 课程章节分割结果 ===", ""], "ch", "chapter_id", CHAPTER_BLOCK),
        "summary_report": f"""{chs[:-1]}{MICRO}, {MICRO_OUT}, {CHAPTER_SUMS}, {GLOBAL},
mn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY window_idx) AS r FROM m3),
a AS (SELECT video_id, {cut(heads['micro'] + f" || string_agg({MICRO_BLOCK}, '' ORDER BY r)")} AS micro FROM mn GROUP BY video_id),
b AS (SELECT video_id, {cut(heads['chapters'] + f" || string_agg({SUM_BLOCK}, '' ORDER BY chapter_id)")} AS chapters FROM cs GROUP BY video_id)
SELECT video_id, micro, chapters, {cut(heads['overall'] + ' || ' + global_text)} AS overall FROM a JOIN b USING (video_id) JOIN g USING (video_id)""",
        "rule_report": f"{chs[:-1]}, {RULES} " + report([R60, "📚 章节考试分析报告", R60, ""], "rl", "chapter_id", rule_block(EXAM_LISTS)),
        "rule_report_plain": f"{chs[:-1]}, {RULES} " + report([R60, "📚 章节内容摘要", R60, ""], "rl", "chapter_id", rule_block(EXAM_LISTS[:1])),
        "focus_report": _focus_report(),
        "notes_digest": f"""{chs[:-1]}, {CHAPTER_SUMS}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chapter_id) AS r FROM cs)
SELECT video_id, '《学习笔记》' || chr(10) || chr(10) || '一句话 KPI：' || chr(10) || '知识总览' || coalesce(string_agg(CASE WHEN title <> '' THEN chr(10) || title ELSE '' END
  || CASE WHEN one_line <> '' THEN chr(10) || one_line ELSE '' END, '' ORDER BY chapter_id) FILTER (r <= 5), '') AS notes FROM f GROUP BY video_id""",
        "jsonl_roundtrip": seg + "SELECT video_id, segment_id, start_ms, end_ms, src FROM seg",
        "chapters_roundtrip": chs + "SELECT video_id, chapter_id, title, n_items, array_to_string(texts, '|') AS texts FROM ch",
        "paragraphs_roundtrip": par + "SELECT video_id, paragraph_id, start_ms, end_ms, text FROM par",
        "report_roundtrip": chs + "SELECT video_id, line, count(*) AS n FROM (SELECT video_id, unnest(string_split(report, chr(10))) AS line FROM (" + report(["=== 课程章节分割结果 ===", ""], "ch", "chapter_id", CHAPTER_BLOCK) + ")) GROUP BY video_id, line",
        "media_list": f"WITH {SEGMENTS}, files AS (SELECT 'group-' || CAST(doc_id // 50 AS VARCHAR) AS folder, doc_id // 10 AS file, CAST(sum(strlen(src) + 1) AS BIGINT) AS bytes FROM s3 GROUP BY ALL) "
        "SELECT folder, file, count(*) OVER (PARTITION BY folder) AS n, row_number() OVER (ORDER BY folder, CAST(file AS VARCHAR)) AS place, bytes FROM files",
        "pipeline_chapters": job + chapter_ctes("pp") + " SELECT video_id, chapter_id, title, start_ms, end_ms, n_items FROM ch",
        "pipeline_global": job + chapter_ctes("pp") + f", {GLOBAL} SELECT video_id, one_line, {flat('exam_points')} FROM g",
        "focus_job": f"WITH {ITEMS}{RESPONSES}, al AS (SELECT * FROM (" + aligned("listed AND k = len(ss)", "category / CAST(NULL AS VARCHAR)").split(RESPONSES, 1)[1] + ")) " + stats("al"),
    }
