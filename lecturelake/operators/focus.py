"""Sentences of paragraphs: key or not, their kind, model requests and answers, statistics, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.scans import by_number, numbered

FIELDS = ["category", "summary", "importance", "reason", "type"]


def sentence_table(paragraphs: DataFrame, words: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """One row per sentence: ``pos`` from 0 and ``sentence``."""
    keys = ["video_id", "paragraph_id", "start_ms", "end_ms"]
    return paragraphs.select(*keys, F.posexplode(tx.sentences(F.col("text"), words.question_particles)).alias("_p", "sentence")).select(*keys, F.col("_p").cast("long").alias("pos"), "sentence")


def by_rule(sentence: Column, kind: str, words: lx.Lexicon = lx.DEFAULT, key: Column | None = None) -> list[Column]:
    """The fields of a sentence by key words (``category``), by kind of sentence (``type``), or both."""
    none = F.lit(None).cast("string")
    by_words = tx.focus_item(sentence, words.key_words, key) if kind != "type" else [none.alias(c) for c in FIELDS[:4]]
    return [*by_words, (tx.sentence_type(sentence, words.sentence_types) if kind != "category" else none).alias("type")]


def focus_items(paragraphs: DataFrame, kind: str = "category", words: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Every sentence with its fields by rule."""
    return sentence_table(paragraphs, words).select("*", *by_rule(F.col("sentence"), kind, words))


def group_items(items: DataFrame) -> DataFrame:
    """Sentences back into one row per paragraph, as ``items`` in order."""
    keys = ["video_id", "paragraph_id", "start_ms", "end_ms"]
    own = F.array_sort(F.collect_list(F.struct("pos", "sentence", *FIELDS)))
    return items.groupBy(*keys).agg(own.alias("items"))


def _json(s: Column) -> Column:
    """A string as JSON."""
    text = F.to_json(F.array(s))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def model_requests(paragraphs: DataFrame, system: str = "", model: str = "model", form: str = "json", temperature: float = 0.2) -> DataFrame:
    """``video_id, paragraph_id, model, temperature, messages`` for each paragraph with a sentence.

    ``form``: ``json`` asks with an object of task, sentences and rule, ``lines`` with numbered lines.
    """
    s = tx.sentences(F.col("text"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(s, _json), ", "), F.lit("]"))
    as_json = F.concat(F.lit('{"任务描述": "' + lx.TASK + '", "句子列表": '), listed, F.lit(', "输出要求": "' + lx.OUTPUT_RULE + '"}'))
    lines = F.transform(s, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    as_lines = F.concat(F.array_join(lines, "\n"), F.lit("\n" + lx.LINES_RULE))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return paragraphs.where(F.size(s) > 0).select(
        "video_id", "paragraph_id", F.lit(model).alias("model"), F.lit(temperature).alias("temperature"),
        F.array(message("system", F.lit(system)), message("user", as_json if form == "json" else as_lines)).alias("messages"),
    )


def align_responses(paragraphs: DataFrame, responses: DataFrame, strict: bool = True, words: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Sentences with fields from stored model answers (``video_id, paragraph_id, content``).

    An answer counts if it is a list, and when ``strict`` only with as many elements as the paragraph
    has sentences; otherwise the rules speak.  ``origin`` is ``model`` or ``rule``.  Of several answers
    to a paragraph the first in text order that counts is used.
    """
    keys = ["video_id", "paragraph_id", "start_ms", "end_ms"]
    # Paragraphs without a sentence give no row by themselves: a filter would split every text twice.
    rows = paragraphs.select(*keys, tx.sentences(F.col("text"), words.question_particles).alias("_s"))
    # Of the answers to a paragraph only the first of each number of elements stays, however many there are.
    # Exploding parses an answer once: a filter on the number itself would parse it again.
    number = F.explode(F.array(F.size(tx.json_array(F.col("content")))))
    parsed = responses.select("video_id", "paragraph_id", "content", number.alias("_k")).where("_k >= 0")
    if strict:
        first = parsed.groupBy("video_id", "paragraph_id", "_k").agg(F.min("content").alias("_c")).groupBy("video_id", "paragraph_id")
        found = first.agg(F.map_from_entries(F.collect_list(F.struct("_k", "_c"))).alias("_by"))
        chosen = F.try_element_at("_by", F.size("_s"))
    else:
        found, chosen = parsed.groupBy("video_id", "paragraph_id").agg(F.min("content").alias("_by")), F.col("_by")
    rows = rows.join(found, ["video_id", "paragraph_id"], "left").select(*keys, "_s", tx.json_array(chosen).alias("_a"))
    names = ["类别", "总结", "重要性说明", "非重点原因", "type"]

    def model(v: Column) -> Column:
        field = lambda n: F.try_variant_get(v, f'$["{n}"]', "string")
        own = [field(n).alias(c) for n, c in zip(names, FIELDS, strict=True)]
        return F.struct(F.coalesce(field("句子"), field("text")).alias("sentence"), *own, F.lit("model").alias("origin"))

    def rule(s: Column) -> Column:
        fields = lambda key: F.struct(s.alias("sentence"), *by_rule(s, "category" if strict else "type", words, key), F.lit("rule").alias("origin"))
        return tx.let(tx.contains_any(s, words.key_words), fields) if strict else fields(None)

    answered = F.col("_a").isNotNull() & (F.size("_s") > 0)
    items = F.when(answered, F.transform("_a", model)).otherwise(F.transform("_s", rule))
    rows = rows.select(*keys, F.posexplode(items).alias("_p", "_i"))
    return rows.select(*keys, F.col("_p").cast("long").alias("pos"), "_i.*")


def is_key() -> Column:
    return F.coalesce(F.col("category") == lx.KEY, F.lit(False))


def tenths(part: Column, whole: Column) -> Column:
    """Tenths of a percent, halves to even."""
    q, r = F.floor(1000 * part / F.greatest(whole, F.lit(1))), 1000 * part % F.greatest(whole, F.lit(1))
    up = (2 * r > whole) | ((2 * r == whole) & (q % 2 == 1))
    return (q + F.when(whole == 0, 0).when(up, 1).otherwise(0)).cast("long")


def focus_stats(items: DataFrame) -> DataFrame:
    """Counts and percentages of key sentences per lecture, and over all (``video_id`` null)."""
    per = items.rollup("video_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(is_key()).alias("key_count"), F.grouping("video_id").alias("_all"))
    per = per.where("_all = 1 or video_id is not null").withColumn("_t", tenths(F.col("key_count"), F.col("total")))
    return per.select(
        "video_id", "total", "key_count", (F.col("_t") / 10).alias("key_pct"),
        (F.col("total") - F.col("key_count")).alias("non_key_count"), ((1000 - F.col("_t")) / 10).alias("non_key_pct"),
    )


def focus_rank(items: DataFrame) -> DataFrame:
    """``rank`` within a lecture: key sentences first, otherwise in order."""
    key = is_key() | F.coalesce(F.col("type") == lx.KEY_TYPE, F.lit(False))
    rows = items.withColumn("is_key", key)
    block = F.when(F.col("is_key"), 0).otherwise(1 << 50) + by_number()
    return numbered(rows, block, [F.col("is_key").desc(), "paragraph_id", "pos"], "rank", ["is_key", "paragraph_id", "pos"])


def key_list(items: DataFrame) -> DataFrame:
    """Key sentences, numbered within each lecture."""
    return numbered(items.where(is_key()), by_number(), ["paragraph_id", "pos"], "number", ["paragraph_id", "pos"])


def non_key_examples(items: DataFrame, first: int = 10) -> DataFrame:
    """The first other sentences of each lecture, numbered, and ``rest``: how many are left out."""
    rows = numbered(items.where(~is_key()), by_number(), ["paragraph_id", "pos"], "number", ["paragraph_id", "pos"], "rest")
    return rows.where(F.col("number") <= first).withColumn("rest", F.greatest(F.col("rest") - first, F.lit(0)))
