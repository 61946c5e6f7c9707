"""Quality rules: counted base measures, then a hashed n-gram log-likelihood ratio.

Every document is scored by the mean, over its hashed word unigrams and bigrams, of
``ln(p_trusted(bucket) / p_raw(bucket))``.  The raw multinomial counts every n-gram of every
document; the trusted one counts those of documents marked as trusted.  All of it is DataFrame
work: the bucket table has ``buckets`` rows whatever the corpus holds, so it is broadcast, and
each document's partial sums are combined in the task that exploded it.

Defined results: a null or empty text has no words, fails the base rule and scores 0; repeated
rows are scored each on their own; with no trusted document every ratio is 0 and only the base
rule decides; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, words

#: Characters that count as symbols, and those that separate words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counted measures, ``base_failed`` and the words, one row per input row.

    Two three-word windows count as equal when their 64-bit hashes are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id",
        F.xxhash64("text").alias("_hash"),
        words(F.col("text")).alias("_w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.array_remove(F.split(text, "\n"), "").alias("_lines"),
    )
    # Lines without a word count only where some line is found twice.
    twice = F.when(F.size(F.array_distinct("_lines")) < F.size("_lines"), F.col("_lines")).otherwise(F.array().cast("array<string>"))
    df = df.select(
        "doc_id", "_hash", "_w", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        F.filter(twice, lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("_lines"),
    )
    w, n = F.col("_w"), F.size("_w")
    starts = F.slice(w, 1, F.greatest(n - 2, F.lit(0)))
    windows = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.select(
        "doc_id", "_hash", "_w", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_s"),
    )
    # Only texts with a window found twice are looked at closely.
    twice = F.when(F.size(F.array_distinct("_s")) < F.size("_s"), F.col("_s")).otherwise(F.array().cast("array<bigint>"))
    placed = F.transform(twice, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.select("doc_id", "_hash", "_w", "word_chars", "n_symbols", "n_dup_lines", F.sort_array(placed).alias("_s"))
    s = F.col("_s")
    same = F.filter(
        s,
        lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
    )
    covered = F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.select(
        "doc_id", "_hash", "_w", F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.size(covered).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _pairs(w):
    """Each word with the next one (null after the last)."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"))


def _bucket(buckets: int, *parts):
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """``(bucket, ratio)``: the log ratio of the smoothed multinomials, ``buckets`` rows at most.

    ``trusted`` holds ids only, any number of them.  A task's ids are hashed, so texts are dealt out
    but not sorted; documents without an id can't be trusted and stay where they are.
    """
    mark = trusted.select(F.col("doc_id").alias("_t")).distinct().hint("shuffle_hash")
    named, nameless = (docs.where(x).select("doc_id", "text") for x in ("doc_id is not null", "doc_id is null"))
    marked = named.join(mark, F.col("doc_id") == F.col("_t"), "left")
    marked = marked.unionByName(nameless.withColumn("_t", F.lit(None).cast(mark.schema["_t"].dataType)))
    grams = marked.select(F.col("_t").isNotNull().cast("long").alias("t"), words(F.col("text")).alias("_w")).select(
        "t", F.explode(_pairs(F.col("_w"))).alias("p")
    )
    pair = grams.select(
        "t",
        F.explode(
            F.array(
                _bucket(buckets, F.col("p.a")),
                F.when(F.col("p.b").isNotNull(), _bucket(buckets, F.col("p.a"), F.col("p.b"))),
            )
        ).alias("bucket"),
    ).where(F.col("bucket").isNotNull())
    counts = pair.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    counts = materialize(counts)
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))
    return counts.select(
        "bucket",
        (
            F.log((F.col("target") + alpha) / F.lit(target + alpha * buckets))
            - F.log((F.col("raw") + alpha) / F.lit(raw + alpha * buckets))
        ).alias("ratio"),
    )


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = 1 << 16,
    alpha: float = 1.0,
    threshold: float = -0.1,
) -> DataFrame:
    """One row per document: base measures, ``llr`` (mean log ratio per n-gram) and ``kept``.

    ``kept`` is false where the base rule failed, else true when ``llr >= threshold``.
    """
    return judged(docs, trusted, buckets, alpha, threshold).drop("_hash")


def select(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, alpha: float = 1.0, threshold: float = -0.1) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    d, h, own = free_names(docs.columns, "_d", "_h", "_own")
    kept = judged(docs, trusted, buckets, alpha, threshold).where("kept").select(F.col("doc_id").alias(d), F.col("_hash").alias(h)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left_semi").drop(own)


def judged(docs: DataFrame, trusted: DataFrame, buckets: int, alpha: float, threshold: float) -> DataFrame:
    """The rows of ``quality_rules`` and a hash of the text, which names it beside its id."""
    ratios = F.broadcast(ratio_table(docs, trusted, buckets, alpha))
    one = ratios.select(F.col("bucket").alias("_b1"), F.col("ratio").alias("_r1"))
    two = ratios.select(F.col("bucket").alias("_b2"), F.col("ratio").alias("_r2"))
    keys = ["_row", "doc_id", "_hash", *MEASURES, "base_failed"]
    grams = (
        base_measures(docs)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(*keys, F.explode_outer(_pairs(F.col("_w"))).alias("p"))
        .select(
            *keys,
            F.when(F.col("p.a").isNotNull(), _bucket(buckets, F.col("p.a"))).alias("_u"),
            F.when(F.col("p.b").isNotNull(), _bucket(buckets, F.col("p.a"), F.col("p.b"))).alias("_v"),
        )
    )
    scored = (
        grams.join(one, F.col("_u") == F.col("_b1"), "left")
        .join(two, F.col("_v") == F.col("_b2"), "left")
        .groupBy(*keys)
        .agg(
            F.sum(F.coalesce("_r1", F.lit(0.0)) + F.coalesce("_r2", F.lit(0.0))).alias("_sum"),
            (F.count("_u") + F.count("_v")).alias("n_grams"),
        )
    )
    llr = F.when(F.col("n_grams") > 0, F.col("_sum") / F.col("n_grams")).otherwise(0.0)
    return scored.select("doc_id", "_hash", *MEASURES, "base_failed", llr.alias("llr")).select(
        "doc_id", *MEASURES, "base_failed",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr", "_hash",
    )
