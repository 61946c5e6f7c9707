"""The registered queries: each applies one operation to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Bound on the labelled rows that the classifier is fitted on.
LABELLED_ROWS = 20_000
#: Ids of a packed sequence, and bytes of text in a shard at most (a range request of a data loader).
SEQUENCE_IDS, SHARD_BYTES = 2048, 1 << 20


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules, trusted_ids

    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import new_folder
    from .warc import archive_of, read_warc, resolve, write_warc

    path = new_folder(spark, "warc")
    write_warc(archive_of(table(spark, sf_dir, "pages")), path)
    found = resolve(read_warc(spark, path, bodies=False))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op3_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .avi import decode, encode, feature
    from .common import materialize

    found = decode(materialize(encode(table(spark, sf_dir, "documents"))))
    return found.withColumn("feature", feature(found["clips"])).drop("clips")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import vocabulary

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE_IDS, end_id=0)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import token_shards
    from .tokens import vocabulary

    return token_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op9_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_with_slots

    return assign_with_slots(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, grade

    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", grade(labels["quality"], labels["toxic"]).alias("grade"))
    return classify(table(spark, sf_dir, "documents"), ratings, rated_rows=LABELLED_ROWS)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .product_codes import product_codes

    return product_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
