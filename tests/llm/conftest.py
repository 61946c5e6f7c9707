import pytest

LONG = "long " * 60_000 + "end"

#: Null id, null and empty texts, text without words, a very long one, repeated rows, ties, null source.
EDGE = [
    (1, "a plain short text of words", "en", "s1", 27),
    (1, "a plain short text of words", "en", "s1", 27),
    (2, None, "en", "s1", None),
    (3, "", None, "s2", 0),
    (4, " \n\t ", "de", None, 4),
    (5, LONG, "en", "s2", len(LONG)),
    (None, "no id here", "en", "s3", 10),
    (6, "a plain short text of words", "en", None, 27),
    (7, "Ünï çödé 你好，世界 👍🏽 <|endoftext|> it's 3.14", "xx", "s3", 40),
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(edge):
    """The same rows with columns named like those the operations make."""
    from pyspark.sql import functions as F

    names = """size key kept fp shard bytes length taken score n_words media label carried piece bucket ratio raw target depth node band
        bands sketch n_shingles component_id u v p m x s1 s2 sums code error upper near block first_doc grade hash data sequence_id offset start
        _w _row _d _h _own _hash _grade _tail _g _n _s _t _p _b _part _parts _rank _from _to _bin _text _null _first _least _low _exact _linked
        __lake_hash __lake_grade __lake_tail __d __own""".split()
    return edge.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def rows():
    return rows_of
