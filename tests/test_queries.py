"""Every lecture query against its DuckDB twin."""

import pytest

from lecturelake.plans.oracles import oracles
from lecturelake.plans.queries import queries

QUERIES, ORACLES = queries(), oracles()


def test_each_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck, agree):
    agree(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES.keys() <= __spark_entry__.queries().keys()


def test_media_list_holds_every_transcript_in_order(spark, sf_dir):
    from pyspark.sql import functions as F

    from lecturelake.plans import fixtures as fx

    lines = fx.segments(spark, sf_dir).select(F.substr("video_id", F.lit(2)).cast("long").alias("d"), F.octet_length("src").alias("n"))
    want = {r["file"]: r["bytes"] for r in lines.groupBy(F.expr("d div 10").alias("file")).agg(F.sum(F.col("n") + 1).alias("bytes")).collect()}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = QUERIES["media_list"](spark, sf_dir).orderBy("place").collect()
    finally:
        spark.conf.unset(key)
    assert {r["file"]: r["bytes"] for r in rows} == want
    assert [r["place"] for r in rows] == [*range(1, len(want) + 1)]
    assert [f"{r['folder']}/{r['file']}" for r in rows] == sorted(f"group-{f // 5}/{f}" for f in want)
