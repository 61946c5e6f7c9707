import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-test-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if hasattr(x, "asDict"):
        x = tuple(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_plain, x)) + "]"
    if isinstance(x, float):
        return f"{x:.9g}"
    return "null" if x is None else str(x)


def same(df, relation):
    """Rows of a DataFrame and of a DuckDB relation agree, whatever their order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    mine = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in relation.fetchall())
    assert len(mine) == len(theirs)
    wrong = [p for p in zip(mine, theirs, strict=True) if p[0] != p[1]]
    assert not wrong, wrong[:2]


@pytest.fixture(scope="session")
def agree():
    return same
