"""Shared pieces: table access, the word pattern, and lineage cuts in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.coalesce(F.array_remove(F.split(text, GAP, -1), ""), F.array().cast("array<string>"))


def free_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores in front until no column has its name."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Without ``spark.checkpoint.dir`` a local session takes a temporary folder of its own; on a cluster
    there is no folder to guess, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_lecturelake_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext._lecturelake_shared = own
    return own


def new_folder(spark: SparkSession, name: str = "lecturelake") -> str:
    """A folder of its own in the shared folder, noted for ``clean_up``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    noted = getattr(spark.sparkContext, "_lecturelake_written", None)
    if noted is None:
        noted = spark.sparkContext._lecturelake_written = []
    noted.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> int:
    """Remove all tables and files that operations of this session have written to the shared folder.

    Results read them, so call it once these are written; gives the number of folders.
    """
    noted = getattr(spark.sparkContext, "_lecturelake_written", [])
    for path in noted:
        _remove(spark, path)
    n = len(noted)
    noted.clear()
    return n


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor, and unlike ``checkpoint()`` the
    plan runs once, not once to count and once to write.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``materialize``d frame that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _remove(df.sparkSession, path)
        df.sparkSession.sparkContext._lecturelake_written.remove(path)
        df._shared_path = None
