"""Pieces that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

#: A word: a run of anything but ASCII space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = spark.conf.get("rankfold.shared.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rankfold-")
    spark.conf.set("rankfold.shared.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that written() made and that no frame still to be computed reads."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            to = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; native."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(h: Column) -> Column:
    """A number strictly between 0 and 1 from a 64-bit hash."""
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
