"""Helpers that the operators of this subpackage share: tables in the shared folder, doc folds, batches of text."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine (as in tests), one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of stored tables that a ``scratch`` block will remove.
_made: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables stored in this block at its end, when what was made of them is written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            discard(spark, path)
        del _made[before:]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written as a table of the shared folder and read back: cuts the lineage, survives lost executors.

    free: large shuffles before this step are not needed any more; Spark removes their files when the driver collects its
    garbage, which this asks for.
    """
    spark = df.sparkSession
    _made.append(f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}")
    path = f"{_made[-1]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) as long and string, and ``more``; whatever else the table has stays out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
