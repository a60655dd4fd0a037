"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings by keyword, with _ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
