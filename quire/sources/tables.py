"""Keyed writing without MERGE: every sink is a join of what is there with what comes, written to a new place."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def single(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that comes twice ends the job, as which of its rows is to stand is not known. Nulls are keys, too."""
    w = Window.partitionBy(*keys)
    wrong = F.raise_error(F.concat(F.lit("a key comes twice: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return rows.withColumn("__n", F.count("*").over(w)).filter(F.when(F.col("__n") > 1, wrong).otherwise(True)).drop("__n")


def kept(rows: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder: what is read twice is made once, and lost executors cost only their tasks."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target with rows added, in place of those with the same keys; incoming keys come once."""
    rows = single(rows, keys)
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))


def replace_groups(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target with all rows of the incoming groups replaced by what comes; groups that do not come stay."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*target.columns))


def replace_cascade(target: DataFrame, rows: DataFrame, children: list[tuple[DataFrame, DataFrame]], keys: list[str]) -> list[DataFrame]:
    """The target with the incoming groups replaced, and each table of children (what is there, what comes) with the children
    of these groups gone and those that come in their place; children of groups that do not come stay."""
    groups = rows.select(*keys).distinct()
    out = [target.join(groups, keys, "left_anti").unionByName(rows.select(*target.columns))]
    for own, new in children:
        out.append(own.join(groups, keys, "left_anti").unionByName(new.join(groups, keys, "left_semi").select(*own.columns)))
    return out


def write_groups(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Replaces the incoming partitions of a table of files in one commit; others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def retire_missing(target: DataFrame, rows: DataFrame, key: str, now: str) -> DataFrame:
    """Upsert that retires what no longer comes (retired_at) instead of deleting it; what comes again is not retired."""
    values = [c for c in target.columns if c not in (key, "retired_at")]
    t = target.select(key, *(F.col(c).alias(f"__t_{c}") for c in values), F.col("retired_at").alias("__retired"), F.lit(True).alias("__old"))
    n = rows.select(key, *(F.col(c).alias(f"__n_{c}") for c in values), F.lit(True).alias("__new"))
    both = t.join(n, key, "full")
    chosen = [F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(f"__t_{c}")).alias(c) for c in values]
    retired = F.when(F.col("__new"), F.lit(None)).otherwise(F.coalesce("__retired", F.lit(now).cast("timestamp")))
    return both.select(key, *chosen, retired.cast("timestamp").alias("retired_at"))


def clashes(rows: DataFrame, target: DataFrame, key: str, owner: str) -> DataFrame:
    """Incoming keys that belong to another owner already: an error for the caller."""
    return rows.join(target.select(key, F.col(owner).alias("__owner")), key).filter(~F.col(owner).eqNullSafe(F.col("__owner"))).select(key, owner, F.col("__owner").alias("taken_by"))


def first_ticks(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Ticks that may come again: the first time stands."""
    return events.groupBy(*keys).agg(F.min(at).alias(at))


def changed(rows: DataFrame, stored: DataFrame, keys: list[str], hash_column: str, force: bool = False) -> DataFrame:
    """Rows whose hash is new or differs from the stored one; all rows if forced."""
    if force:
        return rows
    old = stored.select(*keys, F.col(hash_column).alias("__hash"))
    return rows.join(old, keys, "left").filter(~F.col(hash_column).eqNullSafe(F.col("__hash"))).drop("__hash")


def to_do(wanted: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Resumable selection: wanted keys with what becomes of them: run (no output), redo (not valid) or skip."""
    state = F.when(F.lit(force), "run").when(F.col("valid").isNull(), "run").when(~F.col("valid"), "redo").otherwise("skip")
    return wanted.join(outputs.select(key, "valid"), key, "left").select(key, state.alias("action"))
