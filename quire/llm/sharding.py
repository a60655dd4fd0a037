"""Balanced shards by sampled splitters; DataFrame functions only.

1. Every row gets a key: the hash of its text, then of its doc_id, then its place in the input. Equal texts are
   neighbours in the order of keys. Keys, sizes and checksums are written once; no later step reads a text.
2. Keys are sampled with a chance in proportion to their load: the row's bytes plus the mean bytes of a row, so that
   neither bytes nor rows of a range go without a bound. A sample stands for its own load or for one step, whichever is
   more. The quantiles of the samples, at the starts of texts, are the splitters of ranges.
3. The load of every range is summed exactly. Overfull ranges are subdivided by splitters from their own samples. A
   group of equal texts with more than an eighth of a shard's load (it may hold a third of all rows) is cut where the
   splitter falls, any other only at its ends.
4. Ranges are summed again and dealt to shards, the largest first, each to the shard with the fewest bytes so far. So
   shards differ by no more bytes than one range or one document has, mostly by far fewer. Groups of equal texts
   are in one shard unless they were cut.
5. A row's slot is its place in its range, behind the ranges of its shard that come before.

What the driver holds are splitters and sums of ranges: ``per_shard`` a shard, or one for ``rows_a_range`` rows, if
those are more. That is at most some 25,000 for 5 * 10**10 rows, and one task sorts 32 sampled keys for each.

Defined results: a null text has no bytes, checksum 0 and size 1; rows without doc_id, repeated rows and equal texts
are rows like any others; fewer rows than shards leave shards empty; an empty table gives an empty result; extra columns
are not looked at (``with_shard`` keeps them all and names its column as free).
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import spare, stored

SHARDS, PER_SHARD, SAMPLES, ROWS_A_RANGE = 8, 128, 32, 2_000_000
#: A range is overfull beyond so many times the mean load; groups of a shard's load by WHOLE or less stay in one piece.
OVERFULL, WHOLE = 2, 8
LEAST = -(1 << 63)
SPLITTER = "struct<h:bigint,g:bigint,u:bigint>"


def body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def size_of() -> Column:
    """Bytes of the text in UTF-8, plus 1."""
    return (F.octet_length(body()) + 1).cast("long")


def key_of() -> Column:
    """Where a row stands: hash of its text, hash of its doc_id, its place in the input."""
    return F.struct(
        F.xxhash64(body()).alias("h"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("g"),
        F.monotonically_increasing_id().alias("u"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of each row."""
    crc = F.crc32(body().cast("binary")).alias("text_crc32")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), crc, key_of().alias("key"))


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of literal rows, made by the JVM alone."""
    packed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(packed))


def range_of(splitters: list[tuple[int, int, int]], key: Column) -> Column:
    """The number of splitters (in order) up to ``key``: a binary search, from the largest step down to 1."""
    rows = [{"h": h, "g": g, "u": u} for h, g, u in splitters]
    known = F.from_json(F.lit(json.dumps(rows)), f"array<{SPLITTER}>")
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    if not steps:
        return F.lit(0)

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(splitters)) & (F.get(known, at + by - 1) <= key), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def sampled(rows: DataFrame, mean: float, step: float) -> DataFrame:
    """key and load of sampled rows: each is drawn with chance load / step, by a hash of its key."""
    load = F.col("size") + F.lit(mean)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "key.h", "key.g", "key.u"), 11) / F.lit(float(1 << 53))
    return rows.filter(chance < load / F.lit(step)).select("key", F.greatest(load, F.lit(step)).alias("load"))


def quantiles(samples: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Up to ranges - 1 splitters that cut the samples into equal loads, each at the start of a text."""
    texts = samples.groupBy(F.col("key.h").alias("h")).agg(F.sum("load").alias("load"))
    before = F.sum("load").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("load").over(Window.partitionBy())
    cut = texts.select("h", F.floor(F.coalesce(before, F.lit(0.0)) / whole * ranges).alias("part"))
    found = cut.groupBy("part").agg(F.min("h").alias("h")).filter("part > 0").collect()
    return sorted((r["h"], LEAST, LEAST) for r in found)


def subdivided(samples: DataFrame, splitters: list, overfull: dict[int, int], whole: float) -> list[tuple[int, int, int]]:
    """The splitters and those that cut each overfull range into its number of parts, but no text of load ``whole`` or less."""
    spark = samples.sparkSession
    parts = frame(spark, [{"range": k, "parts": n} for k, n in overfull.items()], "range int, parts int")
    own = samples.withColumn("range", range_of(splitters, F.col("key"))).join(F.broadcast(parts), "range")
    ordered = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.sum("load").over(Window.partitionBy("range")) / F.col("parts")
    heavy = F.sum("load").over(Window.partitionBy("range", "key.h")) > whole
    start = F.struct(F.col("key.h").alias("h"), F.lit(LEAST).alias("g"), F.lit(LEAST).alias("u"))
    cut = own.select(
        "range",
        F.floor(F.coalesce(F.sum("load").over(ordered), F.lit(0.0)) / unit).alias("part"),
        F.when(heavy, F.col("key")).otherwise(start).alias("at"),
    )
    firsts = cut.groupBy("range", "part").agg(F.min("at").alias("at")).filter("part > 0").select("at.*")
    return sorted({*splitters, *((r["h"], r["g"], r["u"]) for r in firsts.collect())})


@dataclass
class Plan:
    """Splitters of ranges, and for each range its shard and the slots before it."""

    splitters: list[tuple[int, int, int]]
    ranges: list[dict]

    def table(self, spark: SparkSession) -> DataFrame:
        return frame(spark, self.ranges, "range int, shard int, start bigint")


def dealt(sums: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """(range, bytes, rows) dealt to shards, the largest first to the one with the fewest bytes; slots in range order."""
    loads, shard_of = [(0, s) for s in range(shards)], {}
    for k, size, _ in sorted(sums, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        shard_of[k] = shard
        heapq.heappush(loads, (load + size, shard))
    out, filled = [], [0] * shards
    for k, _, n in sorted(sums):
        out.append({"range": k, "shard": shard_of[k], "start": filled[shard_of[k]]})
        filled[shard_of[k]] += n
    return out


def planned(rows: DataFrame, shards: int, per_shard: int, rows_a_range: int = ROWS_A_RANGE) -> Plan:
    """The plan for rows (as ``keyed`` makes them; they are read five times)."""
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return Plan([], [])
    ranges = max(shards * per_shard, math.ceil(n / rows_a_range))
    mean, unit = total / n, 2 * total / ranges
    samples = stored(sampled(rows, mean, unit / SAMPLES), "samples")

    def sums(splitters: list) -> list[tuple[int, int, int]]:
        own = rows.select(range_of(splitters, F.col("key")).alias("range"), "size")
        return [tuple(r) for r in own.groupBy("range").agg(F.sum("size"), F.count("*")).collect()]

    splitters = quantiles(samples, ranges)
    found = sums(splitters)
    overfull = {k: math.ceil((s + c * mean) / unit) for k, s, c in found if s + c * mean > OVERFULL * unit}
    if overfull:
        splitters = subdivided(samples, splitters, overfull, 2 * total / shards / WHOLE)
        found = sums(splitters)
    return Plan(splitters, dealt(found, shards))


def shard_table(docs: DataFrame, shards: int = SHARDS, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law)."""
    rows = stored(keyed(docs), "keys")
    plan = planned(rows, shards, per_shard)
    placed = rows.withColumn("range", range_of(plan.splitters, F.col("key")))
    placed = placed.join(F.broadcast(plan.table(docs.sparkSession)), "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + place).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, plan: Plan, name: str = "shard") -> DataFrame:
    """docs with the number of each row's shard, as a last column; nothing is shuffled.

    Of rows that share doc_id and text and lie in a cut group, the place in the input decides: another order of the
    input may put them into another shard.
    """
    range_, shard = spare(docs, "range", name)
    ranges = plan.table(docs.sparkSession).select(F.col("range").alias(range_), F.col("shard").alias(shard))
    return docs.withColumn(range_, range_of(plan.splitters, key_of())).join(F.broadcast(ranges), range_).drop(range_)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, per_shard: int = PER_SHARD) -> None:
    """docs as Parquet under ``path``, a folder for each shard: shard=0, shard=1 and so on."""
    plan = planned(stored(keyed(docs), "keys"), shards, per_shard)
    out = with_shard(docs, plan)
    out.repartition(out.columns[-1], F.xxhash64(body()) % 16).write.partitionBy(out.columns[-1]).parquet(path)
