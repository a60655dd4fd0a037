"""Logs and job events as streams: tails, changes, first ticks, limits and state, with Structured Streaming.

The forms over windows of event time (tumbling, sliding, session, with a watermark for late rows) go beyond what a
page service needs; they are here because its logs lend themselves to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.text import CITATION
from quire.operators.jobs import MOVES


def tail(spark: SparkSession, path: str, schema: str, after: int = -1, max_files: int = 1) -> DataFrame:
    """New rows of an append-only folder of Parquet files whose event_id is beyond ``after``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.filter(F.col("event_id") > after)


def timed(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """ts as a timestamp with time zone, which watermarks need, and rows later than ``late`` dropped."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def once(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Replays left out; keys are remembered as long as the watermark says."""
    return rows.dropDuplicatesWithinWatermark([key])


def counted(rows: DataFrame, size: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts by tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), by, "n")


def in_sessions(rows: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def over_limit(rows: DataFrame, limit: int, size: str = "15 minutes", slide: str = "1 minute", key: str = "user_id") -> DataFrame:
    """Keys with at least ``limit`` rows in a sliding window."""
    return counted(rows, size, slide, key).filter(F.col("n") >= limit)


def changes(rows: DataFrame, key: str = "job", value: str = "status") -> DataFrame:
    """A row of a key only where its value differs from the last one seen; state is one value a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seen = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for n, v in zip(seen["event_id"], seen[value]):
            if v != last:
                out.append((k[0], n, v))
                last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", value])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "event_id", value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, {value} string", "last string", "append", GroupStateTimeout.NoTimeout)


def job_states(rows: DataFrame, key: str = "job") -> DataFrame:
    """The status of each job after every batch of moves (event_id, move); moves that are not allowed are refused."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, refused = state.get if state.exists else ("uploaded", 0)
        for move in pd.concat(list(batches)).sort_values("event_id")["move"]:
            sources, target = MOVES.get(move, ((), None))
            if status in sources:
                status = target
            else:
                refused += 1
        state.update((status, refused))
        yield pd.DataFrame([(k[0], status, refused)], columns=[key, "status", "refused"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "event_id", "move").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, status string, refused long", "status string, refused long", "update", GroupStateTimeout.NoTimeout)


class Citations:
    """Splits a text that arrives in pieces into words and citation markers; an open bracket is held back until it
    closes or ``most`` characters have passed."""

    def __init__(self, labels: dict[str, str], most: int = 400):
        self.marker = re.compile(CITATION)
        self.labels, self.most, self.held = labels, most, ""

    def push(self, piece: str) -> list[tuple]:
        self.held += piece
        at = self.held.rfind("[")
        open_ = at >= 0 and "]" not in self.held[at:] and len(self.held) - at <= self.most
        ready, self.held = (self.held[:at], self.held[at:]) if open_ else (self.held, "")
        return self._read(ready)

    def flush(self) -> list[tuple]:
        ready, self.held = self.held, ""
        return self._read(ready)

    def _read(self, ready: str) -> list[tuple]:
        out, at = [], 0
        for m in self.marker.finditer(ready):
            label = "".join(m[1].lower().split()).replace(".", "")
            if label not in self.labels:
                continue
            if m.start() > at:
                out.append(("text", ready[at : m.start()]))
            out.append(("cite", self.labels[label], int(m[2]), m[3]))
            at = m.end()
        return [*out, ("text", ready[at:])] if at < len(ready) else out


def sse(event: str, data: str) -> str:
    """A server-sent event; data with line ends goes as several data lines."""
    return f"event: {event}\n" + "".join(f"data: {line}\n" for line in data.split("\n")) + "\n"
