"""Limits of logins and lives of sessions, as state with timers; and the same over whole tables.

Streams need spark.sql.streaming.stateStore.providerClass set to RocksDB's provider, which keeps such state. Timers follow the
watermark: state that can change no answer any more goes when its time has passed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import relational

#: Fixed values, in seconds: the window of failed logins, and how many a user and an address may have in it; how often a
#: session is renewed at most, and how long it lives from then.
WINDOW, PER_USER, PER_ADDRESS = 900, 5, 20
TOUCH, LIFE = 3600, 30 * 24 * 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_key(attempts: DataFrame) -> DataFrame:
    """Two rows for each login attempt (id, ts, user, address, ok): its user's and its address's, which has no success."""
    key = F.explode(F.array(
        F.struct(F.concat(F.lit("u:"), "user").alias("key"), F.lit(PER_USER).alias("most"), F.lit(True).alias("clears")),
        F.struct(F.concat(F.lit("a:"), F.col("address").cast("string")).alias("key"), F.lit(PER_ADDRESS).alias("most"), F.lit(False).alias("clears")),
    )).alias("k")
    return attempts.select("id", "ts", "ok", key).select("id", "ts", "ok", "k.*")


class Limit(StatefulProcessor):
    """Of each key the times of its latest failures, as many as its limit; an attempt is answered before it counts itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.fails = handle, handle.getListState("fails", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.fails.get()] if self.fails.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            now = r.ts.timestamp()
            full = len(held) >= r.most and held[-r.most] + WINDOW > now
            out.append((r.id, key[0], math.ceil(held[-r.most] + WINDOW - now) if full else 0))
            if not r.ok:
                held = [*held, now][-r.most :]
            elif r.clears:
                held = []
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.fails.put([(t,) for t in held])
            self.handle.registerTimer(int((held[-1] + WINDOW) * 1000))
        else:
            self.fails.clear()
        yield pd.DataFrame(out, columns=["id", "key", "wait"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.fails.clear()
        return iter([])

    def close(self) -> None:
        pass


def login_waits_stream(attempts: DataFrame, late: str = "1 minute") -> DataFrame:
    """id, key and wait (whole seconds until the next attempt is allowed, or 0) of each attempt, for its user and its address."""
    rows = by_key(attempts.withWatermark("ts", late)).groupBy("key")
    return rows.transformWithStateInPandas(Limit(), "id long, key string, wait long", "Append", "EventTime")


def login_waits(attempts: DataFrame) -> DataFrame:
    """The same over a whole table: the failures before each attempt, in its key's order since the last success that clears."""
    rows = by_key(attempts).withColumn("t", F.unix_micros("ts") / 1e6)
    order = Window.partitionBy("key").orderBy("t", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("era", F.coalesce(F.sum((F.col("ok") & F.col("clears")).cast("int")).over(before), F.lit(0)))
    failed = Window.partitionBy("key", "era", "ok").orderBy("t", "id")
    nth = F.when(F.col("most") == PER_USER, F.lag("t", PER_USER - 1).over(failed)).otherwise(F.lag("t", PER_ADDRESS - 1).over(failed))
    rows = rows.withColumn("nth", F.when(~F.col("ok"), nth))
    here = Window.partitionBy("key", "era").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.last("nth", ignorenulls=True).over(here) + WINDOW - F.col("t")
    return rows.withColumn("wait", F.when(left > 0, F.ceil(left)).otherwise(0).cast("long")).select("id", "key", "wait")


class Sessions(StatefulProcessor):
    """Of each session when it was last renewed; a timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.renewed = handle, handle.getValueState("renewed", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last = self.renewed.get()[0] if self.renewed.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            last, live, touched = used(last, r.ts.timestamp(), r.login)
            out.append((r.id, key[0], live, touched))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if last is None:
            self.renewed.clear()
        else:
            self.renewed.update((last,))
            self.handle.registerTimer(int((last + LIFE) * 1000))
        yield pd.DataFrame(out, columns=["id", "session", "live", "touched"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.renewed.clear()
        return iter([])

    def close(self) -> None:
        pass


def used(last: float | None, now: float, login: bool) -> tuple[float | None, bool, bool]:
    """The next state of a session that was last renewed at ``last``, whether a use finds it live, and whether it renews it."""
    if login:
        return now, True, True
    if last is None or now >= last + LIFE:
        return None, False, False
    touched = now - last > TOUCH
    return (now if touched else last), True, touched


def session_uses_stream(uses: DataFrame, late: str = "1 minute") -> DataFrame:
    """id, session, live and touched of each use (id, ts, session, login: whether it opens the session)."""
    rows = uses.withWatermark("ts", late).groupBy("session")
    return rows.transformWithStateInPandas(Sessions(), "id long, session string, live boolean, touched boolean", "Append", "EventTime")


def session_uses(uses: DataFrame) -> DataFrame:
    """The same over a whole table, each session's uses folded in their order."""
    rows = uses.select("id", "session", F.struct((F.unix_micros("ts") / 1e6).alias("t"), "id", "login").alias("use"))

    def marks(which: int) -> object:
        def step(last: float | None, use: dict) -> tuple[float | None, bool]:
            last, *said = used(last, use["t"], use["login"])
            return last, said[which]

        return step

    live = relational.folded(rows, ["session"], ["use"], "use", marks(0), None, "live")
    both = relational.folded(live, ["session"], ["use"], "use", marks(1), None, "touched")
    return both.select("id", "session", "live", "touched")
