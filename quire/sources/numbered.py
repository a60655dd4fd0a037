"""A stream of rows that are numbered as they are appended: its offset is the last number read.

The table is a folder of Parquet files to which files are added; numbers only grow from file to file. A reader knows from the
files' statistics how far the table goes, and reads stretches of numbers in parallel. Nothing is read twice and nothing is
passed over, also after a restart from a checkpoint, as that holds the number.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


class Stretch(InputPartition):
    """Numbers after ``lo``, up to ``hi``."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class NumberedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        self.path, self.number = options["path"], options.get("number", "id")
        self.after, self.most = int(options.get("after", -1)), int(options.get("most", 100_000))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        """The largest number of any file, by the statistics of its row groups; a file is looked at once."""
        for part in ds.dataset(self.path, format="parquet").get_fragments():
            if part.path not in self.seen:
                at = part.metadata.schema.to_arrow_schema().names.index(self.number)
                groups = (part.metadata.row_group(i).column(at).statistics for i in range(part.metadata.num_row_groups))
                self.seen[part.path] = max((g.max for g in groups if g is not None and g.has_min_max), default=-1)
        return {"id": max([self.after, *self.seen.values()])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(lo, min(lo + self.most, end["id"])) for lo in range(start["id"], end["id"], self.most)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        own = (ds.field(self.number) > partition.lo) & (ds.field(self.number) <= partition.hi)
        yield from ds.dataset(self.path, format="parquet").to_batches(columns=self.columns, filter=own)

    def commit(self, end: dict) -> None:
        pass


class NumberedRows(DataSource):
    """Options: path, columns (DDL), number (the column with the number), after (where to begin), most (numbers a task)."""

    @classmethod
    def name(cls) -> str:
        return "numbered"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema: StructType) -> NumberedReader:
        return NumberedReader(schema, self.options)


def stream(spark: SparkSession, path: str, columns: str, number: str = "id", after: int = -1, most: int = 100_000) -> DataFrame:
    """The rows of a folder as a stream, from those after number ``after`` on."""
    spark.dataSource.register(NumberedRows)
    options = {"path": path, "columns": columns, "number": number, "after": after, "most": most}
    return spark.readStream.format("numbered").options(**{k: str(v) for k, v in options.items()}).load()


def drained(write: Callable[[], DataStreamWriter], settled: Callable[[], bool], wait: float = 1.0, most: float = 300.0) -> int:
    """Runs a stream again and again until what it follows is settled and a run after that brought nothing: rows read in all.

    write gives the writer (with its checkpoint, by which each run goes on where the last ended); settled is asked before each
    run, so that rows written up to then are read. Stops after ``most`` seconds too.
    """
    total, began = 0, time.monotonic()
    while True:
        done = settled()
        query = write().trigger(availableNow=True).start()
        query.awaitTermination()
        rows = sum(p["numInputRows"] for p in query.recentProgress)
        total += rows
        if done and not rows or time.monotonic() - began > most:
            return total
        time.sleep(0 if rows else wait)
