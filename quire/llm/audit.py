"""How filters interact when they are applied in different orders, by products of incidence matrices.

Each text is judged once by five filters; which ones it fails is a mask of five bits. All that an order of filters does to a
document follows from its mask, so parts of the table are histograms over 32 masks. Three of them are stacked for each
part (all documents, good ones, toxic ones) and multiplied by integer matrices with 32 rows, one a mask, and 600
columns, one for each step of each order: 1 where a document of the mask is kept, removed, redundant or a unique fail.

Failing E needs other rows: a text must be the same as one with a smaller doc_id. Rows are folded by digest, doc_id
and part before groups of equal texts meet, so that a group has a row for each part and label, however many copies.

Defined results: a null text is an empty text, a null lang the part ""; a row without doc_id has no labels, never fails
E and makes no other row fail; of rows that share text and the smallest doc_id none fails E; a doc_id with several rows of
labels is good if one has quality 1, toxic if one has toxic 1; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
MASKS = 1 << len(FILTERS)
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def failures(text: str) -> int:
    """The bits of A to D that a text fails; words end at ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < 200
    repeated = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text)
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return few | repeated << 1 | capitals << 2 | marked << 3


def judged(docs: DataFrame) -> DataFrame:
    """at (doc_id, or where it is null a number of the row), numbered, part, digest (of the text) and mask (A to D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            masks, digests = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                masks.append(failures(text))
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
            columns = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "numbered", "part", "digest", "mask"])

    text, part = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang"))
    own = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(own, F.monotonically_increasing_id()).alias("at"), own.isNotNull().alias("numbered"), part, text)
    return rows.mapInArrow(run, "at long, numbered boolean, part string, digest binary, mask int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), and how many documents, good and toxic ones have it."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("at"), F.lit(True).alias("numbered"))
    known = known.agg(flag("quality"), flag("toxic"))
    one = ["digest", "part", "mask", "quality", "toxic"]
    rows = judged(docs).join(known, ["at", "numbered"], "left").groupBy("at", "numbered", *one).agg(F.count("*").alias("n"))
    doc = F.when(F.col("numbered"), F.col("at"))
    folded = rows.groupBy(*one).agg(
        F.sum(F.when(~F.col("numbered"), F.col("n"))).alias("apart"),
        F.sum(F.when(F.col("numbered"), F.col("n"))).alias("n"),
        F.min(doc).alias("first"),
        F.min_by("n", doc).alias("at_first"),
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    folded = folded.withColumn("original", F.when(F.col("first") == least, F.col("at_first")).otherwise(0))
    masks = F.array(
        F.struct(F.col("mask").alias("mask"), (F.coalesce("apart", F.lit(0)) + F.col("original")).alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.coalesce("n", F.lit(0)) - F.col("original")).alias("n")),
    )
    both = folded.select("part", "quality", "toxic", F.inline(masks))
    own = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), own("quality"), own("toxic"))


def incidence() -> dict[str, np.ndarray]:
    """The matrices: what a step of an order does to a document of a mask."""
    mask = np.arange(MASKS)[:, None]
    bit = np.array([1 << FILTERS.index(order[s]) for order, s in STEPS])
    before = np.array([sum(1 << FILTERS.index(c) for c in order[:s]) for order, s in STEPS])
    fails, gone = mask & bit > 0, mask & before > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()}


def products(counts: np.ndarray) -> dict[str, np.ndarray]:
    """counts: histograms of parts, three rows each (all, good, toxic). What each step of each order counts, by part."""
    matrices = incidence()
    out = {k: counts[::3] @ m for k, m in matrices.items()}
    out["good_lost"], out["toxic_lost"] = counts[1::3] @ matrices["removed"], counts[2::3] @ matrices["removed"]
    letters = np.array([FILTERS.index(order[s]) for order, s in STEPS])
    own = np.stack([out["removed"][:, letters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    out["shapley"] = own[:, letters]
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: ``AUDIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = [o for o, _ in STEPS], [s + 1 for _, s in STEPS]
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                parts, *three = batch.slice(lo, 100).columns
                stacked = np.zeros((3 * len(parts), MASKS), dtype=np.int64)
                for k, column in enumerate(three):
                    stacked[k::3] = np.array(column.to_pylist(), dtype=np.int64)
                found = products(stacked)
                columns = [pa.array(np.repeat(parts.to_numpy(zero_copy_only=False), len(STEPS)), pa.string())]
                columns += [pa.array(orders * len(parts)), pa.array(steps * len(parts), pa.int32())]
                columns += [pa.array(found[c].ravel()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    cells = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)))
    parts = histograms(docs, labels).groupBy("part").agg(*(cells(c).alias(c) for c in ("n", "quality", "toxic")))
    return parts.mapInArrow(run, AUDIT)


AUDIT_SQL = r"""
WITH letters(f, i) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT filter_order, step, o[step] AS own, (1 << o[step]) AS bit,
    coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::BIGINT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
