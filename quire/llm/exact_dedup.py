"""Exact deduplication through an extendible-hash index that lives in shared files.

A text's key is the XXH64 of its normalised text. The directory says which bucket a key lies in by the key's leading
bits. It doubles (one more bit) until no cell has more distinct keys than a bucket's capacity, without a greatest
depth; a bucket is the shallowest prefix that fits, as splitting only the overfull ones leaves it. Texts meet by key and
are told apart by their bytes, never by the key alone. What is left of each (its digest, row that stays and number of
rows) is routed by the directory: owner tasks, each with a range of buckets and keys, chain the texts that share a key as
links and write their range as one file of the shared folder, in order, so that the files' least and greatest buckets
tell where one is, and there are as many files as tasks, however many buckets. Every row then looks its text up in its
bucket. Only keys and digests are routed: where the directory is too large to be sent, no text is shuffled for that.

Defined results: a null text is an empty text; texts are equal when their bytes are equal after lower-casing A-Z;
of equal texts the row with the largest doc_id stays; rows without doc_id lose against any doc_id; a doc_id that
occurs twice with equal texts gives two rows of one group, both kept if it is the largest (``drop_copies`` leaves one
of them); an empty table gives an empty result; extra columns are not looked at. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.shared import ascii_lower, spare, stored, text_of

CAPACITY = 50_000
#: A directory of up to so many bits (65,536 cells) is broadcast, a larger one is joined by a shuffle.
BROADCAST_BITS = 16


def prefix(key: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory over distinct keys (column ``key``), and its bits: cell (a prefix of that many bits), bucket (its first
    cell) and local depth."""
    held, depth = keys.count(), 0
    while held > capacity:
        # Keys are hashes, so that the first step can take as many bits as even buckets need.
        depth = depth + 1 if depth else max(1, math.ceil(math.log2(held / capacity)))
        cells = keys.groupBy(prefix(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))
        held = cells.agg(F.max("n")).first()[0]
    if not depth:
        return keys.sparkSession.range(1).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth")), 0
    above = cells.select("n", "cell", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    full = stored(above.groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("bucket")).agg(F.sum("n").alias("held")), "levels")
    halves = full.filter(F.col("held") > capacity).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    buckets = full.filter(F.col("held") <= capacity).join(halves, ["depth", "bucket"])
    first, width = F.expr(f"shiftleft(bucket, {depth} - depth)"), F.expr(f"shiftleft(1L, {depth} - depth)")
    return buckets.select(F.explode(F.sequence(first, first + width - 1)).alias("cell"), first.alias("bucket"), "depth"), depth


def routed(rows: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """rows (with column key) and the bucket that the directory has for each."""
    cells = F.broadcast(cells) if bits <= BROADCAST_BITS else cells
    return rows.withColumn("cell", prefix(F.col("key"), bits)).join(cells.select("cell", "bucket"), "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index in the shared folder (bucket, key, link, sha, keep_id, group_size; files by ranges of buckets), its directory and bits.

    On the way to its key a task folds its own copies of a text into one, so that a group of copies, however large,
    sends one row a task.
    """
    keyed = text_of(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    cells, bits = directory(stored(keyed.select("key").distinct(), "keys"), capacity)
    cells = stored(cells, "directory")
    texts = keyed.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = texts.select("key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    owned = routed(texts, cells, bits).repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    # Rows look links up by their SHA-256: two different texts of one would be mistaken, so they end the job.
    link = F.when(F.lag("sha").over(chain).eqNullSafe(F.col("sha")), F.raise_error(F.lit("two texts share one SHA-256")).cast("int")).otherwise(F.row_number().over(chain))
    owned = owned.withColumn("link", link).select("bucket", "key", "link", "sha", "keep_id", "group_size")
    return stored(owned.sortWithinPartitions("bucket", "key", "link"), "index"), cells, bits


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index, cells, bits = build_index(docs, capacity)
    norm = ascii_lower(F.col("text"))
    rows = routed(text_of(docs).select("doc_id", F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("sha")), cells, bits)
    found = rows.join(index.select("bucket", "key", "sha", "keep_id", "group_size"), ["bucket", "key", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one row of each group of equal texts.

    Every row is judged by its own text, also where a doc_id has several; of rows that share doc_id and text any one
    stays, and of rows without doc_id one where no equal text has a doc_id.
    """
    doc, sha, rank = spare(docs, "doc", "sha", "rank")
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), sha: F.sha2(ascii_lower(text), 256)})
    # Repeated rows are cut to one in each task before they are shuffled.
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(doc, sha).orderBy(doc))).filter(F.col(rank) == 1)
    same = (F.col(doc) == F.coalesce(kept["kept_id"].cast("string"), F.lit("none"))) & (F.col(sha) == kept["kept_sha"])
    return rows.join(kept, same, "left_semi").select(*docs.columns)


EXACT_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
