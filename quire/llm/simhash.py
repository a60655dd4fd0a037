"""SimHash near-duplicate detection by meeting in the middle of Hamming balls.

Fingerprints link at 3 or fewer differing bits. Instead of comparing pairs, fingerprints emit the variants around
them and meet on equal variants. Let w be a variant at distance s from one fingerprint and t from another: with
s + t <= 3 they link. So among all that meet on w, those at distance 0 or 1 (inner) link with all at distance 2 or
less, and one inner fingerprint can stand as the centre that the others are linked with: one link a row, no pairs.

Every pair is met: at distance 1 or 2 both emit their inner variants; at distance 3 one of the two has an even
number of set bits and emits variants at distance 2, the other its inner ones. Of the three differing bits, two lie
in one half of the word, so flips of two bits within a half (992, not 2016) are enough.

Before that, a cheaper meeting prunes: with one of three blocks of bits blanked (the one that holds a differing
bit), a pair differs in at most 2 bits, so both emit their variants within 1 of the rest. Fingerprints that meet
nobody there have no partner within 3 bits. It loses no pair.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows share their
fingerprint and component; rows without doc_id get the component of their fingerprint; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.components import star_components
from quire.llm.shared import spare, stored, text_of

BITS, RADIUS, SEED = 64, 3, 42


def fingerprint(text: str, width: int = 3, step: int = 1 << 16) -> int:
    """Majority bits of the XXH64 of all shingles of ``width`` words, counted over ``step`` shingles at a time."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(n + 1) - 1
    starts, last = (ends - n), min(width, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + step], ends[lo : lo + step])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return text_of(docs).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(signed(v)).cast("long") for v in values))


#: Bits that each of the three blocks leaves when it is blanked.
BLOCKS = [((1 << 22) - 1), ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43]
FULL = (1 << 64) - 1
INNER = [0, *(1 << i for i in range(BITS))]
OUTER = [(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]


def candidates(nodes: DataFrame) -> DataFrame:
    """The fingerprints that meet another with a block blanked; column fp, distinct in and out.

    A key has at most 43 * 2**22 fingerprints, as they are distinct. The blanked block holds its own number, so that
    the keys of the three blankings stay apart.
    """
    met = None
    for k, block in enumerate(BLOCKS):
        rest = FULL & ~block
        flips = [0, *(1 << i for i in range(BITS) if rest >> i & 1)]
        mark = k << (block & -block).bit_length() - 1
        own = nodes.select("fp", F.explode(F.transform(longs([f | mark for f in flips]), lambda f: F.col("fp").bitwiseAND(F.lit(signed(rest))).bitwiseXOR(f))).alias("key"))
        met = own if met is None else met.unionByName(own)
    w = Window.partitionBy("key")
    return met.withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w)).filter("lo <> hi").select("fp").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that join all pairs of RADIUS or fewer differing bits."""
    some = stored(candidates(nodes), "candidates")
    near = lambda flips: F.explode(F.transform(longs(flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("w")
    inner = some.select("fp", F.lit(True).alias("inner"), near(INNER))
    outer = some.filter(F.bit_count("fp") % 2 == 0).select("fp", F.lit(False).alias("inner"), near(OUTER))
    centre = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("w"))
    met = inner.unionByName(outer).withColumn("b", centre).filter("b is not null and b <> fp")
    return met.select(F.col("fp").alias("a"), "b").distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (long) and component_id, the smallest doc_id reachable over links."""
    marks = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = star_components(stored(links(nodes.select("fp")), "links"))
    smallest = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    joined = roots.join(smallest, "root").select(F.col("node").alias("fp"), "least")
    every = nodes.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marks.join(stored(every, "components"), "fp", "left").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicates, with the columns of docs.

    Rows without doc_id stay, and rows that share a doc_id stay or go together.
    """
    own = spare(docs, "own")[0]
    kept = near_groups(docs).filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[own]), "left_semi")
