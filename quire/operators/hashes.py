"""Photos and pages by their 64-bit hashes: all pairs within a radius, and which page a photo shows."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import kept

#: How many bits two photos of one page may differ in, and by how many the next page must be farther.
SAME, MARGIN = 14, 6
BITS = 64


def shares(radius: int, blocks: int) -> list[int]:
    """How many differing bits each block may have: of any pair within the radius one block at least keeps to its share."""
    most, over = divmod(radius + 1, blocks)
    return [most - 1 + (i < over) for i in range(blocks)]


def masks(bits: int, most: int) -> Column:
    """An array of all patterns of up to ``most`` of ``bits`` bits."""
    found = [sum(1 << i for i in some) for n in range(most + 1) for some in combinations(range(bits), n)]
    return F.from_json(F.lit(json.dumps(found)), "array<bigint>")


def within(photos: DataFrame, pages: DataFrame, radius: int, blocks: int = 4) -> DataFrame:
    """photo, page and distance of all pairs (key, h each) whose hashes differ in at most ``radius`` bits.

    Hashes are cut in blocks that share out the radius. A photo looks for all variants of each block within the block's share,
    so it meets only pages that are that near in some block; the first such block counts, which leaves no pair twice.
    """
    width, share = BITS // blocks, shares(radius, blocks)
    block = lambda h, i: F.shiftrightunsigned(h, i * width).bitwiseAND((1 << width) - 1)
    sought = []
    for i, most in enumerate(share):
        if most >= 0:
            own = photos.select(F.col("key").alias("photo"), F.col("h").alias("g"), F.lit(i).alias("i"), block("h", i).alias("own"))
            near = F.explode(F.transform(masks(width, most), lambda m: F.col("own").bitwiseXOR(m)))
            sought.append(own.withColumn("b", near).drop("own"))
    own = F.array(*(F.struct(F.lit(i).alias("i"), block("h", i).alias("b")) for i in range(blocks)))
    there = pages.select(F.col("key").alias("page"), "h", F.inline(own))
    # Rows are many times those that sizes are guessed from: neither side is sent whole through the driver.
    met = reduce(DataFrame.unionByName, sought).join(there.hint("merge"), ["i", "b"])
    far = lambda i: F.bit_count(block("g", i).bitwiseXOR(block("h", i)))
    earlier = [(F.col("i") <= i) | (far(i) > share[i]) for i in range(blocks) if share[i] >= 0]
    distance = F.bit_count(F.col("g").bitwiseXOR(F.col("h"))).cast("long")
    near = met.filter(reduce(Column.__and__, earlier)).withColumn("distance", distance).filter(F.col("distance") <= radius)
    return near.select("photo", "page", "distance")


def closest(photos: DataFrame, pages: DataFrame, same: int = SAME, margin: int = MARGIN, blocks: int = 4) -> DataFrame:
    """photo, page, distance: the page whose hash is at most ``same`` bits away, if no other is less than ``margin`` bits farther.

    Pages of one hash are one while photos look for them, as the two first of them are enough to tell. Only photos whose best
    page leaves room beyond ``same`` for another one look farther than that.
    """
    alike = pages.groupBy("h").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    known = photos.select("key", "h").distinct()

    def two(pairs: DataFrame) -> DataFrame:
        counted = pairs.join(alike.select(F.col("key").alias("page"), "n"), "page")
        w = Window.partitionBy("photo").orderBy("distance", "page")
        second = F.when(F.col("n") > 1, F.col("distance")).otherwise(F.lead("distance").over(w))
        placed = counted.withColumn("second", second).withColumn("r", F.row_number().over(w)).filter("r = 1")
        return placed.select("photo", "page", "distance", "second")

    found = kept(two(within(known, alike, same, blocks)))
    sure = F.col("second").isNotNull() | (F.col("distance") + margin - 1 <= same)
    rest = found.filter(~sure).join(known.select(F.col("key").alias("photo"), "h"), "photo").select(F.col("photo").alias("key"), "h")
    again = two(within(rest, alike, same + margin - 1, blocks))
    every = found.filter(sure).unionByName(again)
    return every.filter(F.col("second").isNull() | (F.col("second") - F.col("distance") >= margin)).drop("second")


def identified(photos: DataFrame, numbers: DataFrame, pages: DataFrame, same: int = SAME, margin: int = MARGIN) -> DataFrame:
    """photo, page, how and distance: which page each photo (key, h) shows; page and how are null where none is clear.

    First by folio: a number read on the photo (numbers: key, number, ever so many) that is a page's own, if the page's
    hash is near enough and, of several such pages, one is nearer by the margin. Else by the photo alone.
    """
    read = numbers.select(F.col("key").alias("photo"), F.col("number").alias("page")).distinct()
    held = read.join(photos.select(F.col("key").alias("photo"), F.col("h").alias("g")), "photo")
    held = held.join(pages.select(F.col("key").alias("page"), "h"), "page")
    held = held.withColumn("distance", F.bit_count(F.col("g").bitwiseXOR(F.col("h"))).cast("long")).filter(F.col("distance") <= same)
    hits = held.groupBy("photo").agg(F.array_sort(F.collect_list(F.struct("distance", "page"))).alias("hits"))
    first, second = F.get("hits", F.lit(0)), F.get("hits", F.lit(1))
    clear = second.isNull() | (second["distance"] - first["distance"] >= margin)
    folio = hits.filter(clear).select("photo", first["page"].alias("page"), F.lit("folio").alias("how"), first["distance"].alias("distance"))
    rest = photos.join(folio.select(F.col("photo").alias("key")), "key", "left_anti")
    seen = closest(rest, pages, same, margin).withColumn("how", F.lit("photo"))
    named = folio.unionByName(seen.select(*folio.columns))
    return photos.select(F.col("key").alias("photo")).join(named, "photo", "left").select("photo", "page", "how", "distance")
