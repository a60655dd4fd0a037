"""Soft rules over pages, and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.sources.tables import kept

FIGURE = r"(?i)\[?fig(?:ure)?\.?\s*(\d+)"


def problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds problems: the names of the rules that hold, in their order."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()))
    return rows.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def page_rules(markdown: Column, figures: Column, entities: Column, quality: Column) -> dict[str, Column]:
    """Rules of a page document: figures, illegible marks, names and retakes that do not agree with each other."""
    refs = F.transform(F.regexp_extract_all(markdown, F.lit(FIGURE), F.lit(1)), lambda x: x.cast("int"))
    n = F.size(figures)
    marks = F.size(F.regexp_extract_all(markdown, F.lit(r"(\[illegible\])"), F.lit(1)))
    return {
        "figure reference beyond the figures": F.coalesce(F.array_max(refs), F.lit(0)) > n,
        "figure never referred to": F.size(F.array_distinct(F.filter(refs, lambda x: x <= n))) < n,
        "illegible count differs": quality["illegible_regions"] != marks,
        "name not in the text": F.exists(entities, lambda e: ~F.contains(markdown, e["name"])),
        "poor image without retake": quality["image_quality"].isin("poor", "unusable") & ~quality["retake_recommended"],
        "retake without reason": quality["retake_recommended"] & (F.coalesce(F.trim(quality["retake_reason"]), F.lit("")) == ""),
    }


def unverified(uses: DataFrame, known: DataFrame) -> DataFrame:
    """name, uses and place of the names that are not known, the most used first, of equals by name.

    Names are numbered within those of equally many uses; how many names come before is summed over the numbers of uses.
    """
    n = uses.join(known.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.count("*").alias("uses"))
    by_uses = n.groupBy("uses").agg(F.count("*").alias("names"))  # some thousands of rows at most for any input
    ahead = F.sum("names").over(Window.orderBy(F.desc("uses")).rowsBetween(Window.unboundedPreceding, -1))
    before = by_uses.select("uses", F.coalesce(ahead, F.lit(0)).alias("before"))
    here = places_within(n, "uses", "name")
    return here.join(before, "uses").select("name", "uses", (F.col("before") + F.col("place")).cast("long").alias("place"))


def places_within(rows: DataFrame, group: str, by: str) -> DataFrame:
    """Adds place (from 1, by ``by``, without ties) within each group, however large: rows are dealt by ranges of group and
    ``by``; within a range they are numbered, and ranges know how many of their first group came before."""
    dealt = kept(rows.repartitionByRange(group, by).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(group, "__range", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    own = F.row_number().over(Window.partitionBy(group, "__range").orderBy(by))
    return dealt.join(sizes, [group, "__range"]).withColumn("place", F.col("__ahead") + own).drop("__range", "__ahead")


def shifted_figures(parts: DataFrame) -> DataFrame:
    """Parts of a page (page, part, figures: how many, markdown) with shift added and figure marks renumbered by it."""
    before = Window.partitionBy("page").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = parts.withColumn("shift", F.coalesce(F.sum("figures").over(before), F.lit(0)).cast("long"))
    pieces = F.split("markdown", r"(?=\[FIGURE \d)")
    number = lambda x: F.regexp_extract(x, r"^\[FIGURE (\d+)", 1)
    moved = F.transform(pieces, lambda x: F.when(number(x) != "", F.concat(F.lit("[FIGURE "), number(x).try_cast("long") + F.col("shift"), F.substring(x, F.length(number(x)) + 9, F.length(x)))).otherwise(x))
    return shifted.withColumn("markdown", F.when(F.col("shift") == 0, F.col("markdown")).otherwise(F.array_join(moved, "")))
