"""Checklists: Markdown read into items, what a reader sees of them, ids, links to pages and progress."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.operators import names

#: Headings of levels 2 to 4, the id at the end of an item, bold spans, and counted things in plain text.
HEADING = r"^(#{2,4})\s+(.+?)\s*$"
ITEM_ID = r"\s*<!--\s*q:([a-z0-9]+)\s*-->\s*$"
BOLD = r"\*\*([^*]+?)\*\*"
COLLECTIBLE = r"^([A-Z][\w' ]*?)\s?#\s?(\d+)\b"
#: Marks at the ends of names, the possessive that ends one, and what parts the names in a span.
NAME_ENDS, POSSESSIVE, LISTED = r"^[.,:;!?()]+|[.,:;!?()]+$", r"['’]s\b.*$", r",|\band\b"


def parsed(files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Rows of checklist files (file, body): file, ord (line number), type (heading, item, note, error), id, section, path,
    text, marker, bold, raw.

    markers are prefixes of items, of which the longest that fits is taken. A path is that of the last heading above;
    a heading of level n replaces what the path before had from place n - 1 on. An indented line right below an item
    is an error, as items have one line each.
    """
    each = files.select("file", F.posexplode(F.split("body", "\n")).alias("ord", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).filter("line <> ''")
    level, item = F.length(F.regexp_extract("line", HEADING, 1)), F.col("line").startswith("- ")
    each = each.withColumn("type", F.when(level > 0, "heading").when(item, "item").otherwise("note"))
    before = F.lag("type").over(Window.partitionBy("file").orderBy("ord"))
    indented = (F.col("type") == "note") & F.col("raw").rlike(r"^[ \t]") & before.eqNullSafe(F.lit("item"))
    each = each.withColumn("type", F.when(indented, "error").otherwise(F.col("type")))

    # The headings of a file are few: they are folded as one array, from each to the path that it opens.
    heads = each.filter("type = 'heading'").select("file", F.struct("ord", level.alias("level"), F.regexp_extract("line", HEADING, 2).alias("title")).alias("h"))
    start = F.array(F.struct(F.lit(-1).alias("ord"), F.array().cast("array<string>").alias("path")))
    opened = lambda done, h: F.struct(h["ord"].alias("ord"), F.concat(F.slice(F.element_at(done, -1)["path"], 1, h["level"] - 2), F.array(h["title"])).alias("path"))
    paths = heads.groupBy("file").agg(F.aggregate(F.array_sort(F.collect_list("h")), start, lambda done, h: F.array_append(done, opened(done, h))).alias("p"))
    paths = paths.select("file", F.explode("p").alias("p")).select("file", "p.ord", "p.path")
    above = F.last("path", ignorenulls=True).over(Window.partitionBy("file").orderBy("ord"))
    rows = each.join(paths, ["file", "ord"], "left").withColumn("path", F.coalesce(above, F.array().cast("array<string>")))

    body = F.regexp_replace("line", r"^-\s+", "")
    bare = F.when(F.col("type") == "item", F.regexp_replace(body, ITEM_ID, "")).when(F.col("type") == "heading", F.regexp_extract("line", HEADING, 2)).otherwise(F.col("line"))
    own_id = F.when(F.col("type") == "item", F.nullif(F.regexp_extract(body, ITEM_ID, 1), F.lit("")))
    rows = rows.withColumns({"id": own_id, "bare": bare})
    fits = [F.when((F.col("type") == "item") & F.startswith("bare", F.lit(m + " ")), F.lit(m)) for m in sorted(markers or [], key=len, reverse=True)]
    rows = rows.withColumn("marker", F.coalesce(*fits) if fits else F.lit(None).cast("string"))
    text = F.when(F.col("marker").isNotNull(), F.trim(F.substring("bare", F.length("marker") + 1, F.length("bare")))).otherwise(F.col("bare"))
    rows = rows.withColumn("text", text)
    return rows.select("file", "ord", "type", "id", F.try_element_at("path", F.lit(-1)).alias("section"), "path", "text", "marker", bold_names(F.col("text")).alias("bold"), "raw")


def clean_name(name: Column) -> Column:
    """A name without marks at its ends, cut at a possessive s."""
    bare = F.trim(F.regexp_replace(F.trim(name), NAME_ENDS, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, POSSESSIVE, ""), r"['’]+$", ""))


def bold_names(text: Column) -> Column:
    """The names in bold spans; a span may list several, parted by commas or and."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(BOLD), F.lit(1)), lambda s: F.split(s, LISTED)))
    return F.filter(F.transform(parts, clean_name), lambda x: x != "")


def bold_spans(text: Column) -> Column:
    """Each bold span as (whole, parts): the name as a whole, which is tried first, and the names that it may list."""
    spans = F.regexp_extract_all(text, F.lit(BOLD), F.lit(1))
    parts = lambda s: F.filter(F.transform(F.split(s, LISTED), clean_name), lambda x: x != "")
    each = F.transform(spans, lambda s: F.struct(clean_name(s).alias("whole"), parts(s).alias("parts")))
    return F.filter(each, lambda x: x["whole"] != "")


def slug(name: Column) -> Column:
    """A name for addresses: normalised, without accents, words joined by hyphens."""
    return F.regexp_replace(names.folded_name(name), r"\s+", "-")


def with_ids(files: DataFrame, prefix: str, markers: list[str] | None = None) -> DataFrame:
    """file, body, added and error: items without an id get the next free number; line ends stay, so that it can run again.

    A file in which an id stands twice, or a line is indented below an item, has an error and keeps its body.
    """
    rows = parsed(files, markers)
    number = F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1).try_cast("long")
    state = rows.groupBy("file").agg(F.coalesce(F.max(number), F.lit(0)).alias("most"), (F.count("id") > F.countDistinct("id")).alias("twice"), F.bool_or(F.col("type") == "error").alias("bad"))
    bare = rows.filter("type = 'item' and id is null").join(state, "file")
    nth = F.col("most") + F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    end = F.when(F.col("raw").endswith("\r"), "\r").otherwise("")
    given = bare.select("file", "ord", F.concat(F.regexp_replace("raw", r"\s+$", ""), F.lit(" <!-- q:"), F.lit(prefix), F.format_string("%03d", nth), F.lit(" -->"), end).alias("new"))
    lines = files.select("file", F.posexplode(F.split("body", "\n")).alias("ord", "raw")).join(given, ["file", "ord"], "left")
    joined = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("new", "raw").alias("line")))).alias("l"), F.count("new").alias("n"))
    done = files.select("file", "body").join(joined, "file").join(state, "file", "left")
    error = F.when(F.col("twice"), "an id stands twice").when(F.col("bad"), "an indented line stands below an item")
    body = F.when(error.isNull(), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(F.col("body"))
    return done.select("file", body.alias("body"), F.when(error.isNull(), F.col("n")).otherwise(0).alias("added"), error.alias("error"))


def plain(markdown: Column) -> Column:
    """Text without stars, white space as single spaces."""
    return F.trim(F.regexp_replace(F.replace(markdown, F.lit("*"), F.lit("")), r"\s+", " "))


def collectible(text: Column) -> Column:
    """The name and number of a counted thing at the start of an item: Golden Seed #4; null for other items."""
    t = plain(text)
    return F.when(t.rlike(COLLECTIBLE), F.struct(F.regexp_extract(t, COLLECTIBLE, 1).alias("name"), F.regexp_extract(t, COLLECTIBLE, 2).cast("int").alias("number")))


def with_overrides(items: DataFrame, pages: DataFrame, overrides: DataFrame, books: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items with the pages looked up for them, replaced where an override says so; and the errors.

    items: item; pages and overrides: item, pages (array of book and page). Errors: overrides of items that do not
    exist, pages in books that the list does not cover.
    """
    own = items.join(pages.select("item", F.col("pages").alias("found")), "item", "left").join(overrides.select("item", F.col("pages").alias("given")), "item", "left")
    rows = own.withColumn("pages", F.coalesce("given", "found", F.array().cast(pages.schema["pages"].dataType))).withColumn("overridden", F.col("given").isNotNull()).drop("found", "given")
    unknown = overrides.join(items, "item", "left_anti").select("item", F.lit("unknown item").alias("error"))
    foreign = rows.select("item", F.explode("pages").alias("p")).filter(~F.col("p.book").isin(*books)).select("item", F.concat(F.lit("foreign book "), "p.book").alias("error")).distinct()
    return rows, unknown.unionByName(foreign)


def rated(items: DataFrame, pages: DataFrame, npcs: DataFrame, mentions: DataFrame) -> DataFrame:
    """item and rating: how well the pages linked to an item fit the characters that it names.

    items: item; pages: item, place, at (book, page), the best first; npcs: item, norm (null if unknown), chapter (book,
    first, last or null); mentions: norm, at. In order: missing (no page), no-npc (nobody known), chapter (the first page
    lies in a chapter of one of them), chapter+ (another page does), npc-page (the first page names one), check.
    """
    known = npcs.filter("norm is not null")
    placed = pages.withColumn("first", F.row_number().over(Window.partitionBy("item").orderBy("place", "at")) == 1)
    inside = (F.col("chapter.book") == F.col("at.book")) & F.col("at.page").between(F.col("chapter.first"), F.col("chapter.last"))
    both = placed.join(known.withColumnRenamed("item", "i"), F.col("item") == F.col("i")).withColumn("inside", F.coalesce(inside, F.lit(False)))
    met = both.filter("first").join(mentions.distinct(), ["norm", "at"], "left_semi").select("item").distinct().withColumn("met", F.lit(True))
    hits = both.groupBy("item").agg(F.bool_or(F.col("first") & F.col("inside")).alias("chapter"), F.bool_or(F.col("inside")).alias("later"))
    rows = items
    for side in (pages.select("item").distinct().withColumn("linked", F.lit(True)), known.select("item").distinct().withColumn("named", F.lit(True)), hits, met):
        rows = rows.join(side, "item", "left")
    rating = F.when(F.col("linked").isNull(), "missing").when(F.col("named").isNull(), "no-npc").when(F.col("chapter"), "chapter").when(F.col("later"), "chapter+").when(F.col("met"), "npc-page").otherwise("check")
    return rows.select("item", rating.alias("rating"))


def visible(items: DataFrame, hide_done: bool = False, words: str = "", npc: str | None = None, chain: int | None = None) -> DataFrame:
    """What a reader sees: filters that are set hold together; words are looked for without case and stars."""
    if hide_done:
        items = items.filter(~F.coalesce("done", F.lit(False)))
    if words:
        items = items.filter(F.contains(F.lower(F.replace("text", F.lit("*"), F.lit(""))), F.lit(words.lower())))
    if npc is not None:
        items = items.filter(F.array_contains("npcs", npc))
    if chain is not None:
        items = items.filter(F.col("chain") == chain)
    return items


def chain_labels(chains: DataFrame, npcs: DataFrame) -> DataFrame:
    """chain, label: the names that more than half of a chain's items have, else its most frequent one."""
    size = chains.groupBy("chain").agg(F.count("*").alias("size"))
    n = chains.join(npcs, "item").groupBy("chain", "npc").agg(F.countDistinct("item").alias("n")).join(size, "chain")
    top = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "npc")))
    major = F.array_sort(F.collect_list(F.when(F.col("n") * 2 > F.col("size"), F.struct((-F.col("n")).alias("less"), "npc"))))
    named = n.groupBy("chain").agg(top.alias("top"), major.alias("major"))
    return named.select("chain", F.when(F.size("major") > 0, F.array_join(F.transform("major", lambda x: x["npc"]), " & ")).otherwise(F.col("top")[0]["npc"]).alias("label"))


def content_hash(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
