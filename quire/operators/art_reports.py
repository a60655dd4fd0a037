"""Reports on art books and retakes: names to look up, artworks that lack one, boxes used wrongly, odd pages, lists to re-shoot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matches to check by eye, how many uses of a name and odd pages are shown, shares of a spread and numbers of names
#: that make a box suspect.
LOOSE = ("prefix", "close", "word_order")
SHOWN, ODD_SHOWN = 6, 20
LARGE, NAMES_OF_ONE, CROWDED = 0.6, 2, 3


def unverified_uses(names: DataFrame) -> DataFrame:
    """name, uses and shown of the names that no guide has: where the first six stand (and … if there are more).

    names: page, idx, name, source, confidence, verified; a use is written s0012#3 caption/high.
    """
    use = F.concat(F.lit("s"), F.lpad("page", 4, "0"), F.lit("#"), F.col("idx"), F.lit(" "), "source", F.lit("/"), "confidence")
    w = Window.partitionBy("name").orderBy("page", "idx", "source", "confidence")
    rows = names.filter(~F.col("verified")).withColumns({"use": use, "at": F.row_number().over(w)})
    n = rows.groupBy("name").agg(F.count("*").alias("uses"), F.array_sort(F.collect_list(F.when(F.col("at") <= SHOWN, F.struct("at", "use")))).alias("first"))
    more = F.when(F.col("uses") > SHOWN, " …").otherwise("")
    return n.select("name", "uses", F.concat(F.array_join(F.transform("first", lambda x: x["use"]), ", "), more).alias("shown"))


def to_look_at(names: DataFrame) -> DataFrame:
    """The names that a reader should check, with why: verified by a loose match, or seen (not read) below high confidence."""
    why = F.array_compact(F.array(
        F.when(F.col("match").isin(*LOOSE), F.lit("loose match")),
        F.when((F.col("source") == "visual") & (F.col("confidence") != "high"), F.lit("low confidence")),
    ))
    return names.withColumn("why", F.explode(why))


def unnamed(artworks: DataFrame, kinds: list[str]) -> DataFrame:
    """Artworks without a name, of kinds that usually have one. artworks: names (array) and kind."""
    return artworks.filter((F.coalesce(F.size("names"), F.lit(0)) <= 0) & F.col("kind").isin(*kinds))


def suspects(spreads: DataFrame, words: list[str]) -> DataFrame:
    """Spreads whose boxes may be wrong: their notes speak of it (words), one large box holds the only artwork though that has
    two names, or an artwork has three. spreads: notes, boxes (left, top, right, bottom as shares), artworks (with names)."""
    note = F.lower(F.coalesce("notes", F.lit("")))
    said = F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(note, w))
    large = F.exists("boxes", lambda b: (b[2] - b[0]) * (b[3] - b[1]) > LARGE)
    alone = (F.size("artworks") == 1) & (F.size(F.get("artworks", F.lit(0))["names"]) >= NAMES_OF_ONE)
    crowded = F.exists("artworks", lambda a: F.size(a["names"]) >= CROWDED)
    return spreads.filter(F.coalesce(said, F.lit(False)) | F.coalesce(large & alone, F.lit(False)) | F.coalesce(crowded, F.lit(False)))


def box_fault(used: Column, boxes: Column) -> Column:
    """Why the boxes that a label uses (an array of numbers) are not each of 1 to ``boxes`` once; null if they are."""
    listed = lambda x: F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(x)), ", "), F.lit("]"))
    beyond = F.filter(used, lambda b: b > boxes)
    twice = F.filter(used, lambda b: F.size(F.filter(used, lambda x: x == b)) > 1)
    every = F.when(boxes > 0, F.sequence(F.lit(1).cast("bigint"), boxes.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    missing = F.array_except(every, used.cast("array<bigint>"))
    return (
        F.when(F.size(beyond) > 0, F.concat(F.lit("box numbers "), listed(beyond), F.lit(" do not exist (there are "), boxes, F.lit(")")))
        .when(F.size(twice) > 0, F.concat(F.lit("boxes "), listed(twice), F.lit(" are used more than once")))
        .when(F.size(missing) > 0, F.concat(F.lit("boxes "), listed(missing), F.lit(" are neither in an artwork nor left out")))
    )


def odd_pages(pages: DataFrame, spreads: DataFrame) -> DataFrame:
    """book, usual and odd: the most frequent size of a book's pages (of equals the one that comes first), and the pages of other
    sizes from the first spread on, twenty at most. pages: book, page, width, height; spreads: book, first."""
    size = F.concat(F.round("width").cast("long"), F.lit("x"), F.round("height").cast("long"))
    own = pages.select("book", "page", size.alias("size"))
    n = own.groupBy("book", "size").agg(F.count("*").alias("n"), F.min("page").alias("at"))
    usual = n.groupBy("book").agg(F.min_by("size", F.struct((-F.col("n")).alias("less"), "at")).alias("usual"))
    odd = own.join(usual, "book").join(spreads, "book").filter((F.col("page") >= F.col("first")) & (F.col("size") != F.col("usual")))
    w = Window.partitionBy("book").orderBy("page")
    shown = odd.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= ODD_SHOWN)
    listed = shown.groupBy("book", "usual").agg(F.array_sort(F.collect_list("page")).alias("odd"))
    return listed.select("book", "usual", "odd")


def missing_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """book, page and problem of pages without a file, or with another one than the book's (pages, files: book, page, sha256)."""
    held = files.select("book", "page", F.col("sha256").alias("held"))
    both = pages.join(held, ["book", "page"], "left")
    problem = F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("sha256"), "differs")
    return both.select("book", "page", problem.alias("problem")).filter("problem is not null")


def by_issue(items: DataFrame) -> DataFrame:
    """book, page, issue, size and section of pages once for each of their issues: the largest sections first, of equals the one
    whose first page comes first. items: book, page, issues (array)."""
    listed = F.when(F.coalesce(F.size("issues"), F.lit(0)) > 0, F.col("issues")).otherwise(F.array(F.lit("(no issue listed)")))
    rows = items.select("book", "page", F.explode(listed).alias("issue"))
    n = rows.groupBy("issue").agg(F.count("*").alias("size"), F.min(F.struct("book", "page")).alias("first"))
    # As many rows as there are kinds of issues.
    placed = n.withColumn("section", F.row_number().over(Window.orderBy(F.desc("size"), "first", "issue")))
    return rows.join(F.broadcast(placed.select("issue", "size", "section")), "issue").select("book", "page", "issue", "size", "section")


def reshoot_lines(items: DataFrame, labels: DataFrame) -> DataFrame:
    """book, at and line: what is to be shot anew, a heading for each book, then its pages in order with their issues.

    items: book, page, status, issues; labels: book, label.
    """
    open_ = items.filter(F.col("status").isin("flagged", "still_flagged"))
    said = F.array_join(F.coalesce("issues", F.array().cast("array<string>")), ", ")
    line = F.concat(F.col("page").cast("string"), F.lit("  # "), F.when(said != "", said).otherwise("-"))
    w = Window.partitionBy("book").orderBy("page", line)
    rows = open_.select("book", F.row_number().over(w).alias("at"), line.alias("line"))
    title = F.concat(F.lit("# "), F.coalesce("label", "book"), F.lit(" ("), "book", F.lit(")"))
    heads = open_.select("book").distinct().join(labels, "book", "left").select("book", F.lit(0).alias("at"), title.alias("line"))
    return heads.unionByName(rows)
