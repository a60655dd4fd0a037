"""Names met with a vocabulary in tiers: each tier is a join on a key of its own, the first that matches stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions import text


def matched(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """name, entity and match: exact, order (the same words), prefix (the longest entity of two words or more that the
    name starts with) or none."""
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    exact = vocabulary.select(F.col("entity").alias("name"), F.col("entity").alias("e1"))
    same = vocabulary.groupBy(bag("entity").alias("bag")).agg(F.min("entity").alias("e2"))
    starts = wanted.select("name", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("name", " ")) - 1, F.lit(2))), lambda n: F.array_join(F.slice(F.split("name", " "), 1, n), " "))).alias("entity"))
    prefix = starts.filter("name <> entity").join(vocabulary, "entity", "left_semi").groupBy("name").agg(F.max_by("entity", F.length("entity")).alias("e3"))
    joined = wanted.withColumn("bag", bag("name")).join(exact, "name", "left").join(same, "bag", "left").join(prefix, "name", "left")
    tier = F.when(F.col("e1").isNotNull(), "exact").when(F.col("e2").isNotNull(), "order").when(F.col("e3").isNotNull(), "prefix").otherwise("none")
    return joined.select("name", F.coalesce("e1", "e2", "e3").alias("entity"), tier.alias("match"))


def close_matches(wanted: DataFrame, vocabulary: DataFrame, least: float = 0.92, share: float = 0.4) -> DataFrame:
    """The one entity close enough to a name: candidates share trigrams, the ratio of matching blocks decides; a second
    close one makes the match unclear and drops it."""
    from quire.operators.retrieval import trigram_matches

    near = trigram_matches(wanted.select(F.lit(0).cast("long").alias("q"), F.col("name").alias("norm")), vocabulary.select(F.col("entity").alias("name_norm")), share)
    rated = near.withColumn("ratio", text.close_ratio(F.col("norm"), F.col("name_norm"))).filter(F.col("ratio") >= least)
    alone = rated.withColumn("n", F.count("*").over(Window.partitionBy("norm"))).filter("n = 1")
    return alone.select(F.col("norm").alias("name"), F.col("name_norm").alias("entity"), "ratio")


def resolved(wanted: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """The entity of the first tier (name, entity) that has the name, and the tier's number; tiers in order of trust."""
    joined = wanted
    for k, tier in enumerate(tiers):
        one = tier.groupBy("name").agg(F.min("entity").alias(f"e{k}"))
        joined = joined.join(one, "name", "left")
    cols = [F.col(f"e{k}") for k in range(len(tiers))]
    number = F.coalesce(*(F.when(c.isNotNull(), k) for k, c in enumerate(cols)))
    return joined.select("name", F.coalesce(*cols).alias("entity"), number.alias("tier"))


def text_mentions(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary words (word) in plain texts (id, text) that no capitalised word follows and that stand outside bold."""
    plain = F.regexp_replace("text", r"\*\*[^*]*\*\*", " ")
    words = F.regexp_extract_all(plain, F.lit(r"(\p{Lu}[\p{L}'’-]+)(?=[^\p{L}]*(?:\p{Ll}|$|[^\s\p{L}]))"), F.lit(1))
    found = texts.select("id", F.explode(F.array_distinct(words)).alias("word"))
    return found.join(vocabulary.select("word").distinct(), "word", "left_semi").select("id", "word")


def folded_name(name: Column) -> Column:
    """A normalised name without accents."""
    return text.folded(text.normalize_names(name))


def runs_of(words: Column, whole: bool = True) -> Column:
    """All runs of neighbouring words of an array, as strings; without the whole, if so asked."""
    n = F.size(words)
    at = lambda i: F.transform(F.sequence(F.lit(1), n - i), lambda k: F.array_join(F.slice(words, i + 1, k), " "))
    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))
    return found if whole else F.array_except(found, F.array(F.array_join(words, " ")))


def chapter_of(wanted: DataFrame, chapters: DataFrame, mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The chapter of each character (norm) that has one: norm, book, title, chapter (its normalised title), lo, hi.

    By alias (fold, title: a chapter's title for a folded name) first, which is final: an alias of no chapter gives none. Else
    the first of these that has chapters: the title is the name; the title holds it as whole words; the title's head, up to
    a comma or slash, is whole words of the name. Of several the chapter with most pages that mention the character
    (mentions: norm, book, page), then the first. Accents do not count.
    """
    own = chapters.select("book", "title", "lo", "hi", text.normalize_names("title").alias("chapter"), folded_name(F.col("title")).alias("f"))
    own = own.withColumn("head", folded_name(F.split("title", "[,/]")[0])).filter("f <> ''")
    names = wanted.select("norm").distinct().withColumn("fold", folded_name(F.col("norm"))).filter("fold <> ''")
    split = lambda c: F.split(c, " ")
    equal = names.join(own, F.col("fold") == F.col("f")).withColumn("tier", F.lit(1))
    inside = own.withColumn("key", F.explode(runs_of(split("f"), whole=False)))
    holds = names.join(inside, F.col("fold") == F.col("key")).drop("key").withColumn("tier", F.lit(2))
    parts = names.withColumn("key", F.explode(runs_of(split("fold"))))
    heads = parts.join(own.filter("head <> ''"), F.col("key") == F.col("head")).drop("key").withColumn("tier", F.lit(3))
    every = reduce(DataFrame.unionByName, [equal, holds, heads])
    if aliases is not None:
        known = aliases.select(F.col("fold"), folded_name(F.col("title")).alias("target"))
        named = names.join(known, "fold").join(own, F.col("target") == F.col("f")).drop("target").withColumn("tier", F.lit(0))
        every = every.join(known.select("fold"), "fold", "left_anti").unionByName(named)
    best = every.groupBy("norm").agg(F.min("tier").alias("tier"))
    every = every.join(best, ["norm", "tier"])
    seen = mentions.select("norm", "book", "page").distinct()
    here = every.join(seen, ["norm", "book"], "left")
    n = F.count_if(F.col("page").between(F.col("lo"), F.col("hi"))).alias("n")
    rated = here.groupBy("norm", "book", "title", "chapter", "lo", "hi").agg(n)
    first = Window.partitionBy("norm").orderBy(F.desc("n"), "lo", "book", "title")
    return rated.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "n")


def resolved_characters(wanted: DataFrame, npcs: DataFrame, chapters: DataFrame, mentions: DataFrame, aliases: DataFrame | None = None, chapter_aliases: DataFrame | None = None) -> DataFrame:
    """name, norm, entity, match and chapter (book, title, lo, hi) of names in a checklist; norm is null where nobody is found.

    npcs: norm, entity; aliases: fold, target (a name); chapter_aliases: fold, title. The match, in this order: alias or
    exact; accent (one character of that name without accents); chapter (the name's chapter is a character's); word (one
    character's name begins or ends with it); close (one name near enough); none. An alias that needs more than its exact
    name keeps that match.
    """
    names = wanted.select("name").distinct().withColumn("fold", folded_name(F.col("name")))
    if aliases is not None:
        names = names.join(aliases.select("fold", "target").dropDuplicates(["fold"]), "fold", "left")
    else:
        names = names.withColumn("target", F.lit(None).cast("string"))
    names = names.withColumn("n", text.normalize_names(F.coalesce("target", "name"))).withColumn("f", text.folded("n")).drop("fold")
    people = npcs.select("norm", "entity").dropDuplicates(["norm"]).withColumn("fold", text.folded("norm"))
    one = people.groupBy("fold").agg(F.min("norm").alias("norm"), F.count("*").alias("many"))
    keys = names.select("n", "f").distinct()

    exact = keys.join(people, keys["n"] == people["norm"]).select("n", "norm").withColumn("how", F.lit(0))
    accent = keys.join(one.filter("many = 1"), keys["f"] == one["fold"]).select("n", "norm").withColumn("how", F.lit(1))
    chaptered = chapter_of(keys.select(F.col("n").alias("norm")), chapters, mentions).select(F.col("norm").alias("n"), F.col("chapter").alias("norm"))
    chaptered = chaptered.join(people.select("norm"), "norm", "left_semi").select("n", "norm").withColumn("how", F.lit(2))
    words, size = F.split("fold", " "), F.size(F.split("fold", " "))
    ends = lambda k: F.array(F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, -k, k), " "))
    affixes = people.filter(size > 1).withColumn("part", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), ends)))))
    word = keys.join(affixes, keys["f"] == affixes["part"]).groupBy("n").agg(F.min("norm").alias("norm"), F.countDistinct("norm").alias("many"))
    word = word.filter("many = 1").select("n", "norm").withColumn("how", F.lit(3))
    near = close_matches(keys.select(F.col("f").alias("name")).distinct(), one.select(F.col("fold").alias("entity")), least=0.88)
    near = near.join(one.filter("many = 1").withColumnRenamed("fold", "entity").select("entity", "norm"), "entity")
    close = keys.join(near, keys["f"] == near["name"]).select("n", "norm").withColumn("how", F.lit(4))

    best = reduce(DataFrame.unionByName, [exact, accent, chaptered, word, close]).groupBy("n").agg(F.min(F.struct("how", "norm")).alias("b"))
    rows = names.join(best.select("n", "b.how", "b.norm"), "n", "left")
    said = F.get(F.array(*map(F.lit, ("exact", "accent", "chapter", "word", "close"))), F.col("how"))
    match = F.when(F.col("norm").isNull(), "none").when(F.col("target").isNotNull(), "alias").otherwise(said)
    places = chapter_of(rows.filter("norm is not null").select("norm"), chapters, mentions, chapter_aliases)
    place = places.select("norm", F.struct("book", "title", "lo", "hi").alias("chapter"))
    rows = rows.join(people.select("norm", "entity"), "norm", "left").join(place, "norm", "left")
    return rows.select("name", "norm", "entity", match.alias("match"), "chapter")
