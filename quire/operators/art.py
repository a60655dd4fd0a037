"""Artworks: which of them show the subjects of a question, and the strip that is shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions import text

#: Sizes of the strip and similarities below which a text-search hit is left out.
LIMIT, PER_SUBJECT = 6, 2
LEAST, LEAST_WITH_NAMES = 0.55, 0.58
#: Fixed value: questions about how something looks.
APPEARANCE = r"(?i)\b(look(s|ed)? like|what does .{1,60} look|appearance|show me|picture|image|artwork|art of|concept art|design(s|ed)?|illustration|drawing|painting)\b"


def asks_for_looks(question: Column) -> Column:
    return F.coalesce(question.rlike(APPEARANCE), F.lit(False))


def for_entities(artworks: DataFrame, asked: DataFrame, whole: list[str] | None = None, names: str = "norms") -> DataFrame:
    """Artworks (id, array of normalised names) with a name that is asked for; names in ``whole`` also match as the first
    or last words of a name. Exploded names meet the asked ones by equality, so that neither side is sent as a whole."""
    each = artworks.select("id", F.explode(names).alias("norm"))
    hit = each.join(asked.select("norm").distinct(), "norm", "left_semi").select("id")
    for word in whole or []:
        hit = hit.union(each.filter(F.col("norm").startswith(f"{word} ") | F.col("norm").endswith(f" {word}")).select("id"))
    return artworks.join(hit.distinct(), "id", "left_semi")


#: Fixed value: types of entities that are persons.
PERSONS = ("npc", "boss", "merchant")


def subjects(entities: DataFrame) -> DataFrame:
    """q, subject, person and place of what a question is about, from its entities (see retrieval.entity_groups): all but those
    known from earlier turns alone, in their order."""
    now = entities.filter("rank <> 2")
    person = F.arrays_overlap("types", F.array(*map(F.lit, PERSONS)))
    return now.select("q", F.col("name_norm").alias("subject"), person.alias("person"), F.col("place"))


def forms(raw: Column) -> Column:
    """The persons that a name with a title may mean, normalised: Name, Title; Name the ...; Name of ...; Title Name (but for
    names with "of")."""
    norm = text.normalized(raw)
    words, n = F.split(norm, " "), F.size(F.split(norm, " "))
    comma = F.when(F.contains(raw, F.lit(",")), F.array(text.normalized(F.split(raw, ",")[0])))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & (i > 1) & F.get(words, i - 1).isin("the", "of"))
    opens = F.transform(at, lambda i: F.array_join(F.slice(words, 1, i - 1), " "))
    behind = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, -k, k), " "))
    closes = F.when((n > 1) & ~F.contains(norm, F.lit(" of ")), behind)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(comma, none), opens, F.coalesce(closes, none)))


def tiers(names: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, subject, tier, exact, name: how well an artwork's names (id, name, origin, confidence) show a subject.

    Captions are tier 0, sure guesses 1, likely ones 2, others do not count. Of an artwork's names the best tier
    stands, exact before titled. subjects: subject, person. Both sides meet on equal names in the singular, and persons on
    the forms of titled names, so neither is sent as a whole nor meets all of the other.
    """
    tier = F.when(F.col("origin") == "caption", 0).when(F.col("confidence") == "high", 1).when(F.col("confidence") == "medium", 2)
    own = names.withColumn("tier", tier).filter("tier is not null").select("id", "name", "tier")
    asked = subjects.select("subject", "person").distinct()
    single = own.withColumn("key", text.singular(text.normalized(F.col("name"))))
    exact = single.join(asked.withColumn("key", text.singular(F.col("subject"))), "key").withColumn("loose", F.lit(False))
    titled = own.withColumn("key", F.explode(forms(F.col("name"))))
    loose = titled.join(asked.filter("person").withColumn("key", F.col("subject")), "key").withColumn("loose", F.lit(True))
    best = exact.unionByName(loose).groupBy("id", "subject").agg(F.min(F.struct("tier", "loose", "name")).alias("b"))
    return best.select("id", "subject", "b.tier", (~F.col("b.loose")).alias("exact"), "b.name")


def strip(rated: DataFrame, hits: DataFrame) -> DataFrame:
    """The strip of each question: best tier first, at most two artworks a subject and one a spread, six in all, then
    text-search hits that are similar enough. rated: q, id, subject, place (of the subject), tier, exact, book, page;
    hits: q, id, similarity. A question has at most some hundred of either."""

    def choose(key: tuple, names: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        shown, by_subject, spreads = [], {}, set()
        for x in names.sort_values(["tier", "exact", "place", "book", "page", "id"], ascending=[True, False, True, True, True, True]).itertuples():
            spread = (x.subject, x.book, x.page)
            if len(shown) < LIMIT and x.id not in {s[1] for s in shown} and spread not in spreads and by_subject.get(x.subject, 0) < PER_SUBJECT:
                shown.append((key[0], x.id, x.subject, x.tier))
                spreads.add(spread)
                by_subject[x.subject] = by_subject.get(x.subject, 0) + 1
        least = LEAST_WITH_NAMES if shown else LEAST
        for x in found.sort_values(["similarity", "id"], ascending=[False, True]).itertuples():
            if len(shown) < LIMIT and x.similarity >= least and x.id not in {s[1] for s in shown}:
                shown.append((key[0], x.id, None, 3))
        return pd.DataFrame([(*s, i + 1) for i, s in enumerate(shown)], columns=["q", "id", "subject", "tier", "position"])

    return rated.groupBy("q").cogroup(hits.groupBy("q")).applyInPandas(choose, "q long, id long, subject string, tier int, position int")


def overridden(artworks: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artworks (page, idx, names, dropped) with names replaced and marked ones dropped; and overrides of none that is there."""
    key = ["page", "idx"]
    given = overrides.select(*key, F.col("names").alias("__names"), F.col("dropped").alias("__dropped"))
    rows = artworks.join(given, key, "left").withColumn("names", F.coalesce("__names", "names")).filter(~F.coalesce("__dropped", F.lit(False))).select(*artworks.columns)
    return rows, overrides.join(artworks.select(*key), key, "left_anti")


def reading_order(boxes: DataFrame, band: float = 0.08) -> DataFrame:
    """Boxes of page images (page, box, x, y, width, height of the page; in pixels) with their place in reading order:
    the left half before the right one, then rows of ``band`` of the page's height, then from left to right."""
    half = (F.col("x") >= F.col("width") / 2).cast("int")
    row = F.floor(F.col("y") / (F.col("height") * band))
    w = Window.partitionBy("page").orderBy(half, row, "x", "y", "box")
    return boxes.withColumn("place", F.row_number().over(w))


def with_spreads(artworks: DataFrame, spreads: DataFrame, books: DataFrame) -> DataFrame:
    """Artworks (id, book, spread) with the facts of their spreads (book, spread, ...) and books (book, ...); what has
    no spread is kept, what has no book is not."""
    return artworks.join(spreads, ["book", "spread"], "left").join(books, "book")
