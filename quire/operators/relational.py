"""Groupings, windows and set operations that reports and services of a page collection are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.sources.tables import kept


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row a key: the last by the columns ``by``, which should leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in by))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def shares(rows: DataFrame, by: list[str], digits: int = 1) -> DataFrame:
    """Counts with their share of all rows in percent."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("n") / F.col("total"), digits)).drop("total")


def members(rows: DataFrame, array: str, placeholder: str) -> DataFrame:
    """A row for each element of an array column; empty and null arrays count under the placeholder."""
    return rows.withColumn(array, F.explode(F.when(F.coalesce(F.size(array), F.lit(0)) > 0, F.col(array)).otherwise(F.array(F.lit(placeholder)))))


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers: first, last and how many, by key."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = rows.select(*keys, value).distinct().withColumn("__g", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*keys, "__g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__g")


def compressed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The runs of a key as text: 1-3,7."""
    runs = islands(rows, keys, value)
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", one.alias("t")))).alias("x"))
    return listed.select(*keys, F.array_join(F.transform("x", lambda x: x["t"]), ",").alias("ranges"))


def expanded_ranges(specs: DataFrame, spec: str, keys: list[str] | None = None) -> DataFrame:
    """Page specs such as 1-3,7 as numbers, each where it occurs first in its key's specs: the keys, pos, page."""
    keys = keys or []
    parts = specs.select(*keys, F.posexplode(F.split(F.regexp_replace(F.regexp_replace(spec, "#.*$", ""), r"\s+", ""), ",")).alias("a", "part")).filter("part <> ''")
    ends = parts.withColumn("lo", F.split("part", "-")[0].cast("int")).withColumn("hi", F.element_at(F.split("part", "-"), -1).cast("int"))
    if not keys:
        pages = ends.select("a", F.posexplode(F.sequence("lo", "hi")).alias("b", "page"))
        first = pages.groupBy("page").agg(F.min(F.struct("a", "b")).alias("at"))
        return first.select("page", F.row_number().over(Window.orderBy("at")).alias("pos"))
    # A key's ranges are short, its pages many: it is ranges that are grouped, and pages are made within the row.
    ranges = ends.filter("lo is not null and hi is not null").groupBy(*keys).agg(F.collect_list(F.struct("a", "lo", "hi")).alias("r"))
    each = F.flatten(F.transform("r", lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda p, b: F.struct(r["a"].alias("a"), b.alias("b"), p.alias("page")))))
    pages = F.array_distinct(F.transform(F.array_sort(each), lambda x: x["page"]))
    return ranges.select(*keys, F.posexplode(pages).alias("pos", "page")).select(*keys, "page", (F.col("pos") + 1).alias("pos"))


def gaps(rows: DataFrame, value: str, lo: int, hi: int, block: int = 1 << 16) -> DataFrame:
    """Runs of the numbers from lo to hi that no row has: first, last, n.

    A gap lies between neighbours: within blocks of numbers, and between the ends of blocks, of which there are few.
    """
    x = F.col("x")
    own = rows.select(F.col(value).cast("long").alias("x")).filter(x.between(lo, hi)).distinct().withColumn("b", F.floor(x / block))
    inside = own.withColumn("before", F.lag("x").over(Window.partitionBy("b").orderBy("x"))).filter("before is not null")
    ends = own.groupBy("b").agg(F.min("x").alias("x"), F.max("x").alias("end"))
    edges = ends.select("x", F.coalesce(F.lag("end").over(Window.orderBy("b")), F.lit(lo - 1)).alias("before"))
    last = ends.agg(F.lit(hi + 1).alias("x"), F.coalesce(F.max("end"), F.lit(lo - 1)).alias("before"))
    both = inside.select("x", "before").unionByName(edges).unionByName(last).filter("x - before > 1")
    return both.select((F.col("before") + 1).alias("first"), (x - 1).alias("last"), (x - F.col("before") - 1).alias("n"))


def mode_by_first(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one that comes first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return top_n(n, [key], [F.desc("n"), F.asc("first")], 1).drop("rank", "first")


def median_of_last(rows: DataFrame, value: str, order: list[Column], n: int = 300, default: float = 0.2, digits: int = 3) -> DataFrame:
    """The median of the last n values; the default where there are none."""
    last = rows.filter(F.col(value).isNotNull()).orderBy(*order).limit(n)
    return last.agg(F.coalesce(F.round(F.median(value), digits), F.lit(default)).alias("median"), F.count("*").alias("n"))


def counters(rows: DataFrame, key: str, buckets: list[str]) -> DataFrame:
    """Counts of fixed buckets, zeros included."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(b,) for b in buckets], f"{key} string")
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return fixed.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def chapter_ends(headings: DataFrame, book: str, page: str, last: Column | None = None) -> DataFrame:
    """Adds to_page: the page before the next heading, or the last page of the book; never before the heading itself."""
    w = Window.partitionBy(book).orderBy(page, "pos")
    end = F.coalesce(F.lead(page).over(w) - 1, last if last is not None else F.max(page).over(Window.partitionBy(book)))
    return headings.withColumn("to_page", F.greatest(F.col(page), end))


def chapters(headings: DataFrame, book: str, page: str, title: str, last: Column | None = None) -> DataFrame:
    """The headings that are chapters, with to_page. An event's heading ("Event 5") goes on with the chapter that it stands in;
    one in capitals ends the chapter before it and is none itself."""
    own = chapter_ends(headings.filter(~F.col(title).rlike(r"^Event\b")), book, page, last)
    name = F.col(title)
    return own.filter(~((F.upper(name) == name) & (F.lower(name) != name)))


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All intervals (lo, hi) of a key that hold each point of it.

    They meet on blocks of numbers as wide as the interval: one of at most 2**level numbers lies in two such blocks.
    Points look at one block of each level that there is, so that no pairs are made that lie far from each other.
    """
    level = F.ceil(F.log2(F.greatest(F.expr("hi - lo + 1"), F.lit(1)))).cast("int")
    spans = intervals.filter("lo <= hi").withColumn("__level", level)
    block = lambda c: F.expr(f"shiftright(cast({c} as bigint), __level)")
    dealt = spans.withColumn("__block", F.explode(F.array_distinct(F.array(block("lo"), block("hi")))))
    levels = spans.select("__level").distinct()  # at most 64
    asked = points.join(F.broadcast(levels)).withColumn("__block", block(at))
    return asked.join(dealt, [*keys, "__level", "__block"]).filter(F.col(at).between(F.col("lo"), F.col("hi"))).drop("__level", "__block")


def narrowest(points: DataFrame, intervals: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The shortest interval (lo, hi, name) that holds each point; of equals the first, then the smaller name."""
    best = F.min(F.struct(F.expr("hi - lo").alias("width"), "lo", "name", "hi")).alias("i")
    return within(points, intervals, keys, at).groupBy(*keys, at).agg(best).select(*keys, at, "i.lo", "i.hi", "i.name")


def compared(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Two runs side by side: which of them has the key, and the values of both."""
    left = a.select(*keys, *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("in_a"))
    right = b.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("in_b"))
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b")
    return left.join(right, keys, "full").withColumn("side", side).drop("in_a", "in_b")


def longest_prefix(rows: DataFrame, prices: DataFrame, name: str) -> DataFrame:
    """Joins the price whose prefix is the longest that the name starts with; prices is a fixed small table."""
    names = rows.select(name).distinct()
    fits = names.join(F.broadcast(prices), F.col(name).startswith(F.col("prefix")))
    best = fits.groupBy(name).agg(F.max_by(F.struct(*prices.columns), F.length("prefix")).alias("__price"))
    return rows.join(best, name, "left").select(*rows.columns, "__price.*")


def chains(members_of: DataFrame, item: str, shared: str, rounds: int = 50) -> DataFrame:
    """item and chain (its smallest item): items that share a value belong together, directly or through others.

    Each round lowers every item to the least of those that share a value with it, and on along these steps to an item
    that none is below; only such items go on to the next round, with the values of all that came to them. That is half of
    them at most, and few where values are shared widely. What is made is checkpointed in spark.checkpoint.dir.
    """
    edges = kept(members_of.select(item, shared).distinct())
    labels = None
    for _ in range(rounds):
        least = edges.groupBy(shared).agg(F.min(item).alias("m"))
        step = kept(edges.join(least, shared).groupBy(item).agg(F.min("m").alias("chain")))
        moved = step.filter(F.col(item) != F.col("chain")).limit(1).count()
        if not moved:
            return step if labels is None else labels
        for _ in range(64):  # each time the way is half as long
            on = step.select(F.col(item).alias("chain"), F.col("chain").alias("deeper")).filter("chain <> deeper")
            step = kept(step.join(on, "chain", "left").select(item, F.coalesce("deeper", "chain").alias("chain"), F.col("deeper").isNotNull().alias("again")))
            again = step.filter("again").limit(1).count()
            step = step.drop("again")
            if not again:
                break
        edges = kept(edges.join(step, item).select(F.col("chain").alias(item), shared).distinct())
        if labels is None:
            labels = step
        else:
            labels = kept(labels.join(step.select(F.col(item).alias("chain"), F.col("chain").alias("deeper")), "chain").select(item, F.col("deeper").alias("chain")))
    raise RuntimeError(f"chains did not settle in {rounds} rounds")


def merged_parts(parts: DataFrame, key: str, ordinals: dict[str, list[str]]) -> DataFrame:
    """Parts of one page put together: first text that is there, worst of ordinal values, any flag, all issues, summed counts."""
    worst = [F.element_at(F.array(*map(F.lit, order)), F.max(F.array_position(F.array(*map(F.lit, order)), F.col(c))).cast("int")).alias(c) for c, order in ordinals.items()]
    return parts.groupBy(key).agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("part"))).alias("title"), *worst, F.coalesce(F.bool_or("flag"), F.lit(False)).alias("flag"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))).alias("issues"), F.sum("n").alias("n"))


def table_stats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows and cells of pipe tables, separator rows left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.aggregate("__l", F.lit(0), lambda s, x: s + F.size(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|")))
    return rows.withColumn("__l", lines).select(key, F.size("__l").alias("table_rows"), cells.alias("table_cells"))


def attempts_window(events: DataFrame, key: str, seconds: int, limit: int, at: str = "ts") -> DataFrame:
    """Failed attempts of a key within the window that ends with each, and how long it must wait from there."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    order = Window.partitionBy(key).orderBy("__t")
    rows = events.withColumn("__t", t).withColumn("attempts", F.count("*").over(w)).withColumn("__old", F.lag("__t", limit - 1).over(order))
    wait = F.greatest(F.lit(0), F.col("__old") + seconds * 1_000_000 - F.col("__t"))
    return rows.withColumn("wait_us", F.when(F.col("attempts") >= limit, wait).otherwise(0)).drop("__t", "__old")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Numbers the sessions of a key: a longer gap than gap_seconds starts a new one."""
    order = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    new = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def admission(groups: DataFrame, spent: DataFrame, budget: float, by: list[str], order: list[str]) -> DataFrame:
    """Adds spent, waits and claimed to groups of work (kind, fresh, estimate): who may start next.

    A new retake waits where the money really spent and its own estimate exceed the budget; what was begun before and
    rollbacks never wait, and those that wait hold up nobody behind them. The first that does not wait is claimed.
    """
    known = groups.join(spent.select(*by, "spent"), by, "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    over = (F.col("kind") == "retake") & F.col("fresh") & (F.col("spent") + F.coalesce("estimate", F.lit(0.0)) > budget)
    marked = known.withColumn("waits", over)
    first = marked.filter(~F.col("waits")).groupBy(*by).agg(F.min(F.struct(*order)).alias("__first"))
    same = F.coalesce(~F.col("waits") & F.struct(*order).eqNullSafe(F.col("__first")), F.lit(False))
    return marked.join(first, by, "left").withColumn("claimed", same).drop("__first")


def folded(rows: DataFrame, keys: list[str], order: list[str], value: str, step: Callable, start: object, out: str) -> DataFrame:
    """Adds the boolean ``out`` by a fold over each key's rows in order: step(state, value) gives the next state and the mark.

    Rows are dealt by key and stream past in order as Arrow batches, so that a key may have any number of them. Spark says
    where a key begins (null is a key like any other); the columns pass untouched.
    """
    first = "__first"
    marked = rows.withColumn(first, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
    at, new = rows.columns.index(value), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for b in batches:
            marks = []
            for begins, x in zip(b.column(new).to_pylist(), b.column(at).to_pylist()):
                state, mark = step(start if begins else state, x)
                marks.append(mark)
            names = [*b.schema.names[:new], out]
            yield pa.RecordBatch.from_arrays([*b.columns[:new], pa.array(marks, pa.bool_())], names)

    return marked.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, BooleanType())]))


def touches(rows: DataFrame, keys: list[str], seconds: str, least: int = 3600) -> DataFrame:
    """Adds touched: the uses of a session that renew it, the first and then those more than ``least`` seconds after the last
    that did. A use without a time renews nothing."""

    def step(last: float | None, now: float | None) -> tuple[float | None, bool]:
        due = now is not None and (last is None or now - last > least)
        return (now if due else last), due

    return folded(rows, keys, [seconds], seconds, step, None, "touched")


def merged_entities(rows: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """The entities of a page's parts, those of one type and name as one: place (from 0, by where each first comes), type, name,
    location and how_to_obtain (the first that says something), connects_to (every target where it first comes).

    rows: the page's columns, those of ``order`` (of parts and of entities within them), type, name, location, how_to_obtain,
    connects_to. An entity of one page has a handful of rows.
    """
    at = F.struct(*order)
    said = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    targets = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "connects_to"))), lambda x: x["connects_to"]))
    one = rows.groupBy(*page, "type", "name").agg(F.min(at).alias("at"), said("location"), said("how_to_obtain"), F.array_distinct(targets).alias("connects_to"))
    w = Window.partitionBy(*page).orderBy("at", "type", "name")
    return one.withColumn("place", F.row_number().over(w) - 1).select(*page, "place", "type", "name", "location", "how_to_obtain", "connects_to")


def page_kind(parts: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """page_type, chapter and region of pages in parts: the first kind that is not "other", if any; the first names that are there."""
    at = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    kind = F.coalesce(F.min_by("page_type", F.when(F.col("page_type") != "other", at)), F.lit("other"))
    return parts.groupBy(*page).agg(kind.alias("page_type"), first("chapter"), first("region"))


def copies(rows: DataFrame, same: list[str], key: str, k: int) -> DataFrame:
    """The k least keys of the rows that are the same in all of ``same``, with head (the least of them) and n (how many, at most k).

    A task lets go of what is beyond its own k before anything is shuffled.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*same))
    least = Window.partitionBy("__h", *same).orderBy(key)
    first = hashed.withColumn("__r", F.row_number().over(least)).filter(F.col("__r") <= k).drop("__r")
    every = Window.partitionBy("__h", *same)
    return first.withColumns({"head": F.min(key).over(every), "n": F.count("*").over(every)}).drop("__h")


def top_of_copies(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """q, key, score and rank of the k best, ties by key, from what was found of heads (q, key, score), k a question at least
    where there are as many; members: head, key and n, see ``copies``.

    A head that k better ones (with their copies) are ahead of is not expanded.
    """
    sizes = members.select("head", "n").distinct()
    q = Window.partitionBy("q")
    known = found.withColumnRenamed("key", "head").join(sizes, "head")
    ahead = F.sum("n").over(q.orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy("q", "score"))
    known = known.withColumn("ahead", ahead).filter(F.col("ahead") < k).select("q", "head", "score")
    rows = known.join(members.select("head", "key"), "head")
    w = q.orderBy(F.desc("score"), "key")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "key", "score", "rank")
