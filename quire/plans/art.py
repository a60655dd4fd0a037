"""Queries of reports on art books and retakes, over lineitem, part, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import art_reports
from quire.plans.registry import query
from quire.session import table


@query("""WITH l AS (SELECT l_orderkey AS label, list(l_linenumber ORDER BY l_linenumber) AS used, (l_orderkey % 5 + 2)::INT AS boxes FROM lineitem GROUP BY l_orderkey),
f AS (SELECT *, list_sort(list_distinct(list_filter(used, lambda b: b > boxes))) AS beyond, list_sort(list_distinct(list_filter(used, lambda b: len(list_filter(used, lambda x: x = b)) > 1))) AS twice,
  list_filter(range(1, boxes + 1), lambda b: NOT list_contains(used, b::INT)) AS missing FROM l)
SELECT label, boxes, CASE WHEN len(beyond) > 0 THEN 'box numbers [' || array_to_string(beyond, ', ') || '] do not exist (there are ' || boxes || ')'
  WHEN len(twice) > 0 THEN 'boxes [' || array_to_string(twice, ', ') || '] are used more than once'
  WHEN len(missing) > 0 THEN 'boxes [' || array_to_string(missing, ', ') || '] are neither in an artwork nor left out' END AS fault FROM f""")
def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether labels (orders) use each of their boxes (line numbers) once."""
    lines = table(spark, sf_dir, "lineitem")
    labels = lines.groupBy(F.col("l_orderkey").alias("label")).agg(F.collect_list("l_linenumber").alias("used"))
    labels = labels.withColumn("boxes", (F.col("label") % 5 + 2).cast("int"))
    return labels.select("label", "boxes", art_reports.box_fault(F.col("used"), F.col("boxes")).alias("fault"))


@query("""WITH n AS (SELECT l_suppkey AS page, l_linenumber AS idx, 'n' || (l_partkey % 300) AS name, CASE WHEN l_returnflag = 'A' THEN 'caption' ELSE 'visual' END AS source, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS confidence
  FROM lineitem WHERE l_discount >= 0.05),
r AS (SELECT *, 's' || lpad(page::VARCHAR, 4, '0') || '#' || idx || ' ' || source || '/' || confidence AS use, row_number() OVER (PARTITION BY name ORDER BY page, idx, source, confidence) AS at_ FROM n)
SELECT name, count(*) AS uses, string_agg(use, ', ' ORDER BY at_) FILTER (at_ <= 6) || CASE WHEN count(*) > 6 THEN ' …' ELSE '' END AS shown FROM r GROUP BY name""")
def unverified_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of artworks that are not verified and where they stand; lines as names, small discounts as verified."""
    lines = table(spark, sf_dir, "lineitem")
    names = lines.select(
        F.col("l_suppkey").alias("page"),
        F.col("l_linenumber").alias("idx"),
        F.concat(F.lit("n"), F.col("l_partkey") % 300).alias("name"),
        F.when(F.col("l_returnflag") == "A", "caption").otherwise("visual").alias("source"),
        F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("confidence"),
        (F.col("l_discount") < 0.05).alias("verified"),
    )
    return art_reports.unverified_uses(names)


@query("""WITH p AS (SELECT p_brand AS book, p_partkey AS page, (p_size // 20) || 'x' || (p_size // 30) AS size FROM part),
n AS (SELECT book, size, count(*) AS n, min(page) AS at_ FROM p GROUP BY ALL), u AS (SELECT book, arg_min(size, (-n, at_)) AS usual FROM n GROUP BY book),
o AS (SELECT p.book, usual, page FROM p JOIN u USING (book) WHERE size <> usual AND page >= 10 QUALIFY row_number() OVER (PARTITION BY p.book ORDER BY page) <= 20)
SELECT book, usual, string_agg(page::VARCHAR, ',' ORDER BY page) AS odd FROM o GROUP BY book, usual""")
def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of another size than most of their book's, from the tenth on."""
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("page"), F.floor(F.col("p_size") / 20).alias("width"), F.floor(F.col("p_size") / 30).alias("height"))
    found = art_reports.odd_pages(pages, pages.select("book").distinct().withColumn("first", F.lit(10)))
    return found.select("book", "usual", F.array_join("odd", ",").alias("odd"))


@query("""WITH i AS (SELECT source AS book, doc_id AS page, CASE WHEN quality = 0 THEN 'flagged' WHEN toxic = 1 THEN 'still_flagged' ELSE 'done' END AS status, list_filter([CASE WHEN n_chars < 900 THEN 'blur' END, CASE WHEN n_chars % 2 = 0 THEN 'glare' END], lambda x: x IS NOT NULL) AS issues
  FROM documents JOIN labels USING (doc_id)), o AS (SELECT * FROM i WHERE status <> 'done'),
r AS (SELECT book, page || '  # ' || CASE WHEN len(issues) > 0 THEN array_to_string(issues, ', ') ELSE '-' END AS line, page FROM o)
SELECT book, 0 AS "at", '# ' || upper(book) || ' (' || book || ')' AS line FROM (SELECT DISTINCT book FROM o) UNION ALL SELECT book, (row_number() OVER (PARTITION BY book ORDER BY page, line))::INT, line FROM r""")
def reshoot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of pages to shoot anew; documents that labels find bad or toxic as flagged pages."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    status = F.when(F.col("quality") == 0, "flagged").when(F.col("toxic") == 1, "still_flagged").otherwise("done")
    issues = F.array_compact(F.array(F.when(F.col("n_chars") < 900, F.lit("blur")), F.when(F.col("n_chars") % 2 == 0, F.lit("glare"))))
    items = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), status.alias("status"), issues.alias("issues"))
    labels = items.select("book").distinct().select("book", F.upper("book").alias("label"))
    return art_reports.reshoot_lines(items, labels)
