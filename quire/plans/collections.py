"""Queries of ingestion, upserts, versions, checklists and artworks, over documents, pages, orders, part and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions import numbers, text
from quire.operators import art, relational
from quire.plans.registry import query
from quire.session import table
from quire.sources import tables

NOW = "2024-06-01 00:00:00"


@query("""SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, n.doc_id IS NULL AS retired FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0) o
FULL JOIN (SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 4 <> 1) n ON o.doc_id = n.doc_id""")
def retire_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    old = docs.filter("doc_id % 4 <> 0").withColumn("retired_at", F.when(F.col("doc_id") % 8 == 2, F.lit("2024-01-01").cast("timestamp")))
    done = tables.retire_missing(old, docs.filter("doc_id % 4 <> 1").withColumn("lang", F.upper("lang")), "doc_id", NOW)
    return done.select("doc_id", "lang", F.col("retired_at").isNotNull().alias("retired"))


@query("""SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, upper(c_name), c_nationkey + 1 FROM customer WHERE c_custkey % 10 = 3""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = own.filter("c_custkey % 10 = 3").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_nationkey") + 1).alias("c_nationkey"))
    return tables.upsert(own, new, ["c_custkey"])


@query("""WITH new AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem WHERE l_orderkey % 9 = 0 AND l_linenumber <= 2)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = own.filter("l_orderkey % 9 = 0 and l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") * 2)
    return tables.replace_groups(own, new, ["l_orderkey"])


@query("""SELECT doc_id, substr(sha256(text), 1, 12) AS version FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0""")
def incremental_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    stored = docs.filter("doc_id % 3 <> 0").withColumn("source_hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("source_hash")))
    return tables.changed(docs, stored, ["doc_id"], "source_hash").select("doc_id", numbers.short_version(F.col("source_hash")).alias("version"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'run' WHEN l.quality = 0 THEN 'redo' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def resumable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    return tables.to_do(table(spark, sf_dir, "documents").select("doc_id"), valid, "doc_id")


@query("""SELECT 'd' AS kind, doc_id AS id, substr(sha256(text), 1, 12) AS version FROM documents UNION ALL SELECT 'p', page_id, substr(sha256(html), 1, 12) FROM pages""")
def image_versions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = lambda c: numbers.short_version(F.sha2(c, 256)).alias("version")
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), short("text"))
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), short("html")))


@query("""SELECT (SELECT count(*) FROM documents WHERE source = 'src3') AS pages, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE source = 'src3') AS judged, (SELECT coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT FROM documents WHERE source = 'src3') AS chunks""")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "documents").filter("source = 'src3'")
    judged = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("j"))
    rows = book.select("doc_id", F.size(F.split("text", "\n")).alias("n")).join(judged, "doc_id", "left")
    return rows.agg(F.count("*").alias("pages"), F.count("j").alias("judged"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query("""SELECT source AS id, CASE WHEN source IN ('src1', 'src10') THEN 'artbook' ELSE 'guide' END AS kind, row_number() OVER (ORDER BY CASE WHEN source IN ('src1', 'src10') THEN 1 ELSE 0 END, source) AS place FROM (SELECT DISTINCT source FROM documents)""")
def book_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    kinds = books.withColumn("kind", F.when(F.col("id").isin("src1", "src10"), "artbook").otherwise("guide"))
    return kinds.withColumn("place", F.row_number().over(Window.orderBy(F.col("kind") == "artbook", "id")).cast("long"))


@query("""SELECT d.doc_id, lang, quality, toxic, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id = 42""")
def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "documents").filter("doc_id = 42").select("doc_id", "lang", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return page.join(table(spark, sf_dir, "labels").filter("doc_id = 42"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic", "lines")


@query("""WITH o AS (SELECT doc_id, quality FROM labels) SELECT d.doc_id, coalesce(o.quality, d.n_chars % 10)::BIGINT AS pages, o.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN o USING (doc_id)""")
def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("o"))
    rows = table(spark, sf_dir, "documents").join(given, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("long"), F.col("n_chars") % 10).alias("pages"), F.coalesce("o", F.lit(False)).alias("overridden"))


@query("""WITH e AS (SELECT lower(p_name) AS norm, min(p_name) AS entity FROM part WHERE p_size < 25 GROUP BY 1) SELECT DISTINCT p_name AS name, e.entity, e.entity IS NOT NULL AS verified FROM part LEFT JOIN e ON lower(p_name) = e.norm""")
def name_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entities = part.filter("p_size < 25").groupBy(text.normalized(F.col("p_name")).alias("norm")).agg(F.min("p_name").alias("entity"))
    pending = part.select(F.col("p_name").alias("name"), text.normalized(F.col("p_name")).alias("norm")).distinct()
    return pending.join(entities, "norm", "left").select("name", "entity", F.col("entity").isNotNull().alias("verified"))


@query("""WITH a AS (SELECT p_partkey, list_distinct([lower(p_name), lower(p_type)]) AS norms FROM part) SELECT p_partkey FROM a WHERE len(list_intersect(norms, ['small', 'cold widget', 'promo'])) > 0 OR len(list_filter(norms, lambda n: n LIKE 'hot %' OR n LIKE '% hot')) > 0""")
def artworks_for_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.array(F.lower("p_name"), F.lower("p_type"))).alias("norms"))
    asked = spark.createDataFrame([("small",), ("cold widget",), ("promo",), ("hot",)], "norm string")
    return art.for_entities(rows, asked, whole=["hot"]).select(F.col("id").alias("p_partkey"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%s' AND p_name NOT LIKE '%ss' AND regexp_matches(p_name, '[^ ]{3,}s$') THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END AS one FROM part""")
def singular_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.singular(F.col("p_name")).alias("one"))


@query(r"""SELECT p_partkey, regexp_replace(concat_ws('. ', nullif(p_name, ''), nullif(p_type, ''), nullif(p_brand, '')), '\.$', '') || '.' AS search FROM part""")
def artwork_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.search_text(F.array("p_name"), F.col("p_type"), F.col("p_brand"), F.lit("")).alias("search"))


@query("""SELECT p_partkey, p_size * 5 AS page, CASE WHEN p_size * 5 BETWEEN 2 AND 220 THEN 2 + 2 * (p_size * 5 - 2) END AS folio, CASE WHEN p_size BETWEEN 2 AND 439 THEN floor((p_size - 2) / 2)::INT + 2 END AS spread FROM part""")
def spread_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("p_size") * 5
    folios = numbers.spread_folios(page, 220, 2, 2)
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page"), F.try_element_at(folios, F.lit(1)).alias("folio"), numbers.spread_of_folio(F.col("p_size"), 220, 2, 2).alias("spread"))


@query("""SELECT c_custkey, regexp_matches(lower(replace(c_name, '#', '_')), '^[a-z0-9_]{3,32}$') AS good_name, length(c_name) BETWEEN 1 AND 60 AS good_length, c_mktsegment IN ('BUILDING', 'MACHINERY') AS good_segment FROM customer""")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.rlike("^[a-z0-9_]{3,32}$").alias("good_name"), F.length("c_name").between(1, 60).alias("good_length"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("good_segment"))


@query("""SELECT user_id, count(*) FILTER (retired = 0) AS done FROM (SELECT DISTINCT user_id, event_type FROM events) t LEFT JOIN (SELECT 'click' AS event_type, 0 AS retired UNION ALL SELECT 'view', 0 UNION ALL SELECT 'error', 1) i USING (event_type) GROUP BY user_id""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame([("click", False), ("view", False), ("error", True)], "event_type string, retired boolean")
    live = items.filter("not retired").select("event_type", F.lit(1).alias("live"))
    ticks = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return ticks.join(F.broadcast(live), "event_type", "left").groupBy("user_id").agg(F.count("live").alias("done"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND contains(lower(p_name), 'cold') AND p_brand <> 'Brand#11' AND NOT (p_partkey % 3 = 0)""")
def checklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.checklists import visible

    rows = table(spark, sf_dir, "part").filter("p_size > 10 and p_brand <> 'Brand#11'").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text"), (F.col("p_partkey") % 3 == 0).alias("done"))
    return visible(rows, hide_done=True, words="Cold").select(F.col("item").alias("p_partkey"), F.col("text").alias("p_name"))


@query("""WITH b AS (SELECT p_brand AS book, p_partkey AS page, p_size AS w FROM part), m AS (SELECT book, w FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, w) = 1)
SELECT b.book, b.page, b.w FROM b JOIN m USING (book) WHERE b.w > m.w + 45""")
def odd_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("page"), F.col("p_size").alias("w"))
    n = rows.groupBy("book", "w").agg(F.count("*").alias("n"))
    usual = relational.top_n(n, ["book"], [F.desc("n"), F.asc("w")], 1).select("book", F.col("w").alias("usual"))
    return rows.join(usual, "book").filter(F.col("w") > F.col("usual") + 45).select("book", "page", "w")


@query("""SELECT doc_id, xx FROM (SELECT doc_id, substr(sha256(text || chr(10) || 'a,b'), 1, 16) AS xx FROM documents)""")
def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = numbers.item_key(F.col("text"), F.array(F.lit("b"), F.lit("a")))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("xx"))


@query("""SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal <= 240 THEN 240 WHEN c_acctbal <= 480 THEN 480 WHEN c_acctbal <= 960 THEN 960 ELSE 1600 END AS width FROM customer""")
def snapped_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", numbers.snapped(F.col("c_acctbal")).alias("width"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def cover_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT p_partkey AS id, p_brand AS book, p_size AS spread, s_name AS title, n_name AS label FROM part LEFT JOIN (SELECT s_suppkey % 50 AS spread, s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1, 2) s ON s.spread = p_size AND s.s_nationkey = substr(p_brand, 7)::INT % 25
JOIN nation ON n_nationkey = substr(p_brand, 7)::INT % 25""")
def artwork_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as artworks in books by brand, suppliers as spreads, nations as books."""
    nation = F.substring("p_brand", 7, 10).cast("int") % 25
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), nation.alias("book"), F.col("p_size").alias("spread"))
    spreads = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("book"), (F.col("s_suppkey") % 50).cast("int").alias("spread")).agg(F.min("s_name").alias("title"))
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("book"), F.col("n_name").alias("label"))
    return art.with_spreads(works, spreads, books).select("id", F.col("brand").alias("book"), "spread", "title", "label")


@query("""WITH b AS (SELECT l_orderkey AS page, l_partkey AS box, l_quantity * 20 AS x, l_linenumber * 90 + l_suppkey % 13 AS y FROM lineitem)
SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN x >= 500 THEN 1 ELSE 0 END, floor(y / 80.0), x, y, box) AS place FROM b""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes on pages of 1000 by 1000."""
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("box"), (F.col("l_quantity") * 20).alias("x"), (F.col("l_linenumber") * 90 + F.col("l_suppkey") % 13).alias("y"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return art.reading_order(boxes).select("page", "box", F.col("place").cast("long").alias("place"))
