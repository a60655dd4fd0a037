"""Queries of quality reports and comparisons, over documents, labels, part, lineitem and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import checklists, names, quality, relational, retrieval
from quire.plans.registry import query
from quire.session import table


@query("""SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'page' ELSE 'long' END AS kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1)::DOUBLE AS share FROM documents GROUP BY 1, 2""")
def distribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "page").otherwise("long")
    return relational.shares(table(spark, sf_dir, "documents").withColumn("kind", kind), ["lang", "kind"])


ISSUES_SQL = """WITH i AS (SELECT doc_id, source, list_filter([CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'bars' END, CASE WHEN n_chars < 400 THEN 'short' END], lambda x: x IS NOT NULL) AS issues FROM documents),
x AS (SELECT doc_id, source, unnest(CASE WHEN len(issues) > 0 THEN issues ELSE ['(none)'] END) AS issue FROM i)"""


def with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    found = F.array(F.when(t.contains("!!"), "shouting"), F.when(t.contains(" | "), "bars"), F.when(F.col("n_chars") < 400, "short"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.filter(found, lambda x: x.isNotNull()).alias("issues"))


@query(ISSUES_SQL + " SELECT issue, count(*) AS n, count(DISTINCT source) AS books FROM x GROUP BY issue")
def issue_explode_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.members(with_issues(spark, sf_dir), "issues", "(none)")
    return rows.groupBy(F.col("issues").alias("issue")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("books"))


@query(ISSUES_SQL + " SELECT doc_id, issue, count(*) OVER (PARTITION BY issue) AS size FROM x")
def issue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.members(with_issues(spark, sf_dir), "issues", "(none)").withColumnRenamed("issues", "issue")
    sizes = rows.groupBy("issue").agg(F.count("*").alias("size"))
    return rows.join(F.broadcast(sizes), "issue").select("doc_id", "issue", "size")


@query("""SELECT source AS book, count(*) AS pages, sum(n_chars)::BIGINT AS chars, floor(sum(n_chars) / count(*))::BIGINT AS avg_chars, count(*) FILTER (quality = 0) AS retake, count(l.doc_id) AS judged
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("one"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return rows.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), F.floor(F.sum("n_chars") / F.count("*")).alias("avg_chars"), F.count_if(F.col("quality") == 0).alias("retake"), F.count("one").alias("judged"))


GAPS_SQL = """WITH m AS (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS doc_id EXCEPT SELECT doc_id FROM labels),
g AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM m)
SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY g"""


@query(GAPS_SQL)
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return relational.gaps(table(spark, sf_dir, "labels"), "doc_id", 0, hi)


@query("""WITH r AS (SELECT source, doc_id, doc_id // 9 - dense_rank() OVER (PARTITION BY source ORDER BY doc_id // 9) AS g FROM documents),
i AS (SELECT source, min(doc_id // 9) AS a, max(doc_id // 9) AS b FROM r GROUP BY source, g)
SELECT source AS book, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM i GROUP BY source""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return relational.compressed(docs.select(F.col("source").alias("book"), F.floor(F.col("doc_id") / 9).alias("page")), ["book"], "page")


SPEC_SQL = """WITH s AS (SELECT l_orderkey AS k, min(l_partkey % 50) AS a, max(l_partkey % 50) AS b, min(l_suppkey % 60) AS c, max(l_linenumber) AS d FROM lineitem GROUP BY 1),
p AS (SELECT k, unnest(range(a, b + 1)) AS page, 0 AS i FROM s UNION ALL SELECT k, c, 1 FROM s UNION ALL SELECT k, unnest(range(d, d + 3)), 2 FROM s)
SELECT k, page::INT AS page, row_number() OVER (PARTITION BY k ORDER BY min((i, page))) AS pos FROM p GROUP BY k, page"""


@query(SPEC_SQL)
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page spec made of every order's lines ("a-b, c ,d-e # rest"), as pages where each occurs first."""
    lines = table(spark, sf_dir, "lineitem")
    ends = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.col("l_partkey") % 50).alias("a"), F.max(F.col("l_partkey") % 50).alias("b"), F.min(F.col("l_suppkey") % 60).alias("c"), F.max("l_linenumber").alias("d"))
    specs = ends.select("k", F.format_string("%d-%d, %d ,%d-%d # 99, the rest", "a", "b", "c", "d", F.col("d") + 2).alias("spec"))
    return relational.expanded_ranges(specs, "spec", ["k"]).select("k", "page", F.col("pos").cast("long").alias("pos"))


@query("""WITH n AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2)
SELECT p_brand, p_name, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1""")
def mode_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.mode_by_first(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query()
def connected_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share parts, directly or through others. SQL would keep a row for each pair of a chain; tests use union-find."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("npc"))
    return relational.chains(rows, "item", "npc").select("item", "chain")


CHAPTER_SQL = """WITH h AS (SELECT source AS book, doc_id AS page, lang AS title FROM documents WHERE n_chars > 4000),
c AS (SELECT book, page AS lo, title, greatest(page, coalesce(lead(page) OVER (PARTITION BY book ORDER BY page) - 1, max(page) OVER (PARTITION BY book))) AS hi FROM h)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "documents").filter("n_chars > 4000").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("lang").alias("title"), F.lit(0).alias("pos"))
    return relational.chapter_ends(heads, "book", "page").select("book", F.col("page").alias("lo"), "title", F.col("to_page").alias("hi"))


@query(CHAPTER_SQL + " SELECT d.doc_id AS page, c.lo, c.title FROM documents d JOIN c ON d.source = c.book AND d.doc_id BETWEEN c.lo AND c.hi")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    return relational.within(docs, chapters(spark, sf_dir), ["book"], "page").select("page", "lo", "title")


@query("""WITH i AS (SELECT lang AS book, doc_id AS lo, doc_id + n_chars // 100 AS hi, source AS name FROM documents),
p AS (SELECT lang AS book, doc_id AS page FROM documents)
SELECT p.book, p.page, i.lo, i.hi, i.name FROM p JOIN i ON p.book = i.book AND p.page BETWEEN i.lo AND i.hi QUALIFY row_number() OVER (PARTITION BY p.book, p.page ORDER BY i.hi - i.lo, i.lo, i.name) = 1""")
def most_specific_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = docs.select(F.col("lang").alias("book"), F.col("doc_id").alias("lo"), (F.col("doc_id") + F.floor(F.col("n_chars") / 100)).alias("hi"), F.col("source").alias("name"))
    return relational.narrowest(docs.select(F.col("lang").alias("book"), F.col("doc_id").alias("page")), spans, ["book"], "page")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '^\s*\|') AND NOT regexp_matches(line, '^[\s|:-]+$'))
SELECT d.doc_id, count(r.line) AS table_rows, coalesce(sum(len(string_split(regexp_replace(trim(r.line), '^\||\|$', '', 'g'), '|'))), 0)::BIGINT AS table_cells FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.table_stats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("table_rows").cast("long").alias("table_rows"), F.col("table_cells").cast("long").alias("table_cells"))


PROBLEM_SQL = r"""WITH d AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'Fig. 2 and [FIGURE ' || (n_chars % 5) || '] ' ELSE '' END || text AS md, doc_id % 4 AS n, toxic + doc_id % 2 AS regions, string_split(text, ' ')[1] AS name, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT *, list_transform(regexp_extract_all(md, '(?i)\[?fig(?:ure)?\.?\s*(\d+)', 1), lambda x: x::INT) AS refs, len(regexp_extract_all(md, '\[illegible\]')) AS marks FROM d),
x AS (SELECT doc_id, list_filter([CASE WHEN coalesce(list_max(refs), 0) > n THEN 'figure reference beyond the figures' END, CASE WHEN len(list_distinct(list_filter(refs, lambda x: x <= n))) < n THEN 'figure never referred to' END,
 CASE WHEN regions <> marks THEN 'illegible count differs' END, CASE WHEN NOT contains(md, upper(name)) THEN 'name not in the text' END,
 CASE WHEN CASE quality WHEN 0 THEN 'poor' ELSE 'good' END = 'poor' AND toxic = 0 THEN 'poor image without retake' END, CASE WHEN toxic = 1 AND quality = 0 THEN 'retake without reason' END], lambda x: x IS NOT NULL) AS p FROM f)"""


@query(PROBLEM_SQL + " SELECT doc_id, array_to_string(p, ',') AS problems FROM x WHERE len(p) > 0")
def page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft rules over documents as pages: figures by their ids, names from their first words, quality from labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    head = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Fig. 2 and [FIGURE "), F.col("n_chars") % 5, F.lit("] "))).otherwise("")
    markdown = F.concat(head, "text")
    figures = F.transform(F.slice(F.array(*map(F.lit, range(3))), 1, (F.col("doc_id") % 4).cast("int")), lambda i: i)
    entities = F.array(F.struct(F.upper(F.split("text", " ")[0]).alias("name")))
    state = F.struct((F.col("toxic") + F.col("doc_id") % 2).alias("illegible_regions"), F.when(F.col("quality") == 0, "poor").otherwise("good").alias("image_quality"), (F.col("toxic") == 1).alias("retake_recommended"), F.when(F.col("quality") == 1, "blurred").otherwise(" ").alias("retake_reason"))
    rows = rows.select("doc_id", markdown.alias("md"), figures.alias("f"), entities.alias("e"), state.alias("q"))
    found = quality.problems(rows, quality.page_rules(F.col("md"), F.col("f"), F.col("e"), F.col("q")))
    return found.filter(F.size("problems") > 0).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars AS n_chars_a, b.n_chars AS n_chars_b, CASE WHEN a.doc_id IS NULL THEN 'b' WHEN b.doc_id IS NULL THEN 'a' ELSE 'both' END AS side
FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, n_chars + doc_id % 2 AS n_chars FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    b = docs.filter("doc_id % 5 <> 0").withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 2)
    return relational.compared(docs.filter("doc_id % 3 <> 0"), b, ["doc_id"], ["n_chars"])


@query("""WITH c AS (SELECT lang, coalesce(sum(n_chars) FILTER (doc_id % 3 <> 0), 0)::BIGINT AS a, coalesce(sum(n_chars) FILTER (doc_id % 5 <> 0), 0)::BIGINT AS b FROM documents GROUP BY lang)
SELECT lang, a, b, round(100.0::DOUBLE * (b - a) / nullif(a, 0), 2) AS change FROM c""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.coalesce(F.sum(F.when(F.col("doc_id") % k != 0, F.col("n_chars"))), F.lit(0))
    both = table(spark, sf_dir, "documents").groupBy("lang").agg(part(3).alias("a"), part(5).alias("b"))
    return both.withColumn("change", F.round(100.0 * (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0)), 2))


@query("""SELECT p_name AS name, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1 EXCEPT SELECT p_name, count(*) FROM part WHERE p_size % 2 = 1 GROUP BY 1""")
def name_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = lambda odd: part.filter(F.col("p_size") % 2 == odd).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return n(0).subtract(n(1))


@query("""SELECT regexp_replace(p_brand, '[0-9]+$', '') AS stem, p_brand, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY stem, regexp_extract(p_brand, '[0-9]+$')::INT LIMIT 20""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", "[0-9]+$", "").alias("stem"), "p_brand").agg(F.count("*").alias("n"))
    return rows.orderBy("stem", F.regexp_extract("p_brand", "[0-9]+$", 0).try_cast("int")).limit(20)


@query("""WITH v AS (SELECT DISTINCT p_name AS entity FROM part WHERE p_size < 25), n AS (SELECT DISTINCT p_name || ' x' AS name FROM part WHERE p_size > 30 UNION SELECT DISTINCT array_to_string(list_reverse(string_split(p_name, ' ')), ' ') FROM part WHERE p_size > 40 UNION SELECT p_name FROM part WHERE p_size = 3)
SELECT n.name, coalesce(e.entity, o.entity, pre.entity) AS entity, CASE WHEN e.entity IS NOT NULL THEN 'exact' WHEN o.entity IS NOT NULL THEN 'order' WHEN pre.entity IS NOT NULL THEN 'prefix' ELSE 'none' END AS match
FROM n LEFT JOIN v e ON e.entity = n.name
LEFT JOIN (SELECT array_to_string(list_sort(string_split(entity, ' ')), ' ') AS k, min(entity) AS entity FROM v GROUP BY 1) o ON o.k = array_to_string(list_sort(string_split(n.name, ' ')), ' ')
LEFT JOIN v pre ON starts_with(n.name, pre.entity || ' ') AND len(string_split(pre.entity, ' ')) >= 2
QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY length(pre.entity) DESC NULLS LAST) = 1""")
def name_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    vocabulary = part.filter("p_size < 25").select(F.col("p_name").alias("entity")).distinct()
    wanted = part.filter("p_size > 30").select(F.concat("p_name", F.lit(" x")).alias("name"))
    wanted = wanted.union(part.filter("p_size > 40").select(F.array_join(F.reverse(F.split("p_name", " ")), " "))).union(part.filter("p_size = 3").select("p_name")).distinct()
    return names.matched(wanted, vocabulary)


GROUPED_SQL = """WITH r AS (SELECT p_size % 7 AS q, lower(p_name) AS name_norm, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'location' WHEN 1 THEN 'item' WHEN 2 THEN 'npc' ELSE 'boss' END AS type, p_brand AS book, p_size AS page, 1 + p_partkey % 3 AS rank, (p_partkey % 10) / 10 AS similarity, p_type AS text FROM part),
b AS (SELECT q, name_norm, rank, similarity, text FROM r QUALIFY row_number() OVER (PARTITION BY q, name_norm ORDER BY rank DESC, similarity DESC, length(text) DESC, text DESC) = 1),
g AS (SELECT q, name_norm, min(name) AS name, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(DISTINCT (book, page)) AS pages, bool_or(type = 'location') AS is_location FROM r GROUP BY 1, 2),
e AS (SELECT g.*, b.rank, b.similarity, b.text, row_number() OVER (PARTITION BY q ORDER BY b.rank DESC, b.similarity DESC, length(b.text) DESC, name, name_norm) AS place FROM g JOIN b USING (q, name_norm))"""


def grouped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as matched names of seven questions."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 4 == 0, "location").when(size % 4 == 1, "item").when(size % 4 == 2, "npc").otherwise("boss")
    rows = table(spark, sf_dir, "part").select((size % 7).alias("q"), F.lower("p_name").alias("name_norm"), F.col("p_name").alias("name"), kind.alias("type"), F.col("p_brand").alias("book"), size.alias("page"), (1 + key % 3).alias("rank"), ((key % 10) / 10).alias("similarity"), F.col("p_type").alias("text"))
    return retrieval.entity_groups(rows)


@query(GROUPED_SQL + " SELECT q, name_norm, name, types, pages, rank, similarity, text, is_location, place FROM e")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_names(spark, sf_dir).withColumns({"types": F.array_join("types", ","), "pages": F.size("pages").cast("long"), "place": F.col("place").cast("long")})


@query(GROUPED_SQL + " SELECT q FROM e WHERE q % 2 = 0 GROUP BY q HAVING count(*) >= 2 AND bool_or(is_location)")
def route_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that get full pages: about a way, with two names or more, one of them a place."""
    groups = grouped_names(spark, sf_dir)
    return retrieval.ready_for_routes(groups.select("q", (F.col("q") % 2 == 0).alias("route")).distinct(), groups)


RATED_SQL = """WITH p AS (SELECT l_orderkey AS item, list({'book': l_linestatus, 'page': l_suppkey} ORDER BY l_linenumber, l_linestatus, l_suppkey) AS pages FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
n AS (SELECT l_orderkey AS item, l_linenumber AS i, l_partkey AS norm, l_returnflag AS book, l_suppkey - 3 AS lo, l_suppkey + l_linenumber AS hi, l_discount > 0.03 AS chapter FROM lineitem WHERE l_tax < 0.03),
x AS (SELECT DISTINCT l_orderkey AS item FROM lineitem), m AS (SELECT DISTINCT l_partkey AS norm, l_linestatus AS book, l_suppkey AS page FROM lineitem WHERE l_linenumber <= 3),
f AS (SELECT x.item, p.pages, exists(SELECT 1 FROM n WHERE n.item = x.item) AS named,
  exists(SELECT 1 FROM n WHERE n.item = x.item AND n.chapter AND n.book = p.pages[1].book AND p.pages[1].page BETWEEN n.lo AND n.hi) AS first,
  exists(SELECT 1 FROM n, (SELECT y.item, unnest(y.pages[2:]) AS r FROM p y) q WHERE n.item = x.item AND q.item = x.item AND n.chapter AND n.book = q.r.book AND q.r.page BETWEEN n.lo AND n.hi) AS later,
  exists(SELECT 1 FROM n JOIN m ON m.norm = n.norm WHERE n.item = x.item AND m.book = p.pages[1].book AND m.page = p.pages[1].page) AS met FROM x LEFT JOIN p USING (item))"""


@query(RATED_SQL + " SELECT item, CASE WHEN pages IS NULL THEN 'missing' WHEN NOT named THEN 'no-npc' WHEN first THEN 'chapter' WHEN later THEN 'chapter+' WHEN met THEN 'npc-page' ELSE 'check' END AS rating FROM f")
def link_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their larger lines as linked pages, lines of little tax as named characters with their chapters."""
    lines = table(spark, sf_dir, "lineitem")
    page = F.struct(F.col("l_linestatus").alias("book"), F.col("l_suppkey").alias("page"))
    chapter = F.struct(F.col("l_returnflag").alias("book"), (F.col("l_suppkey") - 3).alias("first"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("last"))
    items = lines.select(F.col("l_orderkey").alias("item")).distinct()
    pages = lines.filter("l_quantity > 25").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), page.alias("at"))
    npcs = lines.filter("l_tax < 0.03").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("norm"), F.when(F.col("l_discount") > 0.03, chapter).alias("chapter"))
    mentions = lines.filter("l_linenumber <= 3").select(F.col("l_partkey").alias("norm"), page.alias("at"))
    return checklists.rated(items, pages, npcs, mentions)


@query("""SELECT name, count(*) AS uses, row_number() OVER (ORDER BY count(*) DESC, name) AS place FROM (SELECT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)) GROUP BY name""")
def unverified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no entity has, the most used first."""
    part = table(spark, sf_dir, "part")
    known = part.filter("p_size < 3").select(F.col("p_name").alias("name"))
    return quality.unverified(part.select(F.col("p_name").alias("name")), known)


@query("""SELECT l_suppkey % 40 AS page, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS issues, bool_or(l_quantity > 49) AS flag, sum(l_linenumber)::BIGINT AS n,
['high', 'medium', 'low'][max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)] AS quality FROM lineitem GROUP BY 1""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    parts = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("page"), F.col("l_orderkey").alias("part"), F.lit(None).cast("string").alias("title"), level.alias("quality"), (F.col("l_quantity") > 49).alias("flag"), F.array("l_returnflag").alias("issues"), F.col("l_linenumber").cast("long").alias("n"))
    return relational.merged_parts(parts, "page", {"quality": ["high", "medium", "low"]}).select("page", F.array_join("issues", ",").alias("issues"), "flag", "n", "quality")


@query("""WITH p AS (SELECT source AS page, doc_id AS part, doc_id % 4 AS n, n_chars % 3 + 1 AS a FROM documents),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY page ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM p)
SELECT page, part, shift, 'x [FIGURE ' || (a + shift) || '] y [FIGURE ' || (2 + shift) || ': z] [FIGURE' AS markdown FROM s""")
def figure_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a page, numbered figures in their texts: each part's numbers go on where the part before ended."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("x [FIGURE "), F.col("n_chars") % 3 + 1, F.lit("] y [FIGURE 2: z] [FIGURE"))
    return quality.shifted_figures(docs.select(F.col("source").alias("page"), F.col("doc_id").alias("part"), (F.col("doc_id") % 4).alias("figures"), text.alias("markdown"))).select("page", "part", "shift", "markdown")


@query("""SELECT source, n_chars // 1000 AS size, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def page_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("n_chars") / 1000).alias("size")).agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH boxes AS (SELECT DISTINCT l_orderkey AS k, unnest(range(1, 8)) AS box FROM lineitem), used AS (SELECT l_orderkey AS k, l_linenumber AS box, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT b.k, b.box::BIGINT AS box, CASE WHEN u.n IS NULL THEN 'missing' ELSE 'twice' END AS problem FROM boxes b LEFT JOIN used u ON b.k = u.k AND b.box = u.box WHERE u.n IS NULL OR u.n > 1""")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes 1 to 7 of each label that are used never or more than once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("box"))
    boxes = lines.select("k").distinct().select("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("box"))
    used = lines.groupBy("k", "box").agg(F.count("*").alias("n"))
    wrong = boxes.join(used, ["k", "box"], "left").filter("n is null or n > 1")
    return wrong.select("k", "box", F.when(F.col("n").isNull(), "missing").otherwise("twice").alias("problem"))


@query()
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pages drawn by a seed: the same ones for the same seed. Which ones is up to the hash, so no SQL states them."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    return docs.orderBy(F.xxhash64("page", F.lit(7)), "page").limit(20)


TITLED_SQL = """h AS (SELECT source AS book, doc_id AS page, CASE doc_id % 5 WHEN 0 THEN 'Event ' || doc_id WHEN 1 THEN upper(source) || ' AND ALL' WHEN 2 THEN '12' ELSE 'Part ' || doc_id END AS title FROM documents WHERE n_chars > 2000),
k AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY book ORDER BY page) - 1, max(page) OVER (PARTITION BY book)) AS to_page FROM h WHERE NOT starts_with(title, 'Event '))"""


@query(f"WITH {TITLED_SQL} SELECT book, page, title, greatest(page, to_page) AS to_page FROM k WHERE NOT (upper(title) = title AND lower(title) <> title)")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by their headings: events go on with one, titles in capitals end one."""
    key = F.col("doc_id")
    title = F.when(key % 5 == 0, F.concat(F.lit("Event "), key)).when(key % 5 == 1, F.concat(F.upper("source"), F.lit(" AND ALL"))).when(key % 5 == 2, "12").otherwise(F.concat(F.lit("Part "), key))
    heads = table(spark, sf_dir, "documents").filter("n_chars > 2000").select(F.col("source").alias("book"), key.alias("page"), title.alias("title"), F.lit(0).alias("pos"))
    return relational.chapters(heads, "book", "page", "title").select("book", "page", "title", "to_page")


MERGED_SQL = """WITH r AS (SELECT l_suppkey AS page, l_orderkey AS part, l_linenumber * 1000000 + l_partkey AS pos, l_returnflag AS type, 'n' || (l_partkey % 5) AS name, CASE WHEN l_discount > 0.05 THEN 'at ' || l_linenumber END AS location,
  CASE WHEN l_quantity > 30 THEN 'by ' || l_orderkey ELSE '' END AS how, ['t' || (l_orderkey % 3), 't' || (l_linenumber % 4)] AS targets FROM lineitem),
t AS (SELECT page, type, name, target, min((part, pos, i)) AS seat FROM (SELECT *, unnest(targets) AS target, unnest([1, 2]) AS i FROM r) GROUP BY ALL),
c AS (SELECT page, type, name, string_agg(target, ',' ORDER BY seat) AS connects_to FROM t GROUP BY ALL),
m AS (SELECT page, type, name, min((part, pos)) AS seat, arg_min(location, (part, pos)) FILTER (location <> '') AS location, arg_min(how, (part, pos)) FILTER (how <> '') AS how_to_obtain FROM r GROUP BY ALL)
SELECT m.page, row_number() OVER (PARTITION BY m.page ORDER BY seat, m.type, m.name) - 1 AS place, m.type, m.name, location, how_to_obtain, connects_to FROM m JOIN c USING (page, type, name)"""


@query(MERGED_SQL)
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entities of the parts (orders) of pages (suppliers), those of one type and name as one."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_suppkey").alias("page"),
        F.col("l_orderkey").alias("part"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"),
        F.col("l_returnflag").alias("type"),
        F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("name"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.lit("at "), "l_linenumber")).alias("location"),
        F.when(F.col("l_quantity") > 30, F.concat(F.lit("by "), "l_orderkey")).otherwise("").alias("how_to_obtain"),
        F.array(F.concat(F.lit("t"), F.col("l_orderkey") % 3), F.concat(F.lit("t"), F.col("l_linenumber") % 4)).alias("connects_to"),
    )
    found = relational.merged_entities(rows, ["page"], ["part", "pos"])
    return found.withColumn("place", F.col("place").cast("long")).withColumn("connects_to", F.array_join("connects_to", ","))


@query("""WITH e AS (SELECT p_brand AS book, p_size AS page, p_name AS name, p_partkey AS key FROM part), l AS (SELECT DISTINCT a.book, a.name AS source, b.name AS target FROM e a JOIN e b ON b.key = 2 * a.key + 1)
SELECT book, count(*) AS entities, count(DISTINCT name) AS names, count(DISTINCT page) AS pages, coalesce((SELECT count(*) FROM l WHERE l.book = e.book), 0)::BIGINT AS links FROM e GROUP BY book""")
def entity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, distinct names, pages and links of each book."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_size").alias("page"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    b = e.select(F.floor((F.col("key") - 1) / 2).alias("half"), (F.col("key") % 2).alias("odd"), F.col("name").alias("target")).filter("odd = 1")
    links = e.join(b, F.col("key") == F.col("half")).select("book", "name", "target").distinct().groupBy("book").agg(F.count("*").alias("links"))
    counts = e.groupBy("book").agg(F.count("*").alias("entities"), F.countDistinct("name").alias("names"), F.countDistinct("page").alias("pages"))
    return counts.join(links, "book", "left").select("book", "entities", "names", "pages", F.coalesce("links", F.lit(0)).alias("links"))
