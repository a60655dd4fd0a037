"""Queries of retrieval: search, fusion, names, links, routes and budgets, over documents, embeddings and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.functions import numbers, text
from quire.operators import relational, retrieval
from quire.plans.registry import query
from quire.session import table

QUESTION = "Where is the reon of thes and how do I get to the nder"
WORDS_SQL = "('reon'), ('thes'), ('nder')"
CHUNKS_SQL = r"""chunks AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lexeme, 0.4::DOUBLE AS w FROM documents
  UNION ALL SELECT doc_id, lower(lang), 1.0::DOUBLE FROM documents)"""


def chunks_of(docs: DataFrame) -> DataFrame:
    """Lines as chunks: book, page, idx, body; blank lines have no chunk but keep their number."""
    lines = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "lang", F.posexplode(F.split("text", "\n")).alias("idx", "body"))
    return lines.filter(F.length(F.trim("body")) > 0)


def lexemes(spark: SparkSession, question: str = QUESTION) -> DataFrame:
    one = spark.range(1).select(F.col("id").alias("q"), F.lit(question).alias("question"))
    return one.select("q", F.explode(F.transform(text.content_words(F.col("question")), F.lower)).alias("lexeme"))


def lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "lang")
    return retrieval.lexical_top(lexemes(spark), retrieval.postings(docs, {"text": 0.4, "lang": 1.0}), k)


def vectors(spark: SparkSession, sf_dir: str, k: int, seed: int = 7, labels: list[int] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter(F.col("vec_id") == seed).select(F.lit(0).cast("long").alias("q"), F.col("embedding").alias("qv"))
    return retrieval.vector_top(asked, rows.filter(retrieval.in_any(F.col("label"), labels)).withColumnRenamed("vec_id", "key"), k)


LEX_SQL = f"""lex AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (
  SELECT key, round(sum(w), 6) AS score FROM chunks WHERE lexeme IN (SELECT * FROM (VALUES {WORDS_SQL})) GROUP BY key) QUALIFY rank <= 40)"""
VEC_SQL = """vec AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (
  SELECT e.vec_id AS key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) QUALIFY rank <= 40)"""
FUSED_SQL = f"""WITH {CHUNKS_SQL}, {LEX_SQL}, {VEC_SQL},
lists AS (SELECT 'lexical' AS why, key, rank FROM lex UNION ALL SELECT 'vector', key, rank FROM vec),
fused AS (SELECT key, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(why, ',' ORDER BY why) AS why FROM lists GROUP BY key)"""


def fused_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexical(spark, sf_dir, 40).withColumn("why", F.lit("lexical"))
    vec = vectors(spark, sf_dir, 40).withColumn("why", F.lit("vector"))
    return retrieval.rrf(lex.unionByName(vec).select("q", "why", "key", "rank"))


@query(FUSED_SQL + " SELECT key, round(score, 6) AS score, why FROM fused ORDER BY fused.score DESC, key LIMIT 12")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fused_lists(spark, sf_dir).filter("place <= 12")
    return top.select("key", F.round("score", 6).alias("score"), F.array_join("why", ",").alias("why"))


@query("""SELECT e.vec_id AS key, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label IN (1, 3, 5) ORDER BY score DESC, key LIMIT 40""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, 40, labels=[1, 3, 5]).select("key", "score")


@query(f"WITH {CHUNKS_SQL}, {LEX_SQL} SELECT key, score, rank FROM lex")
def lexical_rank_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, 40).select("key", "score", F.col("rank").cast("long").alias("rank"))


@query(FUSED_SQL + """ SELECT f.key, round(f.score * CASE WHEN l.quality = 1 THEN 2.0 WHEN l.doc_id IS NOT NULL THEN 1.5 ELSE 1.0 END, 6) AS score, l.doc_id IS NOT NULL AS boosted
FROM fused f LEFT JOIN labels l ON f.key = l.doc_id""")
def anchor_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"), "quality")
    ranked = retrieval.anchor_boost(fused_lists(spark, sf_dir).withColumn("page", F.col("key")), labels, labels.filter("quality = 1"))
    return ranked.select("key", F.round("score", 6).alias("score"), "boosted")


@query(FUSED_SQL + """, r AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS place FROM fused),
g AS (SELECT r.key, r.place, CASE WHEN r.place <= 30 THEN l.toxic + (r.key % 7) END AS rel FROM r LEFT JOIN labels l ON l.doc_id = r.key)
SELECT key, row_number() OVER (ORDER BY CASE WHEN rel IS NOT NULL THEN 0 ELSE 1 END, -rel, place) AS place FROM g""")
def rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fused_lists(spark, sf_dir)
    given = table(spark, sf_dir, "labels").select(F.lit(0).cast("long").alias("q"), F.col("doc_id").alias("key"), (F.col("toxic") + F.col("doc_id") % 7).cast("double").alias("relevance"))
    return retrieval.rerank_head(fused, given).select("key", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT source AS book, doc_id AS page, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
w AS (SELECT unnest([31, 4, 15]) AS page, unnest([1, 2, 3]) AS ord)
SELECT ord::BIGINT AS ord, book, page, idx::BIGINT AS idx, length(body)::BIGINT AS n FROM (
  SELECT w.ord, c.*, row_number() OVER (PARTITION BY c.page ORDER BY idx) AS r FROM c JOIN w ON c.page = w.page WHERE length(trim(body)) > 0) WHERE r <= 6""")
def focus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = spark.createDataFrame([(1, 31), (2, 4), (3, 15)], "ord long, page long")
    wanted = wanted.join(docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page")), "page")
    return retrieval.page_chunks(wanted, chunks_of(docs)).select("ord", "book", "page", F.col("idx").cast("long").alias("idx"), F.length("body").cast("long").alias("n"))


def entities_of(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_brand").alias("book"), F.col("p_size").alias("page"), F.col("p_name").alias("name"), text.normalized(F.col("p_name")).alias("name_norm"), F.col("p_type").alias("type"))


def asked(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(0, n) for n in names], "q long, norm string")


ENTITY_SQL = r"""e AS (SELECT p_brand AS book, p_size AS page, p_name AS name, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name_norm, p_type AS type FROM part)"""


@query(f"WITH {ENTITY_SQL} SELECT book, page, name, type FROM e WHERE name_norm IN (SELECT min(name_norm) FROM e UNION ALL SELECT max(name_norm) FROM e)")
def entity_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities_of(table(spark, sf_dir, "part"))
    ends = e.agg(F.min("name_norm").alias("a"), F.max("name_norm").alias("b")).select(F.lit(0).cast("long").alias("q"), F.explode(F.array("a", "b")).alias("norm"))
    return retrieval.exact_matches(ends, e).select("book", "page", "name", "type")


TRI_SQL = """tri AS (SELECT name_norm, list_distinct(flatten(list_transform(list_filter(string_split(name_norm, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM (SELECT DISTINCT name_norm FROM n))"""


@query(f"""WITH {ENTITY_SQL}, n AS (SELECT name_norm FROM e UNION SELECT 'coldd widgets' UNION SELECT 'bright gadgt'), {TRI_SQL}
SELECT a.name_norm AS norm, b.name_norm, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
FROM tri a JOIN tri b ON a.name_norm <> b.name_norm WHERE a.name_norm IN ('coldd widgets', 'bright gadgt') AND b.name_norm IN (SELECT name_norm FROM e)
AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.3""")
def trigram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities_of(table(spark, sf_dir, "part"))
    return retrieval.trigram_matches(asked(spark, "coldd widgets", "bright gadgt"), e, 0.3).select("norm", "name_norm", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {ENTITY_SQL}, n AS (SELECT name_norm FROM e UNION SELECT 'cold'), {TRI_SQL},
s AS (SELECT name_norm, len(list_intersect(t, (SELECT t FROM tri WHERE name_norm = 'cold'))) / len(list_distinct(list_concat(t, (SELECT t FROM tri WHERE name_norm = 'cold')))) AS sim FROM tri)
SELECT book, min(name) AS name, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(DISTINCT page) AS pages, round(greatest(CASE WHEN name_norm LIKE 'cold%' THEN 1.0 ELSE 0.0 END, max(sim)), 6) AS score
FROM e JOIN s USING (name_norm) WHERE name_norm LIKE 'cold%' OR sim >= 0.3 GROUP BY book, name_norm ORDER BY score DESC, length(min(name)), min(name), book LIMIT 10""")
def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities_of(table(spark, sf_dir, "part"))
    typed = F.lit("cold")
    sim = text.similarity(text.trigrams(F.col("name_norm")), text.trigrams(typed))
    near = e.select("name_norm").distinct().withColumn("sim", sim).filter((F.col("sim") >= 0.3) | F.col("name_norm").startswith("cold"))
    hits = e.join(near, "name_norm").groupBy("book", "name_norm").agg(F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.countDistinct("page").alias("pages"), F.max("sim").alias("sim"))
    scored = hits.withColumn("score", F.round(F.greatest(F.when(F.col("name_norm").startswith("cold"), 1.0).otherwise(0.0), "sim"), 6))
    return scored.orderBy(F.desc("score"), F.length("name"), "name", "book").limit(10).select("book", "name", "types", "pages", "score")


@query(f"""WITH {ENTITY_SQL}, l AS (SELECT DISTINCT 'b' AS book, a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
f AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT DISTINCT k FROM (SELECT l.t AS k FROM l JOIN f ON l.s = f.k UNION SELECT l.s FROM l JOIN f ON l.t = f.k)""")
def one_hop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    a, b = items.withColumnRenamed("l_partkey", "source"), items.withColumnRenamed("l_partkey", "target")
    # Pairs stay as they come: one_hop keeps those of the hubs and makes them distinct, so that no task gathers them all.
    links = a.join(b, "l_orderkey").filter("source < target").select(F.lit("b").alias("book"), "source", "target")
    nodes = items.select(F.lit("b").alias("book"), F.col("l_partkey").alias("name_norm"), F.lit(1).alias("page")).distinct()
    hubs = items.groupBy("l_partkey").count().orderBy(F.desc("count"), "l_partkey").limit(5).select(F.lit("b").alias("book"), F.col("l_partkey").alias("name_norm"))
    return retrieval.one_hop(hubs, nodes, links).select(F.col("name_norm").alias("k")).distinct()


@query("""WITH f AS (SELECT doc_id AS page, source AS book, 'de' AS name FROM documents WHERE doc_id IN (3, 14, 159)),
r AS (SELECT d.source AS book, d.lang AS region FROM f JOIN documents d ON d.doc_id = f.page UNION SELECT book, name FROM f)
SELECT d.source AS book, d.doc_id AS page, d.lang AS region FROM documents d JOIN r ON d.source = r.book AND d.lang = r.region""")
def region_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("lang").alias("region"))
    found = pages.filter(F.col("page").isin(3, 14, 159)).select("book", "page", F.lit("de").alias("name"))
    return retrieval.region_pages(found, pages)


@query("""WITH c AS (SELECT source AS book, doc_id AS page FROM documents), r AS (SELECT source AS book, doc_id AS page FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
d AS (SELECT c.book, c.page, min(abs(c.page - r.page)) AS distance FROM c LEFT JOIN r ON c.book = r.book GROUP BY ALL)
SELECT book, page, distance FROM d QUALIFY row_number() OVER (PARTITION BY book ORDER BY distance NULLS LAST, page) <= 12""")
def nearest_pages_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("page"))
    return retrieval.nearest_pages(docs, docs.join(bad, "page"))


@query("""WITH p AS (SELECT lang AS endpoint, source AS book, doc_id AS page FROM documents WHERE lang IN ('de', 'es', 'fr')),
x AS (SELECT a.endpoint AS i, b.endpoint AS j, a.book, least(a.page, b.page) AS lo, greatest(a.page, b.page) AS hi FROM p a JOIN p b ON a.book = b.book AND a.endpoint < b.endpoint AND a.page <> b.page),
y AS (SELECT * FROM x WHERE hi - lo <= 24 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY hi - lo, book, lo) = 1)
SELECT DISTINCT book, unnest(range(lo + 1, hi)) AS page FROM y""")
def route_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("de", "es", "fr"))
    return retrieval.route_span(docs.select(F.col("lang").alias("endpoint"), F.col("source").alias("book"), F.col("doc_id").alias("page")))


BUDGET_SQL = """WITH RECURSIVE o AS (SELECT source AS book, doc_id AS page, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
w AS (SELECT book, page, n_chars, r, CASE WHEN n_chars <= 12000 THEN n_chars ELSE 0 END AS used, n_chars <= 12000 AS taken FROM o WHERE r = 1
UNION ALL SELECT o.book, o.page, o.n_chars, o.r, CASE WHEN w.used + o.n_chars <= 12000 THEN w.used + o.n_chars ELSE w.used END, w.used + o.n_chars <= 12000 FROM w JOIN o ON o.book = w.book AND o.r = w.r + 1)"""


@query(BUDGET_SQL + " SELECT book, page, n_chars FROM w WHERE taken")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "n_chars", (-F.col("n_chars")).alias("less"))
    return retrieval.within_budget(docs, 12_000, "book", ["less", "page"], "n_chars").select("book", "page", "n_chars")


@query("""WITH own AS (SELECT d.source AS book, d.doc_id AS page FROM documents d WHERE d.doc_id IN (7, 27, 50, 81)),
span AS (SELECT source AS book, doc_id AS page FROM documents WHERE doc_id IN (27, 47, 67) ),
anchors AS (SELECT source AS book, doc_id AS page FROM documents WHERE doc_id IN (50, 90, 91, 92)),
t AS (SELECT book, page, CASE WHEN book IN (SELECT book FROM span) THEN 0 ELSE 2 END AS tier FROM own
UNION ALL SELECT book, page, 1 FROM span WHERE page NOT IN (SELECT page FROM own)
UNION ALL SELECT book, page, 3 FROM anchors WHERE page NOT IN (SELECT page FROM own) AND page NOT IN (SELECT page FROM span)),
o AS (SELECT t.*, d.n_chars AS tokens, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN 0 ELSE -(t.page % 5)::DOUBLE END, t.book, t.page) AS r FROM t JOIN documents d ON d.doc_id = t.page)
SELECT book, page, tier::INT AS tier, tokens FROM o""")
def route_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("n_chars").alias("tokens"))
    of = lambda *ids: docs.filter(F.col("page").isin(*ids)).select("book", "page")
    scores = docs.select("book", "page", (F.col("page") % 5).cast("double").alias("score"))
    return retrieval.route_pages(of(7, 27, 50, 81), of(27, 47, 67), of(50, 90, 91, 92), scores, docs, 10_000_000).select("book", "page", F.col("tier").cast("int").alias("tier"), "tokens")


@query("""WITH f AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT source AS book, doc_id AS page, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)
SELECT source AS book, doc_id AS page, -1::BIGINT AS idx, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS title, 'page' AS kind FROM documents JOIN f USING (doc_id)
UNION ALL SELECT book, page, idx::BIGINT, CASE WHEN length(body) > 120 THEN substr(body, 1, 119) || '…' ELSE body END, 'chunk' FROM c WHERE length(trim(body)) > 0 AND page NOT IN (SELECT doc_id FROM f)""")
def answer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    full = docs.join(good, "doc_id").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("text").alias("title"), F.col("text").alias("body"))
    chunks = chunks_of(docs).select("book", "page", "idx", F.col("body").alias("title"), "body")
    return retrieval.answer_documents(full, chunks).select("book", "page", F.col("idx").cast("long").alias("idx"), "title", "kind")


@query(r"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, regexp_matches(text, '(?i)\b(from|route|path|way|get to|go to|travel to|reach|head to)\b') AS route FROM q""")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", text.is_route_question(F.col("text")).alias("route"))


@query("""WITH h AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations)
SELECT conv_id, turn, role, coalesce(length(prior), -1)::BIGINT AS prior_chars FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def chat_window_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    last = relational.top_n(turns.withColumn("prior", prior), ["conv_id"], [F.desc("turn")], 6)
    return last.select("conv_id", "turn", "role", F.coalesce(F.length("prior"), F.lit(-1)).cast("long").alias("prior_chars"))


@query(r"""WITH p AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark)
SELECT b.item_id, p.doc_id FROM b JOIN p ON contains(p.t, ' ' || b.t || ' ') WHERE b.t <> ''""")
def quote_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return retrieval.quoted(quotes, docs).select("item_id", F.col("key").alias("doc_id"))


@query(r"""WITH p AS (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)), ' ') || ' ' AS t FROM documents),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM benchmark) WHERE len(w) > 0),
f AS (SELECT item_id, n, [array_to_string(w, ' ')] || list_filter(CASE WHEN n > 8 THEN [array_to_string(w[1:ceil(n * 6 / 10)::INT], ' '), array_to_string(w[1:8], ' '), array_to_string(w[-8:], ' ')] WHEN n > 4 THEN [array_to_string(w[1:5], ' '), array_to_string(w[-4:], ' ')] ELSE [] END, lambda x: length(x) >= 12) AS parts FROM b),
u AS (SELECT item_id, unnest(parts) AS quote, unnest(range(len(parts))) AS fragment FROM f),
m AS (SELECT item_id, doc_id, quote, t FROM u JOIN p ON contains(p.t, ' ' || u.quote || ' ') QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY fragment) = 1)
SELECT item_id, doc_id, len(string_split(quote, ' '))::INT AS words, (len(string_split(t[1:instr(t, ' ' || quote || ' ')], ' ')) - 2)::INT AS at FROM m""")
def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes stand on pages, whole or by a fragment; lines are the pieces."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.split("text", "\n").alias("items"))
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return retrieval.located(quotes, docs).select("item_id", F.col("key").alias("doc_id"), "words", "at")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS name FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(name), '[''‘’]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM l""")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized(F.split("text", "\n")[0]).alias("norm"))


@query("""WITH b AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS g, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (64 - i) ELSE 0 END))::BIGINT AS h FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS other, (bit_count(xor(a.g, b.g)) + bit_count(xor(a.h, b.h)))::BIGINT AS distance FROM b a JOIN b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS rank, lead(distance) OVER (PARTITION BY vec_id ORDER BY distance, other) - distance AS margin FROM d)
SELECT vec_id, other, distance, margin, distance <= 14 AND (margin IS NULL OR margin >= 6) AS same FROM r WHERE rank = 1""")
def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo's nearest page by hash, and its margin over the runner-up. The stated set of photos: ids divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), numbers.sign_bits(F.col("embedding"), bits=64).alias("h"))
    return retrieval.photo_matches(rows.filter("key % 100 = 0"), rows).withColumnRenamed("key", "vec_id")


@query("""WITH a AS (SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem), w AS (SELECT l_partkey FROM a GROUP BY 1 HAVING count(DISTINCT (l_suppkey, l_orderkey)) > 36)
SELECT l_partkey AS name_norm, count(*) AS n FROM a WHERE NOT (l_partkey % 2 = 0 AND l_partkey IN (SELECT l_partkey FROM w)) GROUP BY 1""")
def widespread_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name_norm"), F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("page"), F.when(F.col("l_partkey") % 2 == 0, "trigram").otherwise("exact").alias("match"))
    return retrieval.drop_widespread(rows, 36).groupBy("name_norm").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, text FROM documents), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM d)
SELECT doc_id, count(w) AS n, count(DISTINCT w) AS distinct_words FROM t GROUP BY doc_id""")
def lexeme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return words.filter(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_words"))


@query(FUSED_SQL + """, top AS (SELECT key FROM fused ORDER BY score DESC, key LIMIT 12), full_pages AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT d.source AS book, d.doc_id AS page FROM documents d WHERE d.doc_id IN (SELECT key FROM top UNION SELECT doc_id FROM full_pages)""")
def consulted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages that an answer drew on: full pages and those of chunks."""
    top = fused_lists(spark, sf_dir).filter("place <= 12").select(F.col("key").alias("page"))
    full = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("page"))
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    return pages.join(top.union(full).distinct(), "page", "left_semi").select("book", "page")


@query("""SELECT label, max(round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)) AS best, count(*) AS n FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q GROUP BY label""")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each page's chunks."""
    rows = table(spark, sf_dir, "embeddings")
    asked_ = rows.filter("vec_id = 7").select(F.col("embedding").alias("qv"))
    scored = rows.join(F.broadcast(asked_)).select("label", F.round(numbers.cosine(F.col("embedding"), F.col("qv")), 6).alias("score"))
    return scored.groupBy("label").agg(F.max("score").alias("best"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT key, rank, key // 7 AS page FROM (SELECT vec_id AS key, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 40)
SELECT page, min(rank) AS first_rank, count(*) AS chunks FROM l GROUP BY page ORDER BY first_rank LIMIT 3""")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pages that come first in a ranking of chunks."""
    ranked = vectors(spark, sf_dir, 40).withColumn("page", F.floor(F.col("key") / 7))
    pages = ranked.groupBy("page").agg(F.min("rank").cast("long").alias("first_rank"), F.count("*").alias("chunks"))
    return pages.orderBy("first_rank").limit(3)
