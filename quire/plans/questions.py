"""Whole retrievals: questions made of every user turn, over parts as entities, pages and chunks.

Every part is an entity, a chunk and a mention on a page (its brand as book, its size as page); a conversation's turns ask for
two parts each, one of them misspelled in every other turn, where a zone is named as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import fulltext, retrieval
from quire.plans.registry import query
from quire.session import table


def collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities (with key), pages and links."""
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" mk"), F.col("p_partkey") % 50)
    kind = F.when(F.col("p_type") == "LARGE", "location").when(F.col("p_type") == "PROMO", "region").when(F.col("p_type") == "SMALL", "npc").otherwise("item")
    entities = part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("book"), F.col("p_size").alias("page"), kind.alias("type"), name.alias("name"))
    entities = entities.withColumn("name_norm", text.normalized(F.col("name")))
    ten = F.col("page") % 10
    page_type = F.when(ten == 0, "map").when(ten == 1, "walkthrough").when(ten == 2, "index").otherwise("text")
    region = F.when(F.col("page") % 4 == 0, F.concat(F.lit("zone "), F.floor(F.col("page") / 10)))
    pages = entities.select("book", "page").distinct().select("book", "page", page_type.alias("page_type"), region.alias("region"))
    target = entities.select(F.floor((F.col("key") - 1) / 3).alias("third"), F.col("name_norm").alias("target")).filter("third >= 0")
    links = entities.join(target, F.col("key") == F.col("third")).select("book", F.col("name_norm").alias("source"), "target").distinct()
    return entities, pages, links


def asked(spark: SparkSession, sf_dir: str, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions (q, question) and the names of earlier turns (q, norm)."""
    n = entities.count()
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("q"))
    turns = turns.withColumn("a", (F.col("conv_id") * 13 + F.col("turn") * 7) % n).withColumn("b", (F.col("conv_id") * 5 + F.col("turn") * 3 + 1) % n)
    named = lambda c: entities.select(F.col("key").alias(c), F.col("name").alias(f"name_{c}"))
    turns = turns.join(named("a"), "a").join(named("b"), "b")
    way = F.concat(F.lit("How do I get from the "), "name_a", F.lit(" to "), "name_b", F.lit("?"))
    wrong = F.concat(F.expr("substr(name_b, 1, length(name_b) - 1)"), F.lit("q"))
    other = F.concat(F.lit("Tell me about "), "name_a", F.lit(" and "), wrong, F.lit(" in zone "), F.col("conv_id") % 5)
    questions = turns.select("q", F.when(F.col("turn") % 4 == 0, way).otherwise(other).alias("question"))
    before = F.lag("name_a").over(Window.partitionBy("conv_id").orderBy("turn"))
    prior = turns.select("q", text.normalized(before).alias("norm")).filter("norm is not null")
    return questions, prior


#: Names in questions, as the operators state them: exact, else fuzzy; the spans that stand; regions and earlier names.
RESOLVED = r"""
n AS (SELECT count(*) AS n FROM part),
e AS (
  SELECT p_partkey AS key, p_brand AS book, p_size AS page, p_name || ' mk' || (p_partkey % 50) AS name, name AS name_norm,
    CASE p_type WHEN 'LARGE' THEN 'location' WHEN 'PROMO' THEN 'region' WHEN 'SMALL' THEN 'npc' ELSE 'item' END AS type FROM part),
pages_ AS (
  SELECT DISTINCT book, page, CASE page % 10 WHEN 0 THEN 'map' WHEN 1 THEN 'walkthrough' WHEN 2 THEN 'index' ELSE 'text' END AS page_type,
    CASE WHEN page % 4 = 0 THEN 'zone ' || (page // 10) END AS region FROM e),
links AS (SELECT DISTINCT e.book, e.name_norm AS source, t.name_norm AS target FROM e JOIN e t ON t.key > 0 AND (t.key - 1) // 3 = e.key),
u AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS q, a.name AS a, b.name AS b FROM conversations, n, e a, e b
  WHERE role = 'user' AND a.key = (conv_id * 13 + turn * 7) % n.n AND b.key = (conv_id * 5 + turn * 3 + 1) % n.n),
questions AS (
  SELECT q, turn % 4 = 0 AS route, CASE WHEN turn % 4 = 0 THEN 'How do I get from the ' || a || ' to ' || b || '?'
    ELSE 'Tell me about ' || a || ' and ' || b[:-2] || 'q in zone ' || (conv_id % 5) END AS question FROM u),
prior AS (SELECT * FROM (SELECT q, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS norm FROM u) WHERE norm IS NOT NULL),
w AS (SELECT q, question, regexp_extract_all(question, '[\p{L}\p{N}]+') AS w FROM questions),
grams AS (
  SELECT q, question, w, s, s + k AS t, w[s + 1:s + k] AS g FROM w, (SELECT unnest(range(1, 5)) AS k), (SELECT unnest(range(0, 20)) AS s)
  WHERE s + k <= len(w)),
stops AS (SELECT unnest(['how', 'do', 'i', 'get', 'from', 'the', 'to', 'tell', 'me', 'about', 'and', 'in']) AS word),
spans AS (
  SELECT q, lower(array_to_string(g, ' ')) AS norm, array_to_string(g, ' ') AS text, s, t, len(g) > 1 AND length(norm) >= 8 AS fuzzy FROM grams
  WHERE lower(g[1]) NOT IN (FROM stops) AND lower(g[-1]) NOT IN (FROM stops) AND (len(g) > 1 OR length(g[1]) >= 3)
  UNION ALL SELECT q, lower(array_to_string(w, ' ')), question, 0, len(w), true FROM w),
candidates AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY q, norm ORDER BY t - s = 0, t - s, s) = 1),
known AS (SELECT e.*, page_type, region FROM e JOIN pages_ USING (book, page)),
names AS (SELECT DISTINCT name_norm FROM e),
exact AS (SELECT c.q, c.norm FROM candidates c JOIN names ON names.name_norm = c.norm),
loose AS (SELECT q, norm FROM candidates c WHERE fuzzy AND NOT EXISTS (FROM exact x WHERE x.q = c.q AND x.norm = c.norm)),
strings AS (SELECT DISTINCT norm AS s FROM loose UNION SELECT name_norm FROM names),
tri AS (SELECT s, list_distinct(flatten(list_transform(string_split(s, ' '), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) AS t FROM strings),
parts AS (SELECT s, len(t) AS n, unnest(t) AS tri FROM tri),
alike AS (
  SELECT a.s AS norm, b.s AS name_norm, count(*) AS held, any_value(a.n) AS na, any_value(b.n) AS nb FROM parts a JOIN parts b USING (tri)
  WHERE a.s IN (SELECT norm FROM loose) AND b.s IN (FROM names) AND a.s <> b.s GROUP BY a.s, b.s
  HAVING held / (na + nb - held) >= 0.6),
fuzzy_ AS (
  SELECT l.q, l.norm AS matched, k.*, held / (na + nb - held) AS similarity FROM loose l JOIN alike a ON a.norm = l.norm JOIN known k ON k.name_norm = a.name_norm),
wide AS (SELECT q, name_norm FROM fuzzy_ GROUP BY ALL HAVING count(DISTINCT (book, page)) > 40),
found AS (
  SELECT x.q, x.norm AS matched, k.book, k.page, k.page_type, k.type, k.name, k.name_norm, 1.0 AS similarity, 3 AS rank FROM exact x JOIN known k ON k.name_norm = x.norm
  UNION ALL SELECT q, matched, book, page, page_type, type, name, name_norm, similarity, 1 FROM fuzzy_ f WHERE NOT EXISTS (FROM wide w WHERE w.q = f.q AND w.name_norm = f.name_norm)
  UNION ALL SELECT p.q, p.norm, k.book, k.page, k.page_type, k.type, k.name, k.name_norm, 1.0, 2 FROM prior p JOIN known k ON k.name_norm = p.norm
  UNION ALL SELECT c.q, c.norm, g.book, g.page, g.page_type, 'region', g.region, g.region, 1.0, 3 FROM candidates c JOIN pages_ g ON g.region = c.norm),
best AS (SELECT q, matched AS norm, max(rank) = 3 AS sure FROM found WHERE rank <> 2 GROUP BY ALL),
placed AS (SELECT b.*, c.s, c.t FROM best b JOIN candidates c ON c.q = b.q AND c.norm = b.norm),
fair AS (SELECT * FROM placed x WHERE sure OR NOT EXISTS (FROM placed y WHERE y.q = x.q AND y.sure AND x.s <= y.s AND y.t <= x.t AND x.t - x.s > y.t - y.s)),
kept AS (SELECT * FROM fair x WHERE NOT EXISTS (FROM fair y WHERE y.q = x.q AND y.sure >= x.sure AND y.s <= x.s AND x.t <= y.t AND y.t - y.s > x.t - x.s)),
rows_ AS (
  SELECT f.*, CASE WHEN f.rank = 2 THEN f.name ELSE coalesce(c.text, f.matched) END AS text FROM found f LEFT JOIN candidates c ON c.q = f.q AND c.norm = f.matched
  WHERE page_type <> 'index' AND (f.rank = 2 OR EXISTS (FROM kept k WHERE k.q = f.q AND k.norm = f.matched))),
tops AS (SELECT q, name_norm, rank, similarity, text FROM rows_ QUALIFY row_number() OVER (PARTITION BY q, name_norm ORDER BY rank DESC, similarity DESC, length(text) DESC, text DESC) = 1),
groups AS (
  SELECT r.q, r.name_norm, arg_min(r.name, (r.book, r.page, r.name)) AS name, string_agg(DISTINCT r.type, ',' ORDER BY r.type) AS types,
    count(DISTINCT (r.book, r.page)) AS pages, any_value(t.rank) AS rank, any_value(t.similarity) AS similarity, any_value(t.text) AS text
  FROM rows_ r JOIN tops t ON t.q = r.q AND t.name_norm = r.name_norm GROUP BY r.q, r.name_norm)
"""


def resolved(spark: SparkSession, sf_dir: str) -> retrieval.Anchors:
    entities, pages, links = collection(spark, sf_dir)
    questions, prior = asked(spark, sf_dir, entities)
    return retrieval.resolve(questions, entities.drop("key"), pages, links, prior)


@query("WITH " + RESOLVED + """SELECT q, name_norm, types, pages, rank::INT AS rank, round(similarity, 6)::DOUBLE AS similarity, text,
  row_number() OVER (PARTITION BY q ORDER BY rank DESC, similarity DESC, length(text) DESC, name, name_norm) AS place FROM groups""")
def resolve_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the questions of all conversations speak of."""
    entities, pages, _ = collection(spark, sf_dir)
    questions, prior = asked(spark, sf_dir, entities)
    found = retrieval.names_in(questions, entities.drop("key"), pages, prior).entities
    return found.select(
        "q",
        "name_norm",
        F.array_join("types", ",").alias("types"),
        F.size("pages").cast("long").alias("pages"),
        "rank",
        F.round("similarity", 6).alias("similarity"),
        "text",
        F.col("place").cast("long").alias("place"),
    )


ANCHORS = RESOLVED + r""",
spots AS (SELECT DISTINCT r.q, r.name_norm, r.book, r.page, r.page_type, contains(g.types, 'region') AS wide FROM rows_ r JOIN groups g ON g.q = r.q AND g.name_norm = r.name_norm),
chosen AS (
  SELECT *, NOT wide OR CASE WHEN bool_or(page_type = 'map') OVER (PARTITION BY q, name_norm) THEN page_type = 'map'
    ELSE row_number() OVER (PARTITION BY q, name_norm ORDER BY book, page) = 1 END AS mine FROM spots),
own AS (SELECT DISTINCT q, book, page FROM chosen WHERE mine),
near_names AS (SELECT DISTINCT q, name_norm FROM chosen WHERE NOT wide),
hop_names AS (
  SELECT f.q, l.book, l.target AS name_norm FROM near_names f JOIN links l ON l.source = f.name_norm
  UNION SELECT f.q, l.book, l.source FROM near_names f JOIN links l ON l.target = f.name_norm),
hops AS (SELECT DISTINCT h.q, k.book, k.page FROM hop_names h JOIN known k ON k.book = h.book AND k.name_norm = h.name_norm),
around AS (SELECT g.q, k.book, k.page, k.type, k.name FROM groups g JOIN questions USING (q) JOIN known k ON k.name_norm = g.name_norm WHERE route),
regions AS (
  SELECT DISTINCT a.q, a.book, p.region FROM around a JOIN pages_ p ON p.book = a.book AND p.page = a.page WHERE p.region IS NOT NULL
  UNION SELECT q, book, name FROM around WHERE type = 'region'),
area AS (
  SELECT q, book, page FROM chosen WHERE NOT mine
  UNION SELECT r.q, p.book, p.page FROM regions r JOIN pages_ p ON p.book = r.book AND p.region = r.region),
rest AS (SELECT q, book, page FROM area EXCEPT (SELECT q, book, page FROM own UNION SELECT q, book, page FROM hops)),
near AS (
  SELECT r.q, r.book, r.page FROM rest r LEFT JOIN own o ON o.q = r.q AND o.book = r.book GROUP BY r.q, r.book, r.page
  QUALIFY row_number() OVER (PARTITION BY r.q, r.book ORDER BY min(abs(o.page - r.page)) NULLS LAST, r.page) <= 12),
walks AS (SELECT *, bool_or(page_type = 'walkthrough') OVER (PARTITION BY q, name_norm) AS walked FROM chosen WHERE NOT wide),
ends AS (SELECT DISTINCT q, name_norm, book, page FROM walks JOIN questions USING (q) WHERE route AND (NOT walked OR page_type = 'walkthrough')),
pairs AS (
  SELECT a.q, a.name_norm AS i, b.name_norm AS j, a.book, least(a.page, b.page) AS lo, greatest(a.page, b.page) AS hi
  FROM ends a JOIN ends b ON a.q = b.q AND a.book = b.book AND a.name_norm < b.name_norm AND a.page <> b.page WHERE abs(a.page - b.page) <= 24),
closest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q, i, j ORDER BY hi - lo, book, lo) = 1),
span AS (SELECT DISTINCT q, book, unnest(range(lo + 1, hi)) AS page FROM closest),
anchors AS (SELECT q, book, page FROM own UNION SELECT q, book, page FROM hops UNION SELECT q, book, page FROM near UNION SELECT q, book, page FROM span)
"""


@query("WITH " + ANCHORS + """SELECT 'own' AS kind, q, book, page::INT AS page FROM own UNION ALL SELECT 'hop', q, book, page::INT FROM hops
UNION ALL SELECT 'near', q, book, page::INT FROM near UNION ALL SELECT 'span', q, book, page::INT FROM span""")
def anchor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the questions of all conversations anchor, by why they do."""
    found = resolved(spark, sf_dir)
    kinds = {"own": found.own, "hop": found.hops, "near": found.near, "span": found.span}
    rows = [df.select(F.lit(k).alias("kind"), "q", "book", F.col("page").cast("int").alias("page")) for k, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


RETRIEVED = ANCHORS + r""",
v AS (SELECT count(*) AS n FROM embeddings),
vector_ AS (
  SELECT q, e.key, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score
  FROM questions, v, e, embeddings x, embeddings y WHERE x.vec_id = q % v.n AND y.vec_id = e.key % v.n),
vector_top AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM vector_ QUALIFY rank <= 40),
content AS (SELECT DISTINCT q, lower(unnest(w)) AS word FROM w),
said AS (SELECT q, word FROM content WHERE word NOT IN (FROM stops) AND length(word) >= 2),
tokens AS (
  SELECT key, word, count(*) FILTER (h) * 1.0 + count(*) FILTER (NOT h) * 0.4 AS weight FROM (
    SELECT key, unnest(string_split(name_norm, ' ')) AS word, true AS h FROM e
    UNION ALL SELECT p_partkey, unnest(string_split(lower(p_type) || ' ' || p_name || ' mk' || (p_partkey % 50), ' ')), false FROM part) GROUP BY ALL),
lexical_ AS (SELECT q, key, round(sum(weight), 6) AS score FROM said JOIN tokens USING (word) GROUP BY ALL),
lexical_top AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM lexical_ QUALIFY rank <= 40),
lists AS (SELECT q, key, rank, 'lexical' AS why FROM lexical_top UNION ALL SELECT q, key, rank, 'vector' FROM vector_top),
fused AS (SELECT q, key, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(why, ',' ORDER BY why) AS why FROM lists GROUP BY q, key),
boosted AS (
  SELECT f.q, f.key, f.score * CASE WHEN o.q IS NOT NULL THEN 2.0 WHEN a.q IS NOT NULL THEN 1.5 ELSE 1.0 END AS score,
    f.why || CASE WHEN o.q IS NOT NULL OR a.q IS NOT NULL THEN ',anchor' ELSE '' END AS why
  FROM fused f JOIN e USING (key) LEFT JOIN own o ON o.q = f.q AND o.book = e.book AND o.page = e.page
  LEFT JOIN anchors a ON a.q = f.q AND a.book = e.book AND a.page = e.page)
"""


def retrieved(spark: SparkSession, sf_dir: str) -> retrieval.Retrieved:
    entities, pages, links = collection(spark, sf_dir)
    questions, prior = asked(spark, sf_dir, entities)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = rows.count()
    by = lambda c: F.pmod(F.col(c), F.lit(n)) == F.col("vec_id")
    questions = questions.join(rows, by("q")).select("q", "question", F.col("embedding").alias("qv"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"))
    body = F.concat_ws(" ", F.lower("kind"), "name")
    chunks = entities.join(part, "key").join(rows, by("key")).select("key", "book", "page", F.lit(0).alias("idx"), "name", body.alias("body"), "embedding")
    index = fulltext.Chunks(chunks, "key", "name", "body")
    return retrieval.retrieve(questions, chunks, index, entities.drop("key"), pages.withColumn("tokens", F.lit(1000)), links, prior=prior)


@query("WITH " + RETRIEVED + """SELECT q, key, round(score, 6) AS score, why, row_number() OVER (PARTITION BY q ORDER BY boosted.score DESC, key) AS place
FROM boosted QUALIFY place <= 12""")
def retrieve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve chunks for every question: names resolved, both searches fused, pages that the names anchor raised."""
    found = retrieved(spark, sf_dir).chunks
    return found.select("q", "key", F.round("score", 6).alias("score"), F.array_join("why", ",").alias("why"), F.col("place").cast("long").alias("place"))
