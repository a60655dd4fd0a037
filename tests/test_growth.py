"""What a step holds or reads again must not grow beyond its input."""

import numpy as np
from pyspark.sql import functions as F

from quire import plans
from quire.operators import fulltext, hashes, jobs, relational, retrieval, vectors


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_nearest_pages_reads_no_frame_again(spark, capsys):
    pages = spark.createDataFrame([("b", p) for p in range(0, 60)], "book string, page int")
    marks = spark.createDataFrame([("b", p) for p in (7, 31)], "book string, page int")
    found = retrieval.nearest_pages(pages, marks, 5)
    want = sorted((min(abs(p - 7), abs(p - 31)), p) for p in range(60))[:5]
    assert sorted((r["distance"], r["page"]) for r in found.collect()) == want
    assert "currentrow$(), unboundedfollowing$()" not in plan(found, capsys)


def test_ranges_are_expanded_within_a_row(spark, capsys):
    specs = spark.createDataFrame([(1, "1-3, 7 ,2-4 # 99"), (2, "5"), (2, "4-6"), (3, ""), (4, None)], "k int, spec string")
    found = relational.expanded_ranges(specs, "spec", ["k"])
    assert sorted((r["k"], r["pos"], r["page"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 7), (1, 5, 4), (2, 1, 4), (2, 2, 5), (2, 3, 6)]
    assert "Window" not in plan(found, capsys)


def test_a_long_chain_takes_few_rounds(spark):
    rows = spark.createDataFrame([(i, s) for i in range(40) for s in (i, i + 1)], "item long, s long")
    assert {r["chain"] for r in relational.chains(rows, "item", "s", rounds=2).collect()} == {0}


def test_links_are_made_distinct_after_the_hubs(spark, sf_dir, capsys):
    out = plan(plans.queries()["one_hop_links"](spark, sf_dir), capsys)
    assert "keys=[source" not in out and "keys=[target" not in out


def test_jobs_without_a_transaction_meet_nowhere(spark, capsys):
    own = spark.createDataFrame([("a", None, "retake", "running", "t", None, 1), ("b", None, "retake", "confirmed", None, None, 1), ("c", "v", "retake", "discarded", None, None, 1)], "id string, book string, kind string, status string, txn string, stage string, created int")
    found = jobs.next_work(own, spark.createDataFrame([("v",)], "book string"), spark.createDataFrame([("b",)], "id string"), ["book"])
    assert [(r["id"], r["step"]) for r in found.collect()] == [("a", "requeue")]
    assert "LeftOuter" not in plan(found, capsys)


def test_scores_are_held_for_few_questions(spark):
    seen = []

    def score(m, x):
        seen.append(len(m))
        return vectors.cosines(m, x)

    rng = np.random.default_rng(0)
    m, x = rng.normal(size=(600, 4)), rng.normal(size=(50, 4))
    got = vectors.best_pairs(list(range(600)), list(m), list(range(50)), list(x), 3, score)
    assert max(seen) <= 256 and len(got) == 1800
    best = np.argsort(-vectors.cosines(m, x), axis=1, kind="stable")[:, :3]
    assert [got[got["q"] == q]["key"].astype(int).tolist() for q in (0, 599)] == [best[0].tolist(), best[599].tolist()]


def test_pages_of_photos_are_not_broadcast(spark, capsys):
    rows = spark.createDataFrame([(i, i * 977) for i in range(20)], "key long, h long")
    assert "BroadcastHashJoin" not in plan(hashes.within(rows.filter("key < 3"), rows, 4), capsys)


def test_questions_and_chunks_meet_in_blocks(spark, capsys):
    """Blocks of any size give the same; no row is made for a question and a chunk that is not among its best."""
    texts = [(i, "a " * (i % 7) + "b c " * (i % 3) + "d " * (i % 2)) for i in range(60)]
    index = fulltext.postings(spark.createDataFrame(texts, "id long, body string"), "id", None, "body", stem=False)
    asked = spark.createDataFrame([(0, "a or b"), (1, 'a b or "c d" -e'), (2, "d or zz"), (3, "zz")], "q long, question string")
    whole = {(r["q"], r["key"], r["rank"], r["score"]) for r in fulltext.search(asked, index, k=5, stem=False).collect()}
    every = fulltext.search(asked, index, k=None, stem=False).collect()
    assert whole == {(r["q"], r["key"], r["rank"], r["score"]) for r in every if r["rank"] <= 5} and {q for q, *_ in whole} == {0, 1, 2}
    found = fulltext.search(asked, index, k=5, stem=False)
    assert "CoGroup" in plan(found, capsys)
    terms = fulltext.terms(asked.filter("q = 1"), stem=False)
    places = index.select("key", "lexeme", "pos", "weight")
    one, many = ({tuple(r) for r in fulltext.met_in_blocks(terms, places, None, False, asked=1, held=n).collect()} for n in (10_000, 20))
    assert one == many


def test_copies_of_entities_make_no_rows(spark, monkeypatch):
    """an entity that is there many times is followed once, and a name's pages are found once for all questions."""
    counts, own = [], retrieval.kept

    def counted(rows):
        out = own(rows)
        counts[-1].append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(retrieval, "kept", counted)
    entities = spark.createDataFrame([("b", i, "item", f"Hot Bolt mk{i % 3}", f"hot bolt mk{i % 3}") for i in range(9)] + [("b", 20, "region", "Zone 1", "zone 1")], "book string, page int, type string, name string, name_norm string")
    pages = spark.createDataFrame([("b", i, "map" if i == 7 else "text", "zone 1" if i > 5 else None) for i in range(30)], "book string, page int, page_type string, region string")
    links = spark.createDataFrame([("b", "hot bolt mk0", "hot bolt mk2")], "book string, source string, target string")
    asked = spark.createDataFrame([(q, "How do I get from the hot bolt mk0 to hot bolt mkq in zone 1") for q in range(4)], "q long, question string")
    results = []
    for n in (1, 6):
        counts.append([])
        many = entities.join(spark.range(n).withColumnRenamed("id", "copy")).drop("copy")
        found = retrieval.resolve(asked, many, pages, links)
        rows = [found.own, found.hops, found.near, found.span, found.entities.select("q", "name_norm", "rank", "place")]
        results.append([sorted(map(tuple, df.collect())) for df in rows])
    assert results[0] == results[1] and results[0][0] and results[0][1] and results[0][2]
    assert counts[0] == counts[1]
    assert not any({"q", "book", "page", "name_norm"} <= columns for columns, _ in counts[0]), "no row for each page of each name of each question"


def test_copies_meet_questions_once(spark, monkeypatch):
    """questions and rows with equal vectors, and chunks with the same of the words asked for, are met once; none is lost."""
    met, best, blocks = [], vectors.best, fulltext.met_in_blocks

    def counted(asked, rows, *more):
        met.append((asked.count(), rows.count()))
        return best(asked, rows, *more)

    def placed(wanted, places, *more, **named):
        met.append(places.count())
        return blocks(wanted, places, *more, **named)

    monkeypatch.setattr(vectors, "best", counted)
    monkeypatch.setattr(fulltext, "met_in_blocks", placed)
    v = lambda i: [float(i % 4) - 1.5, float(i % 3), 1.0]
    rows = spark.createDataFrame([(i, v(i)) for i in range(96)] + [(96, None)], "key long, embedding array<double>")
    asked = spark.createDataFrame([(q, v(q % 5)) for q in range(20)], "q long, qv array<double>")
    exact = [np.round(vectors.cosines(np.array([v(q % 5)]), np.array([v(i) for i in range(96)]))[0], 6) for q in range(20)]
    for k in (1, 5, 30):
        found = sorted((r["q"], r["rank"], r["key"]) for r in retrieval.vector_top(asked, rows, k, few=2).collect())
        assert found == [(q, r + 1, key) for q in range(20) for r, key in enumerate(np.lexsort((np.arange(96), -exact[q]))[:k].tolist())]
    assert met == [(5, 12)] * 3

    met.clear()
    texts = [(i, ("a b", "b c", "a a c", "d")[i % 4] + f" own{i}") for i in range(40)]
    index = fulltext.postings(spark.createDataFrame(texts, "id long, body string"), "id", None, "body", stem=False)
    asked = spark.createDataFrame([(0, "a or b"), (1, "c"), (2, "b or zz"), (3, "own7")], "q long, question string")
    every = sorted(map(tuple, fulltext.search(asked, index, k=None, stem=False).select("q", "rank", "key", "score").collect()))
    for k in (1, 3, 15):
        assert sorted(map(tuple, fulltext.search(asked, index, k=k, stem=False).select("q", "rank", "key", "score").collect())) == [r for r in every if r[1] <= k]
    assert met[0] == 61 and met[1:] == [7] * 3, "three kinds of chunks with two words each, and own7"


def test_chunks_are_sent_once(spark, monkeypatch):
    """heavy chunks tell what others must reach, which then are sent once for all questions and give few rows; none is lost."""
    texts = [(i, " ".join(f"{w}{(i * s + j) % 7}" for j in range(40 if i % 25 == 0 else 1 + i % 5) for s, w in ((1, "a"), (3, "b"), (5, "own")))) for i in range(300)]
    index = fulltext.postings(spark.createDataFrame(texts, "id long, body string"), "id", None, "body", stem=False)
    said = ["a1 or b2", "a1 or own3 or b0", "zz or a6", "b1 or b2 or b3", "zz"], ["a1 b2", '"a1 b3" or own4 -b0', 'own1 -"b2 own3"', "a1 a2 zz", "-a1"]
    dealt, sent = fulltext.dealt, []

    def counted(questions, rows, k, plain, a, b):
        sent.append((a, rows.count()))
        return dealt(questions, rows, k, plain, a, b)

    monkeypatch.setattr(fulltext, "dealt", counted)
    for plain, lines in zip((True, False), said):
        terms = fulltext.terms(spark.createDataFrame(list(enumerate(lines)), "q long, question string"), stem=False)
        places = index.groupBy("key", "lexeme").agg(F.sum("weight").alias("weight")) if plain else index
        every = [(r["q"], round(r["score"], 6), r["key"]) for r in fulltext.met_in_blocks(terms, places, None, plain).collect()]
        assert len(every) > 300
        for k in (1, 4, 40):
            sent.clear()
            found = fulltext.met_in_blocks(terms, places, k, plain, held=200, first=700)
            rows = [(r["q"], round(r["score"], 6), r["key"]) for r in found.collect()]
            best = lambda some, q: sorted((-s, key) for p, s, key in some if p == q)[:k]
            assert set(rows) <= set(every) and all(best(rows, q) == best(every, q) for q in range(5))
            (_, heavy), (a, light) = sent
            assert heavy + light == 300 and 0 < heavy < 60 and a == 1


def test_places_are_taken_within_rows(spark):
    """chunks whose places are taken within each row give what a row for every place gives."""
    texts = [("Giants of the North", "They live in a half-giant's house."), (None, "a giant, giants and the north"), ("The of", None), ("", ""), ("north north", "living living house")]
    chunks = fulltext.Chunks(spark.createDataFrame([(i, *t) for i, t in enumerate(texts * 2)], "id long, top string, body string"), "id", "top", "body")
    asked = spark.createDataFrame(list(enumerate(["giant or house", "giant north", '"giants of the north" or house -living', "half-giant", "zz"])), "q long, question string")
    for stem in (True, False):
        for k in (None, 2):
            a, b = (sorted(map(tuple, fulltext.search(asked, x, k=k, stem=stem).collect())) for x in (chunks, chunks.postings(stem)))
            assert a == b and {q for q, *_ in a} >= {0, 1, 2, 3}
            assert a == sorted(map(tuple, fulltext.search(asked, chunks, k=k, stem=stem, few=0).collect()))


def test_vectors_go_by_a_slice_of_questions(spark):
    """however few vectors are compared at once, a question of many has k rows and not k of each block; none is lost."""
    v = lambda i: [float(i * 7 % 11) - 5, float(i % 13), 1.0 + i % 3]
    rows = spark.createDataFrame([(i, v(i)) for i in range(100)] + [(100, [1.0, 2.0])], "key long, v array<float>")
    asked = spark.createDataFrame([(q, v(3 * q)) for q in range(20)] + [(20, [2.0, 1.0])], "q long, v array<float>")
    scores = np.round(vectors.cosines(np.array([v(3 * q) for q in range(20)]), np.array([v(i) for i in range(100)])), 6)
    want = {(q, key, round(scores[q][key], 6)) for q in range(20) for key in np.lexsort((np.arange(100), -scores[q]))[:3].tolist()} | {(20, 100, 0.8)}
    for held in (7, 1000):
        found = [(r["q"], r["key"], round(r["score"], 6)) for r in vectors.best(asked, rows, 3, few=2, held=held).collect()]
        assert len(found) == 61 and set(found) == want


def test_pages_of_a_question_are_a_row_a_book(spark, monkeypatch):
    """the hundreds of pages that a question anchors are one row for each book, not one for each page."""
    tables, own = [], retrieval.kept
    monkeypatch.setattr(retrieval, "kept", lambda rows: (tables.append(set(rows.columns)), own(rows))[1])
    entities = spark.createDataFrame([(f"b{i % 2}", i, "item", "Hot Bolt", "hot bolt") for i in range(24)] + [("b0", 30, "npc", "Odd Nut", "odd nut")], "book string, page int, type string, name string, name_norm string")
    pages = spark.createDataFrame([(f"b{i % 2}", i, "map" if i == 7 else "text", "zone 1" if i > 20 else None) for i in range(40)], "book string, page int, page_type string, region string")
    links = spark.createDataFrame([("b0", "odd nut", "hot bolt"), ("b1", "hot bolt", "odd nut")], "book string, source string, target string")
    asked = spark.createDataFrame([(1, "How do I get from the hot bolt to zone 1"), (2, "odd nut")], "q long, question string")
    found = retrieval.resolve(asked, entities, pages, links)
    assert not any({"q", "book", "page"} <= t for t in tables)
    rows = lambda df: sorted((r["q"], r["book"], r["page"]) for r in df.collect())
    bolts = [(f"b{i % 2}", i) for i in range(24)]
    assert [r[1:] for r in rows(found.own) if r[0] == 1 and r[2] < 21] == sorted(b for b in bolts if b[1] < 21)
    assert rows(found.hops) == [(1, "b0", 30)] + sorted((2, *b) for b in bolts)
    every, area = set(rows(found.pages)), set(rows(found.near))
    assert every == set(rows(found.own)) | set(rows(found.hops)) | area | set(rows(found.span)) and area and not area & (set(rows(found.own)) | set(rows(found.hops)))
