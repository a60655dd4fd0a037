"""Stems, the query grammar, cover density, cells of vectors and hashes, each against a plainer version of its own."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.functions import english, text
from quire.operators import fulltext, hashes, vectors

STEMS = """consign:consign consigned:consign consigning:consign consignment:consign consistency:consist consolatory:consolatori
conspiracy:conspiraci conspirators:conspir constancy:constanc knackeries:knackeri knavish:knavish kneeling:kneel knightly:knight
knitted:knit knotty:knotti knowledge:knowledg hopping:hop hoping:hope cried:cri ties:tie gas:gas this:this kiwis:kiwi gaps:gap
luxuriated:luxuri generically:generic communication:communic relational:relat rational:ration electricity:electr hopefulness:hope
feudalism:feudal happy:happi by:by say:say enjoy:enjoy controlled:control agreed:agre feed:feed sing:sing bed:bed analogy:analog
replacement:replac adoption:adopt probate:probat rate:rate cease:ceas roll:roll dying:die news:news proceed:proceed
skies:sky idly:idl ashes:ash giants:giant"""


def test_stems(spark):
    for pair in STEMS.split():
        word, stem = pair.split(":")
        assert english.stem(word) == stem
    rows = spark.createDataFrame([(["giants", None, "giants", "ashes"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(english.stems("w")).collect()] == [["giant", None, "giant", "ash"], None, []]


def test_content_words_keep_what_is_one_word(spark):
    said = spark.createDataFrame([("Where is the half-giant's Odo's rise, Odo?",)], "s string")
    assert said.select(text.content_words(F.col("s"))).first()[0] == ["half-giant", "Odo", "rise"]
    assert said.select(text.lexical_query(F.lit("how do I get to"))).first()[0] == "how do I get to"


def lexemes(question, stem=True):
    return [(c, t, neg, off, w) for c, t, neg, off, _, w in fulltext.parsed(question, stem)]


def test_grammar():
    assert lexemes("giant ashes") == [(0, 0, False, 0, "giant"), (0, 1, False, 0, "ash")]
    assert lexemes("giant or ashes") == [(0, 0, False, 0, "giant"), (1, 0, False, 0, "ash")]
    assert lexemes("giants -rats") == [(0, 0, False, 0, "giant"), (0, 1, True, 0, "rat")]
    assert lexemes('"queen of the moon"') == [(0, 0, False, 0, "queen"), (0, 0, False, 3, "moon")], "stop words keep their distance"
    assert lexemes("half-giant") == [(0, 0, False, 0, "half-giant"), (0, 0, False, 1, "half"), (0, 0, False, 2, "giant")]
    assert lexemes('-"red door" house') == [(0, 0, True, 0, "red"), (0, 0, True, 1, "door"), (0, 1, False, 0, "hous")]
    assert lexemes('"open end') == [(0, 0, False, 0, "open"), (0, 0, False, 1, "end")]
    assert lexemes("the of or -rat") == [] == lexemes("") == lexemes(None) == lexemes('"" - or or')
    assert lexemes("The or", stem=False) == [(0, 0, False, 0, "the")]


def rank_by_hand(words, question, weight):
    """All stretches of places that hold a clause, the minimal ones of them, and what they count."""
    clauses = {}
    for c, t, neg, off, n, w in fulltext.parsed(question, stem=False):
        clauses.setdefault(c, {}).setdefault((t, neg), []).append((off, w))
    own = {w for terms in clauses.values() for parts in terms.values() for _, w in parts}
    places = [i for i, w in enumerate(words) if w in own]

    def occurs(parts, lo, hi):
        return any(all(lo <= i + off <= hi and i + off < len(words) and words[i + off] == w for off, w in parts) for i in range(lo, hi + 1))

    def holds(terms, lo, hi):
        return all(occurs(parts, lo, hi) for (_, neg), parts in terms.items() if not neg)

    last = len(words) - 1
    whole = [t for t in clauses.values() if holds(t, 0, last) and not any(neg and occurs(p, 0, last) for (_, neg), p in t.items())]
    if not whole:
        return None
    good = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if any(holds(t, places[a], places[b]) for t in whole)]
    least = [(a, b) for a, b in good if not any((x, y) != (a, b) and a <= x and y <= b for x, y in good)]
    rank = 0.0
    for a, b in least:
        size = b - a + 1
        rank += size / sum(1 / weight(places[i]) for i in range(a, b + 1)) / (1 + places[b] - places[a] + 1 - size)
    return round(rank, 6)


@pytest.mark.parametrize("seed", range(3))
def test_cover_density(spark, seed):
    rng = random.Random(seed)
    letters = "a b c d e f".split()
    texts = [[rng.choice(letters) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    asked = ["a", "a b", "a b c", "a or b", 'a "b c"', '"a b" or c d', "a -b", 'c or "a b" -d', "-a", '"a b c"', "a a", 'e -"a b" or f']
    headings = [rng.randrange(0, len(t)) for t in texts]
    rows = [(i, " ".join(t[:h]), " ".join(t[h:])) for i, (t, h) in enumerate(zip(texts, headings))]
    chunks = spark.createDataFrame(rows, "id long, top string, body string")
    index = fulltext.postings(chunks, "id", "top", "body", stem=False)
    questions = spark.createDataFrame(list(enumerate(asked)), "q long, question string")
    want = {}
    for q, question in enumerate(asked):
        for i, words in enumerate(texts):
            score = rank_by_hand(words, question, lambda p, h=headings[i]: 1.0 if p < h else 0.4)
            if score is not None:
                want[q, i] = score
    for few in (100_000, 0):
        found = fulltext.search(questions, index, k=None, stem=False, few=few).collect()
        assert {(r["q"], r["key"]): r["score"] for r in found} == pytest.approx(want, abs=2e-6)
    top = fulltext.search(questions, index, k=2, stem=False).collect()
    for q in range(len(asked)):
        best = sorted(((-s, i) for (p, i), s in want.items() if p == q))[:2]
        assert [r["key"] for r in sorted(top, key=lambda r: r["rank"]) if r["q"] == q] == [i for _, i in best]


@pytest.mark.parametrize("seed", range(3))
def test_covers_of_all_chunks_at_once(seed):
    """the ranks of all chunks of a block in one sweep; those that are sure to be under a bound may go, no others."""
    rng = random.Random(seed)
    letters = "a b c d e".split()
    texts = [[rng.choice(letters) for _ in range(rng.randrange(1, 30))] for _ in range(80)]
    place = {w: i for i, w in enumerate([*letters, "zz"])}
    heavy = [rng.randrange(0, 6) for _ in texts]
    rows = [(i, np.array([place[w] for w in t]), np.arange(1, len(t) + 1), np.array([1.0 if j < h else 0.4 for j in range(len(t))])) for i, (t, h) in enumerate(zip(texts, heavy))]
    rows.append((80, np.array([0, 0, 1]), np.array([1, 1, 2]), np.array([0.4])))
    block = fulltext.Block(pd.DataFrame(rows, columns=["key", "lexemes", "pos", "weights"]).sample(frac=1, random_state=seed), pd.Index(range(len(place))))
    assert block.keys.tolist() == list(range(81))
    weight = lambda i: lambda p: 1.0 if i < 80 and p < heavy[i] else 0.4
    some = ["a", "a b", '"a b c"', '"a a" a', 'a "b c" -d', '"a b" or c d -e', 'e -"a b" or "c c c"', '"a zz" or b', "zz", 'a -"b zz"', '"a b" "b a"']
    for question in some:
        terms = [(*t[:-1], place[t[-1]]) for t in fulltext.parsed(question, stem=False)]
        want = {i: x for i, t in enumerate([*texts, ["a", "b"]]) if (x := rank_by_hand(t, question, weight(i))) is not None}
        assert dict(zip(*map(np.ndarray.tolist, block.covers(terms, -np.inf)))) == pytest.approx(want, abs=1e-6)
        least = sorted(want.values())[len(want) // 2] if want else 0.0
        found = dict(zip(*map(np.ndarray.tolist, block.covers(terms, least))))
        assert {i for i, x in want.items() if x >= least} <= set(found) and all(found[i] == pytest.approx(want[i], abs=1e-6) for i in found)


def test_search_in_english(spark):
    rows = [(1, "Giants", "They live in the north."), (2, "North", "A giant lived here, and another giant."), (3, "Rats", "No big ones."), (4, None, None), (5, "", "The red-hot door of the house")]
    index = fulltext.postings(spark.createDataFrame(rows, "id long, top string, body string"), "id", "top", "body")
    ask = lambda s: [(r["key"], r["score"]) for r in fulltext.search(spark.createDataFrame([(0, s)], "q long, question string"), index).orderBy("rank").collect()]
    assert ask("giant") == [(1, 1.0), (2, 0.8)], "a heading outweighs two mentions"
    assert ask("living giants") == [(2, pytest.approx(0.4 + 0.4 / 4, abs=1e-6)), (1, pytest.approx(2 / (1 + 1 / 0.4) / 2, abs=1e-6))]
    assert ask("red-hot") == [(5, 0.4)] and ask("red") == [(5, 0.4)] and ask('"door of the house"') == [(5, pytest.approx(0.4 / 3, abs=1e-6))]
    assert ask("the of") == [] and ask("giant -another") == [(1, 1.0)]


def test_lexical_rank_english(spark, sf_dir):
    """The registered query against the plain version, with its stems, for every turn and document."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    turns = {r["q"]: r["question"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), text.lexical_query(F.col("text")).alias("question")).collect()}
    places = {}
    for d, t in docs.items():
        own, last = [], 0
        for part, weight in ((t.split("\n")[0], 1.0), (t, 0.4)):
            words = fulltext_words(part)
            own += [(w, last + i, weight) for i, w in words]
            last = max((last + i for i, _ in words), default=last)
        places[d] = own
    want = []
    for q, question in turns.items():
        asked = {w for *_, w in lexemes(question)}
        scores = {d: {} for d in docs}
        for d, own in places.items():
            for w, i, weight in own:
                if w in asked:
                    scores[d][i] = weight
        ranked = sorted((-round(sum(x.values()), 6), d) for d, x in scores.items() if x)[:40]
        want += [(q, d, -s) for s, d in ranked]
    got = plans.queries()["lexical_rank_english"](spark, sf_dir).collect()
    assert {(r["q"], r["doc_id"]): r["score"] for r in got} == pytest.approx({(q, d): s for q, d, s in want}, abs=2e-6)


def fulltext_words(part):
    import re

    out, at = [], 0
    for run in re.findall(r"[^\W_]+(?:-[^\W_]+)*", part.lower()):
        for w in [run, *run.split("-")] if "-" in run else [run]:
            at += 1
            if w not in english.STOPS:
                out.append((at, english.stem(w)))
    return out


def embeddings(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))


def test_cells(spark, tmp_path, capsys):
    """Recall of the query's own parameters, the exact way, and that only cells asked for are read."""
    rows = embeddings(spark, "sf0.1")
    index = vectors.build_cells(rows, str(tmp_path), cells=64)
    asked = rows.filter("key % 100 = 0").select(F.col("key").alias("q"), F.col("v").alias("qv"))
    exact = {(r["q"], r["rank"]): (r["key"], r["score"]) for r in vectors.ranked(vectors.best(asked.withColumnRenamed("qv", "v"), rows, 10), 10).collect()}
    some = {(r["q"], r["key"]) for r in plans.queries()["vector_topk_cells"](spark, "/root/testdata/sf0.1").collect()}
    assert len(some & {(q, k) for (q, _), (k, _) in exact.items()}) / len(exact) >= 0.9
    whole = {(r["q"], r["rank"]): (r["key"], r["score"]) for r in vectors.cell_top(index, asked, 10, probes=2, exact=True).collect()}
    assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in exact.items()}
    assert all(abs(whole[k][1] - v[1]) < 2e-6 for k, v in exact.items())
    vectors.cell_top(index, asked.filter("q = 0"), 10, probes=2).explain("formatted")
    filters = [x for x in capsys.readouterr().out.split("\n") if x.startswith("PartitionFilters")]
    assert filters and all("cell#" in x for x in filters)


def test_cells_of_odd_vectors(spark, tmp_path):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.1 * i, 1.0, -0.3 * i]) for i in range(60)]
    rows += [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0]), (903, [None, 1.0, 0.0]), (904, [float("inf"), 0.0, 1.0])]
    table = spark.createDataFrame(rows, "key long, v array<double>")
    index = vectors.build_cells(table, str(tmp_path), cells=5)
    assert index.sizes["n"].sum() == 360
    asked = spark.createDataFrame([(0, [1.0, 0.1, 0.0]), (1, [0.0, 1.0, 0.0]), (2, None), (3, [1.0, 2.0])], "q long, qv array<double>")
    got = vectors.in_cells(index, spark.createDataFrame([(0, [1.0, 0.1, 0.0], int(c)) for c in index.sizes["cell"]], "q long, v array<double>, cell int"), 3, held=50)
    assert sorted(r["key"] for r in vectors.ranked(got, 3).collect()) == [0, 1, 2]
    exact = vectors.cell_top(index, asked, 4, probes=1, exact=True).collect()
    want = vectors.ranked(vectors.best(asked.select("q", F.col("qv").alias("v")), table, 4), 4).collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, want)) and {r["q"] for r in exact} == {0, 1}
    none = vectors.build_cells(table.filter("false"), str(tmp_path), cells=5)
    assert vectors.cell_top(none, asked, 4).count() == 0


def test_hashes_within_a_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    flipped = lambda h, n: h ^ sum(1 << i for i in rng.sample(range(64), n))
    pages = [(i, flipped(rng.choice(base), rng.randrange(0, 12))) for i in range(150)] + [(200 + i, base[0]) for i in range(30)]
    photos = [(1000 + i, flipped(rng.choice(base), rng.randrange(0, 12))) for i in range(40)]
    signed = lambda rows: spark.createDataFrame([(k, h - (1 << 64) if h >> 63 else h) for k, h in rows], "key long, h long")
    a, b = signed(photos), signed(pages)
    apart = {(p, k): (x ^ y).bit_count() for p, x in photos for k, y in pages}
    for radius, blocks in ((0, 4), (3, 4), (14, 4), (17, 4), (9, 3)):
        got = hashes.within(a, b, radius, blocks).collect()
        assert sorted((r["photo"], r["page"], r["distance"]) for r in got) == sorted((p, k, d) for (p, k), d in apart.items() if d <= radius)
    want = {}
    for p, _ in photos:
        first, second = sorted((d, k) for (q, k), d in apart.items() if q == p)[:2]
        if first[0] <= 14 and second[0] - first[0] >= 6:
            want[p] = (first[1], first[0])
    assert {r["photo"]: (r["page"], r["distance"]) for r in hashes.closest(a, b).collect()} == want
    one = signed(pages[:1])
    assert hashes.closest(signed([(7, pages[0][1])]), one).collect()[0]["distance"] == 0, "no second page, no margin"


def test_photos_by_folio_first(spark):
    pages = spark.createDataFrame([(1, 0), (2, 0xFF), (3, 0xFFF << 40), (4, (0xFFF << 40) + 1)], "key long, h long")
    photos = spark.createDataFrame([(10, 3), (11, 3), (12, 0xFFF << 40), (13, -1), (14, 0xFFF << 40)], "key long, h long")
    numbers = spark.createDataFrame([(10, 2), (10, 2), (10, 77), (11, 99), (12, 3), (12, 4), (14, 3)], "key long, number long")
    got = {r["photo"]: (r["page"], r["how"], r["distance"]) for r in hashes.identified(photos, numbers, pages).collect()}
    # 10: page 1 is nearer, but the folio says 2. 11: no such page, and two are near. 12: two folios, too close. 13: nothing near.
    assert got == {10: (2, "folio", 6), 11: (None, None, None), 12: (None, None, None), 13: (None, None, None), 14: (3, "folio", 0)}


def test_photo_pages_covers_all_cases(spark):
    rows = plans.queries()["photo_pages"](spark, "/root/testdata/sf0.01").collect()
    assert {r["how"] for r in rows} == {"folio", "photo", None}
