"""Names of characters in tiers, chapters, merges of parts, cascades, journals and small helpers, by stated results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers, text
from quire.operators import art, art_reports, checklists, chunking, names, relational, retrieval
from quire.sources import pages, tables


def characters(spark):
    npcs = [("ranni", "Ranni"), ("iron fist alexander", "Iron Fist Alexander"), ("jolán", "Jolán"), ("blaidd the half wolf", "Blaidd the Half-Wolf"), ("knight bernahl", "Knight Bernahl"), ("knight diallos", "Knight Diallos"), ("ranni the witch", "Ranni the Witch"), ("sorceress sellen", "Sorceress Sellen")]
    chapters = [("v1", "Ranni the Witch", 10, 20), ("v1", "Alexander, Warrior Jar", 30, 34), ("v2", "Alexander/Jar", 3, 9), ("v1", "Sellen", 40, 44), ("v1", "Varré", 50, 51)]
    mentions = [("ranni", "v1", 12), ("iron fist alexander", "v2", 4), ("iron fist alexander", "v2", 5), ("iron fist alexander", "v1", 31)]
    return (
        spark.createDataFrame(npcs, "norm string, entity string"),
        spark.createDataFrame(chapters, "book string, title string, lo int, hi int"),
        spark.createDataFrame(mentions, "norm string, book string, page int"),
    )


def test_characters_in_tiers(spark):
    npcs, chapters, mentions = characters(spark)
    asked = ["Ranni", "JOLAN", "Alexander", "Blaidd", "Knight", "Sellen", "Sorceress Selen", "Nobody", "The Jar", "Half-Wolf", "Witch", "Old Friend"]
    aliases = spark.createDataFrame([("the jar", "Iron Fist Alexander"), ("old friend", "No Such One")], "fold string, target string")
    wanted = spark.createDataFrame([(n,) for n in asked], "name string")
    got = {r["name"]: r for r in names.resolved_characters(wanted, npcs, chapters, mentions, aliases).collect()}
    assert {n: (r["norm"], r["match"]) for n, r in got.items()} == {
        "Ranni": ("ranni", "exact"),
        "JOLAN": ("jolán", "accent"),
        "Alexander": ("iron fist alexander", "word"),
        "Blaidd": ("blaidd the half wolf", "word"),
        "Knight": (None, "none"),
        "Sellen": ("sorceress sellen", "word"),
        "Sorceress Selen": ("sorceress sellen", "close"),
        "Nobody": (None, "none"),
        "The Jar": ("iron fist alexander", "alias"),
        "Half-Wolf": ("blaidd the half wolf", "word"),
        "Witch": ("ranni the witch", "chapter"),
        "Old Friend": (None, "none"),
    }
    chapter = {n: r["chapter"] and (r["chapter"]["book"], r["chapter"]["title"], r["chapter"]["lo"], r["chapter"]["hi"]) for n, r in got.items()}
    assert chapter["Ranni"] == ("v1", "Ranni the Witch", 10, 20), "a title that holds the name"
    assert chapter["Alexander"] == ("v2", "Alexander/Jar", 3, 9), "of two heads inside the name the one that mentions it more"
    assert chapter["Sellen"] == ("v1", "Sellen", 40, 44) and chapter["Blaidd"] is None
    other = spark.createDataFrame([("ranni", "Varre"), ("sorceress sellen", "No such chapter")], "fold string, title string")
    got = {r["name"]: r["chapter"] and r["chapter"]["title"] for r in names.resolved_characters(wanted, npcs, chapters, mentions, None, other).collect()}
    assert got["Ranni"] == "Varré" and got["Sellen"] is None and got["The Jar"] is None


def test_chapters_by_headings(spark):
    heads = [("v", 1, "Ranni"), ("v", 5, "Event 5"), ("v", 9, "RANNI AND HER VASSALS"), ("v", 12, "Blaidd"), ("v", 12, "Iji"), ("v", 30, "Eventide"), ("w", 2, "12")]
    rows = spark.createDataFrame([(*h, i) for i, h in enumerate(heads)], "book string, page int, title string, pos int")
    got = {(r["title"], r["page"], r["to_page"]) for r in relational.chapters(rows, "book", "page", "title").collect()}
    assert got == {("Ranni", 1, 8), ("Blaidd", 12, 12), ("Iji", 12, 29), ("Eventide", 30, 30), ("12", 2, 2)}


def test_entities_of_parts_are_merged(spark):
    rows = [(1, 1, 0, "npc", "A", None, "x", ["t1", "t2"]), (1, 1, 1, "item", "A", "", None, []), (1, 2, 0, "npc", "A", "here", "y", ["t2", "t3"]), (1, 2, 1, "npc", "B", None, None, None), (2, 1, 0, "npc", "A", "z", None, ["q"])]
    table = spark.createDataFrame(rows, "page int, part int, pos int, type string, name string, location string, how_to_obtain string, connects_to array<string>")
    got = [tuple(r) for r in relational.merged_entities(table, ["page"], ["part", "pos"]).orderBy("page", "place").collect()]
    assert got == [(1, 0, "npc", "A", "here", "x", ["t1", "t2", "t3"]), (1, 1, "item", "A", None, None, []), (1, 2, "npc", "B", None, None, None), (2, 0, "npc", "A", "z", None, ["q"])]
    parts = spark.createDataFrame([(1, 1, "other", None, ""), (1, 2, "map", "C", "R"), (1, 3, "npc", "D", "S"), (2, 1, "other", None, None)], "page int, part int, page_type string, chapter string, region string")
    assert sorted(map(tuple, relational.page_kind(parts, ["page"], ["part"]).collect())) == [(1, "map", "C", "R"), (2, "other", None, None)]


def test_keys_come_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(target, spark.createDataFrame([(2, "c"), (None, "n")], "id int, v string"), ["id"]).collect()), key=str) == [(1, "a"), (2, "c"), (None, "n")]
    for twice in ([(2, "c"), (2, "d")], [(None, "c"), (None, "d")]):
        with pytest.raises(Exception, match="a key comes twice"):
            tables.upsert(target, spark.createDataFrame(twice, "id int, v string"), ["id"]).collect()


def test_children_follow_their_group(spark):
    spreads = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "book string, page int, v string")
    art = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3)], "book string, page int, id int")
    new = spark.createDataFrame([("a", 1, "new"), ("c", 9, "new")], "book string, page int, v string")
    come = spark.createDataFrame([("a", 1, 7), ("b", 2, 8)], "book string, page int, id int")
    got, children = tables.replace_cascade(spreads, new, [(art, come)], ["book", "page"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "new"), ("b", 2, "old"), ("c", 9, "new")]
    assert sorted(map(tuple, children.collect())) == [("a", 1, 7), ("b", 2, 3)], "art of a spread that does not come stays, and none is added to it"


def test_journals(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "run1.jsonl").write_text('{"page": 1, "status": "ok", "at": 1}\nbroken\n{"page": 1, "status": "failed", "at": 9}\n{"page": 2, "status": "failed", "at": 2}\n')
    (tmp_path / "x" / "run2.jsonl").write_text('{"page": 1, "status": "ok", "at": 5}\n{"page": null, "status": "ok", "at": 8}\n')
    (tmp_path / "notes.txt").write_text("{}")
    log = pages.read_journals(spark, str(tmp_path), "page int, status string, at int")
    assert log.count() == 5 and {r["file"] for r in log.select("file").distinct().collect()} == {"run1.jsonl", "run2.jsonl"}
    assert [tuple(r) for r in pages.last_ok(log).select("page", "at", "file").collect()] == [(1, 5, "run2.jsonl")]
    plain = pages.read_log(spark, str(tmp_path / "run1.jsonl"), "page int, status string, at int")
    assert plain.count() == 3


def test_files_by_their_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"one")
    (tmp_path / "in" / "b.png").write_bytes(b"two")
    got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in pages.binary_hashes(spark, str(tmp_path)).collect()}
    assert got == {n: (3, hashlib.sha256(b).hexdigest()) for n, b in (("a.jpg", b"one"), ("b.png", b"two"))}
    assert pages.binary_hashes(spark, str(tmp_path), "*.png").count() == 1


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_small_helpers(spark):
    assert one(spark, text.safe_name(F.lit("../a b/ç (1).JPG"))) == "_1_.JPG"
    assert one(spark, text.label_key(F.lit("Vol. 1 \t"))) == "vol1"
    assert one(spark, text.html_escape(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    mark = lambda a, b: one(spark, text.marked(F.lit("a<b 'c'"), F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert mark(1, 3) == "a<mark>&lt;b</mark> &#39;c&#39;" and mark(None, None) == "a&lt;b &#39;c&#39;" and mark(0, 7) == "<mark>a&lt;b &#39;c&#39;</mark>"
    at = F.timestamp_seconds(F.lit(1_700_000_000))  # 22:13:20 in UTC
    assert one(spark, text.local_date(at, "Asia/Tokyo")) == "2023-11-15" and one(spark, text.local_date(at, "America/New_York")) == "2023-11-14"
    grey = [200 if i % 3 == 0 else 10 for i in range(64)]
    want = int("".join("1" if v > sum(grey) / 64 else "0" for v in grey), 2)
    assert one(spark, numbers.brightness_hash(F.lit(grey))) == want - (1 << 64) and one(spark, numbers.brightness_hash(F.lit([5] * 64))) == 0
    assert one(spark, numbers.aspect_off(F.lit(110), F.lit(100), F.lit(10), F.lit(10))) == pytest.approx(0.1)
    assert one(spark, text.token_count(F.lit("It's 2 words-or 5?"))) == 9
    assert chunking.embedding_input("A > B", "text") == "A > B\n\ntext"
    assert one(spark, numbers.cache_header(F.lit("v1"), F.lit("v1"))) == "private, max-age=31536000, immutable"
    assert one(spark, numbers.cache_header(F.lit("v1"), F.lit("v2"))) == "no-cache" == one(spark, numbers.cache_header(F.lit(None).cast("string"), F.lit(None).cast("string")))
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, numbers.contained_share(box(0, 0, 2, 2), box(1, 0, 9, 9))) == 0.5
    assert one(spark, numbers.contained_share(box(0, 0, 2, 2), box(5, 5, 9, 9))) == 0.0
    assert one(spark, numbers.contained_share(box(1, 1, 1, 1), box(0, 0, 9, 9))) is None
    assert one(spark, checklists.slug(F.lit("Élan  Vitál's Rise"))) == "elan-vitals-rise"
    spans = one(spark, checklists.bold_spans(F.lit("take **Blackguard, Millicent,** to **D, Hunter of the Dead** and **Patches'** not ** . **")))
    assert [(s["whole"], s["parts"]) for s in spans] == [("Blackguard, Millicent", ["Blackguard", "Millicent"]), ("D, Hunter of the Dead", ["D", "Hunter of the Dead"]), ("Patches", ["Patches"])]
    tiers = [spark.createDataFrame(rows, "name string, entity string") for rows in ([("a", "A1")], [("a", "A2"), ("b", "B2")])]
    got = names.resolved(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), tiers).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "A1", 0), ("b", "B2", 1), ("c", None, None)]


def test_titles_of_persons(spark):
    asked = {"Malenia, Blade of Miquella": {"malenia"}, "Ranni the Witch": {"ranni", "witch", "the witch"}, "Queen of the Full Moon": {"queen", "queen of"}, "Knight Bernahl": {"bernahl"}, "Ranni": set(), "": set(), None: None}
    rows = spark.createDataFrame([(n,) for n in asked], "name string")
    got = {r["name"]: r["f"] and set(r["f"]) for r in rows.select("name", art.forms(F.col("name")).alias("f")).collect()}
    assert got["Malenia, Blade of Miquella"] >= {"malenia"} and "miquella" not in got["Malenia, Blade of Miquella"], "of a name with of only its beginning"
    assert got["Ranni the Witch"] == asked["Ranni the Witch"] and got["Queen of the Full Moon"] == asked["Queen of the Full Moon"]
    assert got["Knight Bernahl"] == {"bernahl"} and not got["Ranni"] and not got[""]


def test_subjects(spark):
    rows = [(1, "ranni", ["npc"], 3, 1), (1, "staff", ["item", "key_item"], 1, 2), (1, "old one", ["boss"], 2, 3)]
    entities = spark.createDataFrame(rows, "q long, name_norm string, types array<string>, rank int, place int")
    assert sorted(map(tuple, art.subjects(entities).collect())) == [(1, "ranni", True, 1), (1, "staff", False, 2)]
    lists = spark.createDataFrame([(1, ["a", "b", None], [3, 4, 5]), (2, [], []), (3, ["c"], [None])], "q long, books array<string>, pages array<int>")
    assert [tuple(r) for r in retrieval.listed_pages(lists).collect()] == [(1, 1, "a", 3), (1, 2, "b", 4)]


def test_reports_of_art_labels(spark):
    names_ = [("Ulla", "caption", "low", "exact"), ("Odo", "visual", "low", "prefix"), ("Tim", "visual", "high", "close"), ("Ann", "visual", "medium", "none")]
    rows = art_reports.to_look_at(spark.createDataFrame(names_, "name string, source string, confidence string, match string"))
    assert sorted((r["name"], r["why"]) for r in rows.collect()) == [("Ann", "low confidence"), ("Odo", "loose match"), ("Odo", "low confidence"), ("Tim", "loose match")]
    arts = spark.createDataFrame([(1, [], "character"), (2, None, "character"), (3, ["x"], "character"), (4, [], "sketch")], "id int, names array<string>, kind string")
    assert sorted(r["id"] for r in art_reports.unnamed(arts, ["character"]).collect()) == [1, 2]
    spreads = [(1, None, [[0.0, 0.0, 1.0, 0.9]], [(["a", "b"],)]), (2, None, [[0.0, 0.0, 1.0, 0.9]], [(["a"],), (["b"],)]), (3, "Box 2 CUTS the art", [], []), (4, None, [], [(["a", "b", "c"],)]), (5, "", [[0.0, 0.0, 0.5, 0.5]], [(["a", "b"],)])]
    spreads = spark.createDataFrame(spreads, "page int, notes string, boxes array<array<double>>, artworks array<struct<names:array<string>>>")
    assert sorted(r["page"] for r in art_reports.suspects(spreads, ["cuts"]).collect()) == [1, 3, 4]
    pages_ = spark.createDataFrame([("v", 1, "x"), ("v", 2, "y"), ("v", 3, "z")], "book string, page int, sha256 string")
    files = spark.createDataFrame([("v", 1, "x"), ("v", 2, "other")], "book string, page int, sha256 string")
    assert sorted(map(tuple, art_reports.missing_files(pages_, files).collect())) == [("v", 2, "differs"), ("v", 3, "missing")]
    items = spark.createDataFrame([("v", 1, ["blur", "glare"]), ("v", 2, []), ("v", 3, ["glare"]), ("w", 1, None)], "book string, page int, issues array<string>")
    got = [tuple(r) for r in art_reports.by_issue(items).orderBy("section", "book", "page").collect()]
    assert got == [("v", 1, "glare", 2, 1), ("v", 3, "glare", 2, 1), ("v", 2, "(no issue listed)", 2, 2), ("w", 1, "(no issue listed)", 2, 2), ("v", 1, "blur", 1, 3)]
    fault = lambda used, n: one(spark, art_reports.box_fault(F.lit(used) if used else F.array().cast("array<int>"), F.lit(n)))
    assert fault([1, 2, 2, 9], 3) == "box numbers [9] do not exist (there are 3)" and fault([2, 2, 1], 3) == "boxes [2] are used more than once"
    assert fault([1], 3) == "boxes [2, 3] are neither in an artwork nor left out" and fault([3, 1, 2], 3) is None and fault([], 0) is None
