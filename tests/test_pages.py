"""Chunks, page files, providers and keyed sinks."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, quality
from quire.sources import pages, providers, tables

SAMPLE = """# North Plain
## Odo's Rise
A tower by the lake.
It stands alone.

| Item | Where |
|------|-------|
| Key | Roof |

> **Boss**
> Beware.

- one
- two
  more of two

## Items
Last words.
"""


def test_blocks():
    found = chunking.blocks_of(SAMPLE)
    assert [b.kind for b in found] == ["heading", "heading", "para", "table", "quote", "list", "heading", "para"]
    assert len(found[3].head) == 2 and found[3].parts == ["| Key | Roof |"]
    assert found[5].parts == ["- one", "- two\n  more of two"]
    assert [b.kind for b in chunking.blocks_of("```\n# no heading\n```\ntext")] == ["code", "para"]


def chunks(markdown, region=None, chapter=None, figures=(), **sizes):
    return chunking.Chunker(chunking.Sizes(**sizes) if sizes else None).page(33, markdown, list(figures), region, chapter)


def test_paths():
    paths = [p for p, _, _ in chunks(SAMPLE, region="Caelid")]
    assert paths == ["Caelid > North Plain > Odo's Rise", "Caelid > North Plain > Items"]
    assert chunks("x")[0][0] == "Page 33" and chunks("x", chapter="Two")[0][0] == "Two"
    assert not any("Odo's Rise" in t for _, t, _ in chunks(SAMPLE))


def test_a_heading_that_comes_again_is_one_section():
    rows = "\n".join(f"## Items\n| row {i} |" for i in range(20))
    (one,) = chunks(rows)
    assert one[1].count("row") == 20


def test_sizes():
    words = lambda n: " ".join(["word"] * n)
    assert len(chunks(f"{words(300)}\n\n{words(250)}")) == 1
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| r{i} {words(12)} | x |" for i in range(120))
    parts = chunks(table)
    assert len(parts) >= 2 and all(t.startswith("| a | b |\n|---|---|\n") for _, t, _ in parts)
    body = "\n".join(t for _, t, _ in parts)
    assert all(body.count(f"| r{i} ") == 1 for i in range(120))
    box = "> **Boss Strategy**\n" + "\n".join(f"> {words(40)} {i}" for i in range(40))
    assert all(t.startswith("> **Boss Strategy**") for _, t, _ in chunks(box)) and len(chunks(box)) >= 2
    prose = " ".join(f"{words(30)} end{i}." for i in range(60))
    assert all(t.endswith(".") for _, t, _ in chunks(prose)) and len(chunks(prose)) >= 2
    assert all(n <= 800 for _, _, n in chunks(prose) + parts)


def test_figures():
    figure = {"description": "Map of Limgrave.", "labels": ["1", "2", "3"], "legend": "1 = a, 2 = b"}
    assert chunks("", region="Limgrave", figures=[{"description": "x"}, figure])[1][:2] == ("Limgrave > Figure 2", "Map of Limgrave.\n\nLabels: 1; 2; 3\n\nLegend: 1 = a, 2 = b")


def page(n, **more):
    q = {"image_quality": "good", "quality_issues": [], "affected_areas": None, "retake_recommended": False, "retake_reason": None, "ocr_agreement": "high", "illegible_regions": 0, "notes": None}
    entity = {"type": "npc", "name": "Ranni's Rise", "location": None, "how_to_obtain": None, "connects_to": ["Caria Manor", "Caria manor", ""]}
    return {"book": "vol1", "page": n, "chapter": None, "region": None, "page_type": "npc", "markdown": "# A\nRanni's Rise", "figures": [], "entities": [entity], "quality": q} | more


def test_page_files(spark, tmp_path):
    bodies = {"p001": json.dumps(page(1)), "p002": "{broken", "p003": json.dumps(page(4)), "p004": json.dumps(page(4, odd=1)), "p005": json.dumps(page(5, book="x")), "notes": "{}"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows = pages.checked(pages.read_files(spark, str(tmp_path)), "vol1")
    assert {r["file"][:4]: r["reason"] for r in rows.collect()} == {
        "p001": None,
        "p002": "invalid JSON",
        "p003": "page field 4 does not match file name page 3",
        "p004": 'schema: Unrecognized key: "odd"',
        "p005": 'book field "x" does not match configured book "vol1"',
    }
    good = pages.good_pages(rows)
    found = pages.entities(good)
    assert [(r["name_norm"], r["entity_idx"]) for r in found.collect()] == [("rannis rise", 0)]
    assert [r["target"] for r in pages.links(found).collect()] == ["caria manor"]
    assert pages.read_files(spark, str(tmp_path), pages=[3, 9]).count() == 1
    (chunk,) = chunking.chunked(good).collect()
    assert (chunk["heading_path"], chunk["text"]) == ("A", "Ranni's Rise")
    (vector,) = providers.embedded(chunking.chunked(good).select("book", "text"), lambda: providers.HashedEmbedder(8, 2)).collect()
    assert len(vector["embedding"]) == 8
    rules = quality.page_rules(F.col("markdown"), F.col("figures"), F.col("entities"), F.col("quality"))
    assert [list(r["problems"]) for r in quality.problems(good, rules).collect()] == [[]]


def reasons(spark, tmp_path, check, bodies, glob, **more):
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())
    return {r["file"].split(".")[0]: r["reason"] for r in check(pages.read_files(spark, str(tmp_path), glob), "vol1").collect()}


def test_reasons_tell_path_and_fault(spark, tmp_path):
    good = page(1)
    entity, quality_ = good["entities"][0], good["quality"]
    short = {k: quality_[k] for k in ("image_quality",)}
    got = reasons(spark, tmp_path, pages.checked, {
        "p001": page(1, figures="none"),
        "p002": page(2, entities=[entity, entity | {"name": 5, "kind": "x", "extra": 1}]),
        "p003": page(3, quality=quality_ | {"illegible_regions": "three"}),
        "p004": page(4, quality=short),
        "p005": json.dumps(page(5)).encode().replace(b"Ranni's", b"Ranni\xff", 1),
        "p006": page(6, page=6.5, quality=quality_ | {"illegible_regions": -1}),
        "p007": [1],
        "p008": page(8, page_type="text", figures=[{"kind": "map", "description": None, "labels": ["a", 1], "legend": None}]),
        "p010": page(10.0, book=""),
        "p011": page(11, entities=[{"type": "npc"}, None]),
    }, "p*.json")
    assert got == {
        "p001": "schema: figures: Invalid input: expected array, received string",
        "p002": 'schema: entities.1.name: Invalid input: expected string, received number; entities.1: Unrecognized keys: "extra", "kind"',
        "p003": "schema: quality.illegible_regions: Invalid input: expected number, received string",
        "p004": "schema: quality.quality_issues: Invalid input: expected array, received undefined; quality.affected_areas: Invalid input: expected string, received undefined; quality.retake_recommended: Invalid input: expected boolean, received undefined; quality.retake_reason: Invalid input: expected string, received undefined; quality.ocr_agreement: Invalid option: expected one of \"high\"|\"medium\"|\"low\" (+2 more)",
        "p005": "invalid JSON: not UTF-8",
        "p006": "schema: page: Invalid input: expected int, received number; quality.illegible_regions: Too small: expected number to be >=0",
        "p007": "schema: Invalid input: expected object, received array",
        "p008": 'schema: page_type: Invalid option: expected one of "walkthrough"|"map"|"item_table"|"boss"|"npc"|"lore"|"index"|"other"; figures.0.description: Invalid input: expected string, received null; figures.0.labels.1: Invalid input: expected string, received number',
        "p010": "schema: book: Too small: expected string to have >=1 characters",
        "p011": "schema: entities.0.name: Invalid input: expected string, received undefined; entities.0.location: Invalid input: expected string, received undefined; entities.0.how_to_obtain: Invalid input: expected string, received undefined; entities.0.connects_to: Invalid input: expected array, received undefined; entities.1: Invalid input: expected object, received null",
    }


def test_reasons_of_art_labels(spark, tmp_path):
    art = {"boxes": [1], "bbox": [0, 0.5, 1, 1], "kind": "photo", "caption_ja": None, "names": [{"name": "Ulla", "source": "caption", "odd": 1}], "description": "d", "confidence": "low"}
    spread = {"book": "vol1", "pdf_page": 1, "folios": [4], "contents": [{}, {"chapter": None}], "artworks": [art], "not_art": [], "section_heading_ja": None, "notes": None, "more": True}
    got = reasons(spark, tmp_path, pages.checked_spreads, {
        "s0001": spread,
        "s0002": spread,
        "s0003": spread | {"pdf_page": 0, "folios": [1.5], "notes": 1, "not_art": None},
        "s0004": spread | {"pdf_page": 4, "artworks": [art | {"bbox": [1]}]},
        "s0005": spread | {"pdf_page": 5, "book": "vol2"},
    }, "s[0-9]*.json")
    assert got == {
        "s0001": None,
        "s0002": "pdf_page field 1 does not match file name page 2",
        "s0003": "schema: pdf_page: Too small: expected number to be >0; folios.0: Invalid input: expected int, received number; not_art: Invalid input: expected array, received null",
        "s0004": "schema: artworks.0.bbox: Invalid input: expected array to have 4 items",
        "s0005": 'book field "vol2" does not match configured book "vol1"',
    }


def test_config_rows_keep_their_order(spark):
    rows = pages.config_rows(spark, '{"b": {"kind": "artbook"}, "a": {}, "c": {"kind": "guide"}}')
    assert [(r["id"], r["kind"]) for r in rows.orderBy("pos").collect()] == [("b", "artbook"), ("a", "guide"), ("c", "guide")]
    assert pages.config_rows(spark, '{"b": {"kind": "artbook"}, "a": {}}', "artbook").count() == 1


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, v string, retired_at timestamp")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    done = {r["id"]: (r["v"], r["retired_at"] is not None) for r in tables.retire_missing(old, new, "id", "2024-01-01").collect()}
    assert done == {1: ("a", True), 2: ("c", False), 3: ("d", False)}
    again = tables.retire_missing(tables.retire_missing(old, new, "id", "2024-01-01"), old.select("id", "v"), "id", "2024-02-01")
    assert {r["id"]: r["retired_at"] is not None for r in again.collect()} == {1: False, 2: False, 3: True}
    assert tables.clashes(spark.createDataFrame([(1, "y"), (5, "y")], "id long, o string"), spark.createDataFrame([(1, "x")], "id long, o string"), "id", "o").count() == 1
    path = str(tmp_path / "t")
    tables.write_groups(spark.createDataFrame([("a", 1), ("b", 2)], "book string, n int"), path, ["book"])
    tables.write_groups(spark.createDataFrame([("b", 3)], "book string, n int"), path, ["book"])
    assert sorted((r["book"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_checklist_files_and_reports(spark, tmp_path):
    import json

    from quire.operators import checklists
    from quire.sources import pages as source

    (tmp_path / "main.json").write_text(json.dumps({"items": [{"id": "m001", "text": "one", "path": ["A"]}, {"id": "m002", "text": "two", "path": []}]}, indent=1))
    (tmp_path / "main_pages.json").write_text(json.dumps({"m001": [{"book": "v1", "page": 3}]}))
    items, links, overrides = source.read_checklist(spark, str(tmp_path), "main")
    assert overrides.count() == 0 and items.count() == 2
    (tmp_path / "main_overrides.json").write_text(json.dumps({"items": {"m002": [{"book": "v1", "page": 9}], "m9": []}}))
    rows, errors = checklists.with_overrides(*source.read_checklist(spark, str(tmp_path), "main"), ["v1"])
    assert {r["item"]: [tuple(p) for p in r["pages"]] for r in rows.collect()} == {"m001": [("v1", 3)], "m002": [("v1", 9)]}
    assert [tuple(r) for r in errors.collect()] == [("m9", "unknown item")]
    source.write_report(spark, str(tmp_path / "report"), "Links", {"Items": rows.select("item").orderBy("item"), "None": rows.filter("false")})
    said = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect())
    assert said.strip() == "# Links\n\n## Items (2)\n\n- m001\n- m002\n\n## None (0)"
    with pytest.raises(ValueError):
        source.write_report(spark, str(tmp_path / "report"), "Links", {"Items": rows}, most=1)
