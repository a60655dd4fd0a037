"""Page documents: files read, checked and turned into tables of pages, chunks, figures, entities and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text
from quire.sources.shapes import Flag, List, Nullable, Number, Object, OneOf, Optional, Text, faults, summed_up

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FIGURE = _struct(kind=S, description=S, labels=T.ArrayType(S), legend=S)
ENTITY = _struct(type=S, name=S, location=S, how_to_obtain=S, connects_to=T.ArrayType(S))
QUALITY = _struct(image_quality=S, quality_issues=T.ArrayType(S), affected_areas=S, retake_recommended=B, retake_reason=S, ocr_agreement=S, illegible_regions=I, notes=S)
PAGE = _struct(book=S, page=I, chapter=S, region=S, page_type=S, markdown=S, figures=T.ArrayType(FIGURE), entities=T.ArrayType(ENTITY), quality=QUALITY)


#: What the fields of page documents may say.
PAGE_TYPES = tuple("walkthrough map item_table boss npc lore index other".split())
FIGURE_KINDS = tuple("map screenshot diagram icon_row".split())
ENTITY_TYPES = tuple("""item weapon armor talisman spell ash_of_war consumable key_item location region dungeon boss enemy
npc merchant site_of_grace""".split())
IMAGE_QUALITY = ("good", "usable", "poor", "unusable")
QUALITY_ISSUES = tuple("""blur glare shadow skew crop_cut_off low_resolution page_curl motion_blur color_cast
fingers_or_obstruction two_pages_in_frame other""".split())
LEVELS = ("high", "medium", "low")

FIGURE_SHAPE = Object({"kind": OneOf(FIGURE_KINDS), "description": Text(), "labels": List(Text()), "legend": Nullable(Text())})
ENTITY_SHAPE = Object({"type": OneOf(ENTITY_TYPES), "name": Text(1), "location": Nullable(Text()), "how_to_obtain": Nullable(Text()), "connects_to": List(Text())})
QUALITY_SHAPE = Object({
    "image_quality": OneOf(IMAGE_QUALITY), "quality_issues": List(OneOf(QUALITY_ISSUES)), "affected_areas": Nullable(Text()),
    "retake_recommended": Flag(), "retake_reason": Nullable(Text()), "ocr_agreement": OneOf(LEVELS),
    "illegible_regions": Number(whole=True, least=0), "notes": Nullable(Text()),
})
PAGE_SHAPE = Object({
    "book": Text(1), "page": Number(whole=True, least=0), "chapter": Nullable(Text()), "region": Nullable(Text()),
    "page_type": OneOf(PAGE_TYPES), "markdown": Text(), "figures": List(FIGURE_SHAPE), "entities": List(ENTITY_SHAPE),
    "quality": QUALITY_SHAPE,
})
#: Labels of art spreads: other fields are passed over.
NAME_SHAPE = Object({"name": Text(1), "source": OneOf(("caption", "visual")), "verified": Optional(Flag()), "entity": Optional(Nullable(Text())), "match": Optional(Text())}, strict=False)
ARTWORK_SHAPE = Object({
    "boxes": List(Number(whole=True)), "bbox": List(Number(), 4), "kind": Text(1), "caption_ja": Nullable(Text()),
    "names": List(NAME_SHAPE), "description": Text(1), "confidence": OneOf(LEVELS),
}, strict=False)
CONTENT_SHAPE = Object({k: Optional(Nullable(Text())) for k in ("chapter", "section", "section_ja", "region")}, strict=False)
SPREAD_SHAPE = Object({
    "book": Text(), "pdf_page": Number(whole=True, above=0), "folios": List(Number(whole=True)), "contents": List(CONTENT_SHAPE),
    "artworks": List(ARTWORK_SHAPE), "not_art": List(Number(whole=True)), "section_heading_ja": Nullable(Text()), "notes": Nullable(Text()),
}, strict=False)
NAME = _struct(name=S, source=S, verified=B, entity=S, match=S)
ARTWORK = _struct(boxes=T.ArrayType(I), bbox=T.ArrayType(T.DoubleType()), kind=S, caption_ja=S, names=T.ArrayType(NAME), description=S, confidence=S)
CONTENT = _struct(chapter=S, section=S, section_ja=S, region=S)
SPREAD = _struct(book=S, pdf_page=I, folios=T.ArrayType(I), contents=T.ArrayType(CONTENT), artworks=T.ArrayType(ARTWORK), not_art=T.ArrayType(I), section_heading_ja=S, notes=S)


def read_files(spark: SparkSession, folder: str, glob: str = "p[0-9][0-9][0-9].json", pages: list[int] | None = None) -> DataFrame:
    """file, number (from the file's name), body (null where the bytes are not UTF-8) and source_hash of the page files of a
    folder, read once as bytes. Files without a byte are passed over by Spark's reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name, body = F.regexp_extract("path", r"([^/]+)$", 1), F.try_validate_utf8(F.col("content").cast("string")).alias("body")
    rows = files.select(name.alias("file"), F.regexp_extract(name, r"(\d+)", 1).cast("int").alias("number"), body, F.sha2("content", 256).alias("source_hash"))
    return rows.filter(F.col("number").isin(pages)) if pages else rows


def _judged(files: DataFrame, shape: Object, schema: T.StructType, at: str, book: str, most: int, more: bool) -> DataFrame:
    """Adds doc and reason, null for files that are taken: a file has one reason, the first that holds."""
    rows = files.withColumn("json", F.try_parse_json("body"))
    d = F.from_json("body", schema)
    rows = rows.withColumn("doc", d).withColumn("faults", faults(F.col("json"), shape))
    number, own = F.col("doc")[at], F.col("doc")["book"]
    reason = (
        F.when(F.col("body").isNull(), "invalid JSON: not UTF-8")
        .when(F.col("json").isNull(), "invalid JSON")
        .when(F.size("faults") > 0, F.concat(F.lit("schema: "), summed_up(F.col("faults"), most, more)))
        .when(~number.eqNullSafe(F.col("number")), F.concat(F.lit(f"{at} field "), number, F.lit(" does not match file name page "), "number"))
        .when(~own.eqNullSafe(F.lit(book)), F.concat(F.lit('book field "'), own, F.lit(f'" does not match configured book "{book}"')))
    )
    return rows.withColumn("reason", reason).drop("json", "faults")


def checked(files: DataFrame, book: str) -> DataFrame:
    """Adds doc (the parsed page) and reason: why a file is not taken (of a wrong document the first five faults, each with its
    path), null for good ones."""
    return _judged(files, PAGE_SHAPE, PAGE, "page", book, 5, True)


def checked_spreads(files: DataFrame, book: str) -> DataFrame:
    """The same for the labels of art spreads (sNNNN.json): unknown fields are passed over, three faults are told."""
    return _judged(files, SPREAD_SHAPE, SPREAD, "pdf_page", book, 3, False)


def good_pages(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").select("doc.*", "source_hash")


def entities(pages: DataFrame) -> DataFrame:
    """book, page, entity_idx (from 0), type, name, name_norm, location, how_to_obtain, connects_to."""
    each = pages.select("book", "page", F.posexplode("entities").alias("entity_idx", "e"))
    return each.select("book", "page", "entity_idx", "e.*").withColumn("name_norm", text.normalize_names("name"))


def links(entity_rows: DataFrame) -> DataFrame:
    """book, source, target: distinct normalised targets of each entity, none empty."""
    each = entity_rows.select("book", F.col("name_norm").alias("source"), F.explode("connects_to").alias("t"))
    return each.withColumn("target", text.normalize_names("t")).filter("target <> ''").select("book", "source", "target").distinct()


def figures(pages: DataFrame) -> DataFrame:
    """book, page, figure_idx (from 1) and the figure."""
    each = pages.select("book", "page", F.posexplode("figures").alias("i", "f"))
    return each.select("book", "page", (F.col("i") + 1).alias("figure_idx"), "f.*")


def config_rows(spark: SparkSession, body: str, kind: str | None = None) -> DataFrame:
    """Books of a config (id → settings) in its order: pos, id and settings as JSON; of one kind if given."""
    one = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", "map<string,string>").alias("m"))
    rows = one.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select("pos", "e.key", "e.value").withColumnsRenamed({"key": "id", "value": "settings"})
    rows = rows.withColumn("kind", F.coalesce(F.get_json_object("settings", "$.kind"), F.lit("guide")))
    return rows.filter(F.col("kind") == kind) if kind else rows


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_ok(log: DataFrame, key: str = "page", at: str = "at", ok: str = "status = 'ok'") -> DataFrame:
    """Of each key's records in a log the last that went well, by time; records without a key are left out."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    good = log.filter(ok).filter(F.col(key).isNotNull())
    return good.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def read_journals(spark: SparkSession, folder: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """The records of all journals of a folder with the file that each is from; malformed lines and files that cannot be read
    are passed over."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob)
    rows = reader.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").json(folder)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def binary_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modified and sha256 of files such as photos."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


LINKS = "map<string, array<struct<book:string,page:int>>>"


def read_checklist(spark: SparkSession, folder: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files of a checklist: items (KEY.json, an object with an array items), and pages by item and overrides
    (KEY_pages.json, KEY_overrides.json, objects of lists of pages), each of the latter two empty if its file is missing."""

    def whole(name: str) -> DataFrame:
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
            return spark.createDataFrame([], "value string")
        return spark.read.text(f"{folder}/{name}.json", wholetext=True)

    def links(name: str, inner: str | None = None) -> DataFrame:
        body = F.get_json_object("value", f"$.{inner}") if inner else F.col("value")
        return whole(name).select(F.explode(F.from_json(body, LINKS)).alias("item", "pages"))

    fields = "array<struct<id:string,text:string,path:array<string>>>"
    items = whole(key).select(F.inline(F.from_json(F.get_json_object("value", "$.items"), fields))).withColumnRenamed("id", "item")
    return items, links(f"{key}_pages"), links(f"{key}_overrides", "items")


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], most: int = 10_000) -> None:
    """A text report: a section for each table with its rows; tables of over ``most`` rows are refused, as reports are read."""
    lines = [f"# {title}", ""]
    for name, rows in sections.items():
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows: sum it up first")
        lines += [f"## {name} ({len(found)})", "", *("- " + ", ".join(str(x) for x in r) for r in found), ""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
