"""Queues, logs, checklists, artworks, names and streams."""

from pyspark.sql import functions as F

from quire.operators import art, checklists, jobs, names, relational
from quire.streaming import events


def test_queue_status(spark):
    cases = [(True, None, None, "flagged"), (True, "accept", "done", "accepted"), (False, "retake", "running", "in_progress"), (False, "retake", "done", "done"), (True, "retake", "done", "still_flagged"), (True, "retake", "rolled_back", "flagged")]
    rows = spark.createDataFrame(cases, "f boolean, k string, s string, want string")
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", jobs.queue_status(F.col("f"), F.col("k"), F.col("s"))).collect())


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, page int, action string, version string, restored string, at timestamp")


def test_rollbacks(spark):
    import datetime

    t = lambda d: datetime.datetime(2026, 9, d)
    own = log(spark, (1, "retake", "r1", None, t(1)), (1, "retake", "r2", None, t(6)), (2, "retake", "r3", None, t(2)), (1, "rollback", None, "r2", t(7)))
    assert {r["page"]: r["version"] for r in jobs.rollback_targets(own).collect()} == {1: "r1", 2: "r3"}
    assert jobs.replaced_pages(own).first()["pages"] == 2
    assert jobs.replaced_pages(own, "2026-09-05").first()["pages"] == 0
    more = own.union(log(spark, (1, "rollback", None, "r1", t(8))))
    assert {r["page"] for r in jobs.rollback_targets(more).collect()} == {2}


def test_states(spark):
    rows = spark.createDataFrame([("a", 1, "validate"), ("a", 2, "confirm"), ("a", 3, "start"), ("a", 4, "finish"), ("b", 1, "finish"), ("b", 2, "discard")], "job string, event_id long, move string")
    assert {r["job"]: r["status"] for r in jobs.folded_status(rows, "job", ["event_id"]).collect()} == {"a": "done", "b": "discarded"}
    moved = jobs.moved(spark.createDataFrame([("done",), ("running",)], "status string"), F.lit("finish")).collect()
    assert {(r["status"], r["error"]) for r in moved} == {("done", "cannot finish from done"), ("done", None)}


def test_lines(spark):
    rows = spark.createDataFrame([('::retake:: {"a": 1}',), ("plain",), ("  ",), ("::retake:: {broken",)], "line string")
    assert {(r["kind"], r["body"]) for r in jobs.parsed_lines(rows).collect()} == {("event", '{"a": 1}'), ("log", "plain"), ("log", "::retake:: {broken")}


SAMPLE = "\r\n## First part\r\n\r\n- Ask **Odo** at the mill <!-- q:m002 -->\r\n  \r\n- ***** Cross the ford and see **Ulla.** Then find **Bern**\r\n### Below\r\nNote: read this.\r\n- ** Ask **Odo** and **Tilda**, then **Bern, Ulla,** and **Kuno's hat**\r\n- Brass Key #3 behind the wall\r\n- **Mason** Handbook #2: up the stairs\r\n## Next\r\n#### Deep\r\n- last\r\n"


def test_checklists(spark):
    files = spark.createDataFrame([("f", SAMPLE)], "file string, body string")
    rows = checklists.parsed(files, ["*****", "**"]).orderBy("ord").collect()
    assert [r["type"] for r in rows] == ["heading", "item", "item", "heading", "note", "item", "item", "item", "heading", "heading", "item"]
    items = [r for r in rows if r["type"] == "item"]
    assert items[0]["id"] == "m002" and items[0]["text"] == "Ask **Odo** at the mill" and items[0]["marker"] is None
    assert items[1]["marker"] == "*****" and items[1]["text"].startswith("Cross") and items[1]["bold"] == ["Ulla", "Bern"]
    assert items[2]["marker"] == "**" and items[2]["path"] == ["First part", "Below"] and items[2]["bold"] == ["Odo", "Tilda", "Bern", "Ulla", "Kuno"]
    assert items[4]["marker"] is None and items[5]["path"] == ["Next", "Deep"]
    counted = checklists.parsed(files, ["*****", "**"]).filter("type = 'item'").orderBy("ord").select(checklists.collectible(F.col("text")).alias("c")).collect()
    assert [r["c"] and tuple(r["c"]) for r in counted] == [None, None, None, ("Brass Key", 3), ("Mason Handbook", 2), None]
    done = checklists.with_ids(files, "m", ["*****", "**"]).first()
    again = checklists.parsed(spark.createDataFrame([("f", done["body"])], "file string, body string"), ["*****", "**"]).orderBy("ord")
    assert done["added"] == 5 and [r["id"] for r in again.collect() if r["type"] == "item"] == [f"m00{i}" for i in range(2, 8)]
    assert "\n" not in done["body"].replace("\r\n", "") and checklists.with_ids(spark.createDataFrame([("f", done["body"])], "file string, body string"), "m").first()["added"] == 0
    wrong = spark.createDataFrame([("a", "- one <!-- q:m001 -->\n- two <!-- q:m001 -->"), ("b", "- one\n  more of it")], "file string, body string")
    assert {r["file"]: r["error"] for r in checklists.with_ids(wrong, "m").collect()} == {"a": "an id stands twice", "b": "an indented line stands below an item"}


def test_overrides(spark):
    kind = "item string, pages array<struct<book:string,page:int>>"
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    rows, errors = checklists.with_overrides(items, spark.createDataFrame([("a", [("v1", 3)]), ("b", [("v1", 4)])], kind), spark.createDataFrame([("b", [("v9", 1)]), ("z", [])], kind), ["v1"])
    assert {r["item"]: ([tuple(p) for p in r["pages"]], r["overridden"]) for r in rows.collect()} == {"a": ([("v1", 3)], False), "b": ([("v9", 1)], True), "c": ([], False)}
    assert {tuple(r) for r in errors.collect()} == {("z", "unknown item"), ("b", "foreign book v9")}


def test_admission(spark):
    rows = [(1, "d", 400.0, "retake", True), (2, "d", 200.0, "retake", True), (3, "d", 50.0, "retake", True), (4, "d", 900.0, "retake", False), (5, "d", 900.0, "rollback", True)]
    groups = spark.createDataFrame(rows, "n int, day string, estimate double, kind string, fresh boolean")
    spent = spark.createDataFrame([("d", 350.0)], "day string, spent double")
    got = {r["n"]: (r["waits"], r["claimed"]) for r in relational.admission(groups, spent, 500.0, ["day"], ["n"]).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, False)}


def test_prices_keep_repeated_rows(spark):
    prices = spark.createDataFrame([("ab", 1.0), ("abc", 2.0)], "prefix string, usd double")
    got = relational.longest_prefix(spark.createDataFrame([("abcd",), ("abcd",), ("x",)], "name string"), prices, "name")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("abcd", "abc", 2.0)] * 2 + [("x", None, None)], "name string, prefix string, usd double").collect()))


def test_intervals_and_gaps(spark):
    import random

    rng = random.Random(3)
    spans = [(rng.choice("ab"), lo := rng.randrange(-50, 500), lo + rng.choice([0, 1, 3, 40, 300]), f"n{i}") for i in range(120)]
    points = [(k, p) for k in "ab" for p in range(-60, 560, 7)]
    got = relational.narrowest(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(spans, "k string, lo long, hi long, name string"), ["k"], "p").collect()
    want = {}
    for k, p in points:
        if own := [(hi - lo, lo, name) for key, lo, hi, name in spans if key == k and lo <= p <= hi]:
            want[k, p] = min(own)[2]
    assert {(r["k"], r["p"]): r["name"] for r in got} == want
    for own in ([], [0], [9], [3, 4, 8], list(range(10)), [-5, 2, 99]):
        rows = spark.createDataFrame([(i,) for i in own], "x long")
        missing = [i for i in range(10) if i not in own]
        found = relational.gaps(rows, "x", 0, 9, block=4).collect()
        assert sorted(i for r in found for i in range(r["first"], r["last"] + 1)) == missing and all(r["n"] == r["last"] - r["first"] + 1 for r in found)


def test_chains_of_a_whole_table(spark, sf_dir):
    from quire import plans

    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    by_part = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = top(r[0]), top(by_part.setdefault(r[1], r[0]))
        root[max(a, b)] = min(a, b)
    got = {r["item"]: r["chain"] for r in plans.queries()["connected_chains"](spark, sf_dir).collect()}
    assert got == {x: top(x) for x in list(root)}


def test_chains(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (6, "d")], "item long, npc string")
    chains = relational.chains(rows, "item", "npc")
    assert {r["item"]: r["chain"] for r in chains.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    labels = {r["chain"]: r["label"] for r in checklists.chain_labels(chains, rows).collect()}
    assert labels == {1: "a & b", 4: "c", 6: "d"}


def test_art(spark):
    art_names = spark.createDataFrame([(1, "Stormborn Harald", "caption", "low"), (2, "Harald Soldier", "caption", "high"), (3, "Harald", "visual", "medium"), (4, "Harald", "visual", "low"), (5, "Harbour Knight", "visual", "high")], "id long, name string, origin string, confidence string")
    subjects = spark.createDataFrame([("harald", True), ("harbour knights", False)], "subject string, person boolean")
    assert {r["id"]: (r["tier"], r["exact"]) for r in art.tiers(art_names, subjects).collect()} == {1: (0, False), 3: (2, True), 5: (1, True)}
    rated = spark.createDataFrame([(0, i, "s", 0, t, True, "b", p) for i, t, p in ((1, 1, 1), (2, 0, 2), (3, 1, 2), (4, 1, 4))], "q long, id long, subject string, place int, tier int, exact boolean, book string, page int")
    hits = spark.createDataFrame([(0, 9, 0.515), (0, 8, 0.62)], "q long, id long, similarity double")
    assert [r["id"] for r in art.strip(rated, hits).orderBy("position").collect()] == [2, 1, 8]
    own = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b"])], "page int, idx int, names array<string>")
    over = spark.createDataFrame([(1, 1, ["c"], None), (1, 2, None, True), (9, 1, None, True)], "page int, idx int, names array<string>, dropped boolean")
    rows, wrong = art.overridden(own, over)
    assert [r["names"] for r in rows.collect()] == [["c"]] and wrong.count() == 1


def test_names(spark):
    known = spark.createDataFrame([("borin the half wolf",), ("sorceress tilda",)], "entity string")
    wanted = spark.createDataFrame([("tilda sorceress",), ("borin the half wolff",), ("nobody here",)], "name string")
    assert {r["name"]: r["match"] for r in names.matched(wanted, known).collect()} == {"tilda sorceress": "order", "borin the half wolff": "none", "nobody here": "none"}
    assert [r["entity"] for r in names.close_matches(wanted, known).collect()] == ["borin the half wolf"]
    texts = spark.createDataFrame([(1, "ask Ulla about it"), (2, "Ulla Manor is far"), (3, "**Ulla** only")], "id int, text string")
    assert [r["id"] for r in names.text_mentions(texts, spark.createDataFrame([("Ulla",)], "word string")).collect()] == [1]


def test_limiter(spark):
    rows = spark.createDataFrame([("u", s) for s in (0, 1, 2, 400)], "u string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r["attempts"], r["wait_us"]) for r in relational.attempts_window(rows, "u", 10, 2).orderBy("s").collect()]
    assert got == [(1, 0), (2, 9_000_000), (3, 9_000_000), (1, 0)]


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    batch.coalesce(1).write.parquet(path)
    rows = events.tail(spark, path, batch.schema.simpleString()[7:-1].replace(":", " "))
    run(events.changes(rows.withColumnRenamed("user_id", "job"), "job", "event_type"), "changed")
    want = spark.read.parquet(path).selectExpr("user_id as job", "event_id", "event_type", "lag(event_type) over (partition by user_id order by event_id) as b").filter("not (b <=> event_type)")
    assert spark.table("changed").exceptAll(want.select("job", "event_id", "event_type")).count() == 0 and spark.table("changed").count() == want.count()
    run(events.counted(events.timed(rows), "6 hours"), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 200
    run(events.once(events.timed(rows)), "distinct_events")
    assert spark.table("distinct_events").count() == 200


def test_citation_stream():
    own = events.Citations({"vol1": "vol1"})
    got = own.push("a shack [Vol 1, p") + own.push(". 159]. Next [") + own.push("x" * 500) + own.flush()
    assert ("cite", "vol1", 159, None) in got
    assert "".join(g[1] for g in got if g[0] == "text") == "a shack . Next [" + "x" * 500
    assert events.sse("m", "a\nb") == "event: m\ndata: a\ndata: b\n\n"


def test_next_work(spark):
    rows = [("r1", "v1", "retake", "running", "t1", None, 1), ("r2", "v2", "retake", "running", "t2", None, 1), ("r3", "v1", "retake", "running", None, None, 1), ("d1", "v2", "retake", "discarded", "t3", None, 2), ("d2", "v3", "retake", "discarded", "t4", None, 2), ("d3", "v3", "retake", "done", "t4", None, 2), ("u1", "v3", "retake", "uploaded", None, None, 4), ("u2", "v3", "retake", "uploaded", None, None, 3), ("u3", "v3", "rollback", "uploaded", None, None, 1), ("c1", "v4", "retake", "confirmed", None, None, 1), ("c2", "v4", "retake", "confirmed", None, None, 2), ("n1", None, "retake", "uploaded", None, None, 1), ("a1", "v5", "retake", "discarded", "t5", "abandoned", 1)]
    own = spark.createDataFrame(rows, "id string, book string, kind string, status string, txn string, stage string, created int")
    locked, claimed = spark.createDataFrame([("v2",)], "book string"), spark.createDataFrame([("c2",)], "id string")
    got = {(r["id"], r["step"]) for r in jobs.next_work(own, locked, claimed, ["book"]).collect()}
    assert got == {("r1", "requeue"), ("d1", "abandon"), ("u2", "validate"), ("c2", "run"), ("n1", "validate")}
    one = own.withColumn("worker", F.lit(1))
    assert [tuple(r) for r in jobs.next_work(one, locked, claimed, ["worker"]).collect()] == [(1, "r1", "requeue")]


def test_answer_events(spark):
    kinds = {1: ["cite", "text", "text", "stop", "cite", "text", "done"], 2: ["text", "cite", "stop", "cite", "fail"], 3: ["cite", "fail"]}
    own = spark.createDataFrame([(a, i, k, "citations") for a, ks in kinds.items() for i, k in enumerate(ks)], "answer int, seq int, kind string, mode string")
    got = sorted(tuple(r) for r in jobs.answer_events(own).collect())
    assert [(a, s) for a, _, s, _ in got] == [(1, 1), (1, 2), (1, 0), (1, 5), (1, 4), (1, 6), (2, 0), (2, 1), (2, 4)]
    assert [r["answer"] for r in jobs.to_ask_again(own).collect()] == [3]
