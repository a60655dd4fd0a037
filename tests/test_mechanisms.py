"""JSON salvage, pictures, table functions, numbered streams and state with timers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import salvage, sql_tables
from quire.operators import checklists, chunking, grids, retrieval
from quire.sources import numbered
from quire.streaming import states


def test_salvage(spark):
    one = '{"a": "x } {", "b": [1, {"c": "\\\\\\""}]}'
    texts = {
        one: one,
        f"```json\n{one}\n```\n": one,
        f"Here it is:\n{one}\nDone.": one,
        f"See {{this}}: {one} and so on }} :}}": one,
        f'{{broken: {one}, {{"z": 1}}': one,
        '{"a": 1': None,
        "no braces": None,
        "} {": None,
        "": None,
        "[1, 2]": "[1, 2]",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(salvage.salvaged(F.col("t"))).collect()]
    assert got == [*texts.values(), None]


def flood(mask):
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (x, y) not in seen:
                todo, cells = [(x, y)], []
                seen.add((x, y))
                while todo:
                    a, b = todo.pop()
                    cells.append((a, b))
                    for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c[0] < w and 0 <= c[1] < h and mask[c[1], c[0]] and c not in seen:
                            seen.add(c)
                            todo.append(c)
                xs, ys = zip(*cells)
                out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(cells)))
    return out


def test_components():
    rng = np.random.default_rng(2)
    for h, w, share in [(1, 1, 0.5), (1, 9, 0.5), (9, 1, 0.5), (20, 30, 0.4), (30, 20, 0.6), (40, 40, 0.55), (8, 8, 0), (8, 8, 1)]:
        for _ in range(20):
            mask = rng.random((h, w)) < share
            assert list(map(tuple, grids.components(mask).tolist())) == flood(mask)
    spiral = np.zeros((61, 61), dtype=bool)
    x, y, dx, dy = 0, 0, 1, 0
    spiral[0, 0] = True
    for length in [60, 60, 60, *(n for n in range(58, 0, -2) for _ in (0, 1))]:
        for _ in range(length):
            x, y = x + dx, y + dy
            spiral[y, x] = True
        dx, dy = -dy, dx
    assert len(flood(spiral)) == 1 == len(grids.components(spiral))


def test_colours_of_borders():
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 40, (12, 17, 3))
    for width in (1, 2, 3, 6, 20):
        want = [tuple(pixels[y, x]) for y in range(12) for x in range(17) if min(x, 16 - x, y, 11 - y) < width]
        assert list(map(tuple, grids.ring(pixels, width))) == want
    for colours in (rng.integers(0, 60, (300, 3)), np.array([[8, 8, 8], [0, 0, 0]]), np.array([[200, 0, 0]] * 5 + [[10, 10, 10]] * 4)):
        coarse = [tuple(int(v) // 8 * 8 for v in c) for c in colours]
        most = max(coarse, key=lambda c: (coarse.count(c), -coarse.index(c)))
        near = [c for c in colours if max(abs(int(a) - b) for a, b in zip(c, most)) <= 26]
        mean = tuple(sum(int(c[i]) for c in near) // len(near) for i in range(3))
        share = sum(max(abs(int(a) - b) for a, b in zip(c, mean)) <= 26 for c in colours) / len(colours)
        got, at = grids.dominant(colours)
        assert tuple(got) == mean and at == pytest.approx(share)
    assert grids.dominant(np.zeros((0, 3))) [1] == 0.0


def picture(w=452, h=300, ground=(230, 230, 230)):
    out = np.empty((h, w, 3), dtype=np.int64)
    out[:] = ground
    return out


def test_spreads(spark):
    two = picture()
    two[40:120, 30:150] = (120, 30, 30)
    two[60:160, 260:400] = (20, 90, 20)
    two[80:100, 300:302] = (230, 230, 230)  # a gap that closes
    two[200:203, 50:52] = (0, 0, 0)  # a speck
    sheet = picture()
    sheet[50:250, 40:400] = (60, 60, 80)
    sheet[80:150, 80:160] = (200, 180, 20)
    sheet[80:200, 240:340] = (10, 200, 180)
    rng = np.random.default_rng(1)
    rows = [(1, two), (2, sheet), (3, picture()), (4, rng.integers(0, 255, (300, 452, 3)))]
    table = spark.createDataFrame([(k, p.shape[1], p.shape[0], p.ravel().tolist()) for k, p in rows], "key long, width int, height int, rgb array<int>")
    got = {r["key"]: r for r in grids.artwork_boxes(table).collect()}
    assert [got[k]["mode"] for k in (1, 2, 3, 4)] == ["segmented", "segmented", "empty", "full_bleed"]
    assert len(got[1]["boxes"]) == 2 and got[1]["background"] == "#e6e6e6" and got[4]["boxes"] == [[0.0, 0.0, 1.0, 1.0]]
    (a, b) = got[1]["boxes"]
    assert a[0] < 30 / 452 < 150 / 452 < a[2] < b[0] < 260 / 452 and b[2] > 400 / 452 and a[1] < 40 / 300
    assert len(got[2]["boxes"]) == 2, "the pieces on a panel, not the panel"
    masks = spark.createDataFrame([(1, 3, [True, False, True] * 2), (2, 2, []), (3, 1, None)], "key long, width int, cells array<boolean>")
    assert sorted(tuple(r) for r in grids.pieces(masks).collect()) == [(1, 0, 0, 0, 1, 2, 2), (1, 1, 2, 0, 3, 2, 2)]


def test_table_functions(spark):
    sql_tables.register(spark)
    body = "# T\n## Area One\n- **Go** to **Ulla, Odo and Tim's** <!-- q:m001 -->\n   note\n### Deep\n- ***** find it\n\n-  x\n## Two\nfree text\n\tlate"
    files = spark.createDataFrame([("f", body), ("g", "## Z\n- one\r\n\n- two **B.**"), ("h", None)], "file string, body string")
    files.select("file", F.posexplode(F.split("body", "\n")).alias("ord", "raw")).createOrReplaceTempView("checklist_lines")
    got = spark.sql("SELECT * FROM parse_checklist(TABLE(checklist_lines) PARTITION BY (file) ORDER BY (ord), '** *****')")
    want = checklists.parsed(files, ["*****", "**"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))

    pages = [("b", 1, "# A\ntext one\n\n| a | b |\n|--|--|\n| 1 | 2 |", None, "R", None), ("b", 2, "## B\nmore", [("Map", ["x", "y"], "1 = a, 2 = b")], None, "C"), ("b", 3, None, None, None, None)]
    pages = spark.createDataFrame(pages, "book string, page int, markdown string, figures array<struct<description:string,labels:array<string>,legend:string>>, region string, chapter string")
    pages.createOrReplaceTempView("page_rows")
    got, want = spark.sql("SELECT * FROM chunk_page(TABLE(page_rows))"), chunking.chunked(pages)
    assert got.schema.simpleString() == want.schema.simpleString() and want.count() > 2
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    asked = ["How do I get from Odo's Rise to the Amber Staff?", "where is the half-giant", "the of", "", None, "Queen of the Full Moon, please", "Ä Ö ü2 x"]
    questions = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "q long, question string")
    questions.createOrReplaceTempView("asked_rows")
    got, want = spark.sql("SELECT * FROM extract_candidates(TABLE(asked_rows))"), retrieval.question_candidates(questions)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 10


def test_numbered_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, columns = tmp_path / "rows", "id long, job string, v double"
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), i / 2) for i in range(1000) if i % 7]

    def append(n, lo, hi):
        spark.createDataFrame([r for r in rows if lo <= r[0] < hi], columns).coalesce(1).write.mode("append").parquet(str(path))

    def write():
        stream = numbered.stream(spark, str(path), columns, after=9, most=100)
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))

    append(1, 0, 300)
    assert numbered.drained(write, lambda: True) == len([r for r in rows if 9 < r[0] < 300])
    append(2, 300, 301)
    append(3, 301, 700)
    state = iter([False, False, True, True, True])
    assert numbered.drained(write, lambda: next(state), wait=0.1) == len([r for r in rows if 300 <= r[0] < 700])
    append(4, 700, 1000)
    # A stream that is stopped in the middle and begun again, from the same checkpoint.
    query = write().trigger(processingTime="50 milliseconds").start()
    query.processAllAvailable()
    query.stop()
    assert numbered.drained(write, lambda: True) == 0
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [r for r in rows if r[0] > 9]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, states.ROCKS)
    yield
    spark.conf.set(name, old)


def replayed(spark, tmp_path, df, f, out, steps=4):
    """df cut in files by time, read one by one as a stream."""
    rows = df.orderBy("ts", "id").collect()
    for i in range(steps):
        own = rows[i * len(rows) // steps : (i + 1) * len(rows) // steps]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = f(stream).writeStream.format("memory").queryName(out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(out)


def test_login_limits(spark, tmp_path, rocks):
    rng = random.Random(7)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.choice([1, 5, 20, 60, 400 if i % 50 == 0 else 2])
        rows.append((i, t, rng.choice("pqrs"), rng.randrange(2), rng.random() < 0.15))
    fails, want = {}, {}
    for i, t, user, address, ok in rows:
        for key, most in ((f"u:{user}", 5), (f"a:{address}", 20)):
            recent = [x for x in fails.get(key, []) if x > t - 900]
            want[i, key] = -int(-(recent[-most] + 900 - t) // 1) if len(recent) >= most else 0
            if not ok:
                fails[key] = [*recent, t]
        if ok:
            fails.pop(f"u:{user}", None)
    table = spark.createDataFrame(rows, "id long, t double, user string, address int, ok boolean")
    table = table.select("id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "user", "address", "ok")
    batch = {(r["id"], r["key"]): r["wait"] for r in states.login_waits(table).collect()}
    assert batch == want and any(want.values())
    stream = replayed(spark, tmp_path, table, states.login_waits_stream, "login_waits_out")
    assert {(r["id"], r["key"]): r["wait"] for r in stream.collect()} == want


def test_sessions(spark, tmp_path, rocks):
    day = 86_400
    times = {"a": [(0, True), (600, False), (3_601, False), (29 * day, False), (58 * day, False), (90 * day, False), (90 * day + 5, False), (91 * day, True)], "b": [(50, False), (60, True), (day, False)], "c": [(5 * day, True), (36 * day, False)]}
    rows = [(s, t, login) for s, uses in times.items() for t, login in uses]
    rows = [(i, s, float(t) + 1e6, login) for i, (s, t, login) in enumerate(sorted(rows, key=lambda r: r[1]))]
    want = {}
    for s in times:
        last = None
        for i, _, t, login in (r for r in rows if r[1] == s):
            last, live, touched = states.used(last, t, login)
            want[i] = (s, live, touched)
    assert [want[i] for i, s, *_ in rows if s == "a"] == [("a", *x) for x in ((True, True), (True, False), (True, True), (True, True), (True, True), (False, False), (False, False), (True, True))]
    table = spark.createDataFrame(rows, "id long, session string, t double, login boolean")
    table = table.select("id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "session", "login")
    of = lambda df: {r["id"]: (r["session"], r["live"], r["touched"]) for r in df.collect()}
    assert of(states.session_uses(table)) == want
    assert of(replayed(spark, tmp_path, table, states.session_uses_stream, "session_uses_out")) == want


def test_json_of_documents_survives_what_is_around_it(spark, sf_dir):
    from quire import plans

    rows = plans.queries()["json_salvage"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["lang"] for r in rows} == {d: None if d % 5 == 4 else lang for d, lang in docs.items()}
