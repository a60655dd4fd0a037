"""Sharding, the audit of filters and periodic runs: against their laws, SQL and brute force, also for odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import audit, queries as llm, runs, sharding


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def check_shards(rows, sizes, shards=8):
    assert Counter(r["size"] for r in rows) == Counter(sizes)
    loads = [0] * shards
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        loads[s] = sum(r["size"] for r in own)
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    return loads


def test_sharding(spark, sf_dir):
    texts = texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = llm.queries()["op11_sharding"](spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    loads = check_shards(rows, [len(t.encode()) + 1 for t in texts.values()])
    assert max(loads) - min(loads) <= max(r["size"] for r in rows) and max(loads) <= 1.01 * sum(loads) / 8
    of_text = {}
    for r in rows:
        of_text.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    mean = sum(loads) / len(rows)
    whole = [s for t, s in of_text.items() if len(s) * (len(t.encode()) + 1 + mean) <= 2 * sum(loads) / 64]
    assert all(len(set(s)) == 1 for s in whole) and max(map(len, whole)) > 1


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard_table(odd_docs).collect()
    check_shards(rows, [len((r["text"] or "").encode()) + 1 for r in odd_docs.collect()])
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert sharding.shard_table(no_docs).count() == 0
    plan = sharding.planned(sharding.keyed(odd_docs), 3, 4)
    clash = sharding.with_shard(odd_docs.withColumn("SHARD", F.lit("x")), plan)
    assert clash.columns == [*odd_docs.columns, "SHARD", "_shard"] and clash.count() == 13


def test_sharding_of_hot_groups(spark):
    """A third of all rows has one text, a third has none: both are cut, shards stay even in bytes, ranges in rows."""
    docs = spark.range(9_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same "), 40)).when(F.col("id") % 3 == 1, F.repeat(F.col("id").cast("string"), 30)).alias("text"),
    )
    rows = sharding.shard_table(docs, shards=4, per_shard=16).collect()
    loads = check_shards(rows, [len(r["text"] or "") + 1 for r in docs.collect()], 4)
    assert max(loads) <= 1.03 * sum(loads) / 4
    kept = sharding.stored(sharding.keyed(docs), "keys")
    plan = sharding.planned(kept, 4, 16)
    held = kept.groupBy(sharding.range_of(plan.splitters, F.col("key")).alias("range")).count().collect()
    assert max(r["count"] for r in held) <= 4 * 2 * 9_000 / 64


def test_binary_search_counts_splitters(spark):
    cuts = [(2, sharding.LEAST, sharding.LEAST), (2, 5, 0), (7, 1, 1), (7, 1, 2), (9, 0, 0)]
    keys = [(h, g, u) for h in range(11) for g in (0, 1, 5, 6) for u in range(3)]
    df = spark.createDataFrame([(k,) for k in keys], "key struct<h:bigint,g:bigint,u:bigint>")
    got = df.select("key", sharding.range_of(cuts, F.col("key")).alias("at")).collect()
    assert all(r["at"] == sum(c <= tuple(r["key"]) for c in cuts) for r in got)
    assert df.select(sharding.range_of([], F.col("key"))).distinct().collect() == [(0,)]


def test_largest_ranges_are_dealt_first():
    placed = {r["range"]: r for r in sharding.dealt([(0, 10, 2), (1, 90, 3), (2, 50, 1), (3, 45, 7)], 2)}
    assert [placed[k]["shard"] for k in range(4)] == [0, 0, 1, 1] and [placed[k]["start"] for k in range(4)] == [0, 2, 0, 1]


def test_shards_are_written(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "out"), shards=3, per_shard=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 13 and set(odd_docs.columns) < set(back.columns)


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, lang). Applies every order to every document, one filter after the other."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    smallest, fails = {}, []
    for d, text, _ in rows:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    for d, text, lang in rows:
        t = text or ""
        words = t.encode().split()
        own = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        own += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        own += "E" * (d is not None and smallest[t] < d)
        fails.append((lang or "", own, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            here = [f for f in fails if f[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in here if f in x[1]]
                redundant, unique = sum(f in x[1] for x in gone), sum(x[1] == f for x in fails if x[0] == part)
                here, gone = [x for x in here if f not in x[1]], gone + hit
                shapley[f] += len(hit)
                out[part, "".join(order), step] = [len(here), len(hit), redundant, unique, sum(x[2] for x in hit), sum(x[3] for x in hit), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    said = con.sql(llm.oracle_sql()["op12_filter_audit"])
    got = llm.queries()["op12_filter_audit"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*said.columns).collect())) == sorted(said.fetchall())
    assert got.count() % 600 == 0


def test_audit_odd_rows(spark, odd_docs, no_docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    marks = [tuple(r) for r in labels.collect()]
    for docs, own in ((odd_docs, rows), (odd_docs.unionAll(odd_docs), rows * 2)):
        got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.filter_audit(docs, labels).collect()}
        assert got == audit_by_hand(own, marks)
    assert audit.filter_audit(no_docs, labels).count() == 0
    assert audit.filter_audit(odd_docs, labels.filter("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_matrices():
    found = audit.incidence()
    assert {m.shape for m in found.values()} == {(32, 600)}
    assert ((found["kept"] + found["removed"]).sum(axis=0)[4::5] < 32).all()
    # A document of mask m is removed once in every order, but for mask 0.
    assert (found["removed"].reshape(32, 120, 5).sum(axis=2) == np.array([0] + [1] * 31)[:, None]).all()


def runs_by_hand(words):
    seen = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p):
                seen.setdefault((s, i + p - s), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in seen.items()), key=lambda r: (r[0], r[2]))


def report_by_hand(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g, first = h // 10, list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [first[i] if i < a else first[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = texts_of(docs)
    got = [tuple(r) for r in llm.queries()["op13_periodic_runs"](spark, sf_dir).collect()]
    short = {d for d, t in texts.items() if len(t) < 20_000}
    assert len(short) > 0.9 * len(texts) and Counter(r[0] for r in got) == Counter(list(texts))
    assert sorted(r for r in got if r[0] in short) == sorted(report_by_hand(d, texts[d]) for d in short)


def test_runs_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, runs.run_report(odd_docs.filter("doc_id <> 8")).collect()), key=str)
    want = [report_by_hand(r["doc_id"], r["text"]) for r in odd_docs.filter("doc_id not in (7, 8)").collect()]
    assert [r for r in got if r[0] != 7] == sorted((r for r in want if r[0] is not None), key=str)
    assert len(runs.run_report(odd_docs).collect()) == 13 and runs.run_report(no_docs).count() == 0
    rows = [(i, t) for i, t in enumerate(["a " * 5, "a " * 6, "x a b a b a b a b y", "a b a b a b a", "b a a a a a a a a b " * 5])]
    plain = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string"), change=False).orderBy("doc_id").collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in plain] == [
        (0, None, None, None, None), (1, 0, 6, 1, 6000), (1, 1, 8, 2, 4000), (0, None, None, None, None), (6, 1, 8, 1, 8000)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(80):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(60))]
            unit = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
            texts.append(words + (unit * 9)[: rng.randrange(60)])
        found = runs.runs_of([np.array(t, dtype=np.int64) for t in texts])
        assert [list(map(tuple, f.tolist())) for f in found] == [runs_by_hand(t) for t in texts]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 400):
        for letters in (1, 2, 30):
            words = np.append(rng.integers(0, letters, n), letters)
            order = runs.suffix_array(words)
            tails = [words[i:].tolist() for i in range(n + 1)]
            assert order.tolist() == sorted(range(n + 1), key=tails.__getitem__)
            common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            want = [0, *(common(tails[a], tails[b]) for a, b in zip(order[:-1], order[1:]))]
            assert runs.common_prefixes(words, order).tolist() == want
            p, q = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
            p, q = p[p != q], q[p != q]
            assert runs.agreeing(words, p, q).tolist() == [common(tails[a], tails[b]) for a, b in zip(p, q)]
