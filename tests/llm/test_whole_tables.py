"""Each operator over whole tables against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quire.llm import queries as llm
from quire.llm import suffix_dedup


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, sf_dir, name):
    return llm.queries()[name](spark, sf_dir).collect()


def test_packing(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows_of(spark, sf_dir, "op1_best_fit_packing"):
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], dtype="<u4")
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(own, key=lambda r: r["piece"])] == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for own in by_doc.values() for r in own)
    assert len(by_sequence) <= -(-total // 4096) + 1


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_exact_dedup"])
def test_equal_to_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    said = con.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(said.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*said.columns).collect()))) == sorted(map(str, said.fetchall()))


def test_quality(spark, sf_dir):
    found = {r["doc_id"]: r for r in rows_of(spark, "/root/testdata/sf0.01", "op4_quality_classifier")}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in found.items())
    held = [(r["predicted"], truth[d]) for d, r in found.items() if r["held_out"] and d in truth]
    for label in (0, 1):
        own = [p == t for p, t in held if t == label]
        assert sum(own) / len(own) >= 0.9


def test_secrets(spark, sf_dir, texts):
    import re

    true = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    want = {(d, hashlib.sha256(m.encode()).hexdigest()) for d, t in texts.items() for m in true.findall(t)}
    found = rows_of(spark, sf_dir, "op5_secret_scan")
    assert {(r["doc_id"], r["candidate_sha256"]) for r in found if r["is_secret"]} == want


def test_language(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows_of(spark, sf_dir, "op6_language_id") if r["held_out"] and langs[r["doc_id"]]]
    assert sum(held) / len(held) >= 0.95


def test_neighbours(spark):
    """Scores, order and recall of the query itself, with its own parameters, against brute force."""
    sf_dir = "/root/testdata/sf0.1"
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    x = np.array([table[i] for i in ids], dtype=np.float64)
    by_query = {}
    for r in rows_of(spark, sf_dir, "op7_nearest_neighbours"):
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in by_query.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        scores = x @ np.array(table[q], dtype=np.float64)
        assert np.allclose([s for _, _, s in found], scores[np.searchsorted(ids, [v for _, v, _ in found])], rtol=0, atol=1e-12)
        scores[ids == q] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits / (20 * len(by_query)) >= 0.9


def test_suffix(spark, sf_dir, texts):
    want = dict(zip(texts, suffix_dedup.brute_force([t.encode() for t in texts.values()], 200)))
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op8_suffix_dedup")}
    assert {d: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want
    assert all(r["n_bytes"] == len(texts[d].encode()) for d, r in got.items())


def test_byte_bpe(spark, sf_dir, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows_of(spark, sf_dir, "op9_byte_bpe"):
        ids = np.array(plain.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha(texts[r["doc_id"]].encode()))


def marks_by_counting(texts):
    out = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        out[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def groups_by_pairs(marks):
    root = {d: d for d in marks}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in marks}


def test_simhash(spark, sf_dir, texts):
    marks = marks_by_counting(texts)
    groups = groups_by_pairs(marks)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf_dir, "op10_simhash_dedup")}
    assert got == {d: (format(marks[d], "016x"), groups[d]) for d in texts}
