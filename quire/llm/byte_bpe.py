"""Byte-level BPE in two tiers: whole pre-tokens of the vocabulary through a minimal perfect hash, the rest by merging.

Tier one hashes the distinct pre-tokens of a batch, looks them up in a minimal perfect hash over the vocabulary, all
at once in numpy, and compares bytes. Tier two merges what is left: bytes are a linked list, candidate pairs a heap
ordered by rank and place, so that a pre-token of n bytes costs n log n however long it is.

Defined results: a null or empty text has no tokens; characters that UTF-8 cannot hold do not occur in a table;
repeated rows repeat; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quire.llm.shared import text_of


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary: the bytes of each id."""
    with open(path, "rb") as file:
        pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, file)]
    words = [b""] * len(pairs)
    for word, rank in pairs:
        words[rank] = word
    return words


class PerfectHash:
    """A minimal perfect hash in levels: keys that fall alone into a cell of a level's bit array stay there, the others go on.

    A key's number is the count of set bits before its own, so n keys have the numbers 0 to n - 1.
    """

    def __init__(self, hashes: np.ndarray, load: float = 1.5):
        self.sizes, bits, rest, level = [], [], hashes, 0
        while len(rest):
            size = max(64, int(len(rest) * load))
            at = self._cell(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            rest, level = rest[~alone[at]], level + 1
            if level > 200:
                raise ValueError("two keys have the same 64-bit hash")
        self.bits = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        self.before = np.cumsum(self.bits) - self.bits
        self.starts = np.cumsum([0, *self.sizes])

    @staticmethod
    def _cell(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; for a hash that is no key some number or -1."""
        found, todo = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.starts[level] + self._cell(hashes[todo], level, size)
            hit = self.bits[at]
            found[todo[hit]] = self.before[at[hit]]
            todo = todo[~hit]
        return found


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class ByteBpe:
    """Encodes and decodes; ids of pre-tokens are remembered, at most ``remember`` of them."""

    def __init__(self, path: str, pattern: str, remember: int = 400_000):
        self.words, self.split = read_ranks(path), regex.compile(pattern).findall
        hashes = hashed(self.words)
        self.table = PerfectHash(hashes)
        self.id_at = np.empty(len(self.words), dtype=np.int64)
        self.id_at[self.table.numbers(hashes)] = np.arange(len(self.words))
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.raw = [np.array([i], dtype="<u4").tobytes() for i in range(len(self.words))]
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def lookup(self, tokens: list[bytes]) -> np.ndarray:
        """Tier one: ids of whole pre-tokens, -1 for those that are not in the vocabulary."""
        at = self.table.numbers(hashed(tokens))
        ids = np.where(at >= 0, self.id_at[at], -1)
        return np.array([i if i >= 0 and self.words[i] == t else -1 for i, t in zip(ids.tolist(), tokens)], dtype=np.int64)

    def merge(self, token: bytes) -> list[int]:
        """Tier two: merges the pair of lowest rank, leftmost first, until no neighbours are in the vocabulary."""
        n, rank = len(token), self.rank
        end = list(range(1, n + 1))  # of the part that starts here; 0 when it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not end[i] or end[i] >= to or end[end[i]] != to:
                continue  # one of its parts has changed since
            end[end[i]], end[i] = 0, to
            if to < n:
                before[to] = i
                if (r := rank.get(token[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (j := before[i]) >= 0 and (r := rank.get(token[j:to])) is not None:
                heapq.heappush(heap, (r, j, to))
        out, i = [], 0
        while i < n:
            out.append(rank[token[i : end[i]]])
            i = end[i]
        return out

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > self.remember:
            self.known.clear()
        new = list(tokens.difference(self.known))
        as_bytes = [t.encode() for t in new]
        for t, b, i in zip(new, as_bytes, self.lookup(as_bytes).tolist() if new else ()):
            self.known[t] = self.raw[i] if i >= 0 else np.array(self.merge(b), dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = list(map(self.split, texts))
        self.learn(set().union(*parts))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of each text."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids = [np.frombuffer(x, dtype="<i4") for x in codec(path, pattern).encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, bytes of each row's ids."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path, pattern)
            out = [own.decode(np.array(x, dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids in the same task."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path, pattern)
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids = own.encode_batch(part.column(1).to_pylist())
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(own.decode(x)) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
