"""Best-fit packing of tokenised documents into sequences, with certified numbers of sequences.

Pieces are dealt to partitions; each packs its own by best-fit decreasing and compares its number of sequences with
the lower bound of dual feasible functions. A partition that meets its bound is certified: no packing of its pieces
has fewer sequences, so it keeps them, but for those at most half full, which pieces of other partitions can still
join. A partition that is not certified puts all its sequences with gaps into a pool. The pool's pieces are dealt
anew, among all partitions that gave any, and packed again, until the pool meets its own bound or has no fewer
sequences than the round before. Nothing is gathered in one task but a partition of ``per_partition`` pieces.

Defined results: a null or empty text is one piece, of the end token alone; repeated rows and doc_ids are packed as
often as they occur; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored, text_of

CAPACITY, END_ID = 4096, 1
#: Python's str.split() parts at these, the tokenizer does not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Fixed value: how the tokenizer parts lower-case text. Below LATIN_END no characters combine.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LATIN_END = "\u0250"
RAW_ID = struct.Struct("<I").pack


class WordEncoder:
    """Token ids of a text as little-endian 32-bit integers; the ids of runs without white space are remembered.

    The tokenizer drops white space, folds case, parts runs into words and marks, and merges within these, so a text's
    ids are those of its parts, one after another. Runs of Latin letters are parted here and their parts merged by the
    tokenizer's model; other runs go through the whole tokenizer.
    """

    def __init__(self, path: str, remember: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.merge = self.tokenizer.model.tokenize
        # Two generations each: what has not been used for a while is forgotten.
        self.runs, self.old_runs, self.parts, self.old_parts = {}, {}, {}, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        #: The model's alphabet: bytes that print stand for themselves, the others for the characters from 256 on.
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def part(self, word: str) -> bytes:
        if (own := self.parts.get(word)) is None:
            if (own := self.old_parts.get(word)) is None:
                letters = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
                own = b"".join([RAW_ID(t.id) for t in self.merge(letters)])
            self.parts[word] = own
        return own

    def run(self, run: str) -> bytes:
        if run.isalpha() and run.isascii():
            return self.part(run.lower())
        if (run.isascii() or max(run) < LATIN_END) and "<|" not in run and run.isprintable():
            return b"".join(map(self.part, PARTS.findall(run.lower())))
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, texts: list[str]) -> None:
        """Encodes the runs of these texts that are not known yet."""
        if len(self.runs) > self.remember:
            self.old_runs, self.runs = self.runs, {}
        if len(self.parts) > self.remember:
            self.old_parts, self.parts = self.parts, {}
        for w in set().union(*map(str.split, texts)).difference(self.runs):
            self.runs[w] = own if (own := self.old_runs.get(w)) is not None else self.run(w)

    def ids(self, text: str) -> bytes:
        """Of a text whose runs are known."""
        if any(c in text for c in NOT_SPACE):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end token, cut only where over capacity."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, out = part.column(1).to_pylist(), []
                encoder.learn(texts)
                for doc_id, text in zip(part.column(0).to_pylist(), texts):
                    raw = encoder.ids(text) + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and its offset there. ``free`` has a bit for every gap that some bin has."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_bins: dict[int, list[int]] = {}
    free, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = free >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            own = open_bins[gap]
            b = own.pop()
            if not own:
                free &= ~(1 << gap)
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - n not in open_bins:
            open_bins[gap - n] = []
        open_bins[gap - n].append(b)
        free |= 1 << (gap - n)
    return bins, offsets


def thresholds(capacity: int) -> list[int]:
    """The parameters of the dual feasible functions that bounds are taken over; 0 is the plain sum of lengths."""
    return sorted({0, *(capacity * k // 24 for k in range(1, 13))})


def dual_feasible(length: np.ndarray, capacity: int, t: int) -> np.ndarray:
    """Lengths over capacity - t count as a whole sequence, those under t as nothing."""
    return np.where(length > capacity - t, capacity, np.where(length < t, 0, length))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return max((-(-int(dual_feasible(lengths, capacity, t).sum()) // capacity) for t in thresholds(capacity)), default=0)


def certificate(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: a lower bound for the number of sequences that any packing of these pieces has."""
    x, cap = F.col("length"), F.lit(capacity)
    sums = [F.coalesce(F.sum(F.when(x > capacity - t, cap).when(x < t, F.lit(0)).otherwise(x)), F.lit(0)) for t in thresholds(capacity)]
    return cut.agg(F.greatest(*(F.ceil(s / capacity) for s in sums)).cast("long").alias("bound"))


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long, certified boolean"


def packer(r: int, capacity: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one partition of round r."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        met = len(used) == lower_bound(lengths, capacity)
        return rows.drop(columns="part").assign(sequence_id=(r << 56) | (int(key[0]) << 32) | bins, offset=offsets, free=capacity - used[bins], certified=met)

    return packed


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = 40_000, slack: int = 16) -> DataFrame:
    """Adds sequence_id, offset, free (tokens of that sequence left over) and certified (its partition met its bound).

    slack: sequences of uncertified partitions with more free tokens than this have a gap.
    """
    cut = stored(cut, "pieces")
    n, done, before = cut.count(), None, None
    gap = F.col("free") > F.when(F.col("certified"), capacity // 2).otherwise(slack)
    for r in count():
        parts = max(1, -(-n // per_partition))
        deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(r)), F.lit(parts)).alias("part")

        now = stored(cut.select("*", deal).groupBy("part").applyInPandas(packer(r, capacity), PACKED), f"round{r}")
        gaps = now.filter(gap)
        left, bins = gaps.count(), gaps.filter("offset = 0").count()
        over = parts == 1 or left == 0 or (before is not None and bins >= before) or bins <= gaps.transform(lambda g: certificate(g, capacity)).first()["bound"]
        keep = now if over else now.filter(~gap)
        done = keep if done is None else done.unionByName(keep)
        if over:
            return done
        cut, n, before = gaps.select(*cut.columns), left, bins
