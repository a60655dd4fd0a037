"""Periodic runs of words, found on a harmonic grid by common extensions.

A run of period p and at least 4p words covers four neighbours on the grid 0, p, 2p, ... So for each p the grid's
points jp and (j+1)p are asked how far their words agree forward and backward; both answers give the run's ends. Over
all periods up to n / 4 a text of n words has some n ln n pairs of points. Pairs whose own words differ agree in
nothing and are not asked, nor are those without two more equal pairs behind or around them (four equal points).

How far two places agree forward is the least common prefix between them in the suffix array: the array is built by
prefix doubling in which only groups that are still unsorted are sorted again, common prefixes of neighbours by
Kasai's rule, and the least of a stretch by blocks of 16 with a sparse table over the blocks. Backward, the same over
the reversed words. A period that is a multiple of a smaller one gives a run of the same ends; the smallest is kept.

Texts are taken in batches of some 2**17 words. Words of different texts never compare as equal, so one suffix array serves
a batch. A longer text is a batch of its own; its grid is walked in stretches of periods. So memory follows the words of
a batch, not their number times anything.

Defined results: a null, empty or blank text has n = 0 words, no run and the checksums of nothing; a row without doc_id is
never changed into a periodic one; repeated rows are rows like any others; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import text_of

#: A run has so many periods at least, and so many words.
PERIODS, WORDS = 4, 6
BATCH, GRID, BLOCK = 1 << 17, 1 << 21, 16


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that start there. No suffix may be a prefix of another but the shorter first."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order][1:] != words[order][:-1]])[:n]
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(heads, sizes)
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the array that are not settled
    k = 1
    while len(at):
        active = order[at]
        # A rank counts the suffixes before a group, so a group's places in the array start at its rank.
        ahead = np.where(active + k < n, rank[np.minimum(active + k, n - 1)] + 1, 0)
        by = np.argsort(rank[active] * (n + 1) + ahead, kind="stable")
        active, ahead, group = active[by], ahead[by], rank[active[by]]
        order[at] = active
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=len(at))
        rank[active] = np.repeat(at[heads], sizes)
        at, k = at[np.repeat(sizes > 1, sizes)], 2 * k
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order; words ends with a word of its own.

    Read by place, a prefix is one shorter than that of the place before if the words before the two suffixes agree. The
    others are compared word by word: the first words of all at once, what is left one by one in growing stretches.
    """
    n = len(words)
    prior = np.full(n, -1, dtype=np.int64)
    prior[order[1:]] = order[:-1]
    follows = np.concatenate([[False], (prior[1:] > 0) & (words[:-1] == words[np.maximum(prior[1:] - 1, 0)])])
    heads = np.flatnonzero(~follows & (prior >= 0))
    same, todo = np.zeros(len(heads), dtype=np.int64), np.arange(len(heads))
    for _ in range(BLOCK):
        p, q = heads[todo] + same[todo], prior[heads[todo]] + same[todo]
        todo = todo[words[np.minimum(p, n - 1)] == words[np.minimum(q, n - 1)]]
        same[todo] += 1
    for i in todo.tolist():
        p, q, step = int(heads[i] + same[i]), int(prior[heads[i]] + same[i]), 64
        while True:
            m = min(step, n - max(p, q))
            differ = np.flatnonzero(words[p : p + m] != words[q : q + m])
            if len(differ) or not m:
                same[i] += differ[0] if len(differ) else 0
                break
            same[i] += m
            p, q, step = p + m, q + m, 2 * step
    out = np.zeros(n, dtype=np.int64)
    if len(heads):
        place = np.flatnonzero(prior >= 0)
        run = np.searchsorted(heads, place, side="right") - 1
        out[place] = same[run] - (place - heads[run])
    return out[order]


class Least:
    """Minima of stretches of an array: prefix and suffix minima of blocks, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        self.values = np.concatenate([values, np.full(-len(values) % BLOCK or BLOCK, np.iinfo(np.int64).max)])
        blocks = self.values.reshape(-1, BLOCK)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            row, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(row[:-half], row[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo : hi + 1], for arrays of lo and hi."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        between = b - a - 1
        for level, row in enumerate(self.levels):
            own = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(own):
                left, right = a[own] + 1, b[own] - (1 << level)
                out[own] = np.minimum(out[own], np.minimum(row[left], row[right]))
        within = np.flatnonzero(a == b)
        if len(within):
            out[within] = self.values[lo[within]]
            for k in range(1, BLOCK):
                some = within[lo[within] + k <= hi[within]]
                out[some] = np.minimum(out[some], self.values[lo[some] + k])
        return out


def agreeing(words: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words from places p and q on are the same (p <> q); words ends with a word of its own."""
    order = suffix_array(words)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    least = Least(common_prefixes(words, order))
    a, b = rank[p], rank[q]
    return least.of(np.minimum(a, b) + 1, np.maximum(a, b))


def equal_points(words: np.ndarray, bases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """place and period of each pair of grid points that may lie in a run: three pairs in a row are equal, and it is one."""
    most = sizes // PERIODS
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(most) - most, most)
    pairs = (sizes[text] - 1) // period  # points but one
    places, periods, edges = [], [], np.concatenate([[0], np.cumsum(pairs)])
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + GRID, side="right")) - 1)
        n, total = pairs[lo:hi], int(edges[hi] - edges[lo])
        p = np.repeat(period[lo:hi], n)
        j = np.arange(total) - np.repeat(edges[lo:hi] - edges[lo], n)
        place = np.repeat(bases[text[lo:hi]], n) + j * p
        equal = words[place] == words[place + p]
        left = np.repeat(n, n) - j  # pairs of this period from here on
        three = np.zeros(total + 2, dtype=bool)  # of three[i + 2]: pairs i, i + 1 and i + 2
        three[2:total] = equal[: total - 2] & equal[1 : total - 1] & equal[2:] & (left[: total - 2] >= 3)
        near = np.flatnonzero(three[:-2] | three[1:-1] | three[2:])
        places.append(place[near])
        periods.append(p[near])
        lo = hi
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text (its words as numbers): rows of start, length and period, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    empty = np.zeros((0, 3), dtype=np.int64)
    out = [empty] * len(texts)
    if not sizes.sum():
        return out
    bases = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    words = np.concatenate(texts).astype(np.int64)
    place, period = equal_points(words, bases, sizes)
    if not len(place):
        return out
    # Only texts that have such points are sorted; their words are told apart by the text they are in.
    asked = np.unique(owner[place])
    some = np.isin(owner, asked)
    moved = np.cumsum(some) - 1
    own = np.unique(owner[some] << 32 | words[some], return_inverse=True)[1].astype(np.int64)
    n, at = len(own), moved[place]
    forward = agreeing(np.append(own, own.max() + 1), at, at + period)
    # Place i is n - 1 - i in reverse; the words before it start one further, and before the first there is none.
    back = agreeing(np.append(own[::-1], [own.max() + 1, own.max() + 2]), n - at, n - at - period)
    start, length = place - back, forward + back + period
    keep = length >= np.maximum(WORDS, PERIODS * period)
    found = np.stack([start, length, period], axis=1)[keep]
    found = np.unique(found, axis=0)
    first = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])[: len(found)]
    found = found[first]
    text = owner[found[:, 0]]
    found[:, 0] -= bases[text]
    found = found[np.lexsort((found[:, 2], found[:, 0], text))]
    text = np.sort(text)
    for t in np.unique(text).tolist():
        lo, hi = np.searchsorted(text, [t, t + 1])
        out[t] = found[lo:hi]
    return out


def top_run(found: np.ndarray) -> tuple | None:
    """start, length, period and exponent_milli of the run of greatest length / period, exactly."""
    if not len(found):
        return None
    ratio = found[:, 1] / found[:, 2]
    rows = found[ratio >= ratio.max() * (1 - 1e-12)].tolist()
    start, length, period = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return start, length, period, 1000 * length // period


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """True for the words that stay: no run has them behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word stands at each place: every tenth document (by crc32 of its id) repeats a stretch to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    place = np.arange(n, dtype=np.int64)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame, change: bool = True) -> DataFrame:
    """``RUNS`` of each row. change: documents become periodic first, as ``periodic`` says."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in RUNS.split(", ")]

    def flush(some: list[tuple]) -> pa.RecordBatch:
        codes = pa.array([w for _, words in some for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
        sizes = [len(words) for _, words in some]
        places = [periodic(n, doc) if change else np.arange(n) for n, (doc, _) in zip(sizes, some)]
        texts = [own[place] for own, place in zip(np.split(codes, np.cumsum(sizes)[:-1]), places)]
        rows = []
        for (doc, words), place, found in zip(some, places, runs_of(texts)):
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
            left = b" ".join([words[i] for i in place[kept_words(len(words), found)].tolist()])
            digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), left))
            rows.append((doc, len(found), *(top_run(found) or (None,) * 4), *digests))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass").split()
                if some and held + len(words) > BATCH:
                    yield flush(some)
                    some, held = [], 0
                some.append((batch.column(0)[i].as_py(), words))
                held += len(words) + 1
                if len(some) >= 5_000:
                    yield flush(some)
                    some, held = [], 0
        if some:
            yield flush(some)

    return text_of(docs).mapInArrow(run, RUNS)
