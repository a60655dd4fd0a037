"""Removal of repeated byte strings through suffix arrays of shards.

1. Anchors. Every string of ``length`` bytes picks, among its ``gram``-byte grams, the one of smallest hash (of equals
   the rightmost). Equal strings pick equal grams at equal places, so a string can only be repeated where its gram
   is. Grams are counted over all documents; strings with a gram that occurs once are done with.
2. Contexts. Each anchor whose gram is repeated takes the bytes of the strings that picked it to the owner of the
   gram. Before that a task folds equal contexts into one: a passage that many documents share is sent once a task.
   Strings that picked a gram found more than ``hot`` times are parted by how far the gram lies behind their start,
   into runs of a quarter, of a sixteenth (over 4 * hot) or of one string (over 16 * hot). Strings of a run share the
   bytes between the latest start and the earliest end; equal strings have equal shared bytes, whose hash names the
   owner. So no owner gathers more strings of a key than ``hot`` anchors pick.
3. Shards. An owner packs contexts into shards of bounded size and builds each shard's suffix array by
   Larsson-Sadakane refinement (only groups that are still unsorted are sorted again, by ranks at twice the depth),
   then the common prefixes of neighbours by Kasai's rule. A string is repeated where such a prefix has its length.
   Where a key's contexts end up in several shards, these are merged, one pair at a time: the strings of one, in
   slices, are looked up by binary search in the other's, which its suffix array has in order.
4. Ranges go back to their documents, which drop the bytes covered.

Defined results: a null text is an empty one; a text shorter than ``length`` keeps all its bytes; texts may be cut
inside a character, as bytes count; repeated rows are repeated strings; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored, text_of

LENGTH, GRAM, HOT = 200, 48, 2_000
#: Bytes that a task takes up at once: of texts, and of contexts with what holds them.
STEP, HELD = 1 << 19, 24 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, from prefix sums of a polynomial modulo 2**64."""
    n = len(raw)
    up = np.full(n + 1, _MULTIPLIER, dtype=np.uint64)
    up[0] = 1
    down = np.full(n + 1, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    x = (sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def picked(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of the smallest, of equals the rightmost; by doubling."""
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        step = min(size, window - size)
        later = value[step:] <= value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    return place


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc, mark (of the text), and arrays by anchor: h, and at, which holds three numbers: the first string that
    picks it, how far the anchor lies behind that (16 bits) and how many strings pick it (16 bits)."""
    window = length - gram + 1

    def flush(some: list) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(t for _, _, _, t in some), dtype=np.uint8)
        sizes = np.array([len(t) for _, _, _, t in some], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        h = gram_hashes(raw, gram)
        place = picked(h, window)
        out = []
        for (doc, mark, lo, _), at, n in zip(some, starts.tolist(), sizes.tolist()):
            own = place[at : at + n - length + 1]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out.append((doc, mark, h[own[first]].view(np.int64), lo + first << 32 | (own[first] - at - first) << 16 | np.diff(first, append=len(own))))
        doc, mark, *arrays = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in arrays)], ["doc", "mark", "h", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            doc, mark, raw = batch.columns
            for i in range(batch.num_rows):
                text = raw[i].as_py()
                # A long text goes in parts that overlap, so that every string is in one part.
                for lo in range(0, len(text) - length + 1, STEP):
                    some.append((doc[i].as_py(), mark[i].as_py(), lo, text[lo : lo + STEP + length - 1]))
                    held += len(some[-1][3])
                    if held >= STEP:
                        yield flush(some)
                        some, held = [], 0
        if some:
            yield flush(some)

    long_enough = docs.filter(F.length("raw") >= length)
    return long_enough.select("doc", "mark", "raw").mapInArrow(run, "doc long, mark long, h array<long>, at array<long>")


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with raw compressed (zstd), for the way to where the bytes are needed again: shuffles take less disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(map(pack, part.column(3).to_pylist()), pa.binary())], ["doc_id", "doc", "mark", "raw"])

    return docs.select("doc_id", "doc", "mark", "raw").mapInArrow(run, "doc_id long, doc long, mark long, raw binary")


CONTEXT = "key long, back int, strings int, context binary, doc long, mark long, lo int, done boolean"


def contexts(docs: DataFrame, found: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Rows of two kinds: contexts for the owners of keys, with the place of their only document or done (known to be
    repeated); and ranges that this task knows to be repeated, with null context."""
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        rows, known = [], []
        for (key, back, context), (strings, places) in held.items():
            if len(places) == 1:
                rows.append((key, back, strings, context, *places[0], False))
            else:
                rows.append((key, back, strings, context, None, None, None, True))
                known.extend((*p, strings) for p in places)
        run: list | None = None
        for doc, mark, lo, strings in sorted(known):  # runs of strings, one row each, dealt by document
            if run and run[:2] == [doc, mark] and lo <= run[2] + run[3]:
                run[3] = max(run[3], lo + strings - run[2])
            else:
                if run:
                    rows.append((run[1], 0, run[3], None, *run[:3], True))
                run = [doc, mark, lo, strings]
        if run:
            rows.append((run[1], 0, run[3], None, *run[:3], True))
        for lo in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 20_000]), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, unpack = 0, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            docs, marks, texts, *own = batch.columns
            edges, own = own[0].offsets.to_pylist(), [c.values.to_numpy() for c in own]
            for i in range(batch.num_rows):
                doc, mark, raw = docs[i].as_py(), marks[i].as_py(), unpack(texts[i].as_py())
                for h, at, n in zip(*(c[edges[i] : edges[i + 1]].tolist() for c in own)):
                    level = sum(n > hot * k for k in (1, 4, 16))
                    for key, back, strings, lo in parted(raw, h, at, level, length, window):
                        context = raw[lo : lo + strings - 1 + length]
                        if (entry := held.get((key, back, context))) is None:
                            entry = held[key, back, context] = (strings, [])
                            size += len(context) + 500
                        entry[1].append((doc, mark, lo))
                        size += 200
                    if size > HELD:
                        yield from flush(held)
                        held, size = {}, 0
        yield from flush(held)

    window = length - gram + 1
    joined = docs.join(found, [docs["doc"] == found["fdoc"], docs["mark"] == found["fmark"]])
    return joined.select("doc", "mark", "raw", "own.h", "own.at", "own.n").mapInArrow(run, CONTEXT)


def parted(raw: bytes, h: int, at: int, level: int, length: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """key, back (how far the gram lies behind the first string), number of strings and first string of each run."""
    lo, back, n = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
    if not level:
        yield h, back, n, lo
        return
    anchor, size = lo + back, 1 if level == 3 else -(-window // 4**level)
    for j in range((back - n + 1) // size, back // size + 1):
        far, near = min(back, j * size + size - 1), max(back - n + 1, j * size)
        shared = raw[anchor - j * size : anchor - (j * size + size - 1) + length]
        yield xxhash.xxh64_intdigest(shared, j << 2 | level) - (1 << 63), far, far - near + 1, anchor - far


def suffix_ranks(text: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement to ``depth`` (a power of two, 8 at least): rank of each place and the unsorted places.

    room: bytes from each place to the end of its context. A rank is the number of places that sort before; places
    of equal rank agree in ``depth`` bytes. Places with less room than the depth reached stand alone.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    first = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | padded[i : i + n]
    rank = -1 - np.arange(n, dtype=np.int64)
    active = np.flatnonzero(room >= 8)
    order = np.argsort(first[active])
    active, key = active[order], first[active][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    head = np.flatnonzero(new)
    sizes = np.diff(head, append=len(key))
    rank[active] = np.repeat(head, sizes)
    active, k = active[np.repeat(sizes > 1, sizes)], 8
    while k < depth and len(active):
        active = active[room[active] >= 2 * k]
        old, ahead = rank[active], rank[active + k]
        order = np.argsort((old << 32) | (ahead + n + 1))  # ranks run from -n to n: both fit in one word
        active, old, ahead = active[order], old[order], ahead[order]
        group = np.concatenate([[True], old[1:] != old[:-1]])[: len(old)]
        new = group | np.concatenate([[True], ahead[1:] != ahead[:-1]])[: len(old)]
        groups, heads = np.flatnonzero(group), np.flatnonzero(new)
        sizes = np.diff(heads, append=len(old))
        start = np.repeat(groups, np.diff(groups, append=len(old)))
        rank[active] = old + np.repeat(heads, sizes) - start
        active, k = active[np.repeat(sizes > 1, sizes)], 2 * k
    return rank, active


def common_prefixes(text: np.ndarray, room: np.ndarray, sorted_places: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each place with the one before it in order: only places whose predecessor is not the
    follower of the previous place's predecessor are compared byte by byte; the others have one byte less."""
    place, prior = sorted_places[1:], sorted_places[:-1]
    order = np.argsort(place)
    p, q = place[order], prior[order]
    follows = np.zeros(len(p), dtype=bool)
    follows[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
    heads = np.flatnonzero(~follows)
    most = np.minimum(room[p[heads]], room[q[heads]])
    same, todo = np.zeros(len(heads), dtype=np.int64), np.arange(len(heads))
    while len(todo):
        at = same[todo]
        go = at < most[todo]
        todo, at = todo[go], at[go]
        equal = text[p[heads[todo]] + at] == text[q[heads[todo]] + at]
        todo = todo[equal]
        same[todo] += 1
    run = np.cumsum(~follows) - 1
    prefix = same[run] - (p - p[heads][run])
    out = np.zeros(len(sorted_places), dtype=np.int64)
    out[1:][order] = prefix
    return out


class Shard:
    """Contexts packed into one text, its sorted strings and which of them are repeated in it."""

    def __init__(self, rows: list[tuple], length: int):
        depth = 8
        while depth * 2 <= length:
            depth *= 2
        self.rows, self.length = rows, length
        self.text = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
        self.base = np.cumsum(sizes) - sizes
        room = np.repeat(self.base + sizes, sizes) - np.arange(len(self.text))
        strings = np.array([r[2] for r in rows], dtype=np.int64)
        starts = np.arange(len(self.text)) - np.repeat(self.base, sizes) < np.repeat(strings, sizes)
        rank, unsorted = suffix_ranks(self.text, room, depth)
        self.rank, self.step, self.strings = rank.astype(np.int32), length - depth, strings
        places = self.in_order(np.sort(unsorted[starts[unsorted]]))
        twin = common_prefixes(self.text, room, places) >= length
        self.repeated = np.zeros(len(self.text), dtype=bool)
        self.repeated[places[twin]] = True
        self.repeated[places[:-1][twin[1:]]] = True

    def in_order(self, places: np.ndarray) -> np.ndarray:
        """Starts of strings in the order of the suffix array: the rank of their first bytes, then of their last ones.

        Stable: equal strings stay in the order of the text, so that few prefixes have to be compared.
        """
        ranks = self.rank[places].astype(np.int64) << 32 | (self.rank[places + self.step] + np.int64(len(self.text) + 1))
        return places[np.argsort(ranks, kind="stable")]

    def of_row(self, i: int) -> np.ndarray:
        return self.base[i] + np.arange(self.strings[i])

    def of_key(self, key: int) -> np.ndarray:
        """The starts of a key's strings, in order."""
        return self.in_order(np.concatenate([self.of_row(i) for i, r in enumerate(self.rows) if r[0] == key]))

    def bytes_at(self, places: np.ndarray) -> np.ndarray:
        """Strings as values that compare like their bytes: they have one length, so zeros at the end make no two equal."""
        return np.lib.stride_tricks.sliding_window_view(self.text, self.length)[places].view(f"S{self.length}").ravel()

    def ranges(self) -> Iterator[tuple]:
        """doc, mark, first and last byte + 1 of each run of repeated strings."""
        for i, (_, _, n, _, doc, mark, lo, done) in enumerate(self.rows):
            if done:
                continue
            hit = self.repeated[self.base[i] : self.base[i] + n]
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    yield doc, mark, lo + a, lo + b - 1 + self.length


def merged(shards: list[Shard], key: int, at_once: int = 1 << 16) -> None:
    """Marks the strings of a key that occur in several of its shards; two slices of strings are in memory at a time.

    One place of equal strings is enough to find: the others of its shard are marked already.
    """
    places = [s.of_key(key) for s in shards]
    for x, own in enumerate(places):
        for lo in range(0, len(own), at_once):
            there = own[lo : lo + at_once]
            table = shards[x].bytes_at(there)
            for y in range(x):
                for a in range(0, len(places[y]), at_once):
                    asked = places[y][a : a + at_once]
                    wanted = shards[y].bytes_at(asked)
                    if wanted[0] > table[-1] or wanted[-1] < table[0]:
                        continue
                    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
                    hit = table[at] == wanted
                    shards[y].repeated[asked[hit]] = True
                    shards[x].repeated[there[at[hit]]] = True


def owners(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """doc, mark, a, b: the repeated ranges of all rows, which are dealt by key and sorted by it."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "mark", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, list, bool]] = {}  # equal contexts of several tasks are one
        waiting: list[Shard] = []  # shards whose ranges are not out yet, as a key goes on through them
        out: list[tuple] = []
        size = 0

        def settle(keep: list[Shard]) -> None:
            nonlocal waiting
            if len(waiting) > 1:
                merged(waiting, waiting[-1].rows[0][0])
            out.extend(r for s in waiting[: len(waiting) - len(keep)] for r in s.ranges())
            waiting = keep

        def close() -> None:
            nonlocal held, size
            if held:
                rows = []
                for (key, back, context), (strings, places, done) in held.items():
                    done = done or len(places) > 1
                    out.extend((doc, mark, lo, lo + strings - 1 + length) for doc, mark, lo in places if done)
                    rows.append((key, back, strings, context, *(places[0] if places else (None, None, None)), done))
                shard = Shard(rows, length)
                if waiting and rows[0][0] != waiting[-1].rows[-1][0]:
                    settle([])
                waiting.append(shard)
                if len(waiting) > 1 and rows[-1][0] != rows[0][0]:
                    settle([shard])
                held, size = {}, 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] is None:
                    out.append((row[4], row[5], row[6], row[6] + row[2] - 1 + length))
                    continue
                key, back, strings, context, doc, mark, lo, done = row
                if (entry := held.get((key, back, context))) is None:
                    entry = held[key, back, context] = (strings, [], done)
                    size += len(context)
                elif done and not entry[2]:
                    entry = held[key, back, context] = (strings, entry[1], True)
                if doc is not None:
                    entry[1].append((doc, mark, lo))
                if size >= shard_bytes:
                    close()
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        close()
        settle([])
        if out:
            yield batch_of(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, mark long, a int, b int")


def removed(raw: bytes, ranges: list) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and the bytes kept."""
    kept, at, gone, runs = [], 0, 0, 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if runs and a <= at:
            if b > at:
                gone, at = gone + b - at, b
            continue
        kept.append(raw[at:a])
        gone, at, runs = gone + b - a, b, runs + 1
    return gone, runs, b"".join([*kept, raw[at:]])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) of every row of docs."""
    raw = text_of(docs).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("mark"), F.encode("text", "UTF-8").alias("raw"))
    marked = stored(anchors(raw, length, gram), "anchors")
    each = marked.select(F.col("doc").alias("fdoc"), F.col("mark").alias("fmark"), F.explode(F.arrays_zip("h", "at")).alias("x")).select("fdoc", "fmark", "x.*")
    # Stored, so that the join that follows has a plain shuffle on either side and can split a hot gram's rows.
    often = stored(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    # A set: equal rows of one doc_id have the same anchors, and each of the rows meets them once.
    found = each.join(often, "h").groupBy("fdoc", "fmark").agg(F.collect_set(F.struct("h", "at", "n")).alias("own"))
    packed = squeezed(raw)
    ranges = owners(contexts(packed, found, length, gram, hot), length, shard_bytes)
    gone = ranges.groupBy("doc", "mark").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    gone = stored(gone, "ranges", free=True).select(F.col("doc").alias("rdoc"), F.col("mark").alias("rmark"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts, own = [unpack(x) for x in part.column(1).to_pylist()], part.column(2).to_pylist()
                out = [removed(t, r or ()) for t, r in zip(texts, own)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed.join(gone, [packed["doc"] == gone["rdoc"], packed["mark"] == gone["rmark"]], "left").select("doc_id", "raw", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """For tests: removed bytes, runs and digest of what is kept, by counting every string."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        own = [{"a": i, "b": i + length} for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        gone, runs, kept = removed(t, own)
        out.append((gone, runs, hashlib.sha256(kept).hexdigest()))
    return out
