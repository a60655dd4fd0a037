"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample of distinct vectors: each node splits at the median of its sample's projections
on a random direction, down to ``leaves`` leaves a tree, whatever the size of the table. Every vector of the table is
then sent down all trees; its leaves are its index cells. A query walks all trees at once through one queue ordered by
the distance to the planes it has to cross, and takes leaves until they hold ``share`` times as many vectors as the
table has (a vector counts once for every tree), or ``budget`` vectors where that is given.

A vector is kept by one owner, a query goes to the owners that hold a vector of one of its leaves. Owners are runs of
neighbouring leaves of the first tree, ``owners`` of them; one that would hold more than ``block`` vectors is split by
a hash. An owner reads its vectors once, streams the queries past them and returns one top list for each, ranked by
exact inner products in double precision; the lists of a query's owners are merged.

Inner products are searched as distances: vectors get one more coordinate that makes their norms equal.

Equal vectors are indexed once, with the k + 1 smallest of their ids, which is all that a ranking of k can show.

Defined results: vectors that are null, of another length than most, zero, or with null or non-finite components
take no part; rows without vec_id take no part; ties go to the smaller vec_id; a repeated row counts once; fewer
candidates than k give fewer rows; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.shared import stored

RESULT = "query_id long, rank int, vec_id long, score double"


class Tree:
    """Planes of inner nodes (children >= 0 are nodes, others -1 - leaf)."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.cuts, self.children, self.leaves = [], [], [], 0
        self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.normals = np.array(self.normals).reshape(-1, sample.shape[1])
        self.cuts = np.array(self.cuts)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            normal = rng.normal(size=sample.shape[1])
            normal /= np.linalg.norm(normal)
            x = sample[rows] @ normal
            cut = float(np.median(x))
            right = x >= cut
            if right.any() and not right.all():
                own = len(self.normals)
                self.normals.append(normal)
                self.cuts.append(cut)
                self.children.append([0, 0])
                self.children[own] = [self._grow(sample, rows[~right], leaf, rng), self._grow(sample, rows[right], leaf, rng)]
                return own
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64) if len(self.normals) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normals[node]) >= self.cuts[node]).astype(np.int64)
            at[inner] = self.children[node, side]
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, norm: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm = norm
        self.trees = [Tree(self.lifted(sample), leaf, rng) for _ in range(trees)]
        self.offset = np.cumsum([0, *(t.leaves for t in self.trees)])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree."""
        lifted = self.lifted(x)
        return np.stack([t.leaf_of(lifted) + o for t, o in zip(self.trees, self.offset)], axis=1)

    def search(self, q: np.ndarray, held: np.ndarray, budget: float) -> list[int]:
        """The cells of one query, nearest first, until they hold ``budget`` vectors."""
        lifted = np.append(q, 0.0)
        margins = [(t.normals @ lifted - t.cuts).tolist() for t in self.trees]
        children = [t.children.tolist() for t in self.trees]
        queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(self.trees)]
        found, total = [], 0
        while queue and total < budget:
            far, k, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[k][node]
                a, b = children[k][node]
                near, other = (b, a) if m >= 0 else (a, b)
                heapq.heappush(queue, (max(far, abs(m)), k, other))
                node = near
            cell = int(self.offset[k]) - 1 - node
            if held[cell]:
                found.append(cell)
                total += held[cell]
        return found


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    most = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.filter(F.size("v") == (most["d"] if most else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


class Owners:
    """Who holds which vectors: runs of leaves of the first tree, split where they are large; and what their cells are."""

    def __init__(self, forest: Forest, counts: list[tuple[int, int, int]], owners: int, block: int):
        """counts: home (cell of the first tree), cell, and how many vectors have both."""
        first, cells = int(forest.offset[1]), int(forest.offset[-1])
        both = np.zeros((first, cells), dtype=np.int64)
        for home, cell, n in counts:
            both[home, cell] = n
        self.held = both.sum(axis=0)
        size = self.held[:first]
        self.run_of = np.minimum((np.cumsum(size) - size // 2) * owners // max(1, size.sum()), owners - 1)
        in_run = np.bincount(self.run_of, weights=size, minlength=owners).astype(np.int64)
        self.parts = np.maximum(1, -(-in_run // block))
        self.start = np.cumsum(self.parts) - self.parts
        self.reach = np.zeros((owners, cells), dtype=bool)
        for home in range(first):
            self.reach[self.run_of[home]] |= both[home] > 0

    def of_items(self, home: np.ndarray, item: np.ndarray) -> np.ndarray:
        run = self.run_of[home]
        return self.start[run] + (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.parts[run]

    def of_query(self, cells: list[int]) -> np.ndarray:
        runs = np.flatnonzero(self.reach[:, cells].any(axis=1))
        return np.concatenate([self.start[r] + np.arange(self.parts[r]) for r in runs])


def best_of(q: np.ndarray, asked: np.ndarray, x: np.ndarray, item: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, item and inner product of the n best items of each query, of those in a cell that it asked for."""
    may = asked[:, cells[:, 0]]
    for t in range(1, cells.shape[1]):
        may |= asked[:, cells[:, t]]
    rough = np.where(may, q @ x.T, -np.inf)
    if rough.shape[1] > n:
        least = np.partition(rough, -n, axis=1)[:, -n]
        # The product of whole matrices may differ from that of two vectors in its last digits.
        slack = 1e-12 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        may &= rough >= (least - slack)[:, None]
    row, at = np.nonzero(may)
    exact = np.einsum("ij,ij->i", q[row], x[at])
    order = np.lexsort((item[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < n
    return row[keep], item[at[keep]], exact[keep]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, trees: int = 8, leaves: int = 64, sample: int = 20_000, share: float = 1.0, budget: int | None = None, owners: int = 16, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which is_query holds its k nearest among all other rows.

    leaves: of each tree, at most; sample: the bound of the rows that trees are fitted on; share and budget: how many
    vectors the leaves of a query hold; owners, block: see above.
    """
    spark = rows.sparkSession
    own = stored(usable(rows).distinct(), "vectors")
    w = Window.partitionBy("v").orderBy("vec_id")
    few = own.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    items = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("item"), "v", "ids"), "items")
    facts = items.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    some = matrix(pd.Series([r["v"] for r in items.orderBy(F.xxhash64("item"), "item").limit(sample).select("v").collect()]))
    forest = Forest(some, trees, max(1, -(-len(some) // leaves)), float(np.sqrt(facts["m"])))
    shipped = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cells=list(shipped.value.cells(matrix(b["v"])).astype(np.int32)))

    placed = stored(items.select("item", "v").mapInPandas(route, "item long, v array<double>, cells array<int>"), "cells")
    # At most leaves * leaves * trees rows.
    counts = placed.select(F.col("cells")[0].alias("home"), F.explode("cells").alias("cell")).groupBy("home", "cell").count().collect()
    held_by = spark.sparkContext.broadcast(Owners(forest, [tuple(r) for r in counts], owners, block))
    # A vector counts once a tree at most, so this many are k + 1 different ones, or all.
    least = max(trees * (k + 1), budget if budget is not None else share * facts["n"])

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                home = np.array([c[0] for c in b["cells"]])
                yield pd.DataFrame({"owner": held_by.value.of_items(home, b["item"].to_numpy()), "asks": False, "id": b["item"], "v": b["v"], "cells": b["cells"]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for q, v in zip(b["q"].iloc[lo : lo + 500], b["v"].iloc[lo : lo + 500]):
                    found = shipped.value.search(np.asarray(v), held_by.value.held, least)
                    out += [(o, True, q, v, found) for o in held_by.value.of_query(found)]
                yield pd.DataFrame(out, columns=["owner", "asks", "id", "v", "cells"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by owner, its vectors before the queries."""
        owner, parts, x = None, [], None
        wide = int(shipped.value.offset[-1])
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False), prepend=-1, append=-1))
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                asks, ids = part.column(1)[0].as_py(), part.column(2).to_numpy()
                v = part.column(3).flatten().to_numpy().reshape(len(ids), -1)
                if part.column(0)[0].as_py() != owner:
                    owner, parts, x = part.column(0)[0].as_py(), [], None
                if not asks:
                    parts.append((ids, v, part.column(4).flatten().to_numpy().reshape(len(ids), -1)))
                    continue
                if x is None and parts:
                    item, x, cells = (np.concatenate(c) for c in zip(*parts))
                    parts = []
                if x is None:
                    continue
                step, asked = max(1, (1 << 21) // len(x)), part.column(4)
                for at in range(0, len(ids), step):
                    own = asked.slice(at, step)
                    marks = np.zeros((len(own), wide), dtype=bool)
                    marks[np.repeat(np.arange(len(own)), np.diff(own.offsets)), own.flatten()] = True
                    row, found, score = best_of(v[at : at + step], marks, x, item, cells, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step][row]), pa.array(found), pa.array(score)], ["q", "item", "score"])

    queries = stored(own.filter(is_query).groupBy("v").agg(F.min("vec_id").alias("q")), "queries")
    sides = "owner long, asks boolean, id long, v array<double>, cells array<int>"
    both = placed.mapInPandas(give, sides).unionByName(queries.select("q", "v").mapInPandas(walk, sides))
    best = both.repartition("owner").sortWithinPartitions("owner", "asks").mapInArrow(meet, "q long, item long, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "item")
    best = best.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    named = best.join(items.select("item", "ids"), "item").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    lists = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    wanted = own.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").join(queries.join(lists, "q").select("v", "found"), "v")
    others = wanted.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def recall(found: DataFrame, rows: DataFrame, is_query: Column, k: int = 20, block: int = 1024) -> DataFrame:
    """One row: the share of the true k nearest that ``found`` has. The stated queries against all rows, in blocks: for tests."""
    own = usable(rows).distinct()
    queries = own.filter(is_query).select("vec_id", "v").collect()
    ids, q = np.array([r["vec_id"] for r in queries]), matrix(pd.Series([r["v"] for r in queries]))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, names = matrix(b["v"]), b["vec_id"].to_numpy()
            for lo in range(0, len(q), block):
                s = q[lo : lo + block] @ x.T
                s[names[None, :] == ids[lo : lo + block, None]] = -np.inf
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                score = np.take_along_axis(s, order, axis=1).ravel()
                out = pd.DataFrame({"query_id": np.repeat(ids[lo : lo + block], order.shape[1]), "vec_id": names[order].ravel(), "score": score})
                yield out[np.isfinite(score)]

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = own.mapInPandas(top, "query_id long, vec_id long, score double").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    hit = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
