"""Nearest vectors by cosine: exactly, block against block, or through cells around fitted centres.

Vectors that are null, zero or hold null or non-finite numbers are nobody's neighbours, and a vector of another length than
the question's is none of its.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import relational
from quire.sources.tables import kept

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Questions that go to the rows, questions of a slice, and vectors that a slice is compared with at once: what a task holds.
ASKED, SLICE, HELD = 4096, 65536, 16384
#: Questions whose scores a task holds at once.
SCORED = 256


def cosines(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounded to six digits; not a number for zero vectors."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round((m @ x.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :], 6)


def stacked(vectors: list) -> np.ndarray:
    """Vectors of one length as rows, in double precision; nulls are not numbers."""
    rows = np.array(vectors)
    return rows.astype(np.float64) if rows.dtype in (object, np.float32) else rows


def best_pairs(q: list, m: list, keys: list, x: list, k: int, score: Score, least: np.ndarray | None = None) -> pd.DataFrame:
    """Of the vectors x (of keys) the k of largest score for each of m (of q), ties by key; lengths are kept apart. Scores under the
    question's ``least`` may be left out."""
    out = []
    sizes = [-1 if v is None else len(v) for v in x]
    for size in {len(v) for v in m if v is not None}:
        own = [i for i, v in enumerate(m) if v is not None and len(v) == size]
        there = [i for i, n in enumerate(sizes) if n == size]
        if not there:
            continue
        there_keys = np.array([keys[i] for i in there])
        rows = stacked([x[i] for i in there])
        n = min(k, len(there))
        for at in range(0, len(own), SCORED):
            some = own[at : at + SCORED]
            scores = score(stacked([m[i] for i in some]), rows)
            scores = np.where(np.isfinite(scores), scores, -np.inf)
            # Only what is as good as the n-th best of its row is sorted: by row, score and key.
            low = least[some] if least is not None else np.full(len(some), -np.inf)
            if np.isneginf(low).any():
                low = np.maximum(low, -np.partition(-scores, n - 1, axis=1)[:, n - 1])
            row, column = np.nonzero(scores >= low[:, None])
            value = scores[row, column]
            order = np.lexsort((there_keys[column], -value, row))
            row, column, value = row[order], column[order], value[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < n
            found = {"q": [q[some[i]] for i in row[first].tolist()], "key": there_keys[column[first]], "score": value[first]}
            out.append(pd.DataFrame(found))
    some = pd.concat(out) if out else pd.DataFrame({"q": [], "key": [], "score": []})
    return some[np.isfinite(some["score"].astype(float))]


FOUND = "q long, key long, score double"


def best(asked: DataFrame, rows: DataFrame, k: int, score: Score = cosines, few: int = ASKED, held: int = HELD) -> DataFrame:
    """q, key and score: the k best of every block of rows (key, v) for each question (q, v); ``ranked`` makes k of them.

    Up to ``few`` questions (they are counted) go to the rows, which then are not shuffled. More are dealt out in slices, and the
    rows go by each slice: a task holds one slice with the best so far and ``held`` rows, and gives k rows a question.
    """
    if asked.limit(few + 1).count() <= few:
        known = [(r["q"], r["v"]) for r in asked.collect()]
        q, m = [r[0] for r in known], [r[1] for r in known]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield best_pairs(q, m, b["key"].tolist(), b["v"].tolist(), k, score)

        return rows.select("key", "v").mapInPandas(run, FOUND)

    def go_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A slice's questions stand before its rows.
        asked_, there, n, slices = {}, {}, {}, {}

        def met(x: int) -> None:
            if x not in slices:
                own = pd.concat(asked_.pop(x)) if x in asked_ else pd.DataFrame({"q": [], "v": []})
                slices[x] = own["q"].tolist(), own["v"].tolist(), None
            q, m, best_ = slices[x]
            rows_ = pd.concat(there.pop(x))
            n[x] = 0
            least = None
            if best_ is not None:
                count = best_.groupby("q")["score"].agg(["size", "min"])
                least = count["min"].where(count["size"] >= k, -np.inf).reindex(q).fillna(-np.inf).to_numpy()
            found = best_pairs(q, m, rows_["q"].tolist(), rows_["v"].tolist(), k, score, least)
            if len(found):
                both = found if best_ is None else pd.concat([best_, found])
                both = both.sort_values(["q", "score", "key"], ascending=[True, False, True])
                slices[x] = q, m, both[both.groupby("q").cumcount() < k]

        for b in batches:
            for (x, row), some in b.groupby(["x", "row"]):
                (there if row else asked_).setdefault(x, []).append(some)
                n[x] = n.get(x, 0) + row * len(some)
                if n[x] >= held:
                    met(x)
        for x in list(there):
            met(x)
        for _, _, best_ in slices.values():
            if best_ is not None:
                yield best_

    slices = max(asked.sparkSession.sparkContext.defaultParallelism, math.ceil(asked.count() / SLICE))
    x = F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int")
    left = asked.select("q", "v", F.lit(0).alias("row"), x.alias("x"))
    right = rows.select(F.col("key").alias("q"), "v", F.lit(1).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("x"))
    both = left.unionByName(right).repartitionById(slices, "x").sortWithinPartitions("row")
    return both.mapInPandas(go_by, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """q, key, score, rank: the k of largest score of each question, ties by key."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "key", "score", "rank")


def top(asked: DataFrame, rows: DataFrame, k: int, score: Score = cosines, few: int = ASKED) -> DataFrame:
    """q, key, score, rank: the k best rows (key, v) for each question (q, v), ties by key. Of more than ``few`` questions those
    with equal vectors are asked once, and so are rows with equal vectors, of which the k least keys can be among the best."""
    if asked.limit(few + 1).count() <= few:
        return ranked(best(asked, rows, k, score, few), k)
    # Vectors are told apart by their digests, so that they are sent nowhere for it.
    same = F.sha2(F.col("v").cast("string"), 256).alias("same")
    asked = asked.select("q", "v", same)
    members_asked = kept(asked.select("q", F.min("q").over(Window.partitionBy("same")).alias("head")))
    members = kept(relational.copies(rows.select("key", same), ["same"], "key", k).select("head", "key", "n"))
    heads = rows.select("key", "v").join(members.filter("key = head").select("key").distinct(), "key", "left_semi")
    own = asked.select("q", "v").join(members_asked.filter("q = head").select("q").distinct(), "q", "left_semi")
    found = best(own.distinct(), heads.distinct(), k, score, few)
    found = relational.top_of_copies(found, members, k)
    return members_asked.join(found.withColumnRenamed("q", "head"), "head").select("q", "key", "score", "rank")


@dataclass(frozen=True)
class Cells:
    """An index of vectors: centres, and a folder with the vectors by cell. sizes: cell, n, radius (the largest angle between a
    vector of the cell and its centre)."""

    path: str
    centres: np.ndarray
    sizes: pd.DataFrame
    rows: DataFrame


def fitted(rows: DataFrame, cells: int, sample: int) -> np.ndarray:
    """Centres of ``cells`` cells (fewer where there are fewer vectors), fitted to at most ``sample`` of the vectors (key, v)."""
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(sample)
    model = KMeans(k=cells, seed=7, maxIter=8, featuresCol="u").fit(drawn.select(array_to_vector(unit("v")).alias("u")))
    return np.array([c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()])


def unit(v: str) -> F.Column:
    """The vector of length 1 in the same direction."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / length)


def angles(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T / np.linalg.norm(x, axis=1)[:, None], -1.0, 1.0))


def usable(rows: DataFrame, size: int) -> DataFrame:
    """Rows whose vector has ``size`` numbers, all finite, not all zero."""
    good = (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False)))


def build_cells(rows: DataFrame, folder: str, cells: int = 256, sample: int = 50_000, parts: int = 8) -> Cells:
    """Stores vectors (key, v; of the length that the first has) by the cell of their nearest centre, under ``folder``.

    cells is at most some thousands, as centres go to every task. A cell that holds many vectors (a third of all may be
    equal) is written by ``parts`` tasks and searched in blocks.
    """
    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("v").cast("array<double>").alias("v"))
    first = rows.filter(F.size("v") > 0).select(F.size("v")).first()
    rows = usable(rows, first[0] if first else 0)
    path = f"{folder}/cells-{uuid.uuid4().hex}"
    centres = fitted(rows, cells, sample) if first and not rows.isEmpty() else np.zeros((1, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = angles(centres, np.array(b["v"].tolist()))
                yield b.assign(cell=far.argmin(axis=1).astype(np.int32), far=far.min(axis=1))

    placed = rows.mapInPandas(run, "key long, v array<double>, cell int, far double")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(parts)))
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    stored = rows.sparkSession.read.schema("key long, v array<double>, far double, cell int").parquet(path)
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas()
    return Cells(path, centres, sizes, stored.select("key", "v", "cell"))


def in_cells(index: Cells, asked: DataFrame, k: int, few: int = ASKED, held: int = HELD) -> DataFrame:
    """The k best for questions (q, v, cell) among the vectors of the cells named; only these cells are read."""
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most as many as there are cells
    parts = {int(c): math.ceil(n / held) for c, n in zip(index.sizes["cell"], index.sizes["n"])}
    spark = asked.sparkSession
    many = spark.createDataFrame([(c, parts.get(c, 1)) for c in wanted], "cell int, parts int")
    rows = index.rows.filter(F.col("cell").isin(wanted)).join(F.broadcast(many), "cell")
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks = max(1, math.ceil(asked.select("q").distinct().count() / few))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = rows.select("key", "v", "cell", block("key", F.col("parts")).alias("y"), every(F.lit(blocks)).alias("x"))
    left = asked.join(F.broadcast(many), "cell")
    left = left.select("q", "v", "cell", block("q", F.lit(blocks)).alias("x"), every(F.col("parts")).alias("y"))

    def pair(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(own["q"].tolist(), own["v"].tolist(), there["key"].tolist(), there["v"].tolist(), k, cosines)

    return left.groupBy("cell", "x", "y").cogroup(right.groupBy("cell", "x", "y")).applyInPandas(pair, FOUND)


def cell_top(index: Cells, questions: DataFrame, k: int = 40, probes: int = 8, exact: bool = False) -> DataFrame:
    """q, key, score, rank: the k nearest of each question (q, qv) among the vectors of its ``probes`` nearest cells.

    exact: then the cells that may hold a better one are read as well: those whose nearest edge (the angle to the centre
    less the cell's radius) is not farther than the k-th found so far. That loses none.
    """
    size = index.centres.shape[1]
    asked = usable(questions.select(F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("v")), size)
    full = {int(c): float(r) for c, r in zip(index.sizes["cell"], index.sizes["radius"])}
    cells, radius = np.array(sorted(full), dtype=np.int64), np.array([full[c] for c in sorted(full)])
    if not len(cells):
        return ranked(asked.select("q", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("score")).limit(0), k)
    centres, probes = index.centres[cells], min(probes, len(cells))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A question goes to many cells with its vector: few of them at a time."""
        for b in batches:
            for at in range(0, len(b), SCORED):
                yield b.iloc[at : at + SCORED]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            if len(b):
                near = cells[np.argsort(angles(centres, np.array(b["v"].tolist())), axis=1, kind="stable")[:, :probes]]
                yield b.loc[b.index.repeat(probes)].assign(cell=near.ravel().astype(np.int32))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            if not len(b):
                continue
            far = angles(centres, np.array(b["v"].tolist()))
            # Scores are rounded to six digits.
            edge = np.cos(np.maximum(far - radius - 1e-6, 0.0))
            again = edge >= b["least"].to_numpy()[:, None] - 1e-6
            np.put_along_axis(again, np.argsort(far, axis=1, kind="stable")[:, :probes], False, axis=1)
            at, cell = np.nonzero(again)
            yield b.drop(columns="least").iloc[at].assign(cell=cells[cell].astype(np.int32))

    schema = "q long, v array<double>, cell int"
    found = in_cells(index, asked.mapInPandas(nearest, schema), k)
    if not exact:
        return ranked(found, k)
    found = kept(ranked(found, k).drop("rank"))
    least = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("least"))
    wider = asked.join(least, "q", "left").select("q", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))
    more = in_cells(index, wider.mapInPandas(others, schema), k)
    return ranked(found.unionByName(more), k)
