"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled 1; all other text is unlabelled. With the prior p of good text among the
unlabelled, the risk is p * R+(as good) + max(0, R_u(as bad) - p * R+(as bad)); where the second part falls below
zero, its gradient is turned round. The prior is estimated from the two samples. No row labelled 0 is used: the last,
monotone step puts 0.7 at the cut with the best balanced accuracy, which the two samples alone determine. With the
shares t(c) of positives and u(c) of unlabelled above a cut c, the balanced error is (1 - t + (u - p * t) / (1 - p)) / 2,
which is least where t(c) - u(c) is greatest, whatever the prior.

Fitted on bounded samples (``positives`` and ``unlabelled`` distinct rows, chosen by a hash of doc_id and text); every
row is scored, from its whole text alone.

Defined results: a null or empty text has the features of no words and is scored like any other; where the table of
labels has no positive for a row, nothing is known against any text, and all are accepted; repeated rows count once in
the samples and are all scored; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import held_out, text_of

THRESHOLD = 0.7
#: Classes of bytes: lower case, upper case, digits, sentence marks, spaces, line ends, other marks, beyond ASCII.
CLASSES = 8
BYTE_CLASS = np.full(256, 7, dtype=np.uint8)
BYTE_CLASS[:128] = 6
BYTE_CLASS[ord("a") : ord("z") + 1] = 0
BYTE_CLASS[ord("A") : ord("Z") + 1] = 1
BYTE_CLASS[ord("0") : ord("9") + 1] = 2
BYTE_CLASS[[ord(c) for c in ".,;:?!'\"-"]] = 3
BYTE_CLASS[ord(" ")] = 4
BYTE_CLASS[[ord(c) for c in "\n\r\t"]] = 5


def features(text: str) -> np.ndarray:
    """Shares and ratios of a whole text: of byte classes, repetition of words and lines, shape of words, worst stretch."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = BYTE_CLASS[np.frombuffer(raw, dtype=np.uint8)] if raw else np.zeros(0, dtype=np.uint8)
    share = np.bincount(kinds, minlength=CLASSES)[:CLASSES] / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, distinct = len(words), len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    # Stretches of 512 bytes, of which the last reaches back so that it ends with the text; a shorter text is one.
    stretch = max(1, min(512, len(kinds)))
    last = max(0, len(kinds) - stretch)
    blocks = np.lib.stride_tricks.sliding_window_view(kinds, stretch)[[*range(0, last, stretch), last]] if len(kinds) else np.full((1, 1), CLASSES)
    upper, marks, ends = ((blocks == c).mean(axis=1) for c in (1, 6, 3))
    worst = [upper.max(), marks.max(), ends.max(), upper.min(), (upper > 0.3).mean(), (marks > 0.08).mean()]
    loud = sum(map(str.isupper, words)) / max(1, n)
    single = sum(1 for w in words if not w[-1:].isalnum()) / max(1, n)
    doubled = text.count("!!") / max(1, n)
    bars = text.count(" | ") / max(1, n)
    return np.array([*share, np.log1p(n), distinct / max(1, n), np.log1p(distinct), again, lengths.mean(), lengths.std(), lengths.max() ** 0.5, (lengths <= 3).mean(), 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines) / 100, loud, single, doubled, bars, *worst])


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w1: np.ndarray, b1: np.ndarray) -> np.ndarray:
    return np.tanh(np.clip((x - mean) / scale, -6, 6) @ w1 + b1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in the unlabelled: the smallest ratio of the two distributions of one score over its tails.

    A score tells the samples apart; where only bad text lies, the unlabelled sample has mass and the positives none,
    so 1 - share in that tail (less a margin for noise) bounds the prior.
    """
    best = 1.0
    for q in np.quantile(pos, np.linspace(0.02, 0.5, 25)):
        p, u = (pos <= q).mean(), (unl <= q).mean()
        bound = (1 - u + 1.0 / np.sqrt(len(unl))) / max(1e-9, 1 - p)
        best = min(best, bound)
    return float(np.clip(best, 0.05, 0.98))


def best_cut(pos: np.ndarray, unl: np.ndarray) -> tuple[float, float]:
    """The cut that parts positives from unlabelled best, and the spread of the unlabelled.

    Cuts within half a standard error of the best are as good as far as samples of this size tell; of these the one in
    the widest gap between outputs is taken.
    """
    cuts = np.unique(np.concatenate([pos, unl]))
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts) / len(z)
    gain = above(pos) - above(unl)
    good = np.flatnonzero(gain >= gain.max() - 0.5 * np.sqrt(0.25 / len(pos) + 0.25 / len(unl)))
    below = cuts[np.maximum(0, good - 1)]
    widest = np.argmax(cuts[good] - below)
    return float(below[widest] + cuts[good[widest]]) / 2, float(unl.std())


class NonNegativePu:
    """A network of one hidden layer, trained with Adam on the non-negative risk under the sigmoid loss."""

    def __init__(self, hidden: int = 32, epochs: int = 60, batch: int = 512, rate: float = 3e-3, seed: int = 7):
        self.hidden, self.epochs, self.batch, self.rate, self.seed = hidden, epochs, batch, rate, seed
        self.prior, self.a, self.b = 0.7, 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale, self.w1, self.b1) @ self.w2 + self.b2

    def _start(self, x: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1 = rng.normal(size=(x.shape[1], self.hidden)) / np.sqrt(x.shape[1])
        self.b1, self.w2, self.b2 = np.zeros(self.hidden), rng.normal(size=self.hidden) / np.sqrt(self.hidden), 0.0

    def _step(self, x: np.ndarray, dz: np.ndarray) -> None:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.w1 + self.b1)
        dh = np.outer(dz, self.w2) * (1 - h * h)
        grads = [z.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum()]
        self.t += 1
        for k, g in enumerate(grads):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            move = self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            name = ("w1", "b1", "w2", "b2")[k]
            setattr(self, name, getattr(self, name) - move)

    def _train(self, pos: np.ndarray, unl: np.ndarray, prior: float | None) -> None:
        """prior None: tells positives from unlabelled, for estimating the prior."""
        self._start(np.vstack([pos, unl]))
        self.m, self.v, self.t = [0.0] * 4, [0.0] * 4, 0
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs if prior is not None else self.epochs // 3):
            order = rng.permutation(len(unl))
            for lo in range(0, len(unl), self.batch):
                u = unl[order[lo : lo + self.batch]]
                p = pos[rng.integers(0, len(pos), len(u))]
                x = np.vstack([p, u])
                s = sigmoid(self.logit(x))
                slope = s * (1 - s)
                sp, su = s[: len(p)], s[len(p) :]
                if prior is None:
                    dz = np.concatenate([-(1 - sp) / len(p), su / len(u)])
                else:
                    rest = su.mean() - prior * sp.mean()
                    dp, du = slope[: len(p)] / len(p), slope[len(p) :] / len(u)
                    dz = np.concatenate([-prior * dp - prior * dp, du]) if rest >= 0 else np.concatenate([prior * dp, -du])
                self._step(x, dz)

    def fit(self, pos: np.ndarray, unl: np.ndarray) -> NonNegativePu:
        """pos, unl: rows of features."""
        if not len(pos) or not len(unl):
            self._start(np.zeros((1, len(features("")))))
            self.w2, self.b2 = np.zeros(self.hidden), 10.0  # nothing is known against any text
            return self
        self._train(pos, unl, None)
        self.prior = estimate_prior(self.logit(pos), self.logit(unl))
        self._train(pos, unl, self.prior)
        cut, spread = best_cut(self.logit(pos), self.logit(unl))
        self.a = 2.0 / max(1e-6, spread)
        self.b = np.log(THRESHOLD / (1 - THRESHOLD)) - self.a * cut
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.logit(x) + self.b)


def _featured(rows: DataFrame, *more: str) -> DataFrame:
    """x (features) and ``more`` (long columns) of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], ["x", *more])

    return rows.select("text", *more).mapInArrow(run, "x array<double>" + "".join(f", {c} long" for c in more))


def train(docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 12_000) -> NonNegativePu:
    """Learns from rows outside the held-out fold; the two bounds are all that reaches the driver, also where rows repeat."""
    fold = text_of(docs).filter(~held_out()).withColumn("mark", F.xxhash64("text"))
    trusted = labels.filter(F.col("quality").cast("int") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    each = fold.select("doc_id", "mark").distinct()
    some = lambda rows, n, use: rows.orderBy(F.xxhash64("doc_id", "mark", F.lit(use)), "doc_id", "mark").limit(n).withColumn("use", F.lit(use).cast("long"))
    chosen = some(each.join(trusted, "doc_id"), positives, 1).unionByName(some(each, unlabelled, 0))
    chosen = chosen.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "use")
    rows = fold.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    # Of rows that repeat, the first found is enough, as their features are equal.
    found = _featured(rows, "doc_id", "mark", "use").groupBy("doc_id", "mark", "use").agg(F.first("x").alias("x")).collect()
    found.sort(key=lambda r: (r["use"], r["mark"]))
    of = lambda k: np.array([r["x"] for r in found if r["use"] == k]).reshape(-1, len(features("")))
    return NonNegativePu().fit(of(1), of(0))


def scored(docs: DataFrame, model: NonNegativePu) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(model.mean))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return text_of(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts the classifier does not reject, with their columns; scored in place, no shuffle."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in texts]).reshape(-1, len(model.mean))
        return pd.Series(model.score(x))

    return docs.filter(score(F.col("text").cast("string")) >= THRESHOLD)
