"""Language identification by words first, with character n-grams of falling length for words that were never seen.

Counts of words and of the n-grams within words are taken over all labelled rows, whole and without a cut, and stay
tables. A word's evidence is the vector of its log frequencies by language; a word that was never seen is scored by the
mean of its n-grams of the greatest length of which any is known. A text's score is the mean evidence of its words, as
a softmax.

Texts are read once. Words that are frequent enough to be among ``carried`` are scored on the spot, with the counts
that the table has for them; the other words of a text meet the tables by joins: each distinct one once, its n-grams
only if it was never seen, and the evidence goes back to its texts as sums. How many words are carried changes the
work, not the result.

Defined results: a null text and one without a letter is ``und`` with score 0; without any labelled row every text
is ``und``; ties go to the smaller language; repeated rows repeat; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import held_out, stored, text_of

#: Runs that have letters only, or letters and characters like superscripts, which LETTERS takes out.
RUNS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
LONGEST, CARRIED = 4, 120_000


def words_of(text: str) -> list[str]:
    runs = RUNS.findall(text.lower())
    return runs if all(map(str.isalpha, runs)) else [w for r in runs for w in LETTERS.findall(r)]


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """word and an n of each language (n0, n1, ...) over the labelled rows of docs; tasks count their batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts[lang].update(words_of(text))
            for lang, own in counts.items():
                names, pairs = ["lang", "word", "n"], list(own.items())
                for lo in range(0, len(pairs), 50_000):
                    some = pairs[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names)

    seen = labelled(docs).mapInArrow(run, "lang string, word string, n long")
    return seen.groupBy("word").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)))


def labelled(docs: DataFrame) -> DataFrame:
    return text_of(docs, F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out())


def grams_of(word: Column, k: Column | int) -> Column:
    """The n-grams of k letters of a word; ^ and $ mark its ends."""
    p = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - k + 1, F.lit(1))), lambda i: p.substr(i, F.lit(k) if isinstance(k, int) else k))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram and an n of each language, of the n-grams of 1 to LONGEST letters in the words of a table of counts."""
    numbers = [c for c in words.columns if c != "word"]
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: grams_of(F.col("word"), k)))
    return words.select(*numbers, F.explode(grams).alias("gram")).groupBy("gram").agg(*(F.sum(c).alias(c) for c in numbers))


def log_frequency(n: Column, total: Column) -> Column:
    """Of a count by language; what a language never had counts half."""
    return F.log(F.greatest(n, F.lit(0.5)) / (total + 1))


@dataclass
class Model:
    langs: list[str]
    #: word or gram, and e: its log frequencies by language.
    words: DataFrame | None = None
    grams: DataFrame | None = None
    #: The words that are carried to every text, and their log frequencies in rows.
    carried: dict[str, int] | None = None
    evidence: np.ndarray | None = None


def train(docs: DataFrame, carried: int = CARRIED) -> Model:
    """Counts all labelled rows outside the held-out fold. The driver gets the languages, totals and ``carried`` words."""
    langs = sorted(r["lang"] for r in labelled(docs).select("lang").distinct().collect())
    if not langs:
        return Model(langs)
    counts = stored(word_counts(docs, langs), "words")
    totals = counts.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(langs)))).first()
    # Languages of which no row has a word are not learned.
    each = [i for i in range(len(langs)) if totals[i]]
    langs, totals = [langs[i] for i in each], [totals[i] for i in each]
    if not langs:
        return Model(langs)
    counts, each = counts.select("word", *(F.col(f"n{i}").alias(f"n{k}") for k, i in enumerate(each))), range(len(langs))
    grams = stored(gram_counts(counts), "grams")
    by_length = {r["k"]: r for r in grams.groupBy(F.length("gram").alias("k")).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in each)).collect()}
    of_length = lambda i: F.element_at(F.array(*(F.lit(by_length[k][f"n{i}"] if k in by_length else 0) for k in range(1, LONGEST + 1))), F.length("gram"))
    words = counts.select("word", F.array(*(log_frequency(F.col(f"n{i}"), F.lit(totals[i])) for i in each)).alias("e"), sum((F.col(f"n{i}") for i in each), F.lit(0)).alias("n"))
    grams = grams.select("gram", F.array(*(log_frequency(F.col(f"n{i}"), of_length(i)) for i in each)).alias("e"))
    # Classes of frequency, 16 for each doubling: from the top, as many whole classes as there is room for.
    rank, room, least = F.floor(F.log2("n") * 16).alias("rank"), carried, None
    for r in sorted(words.groupBy(rank).count().collect(), key=lambda r: -r["rank"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["rank"]
    some = words.filter(rank >= least if least is not None else F.lit(False)).select("word", "e").toArrow()
    evidence = np.array(some.column("e").to_pylist(), dtype=float).reshape(-1, len(langs))
    return Model(langs, words.select("word", "e"), grams, {w: i for i, w in enumerate(some.column("word").to_pylist())}, evidence)


def backed_off(words: DataFrame, grams: DataFrame, langs: int) -> list[DataFrame]:
    """Tables of word and e for the words of which any n-gram is known, by falling length."""
    out = []
    for k in range(LONGEST, 0, -1):
        parts = words.select("word", F.explode(grams_of(F.col("word"), k)).alias("gram"))
        found = parts.join(grams, "gram").groupBy("word").agg(F.array(*(F.avg(F.col("e")[i]) for i in range(langs))).alias("e"))
        out.append(stored(found, f"grams{k}"))
        words = stored(words.join(out[-1], "word", "left_anti"), f"left{k}")
        if words.isEmpty():
            break
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    rows = text_of(docs, held_out().alias("held_out"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped, width = docs.sparkSession.sparkContext.broadcast((model.carried, model.evidence)), len(model.langs)
    names = ["doc_id", "held_out", "mark", "total", "sums", "others", "word", "n"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, evidence = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, out = batch.slice(lo, 1000), []
                for text in part.column(1).to_pylist():
                    words = Counter(words_of(text))
                    known = [(at, n) for w, n in words.items() if (at := carried.get(w)) is not None]
                    other = [(w, n) for w, n in words.items() if w not in carried]
                    at, times = zip(*known) if known else ((), ())
                    total = sum(words.values())
                    out.append((total, np.array(times, dtype=float) @ evidence[list(at)] if known else np.zeros(width), total - sum(times), [w for w, _ in other], [n for _, n in other]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *(pa.array(c, t) for c, t in zip(zip(*out), types[3:]))], names)

    schema = "doc_id long, held_out boolean, mark long, total long, sums array<double>, others long, word array<string>, n array<long>"
    read = stored(rows.select("doc_id", "text", "held_out", F.xxhash64("text").alias("mark")).mapInArrow(run, schema), "read")
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "mark"]
    others = read.filter("others > 0").select(*key, F.explode(F.arrays_zip("word", "n")).alias("x")).select("doc", "mark", "x.*")
    met = stored(others.select("word").distinct().join(model.words, "word", "left"), "met")
    evidence = met.filter("e is not null")
    for found in backed_off(met.filter("e is null").select("word"), model.grams, width):
        evidence = evidence.unionByName(found)
    # Rows with one doc_id and text, repeated m times, have m times these sums and m times these words.
    back = others.join(evidence, "word", "left").groupBy("doc", "mark").agg(F.sum("n").alias("times"), *(F.sum(F.coalesce(F.col("e")[i], F.lit(0.0)) * F.col("n")).alias(f"s{i}") for i in range(width)))
    whole = read.select("doc_id", "held_out", "total", "sums", "others", *key).join(back, ["doc", "mark"], "left")
    means = F.array(*((F.col("sums")[i] + F.coalesce(F.col(f"s{i}") * F.col("others") / F.col("times"), F.lit(0.0))) / F.col("total") for i in range(width)))
    whole = whole.select("doc_id", "held_out", "total", F.when(F.col("total") > 0, means).alias("e")).withColumn("best", F.array_max("e"))
    pred = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("e", F.col("best")).cast("int"))
    score = 1 / F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    some = F.col("total") > 0
    return whole.select("doc_id", "held_out", F.when(some, pred).otherwise("und").alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"))
