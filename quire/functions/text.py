"""Text functions as column expressions; Unicode normal forms, which Spark lacks, as pandas UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that no name candidate starts or ends with, and small words allowed inside a capitalised name.
STOPWORDS = frozenset("""
a an the of to from in on at by for with into onto and or but
is are was were be been do does did can could should would will
i you we they he she it me my your our its his her their there
this that these those what which where when who whom how why
get got find reach go going way path route please tell show need want
any all some each every many much as if then than so not no yes
about after before near next up down out over under through between
""".split())
CONNECTIVES = frozenset("of the and in on at for to de du la le".split())
ROUTE = r"(?i)\b(from|route|path|way|get to|go to|travel to|reach|head to)\b"


def normalized(name: Column) -> Column:
    """Lower case, apostrophes out, other marks a space, spaces collapsed (without compatibility forms)."""
    t = F.regexp_replace(F.lower(name), "['‘’]", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def normalize_name(name: str) -> str:
    """The same with compatibility forms folded (NFKC), for one string."""
    t = unicodedata.normalize("NFKC", name).lower()
    t = re.sub("['‘’]", "", t)
    return " ".join("".join(c if c.isalnum() or unicodedata.category(c)[0] in "LN" else " " for c in t).split())


def fold_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def normalize_names(names: pd.Series) -> pd.Series:
    return names.map(normalize_name, na_action="ignore")


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold_accents, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def close_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """Words and single marks: the default counter, which callers can replace."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1)))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the words, each padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Of two trigram arrays: what they share over what they have together."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


#: Fixed value: what a word of a question is.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*"


def content_words(question: Column) -> Column:
    """Distinct words of a question in order, without possessive endings, stop words and single characters."""
    words = F.transform(F.regexp_extract_all(question, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.regexp_replace(w, r"(?i)['’]s$", ""))
    good = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*sorted(STOPWORDS)))
    # Within one more array, so that the words are taken once and not for each of them.
    both = F.transform(F.array(good), lambda g: F.struct(g.alias("w"), F.transform(g, F.lower).alias("low")))
    return F.transform(both, lambda g: F.filter(g["w"], lambda w, i: F.array_position(g["low"], F.lower(w)) == i + 1))[0]


def lexical_query(question: Column) -> Column:
    """Content words joined by or; the question itself if it has none."""
    words = content_words(question)
    return F.when(F.size(words) > 0, F.array_join(words, " or ")).otherwise(F.trim(question))


def is_route_question(question: Column) -> Column:
    return F.coalesce(question.rlike(ROUTE), F.lit(False))


def singular(name: Column) -> Column:
    """Drops a last s where the last word has over three letters and does not end in ss."""
    return F.when(name.rlike(r"[^ ]{3,}s$") & ~name.endswith("ss"), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def search_text(names: Column, kind: Column, place: Column, description: Column) -> Column:
    """Parts that are there, joined by full stops."""
    full = lambda c: F.when(F.trim(c) != "", c)
    joined = F.concat_ws(". ", full(F.array_join(names, "; ")), full(kind), full(place), full(description))
    return F.concat(F.regexp_replace(joined, r"\.$", ""), F.lit("."))


def plain_quote(text: Column) -> Column:
    """Lower case, marks and white space as single spaces: quotes are looked for in this form."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quote_words(text: Column) -> Column:
    """The lower-case words of a text, as quotes and pages are compared."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)


#: Up to how many words a quote is short, and is not parted; the fewest characters of a fragment.
SHORT_QUOTE, WHOLE_QUOTE, FRAGMENT = 8, 4, 12


def quote_fragments(words: Column) -> Column:
    """What is looked for in turn when a quote of these words is not found whole: the whole, then parts of its head and tail."""
    n = F.size(words)
    head = lambda k: F.slice(words, 1, k)
    tail = lambda k: F.slice(words, -k, k)
    # six tenths of the words, rounded up, in whole numbers
    parts = F.when(n > SHORT_QUOTE, F.array(head(F.floor((n * 6 + 9) / 10).cast("int")), head(8), tail(8))).when(n > WHOLE_QUOTE, F.array(head(5), tail(4))).otherwise(F.array().cast("array<array<string>>"))
    joined = F.filter(F.transform(parts, lambda w: F.array_join(w, " ")), lambda t: F.length(t) >= FRAGMENT)
    return F.when(n > 0, F.array_distinct(F.concat(F.array(F.array_join(words, " ")), joined))).otherwise(F.array().cast("array<string>"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def marked(text: Column, start: Column, end: Column) -> Column:
    """HTML of a text with the characters from start (counted from 0) to end in a mark; without one where start is null."""
    n = F.length(text)
    part = lambda a, b: html_escape(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
    whole = F.concat(part(F.lit(0), start), F.lit("<mark>"), part(start, end), F.lit("</mark>"), part(end, n))
    return F.when(start.isNull(), html_escape(text)).otherwise(whole)


def local_date(at: Column, zone: str) -> Column:
    """The day of a moment as a clock in the zone has it, as text."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone), "yyyy-MM-dd")


def label_key(label: Column) -> Column:
    """Labels without white space and dots, lower case."""
    return F.regexp_replace(F.lower(label), r"[\s.]+", "")


def safe_name(name: Column) -> Column:
    """File names without folders and odd characters."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")


#: Fixed value: the pattern of citations, [label, p. 214], with an optional quote after : or |.
CITATION = r"\[([^\[\],]{1,40}), ?p\.? ?(\d+)(?:\s*[:|]\s*[\"“]([^\"”]*)[\"”])?\]"


def citations(text: Column) -> Column:
    """Array of (label, page, quote) of the citation markers in a text."""
    part = lambda i: F.regexp_extract_all(text, F.lit(CITATION), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("l"), part(2).alias("p"), part(3).alias("q")), lambda x: F.struct(label_key(x["l"]).alias("label"), x["p"].cast("int").alias("page"), F.when(x["q"] != "", x["q"]).alias("quote")))
