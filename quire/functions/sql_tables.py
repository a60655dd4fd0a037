"""Table functions for SQL: checklists parsed, pages chunked and questions' names, as FROM f(TABLE(...)).

Each gives what its DataFrame form gives; ``register`` makes them known to a session.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import checklists
from quire.operators.chunking import CHUNK, Chunker

CHECKLIST = "file string, ord int, type string, id string, section string, path array<string>, text string, marker string, bold array<string>, raw string"
CANDIDATES = "q long, norm string, text string, start int, end int, words int, capitalised boolean, whole boolean, fuzzy boolean"


def clean_name(name: str) -> str:
    bare = re.sub(checklists.NAME_ENDS, "", name.strip(" ")).strip(" ")
    return re.sub(r"['’]+$", "", re.sub(checklists.POSSESSIVE, "", bare)).strip(" ")


@F.udtf(returnType=CHECKLIST)
class ParseChecklist:
    """parse_checklist(TABLE(lines) PARTITION BY (file) ORDER BY (ord), 'markers'): lines are rows of file, ord and raw."""

    def __init__(self):
        self.path: list[str] = []
        self.before = None

    def eval(self, row: Row, markers: str) -> Iterator[tuple]:
        raw = row["raw"]
        line = (raw or "").strip()
        if not line:
            return
        heading = re.search(checklists.HEADING, line)
        kind = "heading" if heading else "item" if line.startswith("- ") else "note"
        error = kind == "note" and raw[:1] in " \t" and self.before == "item"
        self.before = kind
        own, bare = None, line
        if heading:
            self.path = [*self.path[: len(heading[1]) - 2], heading[2]]
            bare = heading[2]
        elif kind == "item":
            body = re.sub(r"^-\s+", "", line)
            found = re.search(checklists.ITEM_ID, body)
            own, bare = found and found[1], re.sub(checklists.ITEM_ID, "", body)
        known = sorted((markers or "").split(), key=len, reverse=True)
        marker = next((m for m in known if kind == "item" and bare.startswith(m + " ")), None)
        said = bare[len(marker) :].strip(" ") if marker else bare
        spans = [clean_name(x) for s in re.findall(checklists.BOLD, said) for x in re.split(checklists.LISTED, s)]
        yield row["file"], row["ord"], "error" if error else kind, own, self.path[-1] if self.path else None, [*self.path], said, marker, [s for s in spans if s], raw


@F.udtf(returnType=CHUNK)
class ChunkPage:
    """chunk_page(TABLE(pages)): rows of book, page, markdown and, where there, figures, region and chapter."""

    def __init__(self):
        self.chunker = Chunker(None)

    def eval(self, row: Row) -> Iterator[tuple]:
        r = row.asDict()
        figures = [f if isinstance(f, dict) else f.asDict() for f in r.get("figures") or []]
        for i, found in enumerate(self.chunker.page(r["page"], r["markdown"], figures, r.get("region"), r.get("chapter"))):
            yield r["book"], r["page"], i, *found


_WORD = re.compile(r"[^\W_](?:[^\W_]|['’\-])*")


def _plain(name: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", re.sub("['‘’]", "", name.lower())))


@F.udtf(returnType=CANDIDATES)
class ExtractCandidates:
    """extract_candidates(TABLE(questions)): rows of q and question; runs of up to four words, and the question as a whole."""

    def eval(self, row: Row) -> Iterator[tuple]:
        said = (row["question"] or "").strip(" ")
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(said)]
        upper, stop = lambda w: w[0][0].isupper(), lambda w: w[0].lower() in text.STOPWORDS
        seen: set[str] = set()
        for n in range(1, 5):
            for i in range(len(words) - n + 1):
                own = words[i : i + n]
                opens = not stop(own[0]) or n > 1 and upper(own[0]) and upper(own[1])
                start, end = own[0][1], own[-1][2]
                norm = _plain(said[start:end])
                if stop(own[-1]) or not opens or not norm or norm in seen or n == 1 and len(norm) < 3:
                    continue
                seen.add(norm)
                inner = all(upper(w) or w[0].lower() in text.CONNECTIVES for w in own[1:-1])
                named = upper(own[0]) and upper(own[-1]) and inner
                yield row["q"], norm, said[start:end], start, end, n, named, False, named or n > 1 and len(norm) >= 8
        norm = _plain(said)
        if words and norm and norm not in seen:
            yield row["q"], norm, said, words[0][1], words[-1][2], len(words), False, True, True


def register(spark: SparkSession) -> None:
    for name, f in (("parse_checklist", ParseChecklist), ("chunk_page", ChunkPage), ("extract_candidates", ExtractCandidates)):
        spark.udtf.register(name, f)
