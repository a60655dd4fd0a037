"""Pages cut into chunks for search: sections by headings, blocks packed to a size, figures on their own.

A page is cut inside one task by plain Python, as what a line means depends on those before it; pages are dealt over
all tasks. Tokens are counted by a function that callers can replace.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: What opens a line of each kind.
LINE_KINDS = [
    ("fence", re.compile(r"\s*(?:```|~~~)")),
    ("heading", re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")),
    ("table", re.compile(r"\s*\|")),
    ("quote", re.compile(r"\s*>")),
    ("list", re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")),
]
#: Fixed value: the line between a table's head and its rows.
RULE = re.compile(r"^\s*\|?(\s*:?-{2,}:?\s*\|)*\s*:?-{2,}:?\s*\|?\s*$")
TITLE = re.compile(r"\s*>\s*\*\*")
WORD = re.compile(r"\w+|[^\w\s]")
JOIN = " > "
#: What labels and legends of figures begin with, and where a legend's entries part.
LABELS, LEGEND, ENTRY = "Labels: ", "Legend: ", r",\s*(?=[A-Za-z0-9]{1,4}\s*=)"
CHUNK = "book string, page int, chunk_idx int, heading_path string, text string, token_count int"


def count_words(text: str) -> int:
    return len(WORD.findall(text))


@dataclass(frozen=True)
class Sizes:
    """Tokens that a chunk should have, may have at most, and below which a last one joins the one before."""

    target: int = 500
    most: int = 800
    tail: int = 80


@dataclass
class Block:
    kind: str
    parts: list[str] = field(default_factory=list)
    head: list[str] = field(default_factory=list)
    level: int = 0

    @property
    def text(self) -> str:
        return "\n".join([*self.head, *self.parts])


def blocks_of(markdown: str) -> list[Block]:
    """Headings, paragraphs, tables (head and rows), quotes, lists (items) and code of a page."""
    out: list[Block] = []
    fenced = fresh = False
    for line in markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        kind, found = next(((k, m) for k, r in LINE_KINDS if (m := r.match(line))), ("para", None))
        if fenced:
            out[-1].parts.append(line)
            fenced, fresh = kind != "fence", kind == "fence"
        elif not line.strip():
            fresh = True
        elif kind == "heading":
            out.append(Block("heading", [found[2]], level=len(found[1])))
            fresh = True
        elif kind == "fence":
            out.append(Block("code", [line]))
            fenced = True
        else:
            last = out[-1] if out and not fresh else None
            if last and last.kind == "list" and kind == "para" and line[:1].isspace():
                last.parts[-1] += "\n" + line
            elif last and last.kind == kind:
                if kind == "table" and not last.head and len(last.parts) == 1 and RULE.match(line):
                    last.head, last.parts = [last.parts[0], line], []
                else:
                    last.parts.append(line)
            else:
                out.append(Block(kind, [line]))
            fresh = False
    return out


class Chunker:
    def __init__(self, sizes: Sizes | None = None, count: Callable[[str], int] = count_words):
        self.sizes, self.count = sizes or Sizes(), count

    def pack(self, pieces: list[str], between: str, head: str = "") -> list[str]:
        """Pieces in order, packed to the target; the rest of them stays together if it ends below the most. ``head``
        opens every part."""
        pieces = [p for p in pieces if p.strip()]
        size = [self.count(p) for p in pieces]
        base, rest = self.count(head) if head else 0, sum(size)
        parts: list[list[str]] = []
        held = base
        for piece, n in zip(pieces, size):
            if not parts or (held + n > self.sizes.target and held + rest > self.sizes.most and held > base):
                parts.append([])
                held = base
            parts[-1].append(piece)
            held, rest = held + n, rest - n
        return [head + between.join(p) for p in parts]

    def sentences(self, text: str) -> list[str]:
        pieces = []
        for s in re.split(r"(?<=[.!?])\s+", text):
            pieces += self.pack(s.split(), " ") if self.count(s) > self.sizes.most else [s]
        return self.pack(pieces, " ")

    def split(self, block: Block) -> list[str]:
        """Parts of a block that is too large: rows under the head of their table, lines under the title of their box."""
        if block.kind == "table":
            return self.pack(block.parts, "\n", "\n".join(block.head) + "\n" if block.head else "")
        if block.kind == "quote" and len(block.parts) > 1 and TITLE.match(block.parts[0]):
            return self.pack(block.parts[1:], "\n", block.parts[0] + "\n")
        if block.kind == "list":
            items = [p for x in block.parts for p in (self.sentences(x) if self.count(x) > self.sizes.most else [x])]
            return self.pack(items, "\n")
        return self.sentences(block.text) if block.kind == "para" else self.pack(block.parts, "\n")

    def section(self, blocks: list[Block]) -> list[str]:
        pieces = [p for b in blocks for p in (self.split(b) if self.count(b.text) > self.sizes.most else [b.text])]
        parts = self.pack(pieces, "\n\n")
        if len(parts) > 1 and self.count(parts[-1]) < self.sizes.tail and self.count(parts[-2] + parts[-1]) <= self.sizes.most:
            parts[-2:] = ["\n\n".join(parts[-2:])]
        return parts

    def sections(self, markdown: str, root: list[str], otherwise: str) -> Iterator[tuple[str, str]]:
        """(path, text): blocks under the same headings, also where a heading comes again, are one section."""
        above: list[tuple[int, str]] = []
        held: list[Block] = []
        path = JOIN.join(root) or otherwise
        for block in [*blocks_of(markdown), None]:
            if block is not None and block.kind != "heading":
                held.append(block)
                continue
            if block is not None:
                above = [x for x in above if x[0] < block.level] + [(block.level, block.parts[0])]
            following = JOIN.join([*root, *(t for _, t in above)]) or otherwise
            if block is None or following != path:
                yield from ((path, t) for t in self.section(held))
                held, path = [], following

    def figures(self, figures: list[dict], root: list[str]) -> Iterator[tuple[str, str]]:
        for n, f in enumerate(figures, 1):
            labels, legend = list(f.get("labels") if f.get("labels") is not None else []), (f.get("legend") or "").strip()
            pieces = [(f.get("description") or "").strip()]
            if labels:
                pieces += self._fitting(LABELS, "; ".join(labels), lambda ls=labels: self.pack(ls, "; ", LABELS))
            if legend:
                entries = re.split(ENTRY, legend)
                more = (lambda e=entries: self.pack(e, ", ", LEGEND)) if len(entries) > 1 else (lambda x=legend: self.pack(self.sentences(x), " ", LEGEND))
                pieces += self._fitting(LEGEND, legend, more)
            yield from ((JOIN.join([*root, f"Figure {n}"]), t) for t in self.pack(pieces, "\n\n"))

    def _fitting(self, head: str, body: str, split: Callable[[], list[str]]) -> list[str]:
        return [head + body] if self.count(head + body) <= self.sizes.most else split()

    def page(self, page: int, markdown: str, figures: list[dict], region: str | None, chapter: str | None) -> list[tuple[str, str, int]]:
        """(path, text, tokens) of a page's chunks."""
        name = (region if region is not None else chapter or "").strip()
        root = [name] if name else []
        found = [*self.sections(markdown or "", root, f"Page {page}"), *self.figures(figures, root)]
        return [(path, t, self.count(t)) for path, t in found]


def chunked(pages: DataFrame, sizes: Sizes | None = None, count: Callable[[str], int] = count_words) -> DataFrame:
    """Chunks of pages (book, page, markdown, and where there: figures, region, chapter)."""
    has = [c for c in ("figures", "region", "chapter") if c in pages.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunker = Chunker(sizes, count)
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                figures = r.get("figures")
                figures = [f if isinstance(f, dict) else f.asDict() for f in figures] if figures is not None else []
                found = chunker.page(r["page"], r["markdown"], figures, r.get("region"), r.get("chapter"))
                rows += [(r["book"], r["page"], i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return pages.select("book", "page", "markdown", *has).mapInPandas(run, CHUNK)


def embedding_input(path: str, text: str) -> str:
    return f"{path}\n\n{text}"
