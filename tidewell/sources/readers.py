"""Readers: markup and plain text into blocks (block_type, level, text, page), by suffix.

Markdown, HTML and plain text are read with the standard library; other kinds come from readers that
a caller registers.  Unknown suffixes are errors of that row, reported in a column.  Null and empty
texts have no blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

Block = tuple[str, int, str, int | None]
_HEADING = re.compile(r"^(第[一二三四五六七八九十百0-9]+[章节部分篇编]|[一二三四五六七八九十]+、|[0-9]+[.、．]\s*[^0-9])")
_META = re.compile(r"^-\s*([^：:]{1,20})[：:]\s*(.*)$")


def read_markdown(text: str, meta_keys: tuple[str, ...] = ()) -> tuple[str | None, dict[str, str], list[Block]]:
    """Title (the first heading of level 1), metadata lines of known keys, blocks."""
    title, meta, blocks, held = None, {}, [], []

    def close() -> None:
        if held:
            blocks.append(("paragraph", 0, " ".join(held), None))
            held.clear()

    for line in (text or "").splitlines():
        s = line.strip()
        if m := re.match(r"^(#{1,6})\s+(.*)$", s):
            close()
            if len(m[1]) == 1 and title is None:
                title = m[2].strip()
            else:
                blocks.append(("heading", len(m[1]), m[2].strip(), None))
        elif (m := _META.match(s)) and m[1].strip() in meta_keys:
            close()
            meta[m[1].strip()] = m[2].strip()
        elif m := re.match(r"^(?:[-*+]|\d+[.)])\s+(.*)$", s):
            close()
            blocks.append(("list_item", 0, m[1].strip(), None))
        elif not s:
            close()
        elif s.startswith("|"):
            close()
            cells = [c.strip() for c in s.strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                blocks.append(("table", 0, " | ".join(cells), None))
        else:
            held.append(s)
    close()
    return title, meta, blocks


def read_text(text: str) -> list[Block]:
    """A block a line; short lines that are numbered like headings are headings; form feeds are page ends."""
    out = []
    for page, part in enumerate((text or "").split("\f"), 1):
        for line in part.splitlines():
            s = line.strip()
            if s:
                head = len(s) <= 60 and bool(_HEADING.match(s))
                out.append(("heading" if head else "paragraph", 2 if head else 0, s, page))
    return out


class _Page(HTMLParser):
    KINDS = {"p": "paragraph", "li": "list_item", "tr": "table"} | {f"h{i}": "heading" for i in range(1, 7)}
    DROPPED = {"script", "style", "nav", "footer", "form", "iframe", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.title = ""
        self.links: list[tuple[str, str]] = []
        self._off = 0
        self._at: str | None = None
        self._text: list[str] = []
        self._in_title = False
        self._link: list | None = None

    def _close(self) -> None:
        if self._at:
            text = re.sub(r"\s+", " ", "".join(self._text)).strip(" |")
            if text and not (self.blocks and self.blocks[-1][2] == text):
                kind = self.KINDS[self._at]
                self.blocks.append((kind, int(self._at[1]) if kind == "heading" else 0, text, None))
        self._at, self._text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROPPED:
            self._off += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "a":
            self._link = [dict(attrs).get("href") or "", []]
        elif tag in ("td", "th"):
            if self._text:
                self._text.append(" | ")
        elif tag == "br":
            self._text.append(" ")
        elif tag in self.KINDS and not self._off:
            self._close()
            self._at = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROPPED:
            self._off = max(0, self._off - 1)
        elif tag == "title":
            self._in_title = False
        elif tag == "a" and self._link:
            self.links.append((self._link[0], "".join(self._link[1]).strip()))
            self._link = None
        elif tag == self._at:
            self._close()

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self._link:
            self._link[1].append(data)
        if self._at and not self._off:
            self._text.append(data)


def read_html(text: str) -> tuple[str | None, list[tuple[str, str]], list[Block]]:
    """Title, links (href, text), blocks in the order of the document, furniture tags left out."""
    page = _Page()
    page.feed(text or "")
    page.close()
    page._close()
    title = page.title.strip() or next((b[2] for b in page.blocks if b[0] == "heading"), None)
    return title, page.links, page.blocks


READERS: dict[str, Callable[[str], tuple[str | None, list[Block]]]] = {
    ".md": lambda t: (lambda r: (r[0], r[2]))(read_markdown(t)),
    ".html": lambda t: (lambda r: (r[0], r[2]))(read_html(t)),
    ".htm": lambda t: (lambda r: (r[0], r[2]))(read_html(t)),
    ".txt": lambda t: (None, read_text(t)),
}
BLOCKS = "array<struct<block_type:string,level:int,text:string,page:int>>"


def parse_documents(df: DataFrame, key: str, suffix: str, text: str, readers: dict | None = None) -> DataFrame:
    """key, title, blocks, error of documents given as text with a suffix."""
    table = READERS | (readers or {})
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, title string, blocks {BLOCKS}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, s, t in zip(pdf[key], pdf[suffix], pdf[text], strict=True):
                reader = table.get((s or "").lower())
                if reader is None:
                    rows.append((k, None, [], f"no reader for {s}"))
                else:
                    title, blocks = reader(t or "")
                    rows.append((k, title, [dict(zip(("block_type", "level", "text", "page"), b, strict=True)) for b in blocks], None))
            yield pd.DataFrame(rows, columns=[key, "title", "blocks", "error"])

    return df.select(key, suffix, text).mapInPandas(run, schema)
