"""Word-processor documents without a library: a zip with one XML file for the text, one for the styles of headings.

Reading keeps the order of the body: headings with their level (style ``Heading N``), paragraphs, and tables as one block
each, cells joined by `` | `` and rows by line ends.  What is no such file gives an error and no blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_ILLEGAL = re.compile("[^\t\n -퟿-�\U00010000-\U0010ffff]")
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
BLOCKS = "array<struct<block_type:string,level:int,text:string>>"


def _paragraph(text: str, level: int = 0) -> str:
    style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
    runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in _ILLEGAL.sub("", text).split("\n"))
    return f"<w:p>{style}<w:r>{runs}</w:r></w:p>"


def to_docx(blocks: list[tuple[str, int | None, str | None]]) -> bytes:
    """A document of blocks (kind, level, text)."""
    out = []
    for kind, level, text in blocks:
        if kind == "table":
            rows = ["".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r.split(" | ")) for r in _ILLEGAL.sub("", text or "").split("\n")]
            out.append("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
        else:
            out.append(_paragraph(text or "", max(1, level or 1) if kind == "heading" else 0))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(out)}</w:body></w:document>')
    return held.getvalue()


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{{{_W}}}t":
            parts.append(x.text or "")
        elif x.tag in (f"{{{_W}}}br", f"{{{_W}}}cr"):
            parts.append("\n")
        elif x.tag == f"{{{_W}}}tab":
            parts.append("\t")
    return "".join(parts)


def from_docx(content: bytes) -> list[tuple[str, int, str]]:
    """Blocks (kind, level, text) of a document, empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{{{_W}}}body")
    out: list[tuple[str, int, str]] = []
    for x in body if body is not None else ():
        if x.tag == f"{{{_W}}}p":
            style = x.find(f"{{{_W}}}pPr/{{{_W}}}pStyle")
            m = re.search(r"(?i)heading ?(\d)", style.get(f"{{{_W}}}val", "") if style is not None else "")
            text = _text(x).strip()
            if text:
                out.append(("heading", int(m[1]), text) if m else ("paragraph", 0, text))
        elif x.tag == f"{{{_W}}}tbl":
            rows = [" | ".join(_text(c) for c in r.iter(f"{{{_W}}}tc")) for r in x.iter(f"{{{_W}}}tr")]
            if "".join(rows).strip(" |\n"):
                out.append(("table", 0, "\n".join(rows).strip()))
    return out


def write_docx(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """key, content BINARY of documents in blocks (block_type, level, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = [to_docx([(b["block_type"], None if pd.isna(b["level"]) else int(b["level"]), b["text"]) for b in bl if b is not None]) for bl in pdf[blocks]]
            yield pd.DataFrame({key: pdf[key], "content": files})

    return df.select(key, blocks).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, content binary")


def read_docx_files(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, blocks, error of documents given as bytes; null and broken ones have an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content], strict=True):
                try:
                    rows.append((k, [dict(zip(("block_type", "level", "text"), b, strict=True)) for b in from_docx(bytes(c))], None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    rows.append((k, [], f"no document: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[key, "blocks", "error"])

    return df.select(key, content).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, blocks {BLOCKS}, error string")
