"""Cutting oversized items into pieces under a limit, at natural boundaries where there are any.

Lengths are counted in tokens; by default a token is a code point, and a token offset array (prefix
sums of code points) maps them to text positions, so that any tokenizer's offsets can be used.
Boundaries are sorted arrays, one a strength: paragraph, line, sentence, clause, word.  For each
piece a binary search finds the last boundary under the limit, of the strongest kind that leaves the
piece at least ``fill`` of the limit full; without any, the cut is hard, though not inside a
grapheme (a base with its combining marks, or CR LF) if the piece can spare it.  The next piece
starts ``overlap`` tokens before the cut.

Defined results: null or empty text, or a null limit: no pieces; text within the limit: one piece,
the text itself; pieces never exceed the limit; consecutive pieces share exactly ``overlap`` tokens;
piece 0 followed by every later piece without its overlap restores the item.  A limit below 1 or an
overlap not below the limit is an error where the operator is set up from numbers, and yields no
pieces for rows that bring such limits with them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: strongest first; a boundary lies after the match
BOUNDARIES = tuple(
    regex.compile(p)
    for p in (
        r"(?:\r?\n[ \t　]*){2,}",
        r"\r?\n|\r",
        r"[。！？!?…]+[”’」』）)\"']*|\.(?=\s|$)[”’\"')]*",
        r"[；;，、,：:](?!\d)|\s\|\s",
        r"\s+|(?<=\p{Han})(?=[^\p{Han}\p{M}])|(?<=[^\p{Han}])(?=\p{Han})",
    )
)


def boundaries(text: str) -> list[np.ndarray]:
    return [np.unique(np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64)) for p in BOUNDARIES]


def split_item(text: str, limit: int, overlap: int = 0, fill: float = 0.5, offsets: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Start and end of each piece, in code points."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap below it")
    n_chars = len(text)
    if n_chars == 0:
        return []
    starts = np.arange(n_chars + 1) if offsets is None else np.asarray(offsets)  # starts[i]: where token i begins; the last is the end
    n = len(starts) - 1
    if n <= limit:
        return [(0, n_chars)]
    levels = boundaries(text)
    if offsets is not None:  # boundaries as token numbers, those inside a token left out
        levels = [np.searchsorted(starts, b[np.isin(b, starts)]) for b in levels]
    pieces, at = [], 0
    while True:
        if at + limit >= n:
            pieces.append((int(starts[at]), n_chars))
            return pieces
        top, low = at + limit, at + max(overlap + 1, int(limit * fill))
        cut = 0
        for b in levels:
            k = int(np.searchsorted(b, top, side="right")) - 1
            if k >= 0 and b[k] >= low:
                cut = int(b[k])
                break
        if not cut:
            cut = top
            while cut > low and offsets is None and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            if cut <= low:
                cut = top
        pieces.append((int(starts[at]), int(starts[cut])))
        at = cut - overlap


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str, fill: float = 0.5) -> DataFrame:
    """keys, piece_no INT, start_pos INT, end_pos INT, piece STRING of the items longer than their limit.

    Items within their limit are dropped before anything leaves the JVM.
    """
    over = df.filter((F.length(text) > F.col(limit)) & (F.col(limit) >= 1) & (F.col(overlap) >= 0) & (F.col(overlap) < F.col(limit)))
    over = over.select(*keys, F.col(text).alias("_tw_text"), F.col(limit).alias("_tw_limit"), F.col(overlap).alias("_tw_overlap"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in over.schema.fields[: len(keys)]) + ", piece_no int, start_pos int, end_pos int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                item, most, shared = row[-3], int(row[-2]), int(row[-1])
                rows += [(*row[:-3], i, a, b, item[a:b]) for i, (a, b) in enumerate(split_item(item, most, shared, fill))]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "start_pos", "end_pos", "piece"])

    return over.mapInPandas(run, schema)
