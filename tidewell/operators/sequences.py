"""Order-sensitive operators: runs, budgets, carried state, packing, decoding.

Everything is keyed by a group (a session, a document, a call) that one task can hold, as the reference
rows of such a group come from one conversation or document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, group: list[str], order: list[str], changed: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run a row stands in; ``changed`` says whether a row begins one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def differs(c: str, group: list[str], order: list[str]) -> Column:
    """Whether a row's value differs from the row before (null for the first)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return ~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1)


def running_budget(df: DataFrame, group: list[str], order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows until their texts reach the budget of characters; the row on the border is cut."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return df.withColumn("_tw_used", used).filter(F.col("_tw_used") < budget).withColumn(text, F.substr(F.col(text), F.lit(1), (budget - F.col("_tw_used")).cast("int"))).drop("_tw_used")


def carried_state(markers: Column, start: str) -> Column:
    """Fold over an array of states, nulls keep the state before; gives the array of states held."""
    folded = F.aggregate(markers, F.array(F.lit(start)), lambda acc, x: F.concat(acc, F.array(F.coalesce(x, F.element_at(acc, -1)))))
    return F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0)))


# --- documents into chunks -------------------------------------------------------------------------


def section_paths(headings: list[tuple[int, str]]) -> list[list[str]]:
    """The path of titles at each heading; skipped levels are empty."""
    path: list[str] = []
    out = []
    for level, title in headings:
        depth = max(level, 1) - 1
        path = path[:depth] + [""] * (depth - len(path[:depth])) + [title]
        out.append(list(path))
    return out


def cut_long(text: str, least: int, most: int) -> list[str]:
    """Sentences gathered up to ``least`` characters, then slices of ``most``."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    for i, c in enumerate(text):
        if c in "。！？；\n" and i + 1 - at >= least:
            out.append(text[at : i + 1])
            at = i + 1
    if at < len(text):
        out.append(text[at:])
    return [p[k : k + most] for p in out for k in range(0, len(p), most)]


def pack_units(units: list[tuple[str, int | None, bool]], least: int = 300, most: int = 600) -> list[tuple[str, int | None, bool]]:
    """Units (text, page, whether a table) packed in order: a chunk closes when the next unit would pass ``most`` and it has
    ``least``; then short neighbours join while they fit, and what is still too long is sliced.  A chunk has the
    page of its first unit that has one, and a table if one of its units is."""
    chunks: list[list[tuple[str, int | None, bool]]] = [[]]
    for text, page, table in units:
        for piece in cut_long(text, least, most):
            held = sum(len(x[0]) for x in chunks[-1])
            if held >= least and held + len(piece) > most:
                chunks.append([])
            chunks[-1].append((piece, page, table))
    merged: list[list] = []
    for chunk in chunks:
        text = "\n".join(x[0] for x in chunk).strip()
        if not text:
            continue
        page, table = next((x[1] for x in chunk if x[1] is not None), None), any(x[2] for x in chunk)
        if merged and len(merged[-1][0]) + 1 + len(text) <= most and min(len(text), len(merged[-1][0])) < least:
            merged[-1] = [f"{merged[-1][0]}\n{text}".strip(), merged[-1][1], merged[-1][2] or table]
        else:
            merged.append([text, page, table])
    return [(text[k : k + most], page, table) for text, page, table in merged for k in range(0, len(text), most)]


def pack(units: list[str], least: int = 300, most: int = 600) -> list[str]:
    """Texts packed in order, see ``pack_units``."""
    return [text for text, _, _ in pack_units([(u, None, False) for u in units], least, most)]


def chunk_blocks(df: DataFrame, key: str, blocks: str, least: int = 300, most: int = 600) -> DataFrame:
    """key, chunk_index, section_title, section_path, content, char_count, page, has_table of documents in blocks
    (block_type, level, text, page).  Null blocks and texts count as empty."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index int, section_title string, section_path array<string>, content string, char_count int, page int, has_table boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, bl in zip(pdf[key], pdf[blocks], strict=True):
                sections: list[tuple[list[str], list]] = []
                heads: list[tuple[int, str]] = []
                for b in bl if bl is not None else ():
                    if b is None:
                        continue
                    if b["block_type"] == "heading":
                        heads.append((int(b["level"] or 1), b["text"] or ""))
                        sections.append((section_paths(heads)[-1], []))
                    else:
                        if not sections:
                            sections.append(([], []))
                        sections[-1][1].append(b)
                n = 0
                for path, body in sections:
                    units = []
                    for b in body:
                        text, page = b["text"] or "", int(b["page"]) if b["page"] is not None and b["page"] == b["page"] else None
                        table = b["block_type"] == "table"
                        units += [(x, page, table) for x in ([text] if table else [y.strip() for y in text.splitlines() if y.strip()])]
                    for content, page, table in pack_units(units, least, most):
                        rows.append((k, n, path[-1] if path else "", path, content, len(content), page, table))
                        n += 1
            yield pd.DataFrame(rows, columns=[c.strip().split()[0].strip("`") for c in schema.split(", ")]).astype({"page": "Int32"})

    return df.select(key, blocks).mapInPandas(run, schema)


# --- two-state decoding ------------------------------------------------------------------------------

# The penalties of a change of state after pauses below a bound, after others, and after long ones; the shortest island.
SHORT_PAUSES, USUAL_PENALTY = ((0.08, 5.5), (0.22, 3.2)), 1.65
LONG_PAUSE, LONG_PENALTY = 0.7, 0.75
SHORTEST_ISLAND = 0.8
VOTE_FLOOR = 1e-5


def switch_penalty(pause: float) -> float:
    return next((p for bound, p in SHORT_PAUSES if pause < bound), LONG_PENALTY if pause > LONG_PAUSE else USUAL_PENALTY)


def likeliest_states(votes: list[tuple[float, float]], pauses: list[float]) -> list[int]:
    """The most likely path through two states: log shares of the votes, less a penalty for every change."""
    if not votes:
        return []
    emit = [[math.log((v + VOTE_FLOOR) / max(a + b, VOTE_FLOOR)) for v in (a, b)] for a, b in votes]
    best, came = [emit[0]], []
    for now, pause in zip(emit[1:], pauses, strict=True):
        stay, switch = best[-1], [x - switch_penalty(pause) for x in reversed(best[-1])]
        came.append([s if stay[s] >= switch[s] else 1 - s for s in (0, 1)])
        best.append([max(stay[s], switch[s]) + now[s] for s in (0, 1)])
    path = [0 if best[-1][0] >= best[-1][1] else 1]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


def without_islands(states: list[int], starts: list[float], ends: list[float]) -> list[int]:
    """Runs shorter than ``SHORTEST_ISLAND`` between two runs of the other state take that state, the first one first."""
    states = list(states)
    while True:
        edges = [0, *(i for i in range(1, len(states)) if states[i] != states[i - 1]), len(states)]
        short = next((k for k in range(1, len(edges) - 2) if ends[edges[k + 1] - 1] - starts[edges[k]] < SHORTEST_ISLAND), None)
        if short is None:
            return states
        a, b = edges[short], edges[short + 1]
        states[a:b] = [1 - states[a]] * (b - a)


def decode_speakers(df: DataFrame, call: str, at: str, end: str, score: str) -> DataFrame:
    """call, at, state: the smoothed sequence of two states from the share of votes in [0, 1] for state 1, per call."""
    schema = f"`{call}` {df.schema[call].dataType.simpleString()}, `{at}` double, state int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[at]).sort_values([at, end], kind="stable")
        if pdf.empty:
            return pd.DataFrame(columns=[call, at, "state"])
        s = pdf[score].fillna(0.5).to_list()
        starts, ends = pdf[at].to_list(), pdf[end].fillna(pdf[at]).to_list()
        states = likeliest_states([(1 - x, x) for x in s], [max(0.0, b - a) for a, b in zip(ends, starts[1:], strict=False)])
        return pd.DataFrame({call: pdf[call].to_list(), at: starts, "state": without_islands(states, starts, ends)})

    return df.select(call, at, end, score).groupBy(call).applyInPandas(run, schema)
