"""Queries that SQL can't say, against plain readings of the same tables."""

import difflib
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.operators import sequences as Q

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def rows(tiny):
    def get(sql):
        return duckdb.sql(sql.format(d=tiny)).fetchall()

    return get


def _got(spark, tiny, name, *cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in QUERIES[name](spark, tiny).collect())


def _plain(x):
    return re.sub("[^一-鿿a-z0-9]", "", (x or "").lower())


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


ORDERS = "select distinct on (case_id) case_id, title, summary from '{d}/workorders.parquet'"
TURNS = "select distinct on (case_id, turn_idx) case_id, turn_idx, text from '{d}/dialogue_turns.parquet'"
PAGES = "select distinct on (page_id) page_id, title, blocks from '{d}/parsed_documents.parquet'"


def test_v6_error_rate(spark, tiny, rows):
    want = []
    for k, t, s in rows(ORDERS):
        r, h = _plain(t), _plain(s)
        want.append(repr((k, round(_distance(r, h) / len(r), 6) if r else None)))
    assert _got(spark, tiny, "v6_error_rate", "case_id", "cer") == sorted(want)


def test_m16_and_v11(spark, tiny, rows):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    data = [(k, t or "", s or "") for k, t, s in rows(ORDERS)]
    assert _got(spark, tiny, "m16_match_ratio", "case_id", "ratio") == sorted(repr((k, round(ratio(t, s), 6))) for k, t, s in data)
    assert _got(spark, tiny, "v11_similarity", "case_id", "similarity") == sorted(repr((k, round(max(float(bool(t) and t in s), ratio(t, s)), 6))) for k, t, s in data)


def test_f17_and_f18(spark, tiny, rows):
    data = rows(TURNS)
    assert _got(spark, tiny, "f17_undouble", "case_id", "turn_idx", "text") == sorted(repr((k, i, t if t is None else re.sub(r"(.{2,8}?)\1+", r"\1", t))) for k, i, t in data)
    label = re.compile(r"(?=(?:接线员|市民|群众|客服|坐席)\s*[:：])")
    assert _got(spark, tiny, "f18_units", "case_id", "turn_idx", "units") == sorted(repr((k, i, [x for x in label.split(t) if x])) for k, i, t in data if t is not None)


def test_x10_w14_chunks(spark, tiny, rows):
    """Every chunk again from a plain walk over the blocks: content, page and table of each."""
    want, sizes = [], []
    for k, _, blocks in rows(PAGES):
        sections = [[]]
        for b in blocks or []:
            if b is None:
                continue
            if b["block_type"] == "heading":
                sections.append([])
            else:
                text = b["text"] or ""
                parts = [text] if b["block_type"] == "table" else [x.strip() for x in text.splitlines() if x.strip()]
                sections[-1] += [(x, b["page"], b["block_type"] == "table") for x in parts]
        chunks = [c for s in sections for c in Q.pack_units(s)]
        want += [repr((k, n, c, p, t)) for n, (c, p, t) in enumerate(chunks)]
        if chunks:
            sizes.append(repr((k, len(chunks), max(len(c) for c, _, _ in chunks))))
        assert all(len(c) <= 600 for c, _, _ in chunks)
    assert _got(spark, tiny, "x10_chunks", "page_id", "chunk_index", "content", "page", "has_table") == sorted(want)
    assert _got(spark, tiny, "w14_packing", "page_id", "chunks", "longest") == sorted(sizes)


def test_x12_hard_split(spark, tiny, rows):
    for r in QUERIES["x12_hard_split"](spark, tiny).collect():
        assert all(0 < len(p) <= 600 for p in r["parts"])
    texts = dict(rows("select doc_id, text from '{d}/documents.parquet'"))
    assert {r["doc_id"]: "".join(r["parts"]) for r in QUERIES["x12_hard_split"](spark, tiny).collect()} == {k: t or "" for k, t in texts.items()}


def test_x3_and_x6_pages(spark, tiny, rows):
    """The text of a page survives being written as HTML and read; furniture tags don't."""
    got = {r["page_id"]: r for r in QUERIES["x6_main_content"](spark, tiny).collect()}
    for k, title, blocks in rows(PAGES):
        texts = []
        for b in blocks or []:
            x = " ".join(((b and b["text"]) or "").split())
            if x and (not texts or texts[-1] != x):
                texts.append(x)
        assert " ".join(got[k]["content"].split()) == " ".join(" ".join(texts).split())
        assert got[k]["title"] == (title.strip() if title and 3 <= len(title.strip()) <= 180 else None)


def test_e1_agrees_with_its_parts(spark, tiny):
    whole = {r["case_id"]: r for r in QUERIES["e1_analyze"](spark, tiny).collect()}
    regions = {r["case_id"]: r["region"] for r in QUERIES["f20_regions"](spark, tiny).collect()}
    assert whole and all(regions[k] == r["region"] for k, r in whole.items())
    for r in whole.values():
        missing = sum(r[c] is None for c in ("time_text", "location", "event", "request"))
        assert abs(r["completeness"] - round((4 - missing) / 4, 4)) < 1e-9
        assert len(r["title"]) <= 48 and len(r["summary"]) <= 300 and len(r["subjects"]) <= 5
        assert r["location"] is None or r["location"] in r["t"]
        assert not re.search(r"(?<!\d)1[3-9]\d{9}(?!\d)", r["t"])


def test_w16_states(spark, tiny, rows):
    got = {}
    for r in QUERIES["w16_decoding"](spark, tiny).collect():
        got.setdefault(r["call_id"], []).append(r["state"])
    data: dict = {}
    for c, i, a, b, v in rows("select distinct on (call_id, seg_idx) call_id, seg_idx, start_sec, end_sec, speaker_id from '{d}/transcript_segments.parquet' where start_sec is not null"):
        m = re.search(r"(\d+)", v or "")
        data.setdefault(c, []).append((a, b if b is not None else a, float(int(m[1]) % 2) if m else 0.5))
    assert got.keys() == data.keys()
    for c, seg in data.items():
        seg.sort(key=lambda x: x[:2])
        states = Q.likeliest_states([(1 - x, x) for _, _, x in seg], [max(0.0, n[0] - p[1]) for p, n in zip(seg, seg[1:], strict=False)])
        assert sum(got[c]) == sum(Q.without_islands(states, [x[0] for x in seg], [x[1] for x in seg]))
