"""Passages planted whole, halved, altered, repeated, short and near-equal; the index against brute force."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import leaks as K
from tidewell.session import materialise

FILL = "工作人员通过资料复核确认路灯连续多日不亮确有其事请申请人在前完成自查并留存备查"


def _leaks(docs, items, **more):
    return K.find_leaks(docs, "doc_id", "text", items, "item_id", "passage", keep=lambda df: materialise(df, "test"), **more)


def _found(spark, texts, passages):
    """(text number, passage number) of the leaks."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    return {(r["doc_id"], r["item_id"]) for r in _leaks(docs, items).collect()}


def _drawer(seed):
    rng = random.Random(seed)
    return lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


def _plain(s):
    return "".join(c for c in s if c.isalnum())


def test_planted_passages(spark, tiny):
    items = duckdb.sql(f"select item_id, passage from '{tiny}/eval_items.parquet' order by item_id").fetchall()[:60]
    rng = random.Random(3)
    docs, want = [(0, None), (1, ""), (2, FILL * 2000)], set()
    for n, (i, p) in enumerate(items):
        parts = [x for x in p.replace("。", "。|").replace(". ", ". |").split("|") if x]
        whole, half = "".join(parts), "".join(parts[: (len(parts) + 2) // 2])
        some = parts[0]
        docs.append((100 + n, FILL + whole + FILL))
        want.add((100 + n, i))
        changed = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in " ".join(whole)) if len(parts) > 1 else whole
        docs.append((300 + n, FILL + changed.upper()))
        want.add((300 + n, i))
        if len(_plain(half)) >= 0.55 * len(_plain(whole)):
            docs.append((500 + n, half + FILL * 3))
            want.add((500 + n, i))
        if len(_plain(some)) <= 0.4 * len(_plain(whole)):
            docs.append((700 + n, FILL + some + FILL))
    rng.shuffle(docs)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in _leaks(d, it).collect()}
    assert got == want
    assert _leaks(d.limit(0), it).count() == 0
    assert _leaks(d, it.limit(0)).count() == 0


def test_equal_passages_are_all_reported(spark):
    draw = _drawer(7)
    passages, texts, want = [], [], set()
    for n in (1, 2, 3, 4, 5, 50):
        p = draw(130)
        want |= {(len(texts), len(passages) + k) for k in range(n)}
        passages += [p] * n
        texts.append(FILL + p + FILL)
    assert _found(spark, texts, passages) == want


def test_near_equal_passages_and_short_ones(spark):
    draw = _drawer(8)
    base = draw(120)
    near = [base + draw(8) for _ in range(5)]
    texts = [FILL + near[0] + FILL]
    assert _found(spark, texts, near) == {(0, i) for i in range(5)}  # each has 120 of 128 there
    short = [draw(10), draw(15), "the pump house on the left bank was shut", "left bank pump house", "短", ""]
    texts = [FILL + p + FILL for p in short[:2]] + [f"we saw that {p} all winter long" for p in short[2:4]] + ["短", ""]
    assert _found(spark, texts, short) == {(i, i) for i in range(4)}  # below a term nothing is found


def test_common_terms_and_altered_halves(spark):
    draw = _drawer(5)
    shared = [draw(70) for _ in range(3)]
    passages = [draw(180)] * 5 + [shared[0] + shared[1] + draw(40), shared[1] + shared[2] + draw(40), shared[0] + draw(40) + shared[2]] + [shared[i % 3] + draw(50) for i in range(12)]
    altered = ["".join(FILL[0] if i % 15 == 14 else c for i, c in enumerate(p[: len(p) * 11 // 20])) for p in passages]
    got = _found(spark, [FILL + p + FILL for p in passages] + [FILL + a + FILL for a in altered], passages)
    n = len(passages)
    assert {(d, i) for d in range(5) for i in range(5)} <= got
    assert {(i, i) for i in range(n)} <= got
    assert {(n + i, i) for i in range(n)} <= got


def test_index_and_bitmap(spark):
    texts = ["甲乙丙丁戊己庚辛", "一甲乙丙丁戊己一甲乙丙丁戊己", "甲乙丙"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = K.test_terms(spark.createDataFrame([(0, "甲乙丙丁戊己"), (1, "乙丙丁戊己庚")], "p int, passage string"))
    flags = K.bitmap(terms)
    assert flags.sum() == 2
    index = K.postings(docs, "doc_id", "text", flags).join(terms.select("term", "p"), "term")
    assert sorted((r["p"], r["doc_id"], list(r["at"])) for r in index.collect()) == [(0, 0, [0]), (0, 1, [1, 8]), (1, 0, [1])]
    assert K.postings(docs, "doc_id", "text", np.zeros(1 << K.BITS, np.bool_)).count() == 0


def test_against_brute_force(spark):
    """Every document against every passage without the index, over texts cut from one another."""
    rng, draw = random.Random(11), _drawer(11)
    passages = [draw(rng.randrange(20, 90)) for _ in range(25)]
    texts = []
    for _ in range(120):
        parts = [draw(rng.randrange(0, 20))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            parts += [p[a:b], draw(rng.randrange(0, 12))]
        texts.append("".join(parts))
    want = set()
    for d, t in enumerate(texts):
        for i, p in enumerate(passages):
            place, off = [], []
            for x in range(len(t) - 5):
                for y in range(len(p) - 5):
                    if t[x : x + 6] == p[y : y + 6]:
                        place.append(x)
                        off.append(y)
            if place:
                got = {z for a, b in K.covered(np.array(place), np.array(off), len(p), True, 0.5, 0.7) for z in range(a, b)}
                if len(got) >= 0.5 * len(p):
                    want.add((d, i))
    assert _found(spark, texts, passages) == want and len(want) > 20


def test_repeated_keys_and_hot_terms(spark):
    """Texts under one id don't mix; repeated rows count once; a passage in a third of the documents is found in each."""
    draw = _drawer(13)
    p = draw(60)
    docs = [(1, p[:25]), (1, p[35:]), (2, p), (2, p), *((10 + i, draw(30) + (p if i % 3 == 0 else "")) for i in range(300)), (None, p)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x"))
    items = spark.createDataFrame([(7, p), (7, p), (8, p + draw(10))], "item_id long, passage string")
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in _leaks(df, items).collect())
    assert got == sorted((d, i) for d in [-1, 2, *range(10, 310, 3)] for i in (7, 8))
