"""Assignment, packing, decoding, the reply gate, word-processor documents and bounds, against plain readings."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import extraction as X
from tidewell.functions import metrics as M
from tidewell.functions import text as S
from tidewell.operators import graphs, joins, retrieval
from tidewell.operators import sequences as Q
from tidewell.sources import office


def test_best_mapping_against_all_permutations():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(1, 6, 2)
        g = rng.integers(0, 9, (a, b))
        pairs = M.best_mapping(g)
        small, big = int(min(a, b)), int(max(a, b))
        assert len(pairs) == small and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == small
        h = g if a <= b else g.T
        assert sum(g[i, j] for i, j in pairs) == max(sum(h[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert len(M.best_mapping(rng.integers(0, 99, (60, 45)))) == 45


def test_diarization_of_many_labels(spark):
    """Ten anonymous labels a side, swapped: no error, and no search over permutations."""
    rows = [("a", s, f"{s}{(k * 7) % 10 if s == 'hyp' else k}", float(k), k + 1.0) for s in ("ref", "hyp") for k in range(10)]
    got = M.diarization_error(spark.createDataFrame(rows, "call string, side string, speaker string, start double, end double"), "call").first()
    assert (got["der"], got["miss"], got["false_alarm"], got["confusion"]) == (0, 0, 0, 0)


def test_pages_and_tables_of_chunks(spark):
    para = lambda c, n: c * n
    blocks = [("heading", 1, "标题", 1), ("paragraph", 0, para("甲", 400), 1), ("paragraph", 0, para("乙", 400), 2), ("table", 0, para("丙", 350), 3), ("paragraph", 0, para("丁", 590), None)]
    df = spark.createDataFrame([("d", blocks), ("n", None)], "k string, b array<struct<block_type:string,level:int,text:string,page:int>>")
    got = [(r["page"], r["has_table"], r["content"][0]) for r in Q.chunk_blocks(df, "k", "b").orderBy("chunk_index").collect()]
    assert got == [(1, False, "甲"), (2, False, "乙"), (3, True, "丙"), (None, False, "丁")]
    assert Q.pack_units([("短", None, False), ("表", 4, True)]) == [("短\n表", 4, True)]
    rng = random.Random(1)
    for _ in range(200):
        units = ["字" * rng.randrange(0, 900) + "。" * rng.randrange(2) for _ in range(rng.randrange(8))]
        out = Q.pack(units)
        assert all(0 < len(x) <= 600 for x in out) and "".join("".join(out).split()) == "".join(units)


def test_states_against_every_path():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        votes = [(x, 1 - x) for x in (round(rng.random(), 2) for _ in range(n))]
        pauses = [rng.choice((0.0, 0.1, 0.5, 0.7, 2.0)) for _ in range(n - 1)]

        def value(path, votes=votes, pauses=pauses):
            emit = sum(math.log((v[s] + Q.VOTE_FLOOR) / max(sum(v), Q.VOTE_FLOOR)) for v, s in zip(votes, path, strict=True))
            return emit - sum(Q.switch_penalty(p) for p, a, b in zip(pauses, path, path[1:], strict=False) if a != b)

        best = max(value(p) for p in itertools.product((0, 1), repeat=n))
        assert abs(value(Q.likeliest_states(votes, pauses)) - best) < 1e-9
    assert [Q.switch_penalty(p) for p in (0.0, 0.08, 0.22, 0.7, 0.71)] == [5.5, 3.2, 1.65, 1.65, 0.75]
    assert Q.without_islands([0, 1, 0, 1, 1], [0, 1, 2, 3, 4], [1, 1.5, 3, 4, 5]) == [0, 0, 0, 1, 1]
    assert Q.without_islands([1, 0], [0, 0.1], [0.1, 0.2]) == [1, 0] and Q.likeliest_states([], []) == []


def test_gate(spark):
    rows = [
        ("已登记，依据材料办理[来源1]。", []), ("申请条件见附件。[来源1]", []), ("依据规定应当办理。", ["policy_claim_grounding"]), ("**应当如此**", []), ("应当如下：", []),
        ("未找到明确依据，需人工核实。", []), ("一定解决[来源1]", ["no_overpromise"]), ("在45日内[来源1]", []), ("在46日内[来源1]", ["numeric_fact_support"]), ("拨打12345。", []),
        ("请拨13800001111。", ["numeric_fact_support", "privacy_safe"]), ("见[来源2]", ["citation_marker_integrity"]), ("", ["non_empty"]), (None, ["non_empty"]), ("[来源1]依据一。\n依据二。", ["policy_claim_grounding"]),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(rows)], "i int, draft string")
    cite = F.array(F.struct(F.lit("a").alias("doc_id"), F.lit("b").alias("doc_title"), F.lit("c").alias("snippet")))
    none = F.lit(None).cast("boolean")
    got = {r["i"]: r["f"] for r in df.select("i", X.reply_checks(F.col("draft"), cite, F.array(F.lit("a:0")), F.array(F.lit("a:0")), F.lit("45日"), none).alias("f")).collect()}
    assert [got[i] for i in range(len(rows))] == [f for _, f in rows]
    bad = F.array(F.struct(F.lit("a").alias("doc_id"), F.lit(" ").alias("doc_title"), F.lit("c").alias("snippet")))
    for cited, known in ((bad, F.array(F.lit("a:0"))), (cite, F.array(F.lit("x")))):
        assert df.limit(1).select(X.reply_checks(F.lit("好"), cited, F.array(F.lit("a:0")), known, F.lit(""), F.lit(False)).alias("f")).first()["f"] == ["citation_integrity", "semantic_verification"]


def test_documents_of_a_word_processor(spark):
    blocks = [("heading", 2, "章 & 节"), ("paragraph", 0, "第一行\n第二行 <b>"), ("table", 0, "甲 | 乙\n丙 | 丁"), ("paragraph", 0, "  "), ("list_item", 0, "- 项\x00目")]
    assert office.from_docx(office.to_docx(blocks)) == [("heading", 2, "章 & 节"), ("paragraph", 0, "第一行\n第二行 <b>"), ("table", 0, "甲 | 乙\n丙 | 丁"), ("paragraph", 0, "- 项目")]
    df = spark.createDataFrame([(1, bytearray(office.to_docx(blocks))), (2, bytearray(b"no zip")), (3, None)], "k int, content binary")
    got = {r["k"]: (len(r["blocks"]), r["error"]) for r in office.read_docx_files(df, "k", "content").collect()}
    assert got[1] == (4, None) and got[2][1] and got[3][1]


def test_blanks_of_all_kinds(spark):
    got = spark.createDataFrame([(" 甲 　 乙\n\n\n\n丙\t",)], "t string").select(S.tidy_space(F.col("t")).alias("t")).first()["t"]
    assert got == "甲 乙\n\n丙"


def test_bounds_are_errors(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    keep = lambda df: session.materialise(df, "t")
    with pytest.raises(RuntimeError, match="rounds"):
        graphs.components(chain, "a", "b", keep, most_rounds=1)
    assert {r["component"] for r in graphs.components(chain, "a", "b", keep).collect()} == {0}

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Cluster)


def test_release(spark):
    df = session.materialise(spark.range(5), "t")
    assert df.count() == 5 and session.release(spark) >= 1 and session.release(spark) == 0


def test_both_ways_of_a_bounded_filter(spark, monkeypatch):
    """Filters inside the scan and the joins beyond their bound give the same."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcde", k=rng.randrange(0, 30))) for _ in range(60)] + [None]
    phrases = ["".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(25)]
    t, p = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(x,) for x in set(phrases)], "p string")
    want = {(i, x) for i, y in enumerate(texts) if y for x in phrases if x in y}
    docs = spark.createDataFrame([(i, " ".join(x or "")) for i, x in enumerate(texts)], "i int, t string")
    queries = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(phrases)], "q int, w string")
    scores = []
    for bound in (1000, 0):
        monkeypatch.setattr(joins, "PHRASE_KEYS", bound)
        monkeypatch.setattr(retrieval, "QUERY_TERMS", bound)
        assert {(r["i"], r["p"]) for r in joins.contains_join(t, "t", p, "p").collect()} == want
        scores.append(sorted((r["q"], r["i"], round(r["score"], 9)) for r in retrieval.bm25(docs, "i", "t", queries, "q", "w").collect()))
    assert scores[0] == scores[1] and scores[0]
