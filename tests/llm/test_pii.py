"""Personal data: the trees on held-out wordings, unseen names, overlaps and placeholders."""

import random

import duckdb
import numpy as np
import pytest

from tidewell.llm import boosting, pii_samples
from tidewell.llm import pii as P

D = ("砚湾区", "岚泊县", "栖桐区", "禾渡县", "云麓区", "望潮区", "松屿县", "沐汀区", "青砚区", "临汐县")


@pytest.fixture(scope="module")
def sample(small):
    rows = duckdb.sql(f"select source.raw_text, [elements.location] from '{small}/workorders.parquet' union all select text, expected.location from '{small}/intake_cases.parquet'").fetchall()
    rows = [(t, [x for x in p or () if x]) for t, p in rows if t]
    return [t for t, _ in rows], [p for _, p in rows]


@pytest.fixture(scope="module")
def red(sample):
    return P.train(sample[0], D, sample[1])


TEXTS = [
    ("收件人韩岑婧，地址宁星祥佳园5栋（乐汀街３号），手机154-4018-4321。", {("name", "韩岑婧"), ("address", "宁星祥佳园5栋（乐汀街３号）"), ("phone", "154-4018-4321")}),
    ("本人李沅婧，身份证号996137200704262586。受理编号990570909994529001，此前工单号为20260711515，取件码823442。", {("name", "李沅婧"), ("id_number", "996137200704262586")}),
    ("地址是解放路5号。", {("address", "解放路5号")}),
    ("建设路12号3号楼2单元101室", {("address", "建设路12号3号楼2单元101室")}),
    ("我住在长江路18号阳光花园3号楼201室", {("address", "长江路18号阳光花园3号楼201室")}),
    ("家住人民东路23号，电话13800001111", {("address", "人民东路23号"), ("phone", "13800001111")}),
    ("王小明昨天来电", {("name", "王小明")}),
    ("陈阿姨说李女士在张氏牙科，紧急时拨打了110，曾向12315投诉。", set()),
    ("邮箱是q.harbour371艾特box点test，材料发a_b@x.example即可", {("email", "q.harbour371艾特box点test"), ("email", "a_b@x.example")}),
    ("锦岚北路与鹤翠巷交叉口", set()),
]


def test_texts(red):
    found = red.spans([t for t, _ in TEXTS])
    for (t, want), spans in zip(TEXTS, found, strict=True):
        assert {(k, t[a:b]) for a, b, k, _ in spans} == want, t


def _scores(found, known):
    hit, made, true = {}, {}, {}
    for spans, want in zip(found, known, strict=True):
        for a, b, k in want:
            if k:
                true[k] = true.get(k, 0) + 1
        for a, b, k, _ in spans:
            if not any(z == "" and a < y and b > x for x, y, z in want):
                made[k] = made.get(k, 0) + 1
                hit[k] = hit.get(k, 0) + ((a, b, k) in want)
    return {k: (hit[k] / made[k], hit[k] / true[k]) for k in true}


def test_held_out_wordings_and_unseen_names(red, sample):
    """Carriers that fitted nothing, with names, roads and numbers drawn anew; a rule without trees does worse."""
    _, held = pii_samples.sentences(sample[0], random.Random(99))
    known = [spans for _, spans in held]
    scores = _scores(red.spans([t for t, _ in held]), known)
    assert scores.keys() == set(P.TYPES)
    for kind, (precision, recall) in scores.items():
        assert precision > 0.9 and recall > 0.9, (kind, precision, recall)
    assert all(m.trees for m in red.models.values())
    # the rule: every candidate, of overlapping ones the longest
    part, rule = P.address_part(D), []
    for t, _ in held:
        taken = []
        for k, a, b, _ in sorted(P.candidates(t, part, red.seen), key=lambda c: c[1] - c[2]):
            if all(b <= x or a >= y for x, y, *_ in taken):
                taken.append((a, b, k, 1.0))
        rule.append(taken)
    f1 = lambda s: np.mean([2 * p * r / (p + r) if p + r else 0 for p, r in s.values()])
    assert f1(scores) > f1(_scores(rule, known)) + 0.1


def test_located_addresses(red, sample):
    """The location that comes with a text is found in it word for word."""
    texts, places = sample
    hit = true = 0
    for t, ps, spans in zip(texts, places, red.spans(texts), strict=True):
        for p in ps:
            if len(p) > 8 and any(c.isdigit() for c in p) and t.count(p) == 1:
                true += 1
                hit += (t.find(p), t.find(p) + len(p), "address") in {(a, b, k) for a, b, k, _ in spans}
    assert true > 300 and hit > 0.95 * true


def test_edges(spark, red):
    assert red.spans([None, "", "好" * 30000]) == [[], [], []]
    t = TEXTS[1][0]
    assert P.mask(t, red.spans([t])[0]).startswith("本人[NAME]，身份证号[ID_NUMBER]。受理编号9905")
    df = spark.createDataFrame([(1, TEXTS[0][0], "z"), (2, None, "z"), (3, "", "z")], "k int, text string, pii_type string")
    assert P.find_pii(df, ["k"], "text", red).count() == 3
    assert [r["masked"] for r in P.find_pii(df, ["k"], "text", red, masked=True).orderBy("k").collect()][1:] == [None, ""]
    assert P.find_pii(df.limit(0), ["k"], "text", red).count() == 0
    nothing = P.train([], D)
    assert nothing.spans(["家住人民东路23号"]) != [[]]


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    p = m.probability(x[2000:])
    t = boosting.calibrated_threshold(m.probability(x[:2000]), y[:2000])
    assert ((p > t) == y[2000:]).mean() > 0.95
    assert boosting.fit(x[:1], y[:1]).probability(x[:3]).shape == (3,)


def test_contexts_of_all_texts(spark, sample):
    """Counted where the texts are, they equal one pass over all of them, beyond what is fitted on too."""
    texts = [*sample[0][:700], "", "王", "１２王小明", "王小明王小明\n王小明", "欧阳\U0001f600王"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    made = ["联系人：王小明", "王小明"]
    got, want = P.count_contexts(df, "text", made), P.Contexts([*(t for t in texts if t), *made])
    assert got.pairs == want.pairs and got.triples == want.triples
    assert got.left == want.left and got.right == want.right
    few = P.train(sample[0][:50], D, sample[1][:50], count=lambda made: P.count_contexts(df, "text", made))
    assert few.seen.pairs["王小"] >= 4 and len(few.seen.left) > len(P.train(sample[0][:50], D, sample[1][:50]).seen.left)


def test_contexts_do_not_depend_on_the_size(spark, sample, monkeypatch):
    """Three times the same texts, and three times as many as are fitted on, give the counts of one."""
    texts = sample[0][:300]
    monkeypatch.setattr(P, "SAMPLE_ROWS", len(texts))
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    got, want = P.count_contexts(df, "text", ["王小明"] * 2), P.Contexts([*texts, "王小明", "王小明"])
    assert got.pairs["王小"] == pytest.approx(want.pairs["王小"])
    for k, n in want.pairs.items():
        assert got.pairs[k] == pytest.approx(n)
    for k, (share, _, size) in want.left.items():
        assert got.left[k][0] == pytest.approx(share) and got.left[k][2] == pytest.approx(size)
