"""Turns on small talks, against a plain fold."""

import random

from pyspark.sql import functions as F

from tidewell.llm import turns as T

SCHEMA = "call_id string, seg_idx int, start_sec double, end_sec double, text string, role string, speaker_id string, idx string, role2 string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def heads(df):
    return [(r["conv_id"], r["turn_no"], r["role"], r["first_idx"]) for r in T.turns(df).orderBy("conv_id", "turn_no").collect()]


def speech(df):
    return T.speech_rows(df, "call_id", "seg_idx", voice="speaker_id", start="start_sec", end="end_sec")


def test_order_roles_and_silence(spark):
    rows = [
        ("a", 3, 9.0, 10.0, "好的谢谢。", "Operator", "SPEAKER_01"),  # wrong role, the voice decides
        ("a", 0, 1.0, 2.0, "您好，请讲", "AGENT ", "spk0"),
        ("a", 0, 1.0, 2.0, "您好，请讲", "AGENT ", "spk0"),  # again
        ("a", 1, 3.0, 4.0, "嗯…", "citizen", "S1"),
        ("a", 2, 2.5, 3.5, "[noise]我要投诉", "citizen", "1"),
        ("a", 4, 5.0, 6.0, "（咳嗽）", None, "0"),
        ("a", 5, 7.0, 8.0, "路灯不亮", "unknown", "spk_1"),
        ("b", 0, None, None, "[00:00:09]群众：再见", None, None),
        ("b", 1, None, None, "【00:02】接线员：那个，您好", "unknown", ""),
        ("c", 0, 1.0, 2.0, None, None, None),
        ("c", 1, 1.0, 2.0, "那个。", "agent", None),
        ("d", 0, 1.0, 1.5, "请问位置", None, None),
    ]
    got = heads(speech(rows_of(spark, rows)))
    assert got == [("a", 1, "operator", 0), ("a", 2, "citizen", 2), ("b", 1, "operator", 1), ("b", 2, "citizen", 0), ("d", 1, "operator", 0)]


def test_voice_known_by_the_other(spark):
    rows = [("a", 0, 0.0, 1.0, "您好", "agent", "0"), ("a", 1, 2.0, 3.0, "漏水", "unknown", "1"), ("a", 2, 4.0, 5.0, "好", None, "1")]
    assert heads(speech(rows_of(spark, rows))) == [("a", 1, "operator", 0), ("a", 2, "citizen", 1)]


def test_wording_overlap_and_pauses(spark):
    rows = [
        ("a", 0, 0.0, 2.0, "我们这边的路灯已经坏了很久", "citizen", "1"),
        ("a", 1, 2.1, 4.0, "路灯已经坏了很久没有人来修", "citizen", "1"),
        ("a", 2, 4.2, 5.0, "呃，怎么说呢，<音乐>请尽快", "citizen", "1"),
        ("a", 3, 60.0, 61.0, "还在吗", "citizen", "1"),
    ]
    one = T.turns(speech(rows_of(spark, rows))).collect()
    assert [r["text"] for r in one] == ["我们这边的路灯已经坏了很久 没有人来修 请尽快 还在吗"]
    two = T.turns(speech(rows_of(spark, rows)), pause_factor=8.0).orderBy("turn_no").collect()
    assert [r["first_idx"] for r in two] == [0, 3]


def test_overlaps_of_any_length(spark):
    long = "".join(chr(0x4E00 + i * 7) for i in range(91))
    rows = [
        ("a", 0, 0.0, 2.0, "开头" + long, "citizen", "1"),
        ("a", 1, 2.1, 4.0, long + "后面还有", "citizen", "1"),
        ("b", 0, 0.0, 2.0, long, "citizen", "1"),
        ("b", 1, 2.1, 4.0, long, "citizen", "1"),
    ]
    got = {r["conv_id"]: r["text"] for r in T.turns(speech(rows_of(spark, rows))).collect()}
    assert got == {"a": "开头" + long + " 后面还有", "b": long}
    rng, pairs = random.Random(1), []
    for _ in range(3000):
        p, c = ("".join(rng.choices("ab", [9, 1], k=rng.randrange(120))) for _ in range(2))
        pairs.append((p, p[rng.randrange(len(p) + 1) :] + c if rng.random() < 0.5 else c))
    df = spark.createDataFrame(pairs, "p string, c string")
    for r in df.select("p", "c", T.overlap(F.col("p"), F.col("c")).alias("k")).collect():
        assert r["k"] == max((k for k in range(6, len(r["c"]) + 1) if r["p"].endswith(r["c"][:k])), default=0)


def test_empty_and_long(spark):
    df = rows_of(spark, [("a", 0, 0.0, 1.0, "好" * 50000, "agent", None)])
    assert heads(speech(df)) == [("a", 1, "operator", 0)]
    assert heads(speech(df.limit(0))) == []
    assert T.turns(speech(df)).select(F.length("text")).first()[0] == 50000
