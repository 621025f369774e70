"""Operators without SQL against brute force, and the defined edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import metrics as M
from tidewell.functions import text as S
from tidewell.operators import graphs, joins, retrieval, sequences, tables
from tidewell.session import materialise
from tidewell.sources import files, readers
from tidewell.streaming import events


def test_upsert_delete_empty(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(2, "c", 2), (None, "m", 2), (3, None, 1)], "k int, v string, t int")
    got = {r["k"]: r["v"] for r in tables.upsert(a, b, ["k"], "t").collect()}
    assert got == {1: "a", 2: "c", None: "m", 3: None}
    assert tables.upsert(a.limit(0), b.limit(0), ["k"], "t").count() == 0
    assert {r["k"] for r in tables.delete(a, b.select("k"), ["k"]).collect()} == {1}
    assert tables.insert_absent(a.filter("k is not null"), b.filter("k is not null"), ["k"]).count() == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(0, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r["vertex"]: r["component"] for r in graphs.components(df, "a", "b", lambda d: materialise(d, "t")).collect()}
    assert got == want
    assert graphs.components(df.limit(0), "a", "b", lambda d: d).count() == 0


def test_interval_joins(spark):
    rng = random.Random(2)
    spans = [(k, rng.uniform(0, 50), 0.0) for k in "xy" for _ in range(40)]
    spans = [(k, s, s + rng.uniform(0, 12)) for k, s, _ in spans] + [("x", 5.0, 1.0)]
    points = [(i, rng.choice("xyz"), rng.uniform(-5, 60)) for i in range(80)]
    a = spark.createDataFrame(points, "i int, k string, t double")
    b = spark.createDataFrame(spans, "k string, s double, e double")
    got = {(r["i"], r["s"]) for r in joins.point_in_interval(a, "t", b, "s", "e", ["k"], 3.0).collect()}
    assert got == {(i, s) for i, k, t in points for kk, s, e in spans if k == kk and s <= t < e}
    left = b.select("k", F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    right = b.select("k", F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    pairs = joins.overlapping(left, right, ["k"], 3.0, 0.5).select("a_start", "b_start").collect()
    want = [(s, u) for k, s, e in spans for kk, u, v in spans if k == kk and s <= e and u <= v and min(e, v) - max(s, u) > 0.5]
    assert sorted(map(tuple, pairs)) == sorted(want)


def test_contains_join_short_and_overlapping(spark):
    t = spark.createDataFrame([(1, "abcabc"), (2, "x"), (3, ""), (4, None), (5, "😀😀b")], "i int, t string")
    p = spark.createDataFrame([("abc",), ("x",), ("b",), ("😀b",), ("",), (None,)], "p string")
    got = sorted((r["i"], r["p"]) for r in joins.contains_join(t, "t", p, "p").select("i", "p").distinct().collect())
    assert got == [(1, "abc"), (1, "b"), (2, "x"), (5, "b"), (5, "😀b")]


def test_vector_top_k_ties_and_lengths(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(100, [1.0]), (101, None), (102, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "q long, w array<double>")
    got = [(r["id"], r["rank"]) for r in retrieval.vector_top_k(df, "id", "v", q, "q", "w", 4).orderBy("rank").collect()]
    assert got == [(0, 1), (3, 2), (6, 3), (9, 4)]
    assert retrieval.vector_top_k(df, "id", "v", q.limit(0), "q", "w", 4).count() == 0


def test_chunks_hold_the_text_and_the_limits():
    rng = random.Random(1)
    for _ in range(200):
        units = ["".join(rng.choice("天地玄黄。！ab\n") for _ in range(rng.choice((0, 5, 80, 400, 1500)))) for _ in range(rng.randrange(6))]
        out = sequences.pack(units, 300, 600)
        assert all(0 < len(c) <= 600 for c in out)
        assert "".join("".join(out).split()) == "".join("".join(units).split())


def test_section_paths():
    assert sequences.section_paths([(1, "A"), (3, "B"), (2, "C"), (1, "D")]) == [["A"], ["A", "", "B"], ["A", "C"], ["D"]]


def test_decoding_smooths_a_flicker(spark):
    rows = [("c", float(i), i + 0.95, 0.9 if i != 5 else 0.3) for i in range(10)]
    df = spark.createDataFrame([*rows, ("d", None, None, None)], "call string, s double, e double, p double")
    got = [r["state"] for r in sequences.decode_speakers(df, "call", "s", "e", "p").orderBy("s").collect()]
    assert got == [1] * 10


def test_diarization_zero_under_swapped_names(spark):
    rows = [("c", "ref", "A", 0.0, 1.0), ("c", "ref", "B", 1.0, 2.0), ("c", "hyp", "1", 0.0, 1.0), ("c", "hyp", "0", 1.0, 2.0), ("e", "ref", "A", 0.0, 1.0)]
    got = M.diarization_error(spark.createDataFrame(rows, "call string, side string, speaker string, start double, end double"), "call").collect()
    assert len(got) == 1 and got[0]["der"] == 0.0


def test_error_rate(spark):
    df = spark.createDataFrame([("ab", "a"), ("", "x"), (None, None), ("你好。", "你")], "r string, h string")
    assert [r[0] for r in df.select(M.error_rate(F.col("r"), F.col("h"))).collect()] == [0.5, None, None, 0.5]


def test_mask_and_pieces(spark):
    df = spark.createDataFrame([("id 11010519491231002X tel 13800138000，138001380001",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(S.mask_numbers(F.col("t"))).collect()]
    assert got == ["id [身份证] tel [电话]，138001380001", "", None]
    assert [r[0] for r in df.select(S.pieces(F.col("t"), 10)).collect()][1:] == [[], None]


@pytest.mark.parametrize("mode", ["batch", "stream"])
def test_retries(spark, mode, tmp_path):
    rows = [("a", 1, False, "x"), ("a", 2, True, None), ("a", 3, False, "late"), ("b", 1, False, "p"), ("b", 2, False, "q"), ("b", 3, False, "r"), ("b", 4, True, None), ("c", 1, False, None)]
    df = spark.createDataFrame(rows, "job string, at int, ok boolean, error string")
    if mode == "batch":
        got = {r["job"]: (r["attempts"], r["status"], r["errors"]) for r in events.retries(df, "job", "at", "ok", "error").collect()}
        assert got == {"a": (2, "done", ["x"]), "b": (3, "dead_letter", ["p", "q", "r"]), "c": (1, "retrying", [""])}
    else:
        timed = df.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("at")))
        timed.coalesce(1).write.parquet(f"{tmp_path}/jobs.parquet")
        out = events.run_once(events.retries_stream(events.stream_of(spark, f"{tmp_path}/jobs.parquet"), "job", "at", "ok", "error"), "t")
        last = {r["job"]: (r["attempts"], r["status"], r["errors"]) for r in out.orderBy("attempts").collect()}
        assert last == {"a": (2, "done", ["x"]), "b": (3, "dead_letter", ["p", "q", "r"]), "c": (1, "retrying", [""])}


def test_state_expires(spark):
    """Open jobs that go silent are given up, closed ones forgotten; silent keys are reported once, with their state dropped."""
    rows = [("a", 0, True, "x"), ("b", 5, False, "p")]
    df = spark.createDataFrame(rows, "job string, s int, ok boolean, error string").select("job", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("at"), "ok", "error")
    beat = events.with_heartbeat(df, "at", "3 days", "t").withColumn("job", F.coalesce("job", F.lit("beat")))
    out = events.run_once(events.retries_stream(beat, "job", "at", "ok", "error", late="1 hour", keep_ms=1000), "t").collect()
    assert {(r["job"], r["status"]) for r in out if r["job"] != "beat"} == {("a", "done"), ("b", "retrying"), ("b", "given_up")}
    beat = events.with_heartbeat(df.select("job", "at"), "at", "3 days", "t").withColumn("job", F.coalesce("job", F.lit("beat")))
    out = events.run_once(events.silent(beat, "job", "at", 1000, "1 hour"), "t").collect()
    assert sorted((r["job"], r["since_ms"], r["n"]) for r in out) == [("a", 1_700_000_000_000, 1), ("b", 1_700_000_005_000, 1)]


def test_dispatch_and_last_versions(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, kind string").coalesce(1).write.parquet(f"{tmp_path}/jobs.parquet")
    s = events.stream_of(spark, f"{tmp_path}/jobs.parquet")
    handlers = {"a": lambda x: x.select("i", F.lit("A").alias("r")), "unknown": lambda x: x.select("i", F.col("kind").alias("r"))}
    got = sorted((r["handler"], r["i"], r["r"]) for r in events.dispatch(s, "kind", handlers, "t").collect())
    assert got == [("a", 1, "A"), ("a", 4, "A"), ("unknown", 2, "b"), ("unknown", 3, None)]
    folder = f"{tmp_path}/more"
    for n in range(3):
        spark.createDataFrame([("k", n), ("l", n)][: 1 + n], "k string, n int").coalesce(1).write.parquet(f"{folder}/{n}")
    s = spark.readStream.schema("k string, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    out = events.run_once(s.groupBy("k").agg(F.sum("n").alias("total")), "t", "update", ["k"])
    assert {(r["k"], r["total"]) for r in out.collect()} == {("k", 3), ("l", 3)}


def test_readers(spark):
    title, meta, blocks = readers.read_markdown("# T\n- 来源：X\n\npara one\npara two\n\n## H\n- item\n| a | b |\n|---|---|\n| 1 | 2 |\n", ("来源",))
    assert (title, meta) == ("T", {"来源": "X"})
    assert [b[:3] for b in blocks] == [("paragraph", 0, "para one para two"), ("heading", 2, "H"), ("list_item", 0, "item"), ("table", 0, "a | b"), ("table", 0, "1 | 2")]
    t, links, blocks = readers.read_html("<title>P</title><nav><p>menu</p></nav><h2>A &amp; B</h2><p>x <a href='/u'>link</a></p><p>x link</p><script>p()</script>")
    assert (t, links, [b[:3] for b in blocks]) == ("P", [("/u", "link")], [("heading", 2, "A & B"), ("paragraph", 0, "x link")])
    df = spark.createDataFrame([(1, ".txt", "第一章 总则\nbody\f2"), (2, ".xyz", "?"), (3, ".md", None)], "k int, s string, t string")
    got = {r["k"]: r for r in readers.parse_documents(df, "k", "s", "t").collect()}
    assert [b["block_type"] for b in got[1]["blocks"]] == ["heading", "paragraph", "paragraph"] and got[2]["error"] and got[3]["blocks"] == []


def test_file_sources(spark, tmp_path):
    for name, body in (("a/x.md", "# t"), ("a/quarantine/y.md", "no"), ("b/z.TXT", "t"), ("b/w.bin", "?")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    assert sorted(r["suffix"] for r in files.list_documents(spark, str(tmp_path)).collect()) == [".md", ".txt"]
    sheet = spark.createDataFrame([(0, ["Report", None]), (1, ["编号", "类别", " "]), (2, ["7", "A", "z"]), (3, ["8"])], "n int, cells array<string>")
    rows = files.table_below_preface(sheet, "n", "cells", "编号").orderBy("n").collect()
    assert [r["row"] for r in rows] == [{"编号": "7", "类别": "A"}, {"编号": "8", "类别": None}]
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ('{"a": ',), ('{"b": 2}',)], "value string")
    assert sorted(str(r["a"]) for r in files.read_jsonl(lines, "value", "a int").collect()) == ["1", "None"]


def test_hooks(spark):
    from tidewell.functions import hooks

    df = spark.createDataFrame([("路灯 不亮", ["甲文", "乙文"]), ("", []), (None, None)], "q string, c array<string>")
    rows = df.select(hooks.get("embed")(F.col("q")).alias("v"), hooks.get("answer")(F.col("q"), F.col("c")).alias("a")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-9 and rows[1]["v"] is None and rows[2]["v"] is None
    assert [r["a"] for r in rows] == ["1. 甲文\n2. 乙文", "", None]
    cells = {r["c"]["i"]: r["s"] for r in df.limit(1).select(F.explode(retrieval.hash_vector(F.col("q"))).alias("c")).groupBy("c.i").agg(F.sum("c.s").alias("s"), F.first("c").alias("c")).collect()}
    n = sum(v * v for v in cells.values()) ** 0.5
    assert all(abs(rows[0]["v"][i] - v / n) < 1e-9 for i, v in cells.items())
    hooks.use("rerank", lambda score, query, content: score * 2)
    assert df.limit(1).select(hooks.get("rerank")(F.lit(1.5), F.col("q"), F.col("q")).alias("s")).first()["s"] == 3.0
    hooks._providers.clear()


def test_near_pairs_and_clusters_of_all_rows(spark, tmp_path):
    rng = random.Random(6)
    vecs = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(150)]
    vecs = [v if i % 3 else [x + rng.gauss(0, 0.2) for x in vecs[i // 3]] for i, v in enumerate(vecs)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    df = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(vecs)] + [(900, None, 0), (901, [1.0], 0)], "vec_id int, embedding array<double>, label int")
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if cos(vecs[a], vecs[b]) >= 0.5}
    for block in (16, 4096):
        pairs = retrieval.near_pairs(df, "vec_id", "embedding", 0.5, block=block).select("a", "b").collect()
        assert sorted(map(tuple, pairs)) == sorted(want)
    forest = retrieval.near_pairs(df, "vec_id", "embedding", 0.5, forest=True, block=16)
    one, two = (graphs.components(g, "a", "b", lambda d: materialise(d, "t")).collect() for g in (forest, spark.createDataFrame(list(want), "a int, b int")))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert retrieval.near_pairs(df.limit(0), "vec_id", "embedding", 0.5).count() == 0

    import __spark_entry__ as entry

    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    near = [(a, b) for a in range(150) for b in range(a + 1, 150) if cos(vecs[a], vecs[b]) >= 0.1]
    got = {r["vec_id"]: r["cluster"] for r in entry.queries()["q1_clusters"](spark, str(tmp_path)).collect()}
    want = graphs.components(spark.createDataFrame(near, "a int, b int"), "a", "b", lambda d: materialise(d, "t")).collect()
    assert got == {r["vertex"]: r["component"] for r in want} and len(got) > 100
    got = entry.queries()["j23_near_pairs"](spark, str(tmp_path)).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(150) for b in range(a + 1, 150) if cos(vecs[a], vecs[b]) >= 0.05]


CALLS = "call_id string, seg_idx int, start_sec double, end_sec double"


def test_frames_to_the_end_of_the_call(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [("a", 0, 0.0, 2.0), ("a", 1, 70.2, 72.0), ("a", 1, 70.2, 72.0), ("b", 0, 3.0, 4.0), ("c", 0, 0.0, None), ("d", 0, None, 9.0)]
    spark.createDataFrame(rows, CALLS).write.parquet(f"{tmp_path}/transcript_segments.parquet")
    got = entry.queries()["j16_point_in_interval"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", 0.5, 0), ("a", 1.5, 0), ("a", 70.5, 1), ("a", 71.5, 1), ("b", 3.5, 0)]


def test_segments_and_cases_against_all_others(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(8)
    rows = [(k, i, float(rng.randrange(12)), 0.0) for k in "ab" for i in range(20)]
    rows = [(k, i, s, s + rng.randrange(1, 5)) for k, i, s, _ in rows] + [("c", 0, 1.0, 2.0), ("d", 0, 0.0, 4.0), ("d", 2, 1.0, 3.0)]
    spark.createDataFrame(rows, CALLS).write.parquet(f"{tmp_path}/transcript_segments.parquet")
    got = {(r["call_id"], r["seg_idx"], r["c"], r["rank"]) for r in entry.queries()["j15_nearest"](spark, str(tmp_path)).collect()}
    want = set()
    for k, i, t, _ in rows:
        other = sorted({s for kk, j, s, _ in rows if kk == k and j != i}, key=lambda c: (abs(c - t), c))
        want |= {(k, i, c, n) for n, c in enumerate(other[:5], 1)}
    assert got == want
    got = {tuple(r[c] for c in ("call_id", "seg_idx", "shared", "n")) for r in entry.queries()["j17_overlap"](spark, str(tmp_path)).collect()}
    want = set()
    for k, i, s, e in rows:
        both = [min(e, v) - max(s, u) for kk, j, u, v in rows if kk == k and j != i and min(e, v) > max(s, u)]
        want |= {(k, i, sum(both), len(both))} if both else set()
    assert got == want and ("d", 2, 2.0, 1) in got

    cases = [("W10", "abcd"), ("W20", "abcd"), ("W21", "abxx"), ("W30", "zzzz"), ("W11", "cdyy")]
    df = spark.createDataFrame([(c, (t,)) for c, t in cases], "case_id string, elements struct<event:string>")
    df.write.parquet(f"{tmp_path}/workorders.parquet")
    got = {(r["case_id"], r["match"], r["shared"]) for r in entry.queries()["r7_history"](spark, str(tmp_path)).collect()}
    assert got == {("W10", "W20", 3), ("W10", "W21", 1), ("W10", "W11", 1), ("W20", "W10", 3), ("W20", "W21", 1), ("W20", "W11", 1)}


def test_all_rows_scored_and_multiplied(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(9)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vecs)], "vec_id int, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True))

    got = {r["vec_id"]: r["best"] for r in entry.queries()["v9_semantic"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60))
    for i, v in enumerate(vecs):
        gold = [vecs[j] for j in range(i % 3, 15, 3) if j != i]
        assert abs(got[i] - max(dot(v, g) / (dot(v, v) * dot(g, g)) ** 0.5 for g in gold)) < 1e-5
    got = {(r["a"], r["b"]): r["dot"] for r in entry.queries()["m3_dot"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, i + 1) for i in range(59)}
    assert all(abs(x - dot(vecs[a], vecs[b])) < 1e-4 for (a, b), x in got.items())
