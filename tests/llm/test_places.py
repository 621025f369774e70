"""Places: reading, the deletion index, the assignment of names, and pairs."""

import random
from functools import cache

from pyspark.sql import functions as F

from tidewell.llm import addresses as A
from tidewell.llm.address_parse import number_of, parse_location
from tidewell.llm.queries import _places
from tidewell.session import materialise

D = {"砚湾": "砚湾区", "岚泊": "岚泊县", "栖桐": "栖桐区"}


def test_parsing():
    p = parse_location("东岭省澜川市栖桐花市街道舒辰北路三百零一号宁星祥佳园二期五栋2单元1702室", D)
    assert (p.kind, p.district, p.town, p.road, p.number, p.estate, p.phase, p.building, p.unit, p.room) == ("building", "栖桐区", "花市", "舒辰|北路", 301, "宁星祥|佳园", 2, 5, 2, 1702)
    p = parse_location("16栋，鹿槿乐城，望溪西路173号，旧坊街办，砚湾", D)
    assert (p.building, p.estate, p.road, p.number, p.district) == (16, "鹿槿乐|城", "望溪|西路", 173, "砚湾区")
    p = parse_location("Rm 802, Unit 1, Bldg 11, Lanlingxing Town, 79 Bairui Lane, Qitong District", D)
    assert (p.building, p.estate, p.road, p.number, p.district) == (11, "lanlingxing", "bairui|巷", 79, "qitong")
    assert parse_location("岚泊县锦岚北路/鹤翠巷", D).kind == "crossing" and parse_location("辉和西路和锦北路口", D).road2 == "和锦|北路"
    assert parse_location("禾渡 岚泊巷252#", D).number == 252
    for vague in ("小区门口", "无", "", None, "我家楼下", "x" * 10000):
        assert parse_location(vague, D).kind is None
    assert [number_of(x) for x in ("十二", "二百三十九", "一百零五", "20", "四〇一", "", "两百")] == [12, 239, 105, 20, 401, None, 200]


def test_places(spark):
    same = [
        ("a1", "栖桐区花市街道舒辰北路301号宁星祥佳园5栋"), ("a2", "宁星祥佳园5#楼1单元101室"), ("a3", "舒辰北路三百零一号五幢"), ("a4", "Bldg 5, Ningxingxiang Estate, 301 Shuchen North Road, Qitong District"),
        ("a5", "5座，宁兴祥佳园，书辰北路301#，花市街办，栖桐"), ("b1", "宁星祥佳园6栋"), ("b2", "砚湾区宁星祥佳园6栋"), ("c1", "砚湾区乐汀街336号"), ("c2", "336号乐汀街"), ("c3", "砚湾乐汀街337号"),
        ("d1", "锦岚北路/鹤翠巷"), ("d2", "岚泊县鹤翠巷、锦岚北路交口"), ("e1", "小区门口"), ("e2", "小区门口"), ("f1", None), ("f2", ""), ("a1", "栖桐区花市街道舒辰北路301号宁星祥佳园5栋"),
        ("g1", "栖桐区舒辰北路301号宁星祥佳园6栋"), ("h1", "宁星祥花园5栋"), ("i1", "魚辰路9号"), ("i2", "榆辰路9号"), ("i3", "榆辰路9号"), ("k1", "榆安路77号"), ("k2", "榆安巷78号"), ("k3", "榆乐路79号"), ("j1", "栖桐区舒辰北路8号"), ("j2", "栖桐区舒辰北路10号"),
    ]
    df = spark.createDataFrame([(*x, "y") for x in same], "rec_key string, location string, place string")
    got = {(r["key_a"], r["key_b"]) for r in A.match_addresses(df, D, lambda x: materialise(x, "t")).collect()}
    group = ["a1", "a2", "a3", "a4", "a5"]
    want = {(x, y) for x in group for y in group if x < y} | {("b1", "b2"), ("b1", "g1"), ("c1", "c2"), ("d1", "d2"), ("i2", "i3"), ("i1", "i2"), ("i1", "i3")}
    assert got - {("b1", "b2")} == want - {("b1", "b2")}
    assert A.match_addresses(df.limit(0), D, lambda x: x).count() == 0


def test_segments():
    inventory = frozenset(("xi", "an", "xian", "wang", "wan", "gan", "lan"))
    assert A.segment("xianlan", inventory, 2) == ["xian lan"] and sorted(A.segment("xianlan", inventory, 3)) == ["xi an lan"]
    assert sorted(A.segment("wangan", inventory, 2)) == ["wan gan", "wang an"]
    assert A.segment("qqq", inventory, 2) == ["qqq"] and A.segment("lan", frozenset(), 1) == ["lan"]


def test_readings_are_general(spark):
    reading = A.readings(spark)
    assert len(reading) > 20000
    assert [reading[c] for c in "解放路建设长江人民"] == ["jie", "fang", "lu", "jian", "she", "zhang", "jiang", "ren", "min"] or reading["长"] == "chang"


def _slow_cost(a, b, slip, firm):
    """The same cost by trying every assignment in order."""

    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return A.TOKEN_COST * (len(a) - i + len(b) - j)
        (s, c), (t, d) = a[i], b[j]
        sure = c is not None and d is not None and c not in slip and d not in slip
        if c is not None and c == d:
            w = 0.0
        elif s == t:
            w = A._NEVER if sure else A.SLIP_COST
        elif c is None or d is None or sure:
            w = A.TOKEN_COST if firm else A._NEVER
        else:
            w = A.TOKEN_COST
        return min(w + best(i + 1, j + 1), A.TOKEN_COST + best(i + 1, j), A.TOKEN_COST + best(i, j + 1))

    return best(0, 0)


def test_assignment_is_optimal():
    rng = random.Random(2)
    sound = dict(zip("abcdefgh", "AABBCCDE", strict=True))
    for _ in range(2000):
        a, b = ([(sound[c], c if rng.random() < 0.8 else None) for c in rng.choices("abcdefgh", k=rng.randrange(1, 5))] for _ in range(2))
        slip, firm = frozenset(rng.sample("abcdefgh", 2)), rng.random() < 0.5
        assert abs(A.assignment_cost(a, b, slip, firm) - _slow_cost(tuple(a), tuple(b), slip, firm)) < 1e-9


def test_candidates_against_all_pairs(spark):
    """The index finds exactly the names of a block that one left-out token makes equal."""
    rng = random.Random(4)
    rows = [(rng.choice(("R|路|1", "E|2")), rng.choice((None, "甲区", "乙区")), None, f"n{i}", False, [" ".join(rng.choices("abc", k=rng.randrange(1, 4)))], 1) for i in range(90)]
    df = spark.createDataFrame(rows, "block string, loc string, kind string, written string, latin boolean, spelled array<string>, n long")
    got = {(r["a_written"], r["b_written"]) for r in A.candidates(df).collect()}

    def near(block, x, y):
        x, y = x.split(), y.split()
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        short, long = sorted((x, y), key=len)
        return block[0] != "R" and len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    want = {(a[3], b[3]) for a in rows for b in rows if a is not b and a[0] == b[0] and (a[1] is None or b[1] is None or a[1] == b[1]) and near(a[0], a[5][0], b[5][0])}
    assert got == want and want


def test_lost_and_wrong_tokens(spark):
    """Names of plain characters with a token lost or wrong, at a house number that many records give."""
    good = "解放路5号阳光锦绣花园3号楼"
    rows = [*((f"g{i}", good) for i in range(4)), ("lost", "解放路5号阳光绣花园3号楼"), ("wrong", "解放路5号阳山锦绣花园3号楼"), ("other", "解放路5号金色锦绣花园3号楼"), ("far", "解放路6号阳光绣花园3号楼")]
    df = spark.createDataFrame(rows, "rec_key string, location string")
    got = {(r["key_a"], r["key_b"]) for r in A.match_addresses(df, D, lambda x: materialise(x, "t")).collect()}
    group = ["g0", "g1", "g2", "g3", "lost", "wrong"]
    assert got == {(x, y) for x in group for y in group if x < y}


def test_index_gives_rows_on_the_data(spark, small):
    records, districts = _places(spark, small)
    keep = lambda df: materialise(df, "t")
    reading = A.readings(spark)
    parsed = keep(A.parse_records(records.dropDuplicates(["rec_key"]), districts, reading))
    near = keep(A.candidates(A.names(parsed)))
    same = A.confusions(near)
    slip = A.slips(A.name_characters(parsed), lambda c: same.get(reading.get(c, c), reading.get(c, c)))
    found = A.assigned(near, slip, same)
    assert near.count() > 500 and found.filter("not latin").count() > 30 and found.filter("latin").count() > 30
    assert found.filter(F.col("means") == F.col("written")).count() == 0


def test_shuffled_names_without_readings(spark, small, monkeypatch):
    """Every name character replaced by an unrelated one, and no reading table: written records are found all the same."""
    records, districts = _places(spark, small)
    written = records.filter(~F.col("location").rlike("Road|Street|Lane|Avenue"))
    keep = lambda df: materialise(df, "t")
    want = {tuple(r) for r in A.match_addresses(written, districts, keep).collect()}
    marks = set("路街巷大道东西南北号號楼栋幢座单元室期花园广场名邸雅居新村佳小区华庭豪公寓家馆里府城苑街道办镇省市县区口交叉和与零〇一二三四五六七八九十百两" + "".join(districts) + "澜川东岭")
    chars = sorted({c for r in written.select("location").collect() for c in r[0] or "" if "一" <= c <= "鿿"} - marks)
    other = [chr(0x5E00 + 7 * i) for i in range(len(chars))]
    random.Random(1).shuffle(other)
    shuffled = written.withColumn("location", F.translate("location", "".join(chars), "".join(other)))
    monkeypatch.setattr(A, "readings", lambda _: {})
    got = {tuple(r) for r in A.match_addresses(shuffled, districts, keep).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


def test_a_place_with_many_records(spark):
    """One place holds most rows: classes are compared once, and every pair is there."""
    rows = [(f"k{i:03d}", "栖桐区乐汀街336号") for i in range(120)] + [("z1", "乐汀街336号"), ("z2", "砚湾区乐汀街336号")]
    df = spark.createDataFrame(rows, "rec_key string, location string")
    got = A.match_addresses(df, D, lambda x: materialise(x, "t"))
    assert got.count() == 120 * 119 // 2 + 120 + 1
