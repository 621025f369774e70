"""Instants against a second reading of the same values by the standard library."""

import datetime
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tidewell.operators.instants import normalise_instants

SENDERS = [("sh", "Asia/Shanghai", "ymd"), ("be", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("un", None, None)]


def us(y, m, d, h=0, mi=0, s=0, micro=0, zone="UTC"):
    t = datetime.datetime(y, m, d, h, mi, s, micro, tzinfo=zoneinfo.ZoneInfo(zone))
    return int((t - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))


CASES = [
    ("2025-05-31T13:28:14+08:00", "ny", us(2025, 5, 31, 5, 28, 14), "ok"),
    ("2025-05-31 13:28:14 CST", "sh", us(2025, 5, 31, 5, 28, 14), "ok"),
    ("2025-05-31 13:28:14 CST", "ny", us(2025, 5, 31, 19, 28, 14), "ambiguous"),
    ("2025-01-31 13:28:14 CEST", "be", us(2025, 1, 31, 11, 28, 14), "ok"),
    ("2025-01-31T13:28:14.123456789Z", "un", us(2025, 1, 31, 13, 28, 14, 123456), "ok"),
    ("20250131T132814-0530", "un", us(2025, 1, 31, 18, 58, 14), "ok"),
    ("20250131132814", "sh", us(2025, 1, 31, 5, 28, 14), "ok"),
    ("20250131", "sh", us(2025, 1, 30, 16), "ok"),
    ("1748471859332", "ny", 1748471859332000, "ok"),
    ("1748471859", "ny", 1748471859000000, "ok"),
    ("03/04/2025 10:00", "be", us(2025, 4, 3, 8), "ok"),
    ("03/04/2025 10:00:05 PM", "ny", us(2025, 3, 5, 3, 0, 5), "ok"),
    ("5/10/25 03:26", "be", us(2025, 10, 5, 1, 26), "ok"),
    ("12 March 2025", "be", us(2025, 3, 11, 23), "ok"),
    ("Mar 9, 2025 1:40 am", "ny", us(2025, 3, 9, 6, 40), "ok"),
    ("Mar 9, 2025 2:40 am", "ny", None, "skipped"),
    ("2025-11-02 01:30:00", "ny", None, "repeated"),
    ("2025-11-02T01:30:00-05:00", "ny", us(2025, 11, 2, 6, 30), "ok"),
    ("2025-11-02T01:30:00[America/New_York]", "sh", None, "repeated"),
    ("Sun, 08 Mar 2026 04:41:14 -0400", "sh", us(2026, 3, 8, 8, 41, 14), "ok"),
    ("2025年4月25日中午12时37分", "sh", us(2025, 4, 25, 4, 37), "ok"),
    ("2025年4月25日晚上11点07分", "sh", us(2025, 4, 25, 15, 7), "ok"),
    ("2025年4月25日 10:00:00（北京时间）", "ny", us(2025, 4, 25, 2), "ok"),
    ("二〇二六年三月二十九日", "sh", us(2026, 3, 28, 16), "ok"),
    ("２０２５－０２－１６　００：２３：５１", "sh", us(2025, 2, 15, 16, 23, 51), "ok"),
    ("2025-02-30 10:00:00", "sh", None, "invalid"),
    ("25:61", "sh", None, "invalid"),
    ("0000-00-00 00:00:00", "sh", None, "invalid"),
    ("2025-01-01 10:00:00", "un", None, "invalid"),
    ("2025-01-01 10:00:00", None, None, "invalid"),
    ("2025-01-01T10:00:00[Mars/Base]", "sh", None, "invalid"),
    ("N/A", "sh", None, "invalid"),
    ("", "sh", None, "missing"),
    (None, "sh", None, "missing"),
    ("x" * 20000, "sh", None, "invalid"),
]


@pytest.fixture(scope="module")
def senders(spark):
    return spark.createDataFrame(SENDERS, "code string, zone_name string, date_order string")


def test_values(spark, senders):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, v string, src string")
    got = {r["i"]: (r["utc_us"], r["status"]) for r in normalise_instants(df, "v", "src", senders).collect()}
    for i, (v, s, want, status) in enumerate(CASES):
        if status == "ambiguous":
            assert got[i][1] in ("ambiguous", "ok"), v
        else:
            assert got[i] == (want, status), (v, s)


def test_session_zone_does_not_matter(spark, senders):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2025-03-09 24:00:00", "ny"), ("2025-03-30T02:30:00.5", "sh"), ("2025-03-30 02:30", "be")], "v string, src string")
        got = [(r["utc_us"], r["status"]) for r in normalise_instants(df, "v", "src", senders).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(got, key=str) == sorted([(us(2025, 3, 10, 4), "ok"), (us(2025, 3, 29, 18, 30, 0, 500000), "ok"), (None, "skipped")], key=str)


def test_undeclared_order_learned_from_the_source(spark, senders):
    """A source without declared order: its clear values decide the unclear ones; without any, they stay marked."""
    more = senders.unionByName(spark.createDataFrame([("q", "UTC", None), ("r", "UTC", None)], senders.schema))
    clear = [("%02d/%02d/2025" % (d, m), "q") for d in range(13, 29) for m in range(1, 7)]
    df = spark.createDataFrame([*clear, ("03/04/2025", "q"), ("03/04/2025", "r")], "v string, src string")
    got = {(r["v"], r["src"]): r for r in normalise_instants(df, "v", "src", more).collect()}
    assert got["03/04/2025", "q"]["utc_us"] == us(2025, 4, 3)
    assert got["03/04/2025", "r"]["status"] == "ambiguous" and got["03/04/2025", "r"]["utc_us"] is None


def test_posteriors_against_a_wrong_declaration(spark, senders):
    """A sender whose values contradict the declared order: the mixture overrules the declaration."""
    more = senders.unionByName(spark.createDataFrame([("w", "UTC", "mdy")], senders.schema))
    clear = [("%02d/%02d/2025" % (d, m), "w") for d in range(13, 29) for m in range(1, 13)] * 3
    df = spark.createDataFrame([*clear, ("03/04/2025", "w"), ("03/04/2025", "ny")], "v string, src string")
    got = {(r["v"], r["src"]): r for r in normalise_instants(df, "v", "src", more).collect()}
    assert got["03/04/2025", "w"]["utc_us"] == us(2025, 4, 3)
    assert got["03/04/2025", "ny"]["utc_us"] == us(2025, 3, 4, 5)


def test_year_first_with_two_digits(spark, senders):
    more = senders.unionByName(spark.createDataFrame([("y", "UTC", None), ("z", "UTC", None)], senders.schema))
    learned = [("%02d-%02d-%02d" % (y, m, d), "y") for y in (97, 98, 99) for m in range(1, 13) for d in (5, 17)]  # 97 is no day
    df = spark.createDataFrame([("24/03/05", "sh"), ("24/03/05", "be"), ("24/03/05", "z"), *learned, ("24-03-05", "y"), ("31/12/99", "ny")], "v string, src string")
    got = {(r["v"], r["src"]): r for r in normalise_instants(df, "v", "src", more).collect()}
    assert got["24/03/05", "sh"]["utc_us"] == us(2024, 3, 4, 16)
    assert got["24/03/05", "be"]["utc_us"] == us(2005, 3, 23, 23)
    assert got["24/03/05", "z"]["status"] == "ambiguous"
    assert got["24-03-05", "y"]["utc_us"] == us(2024, 3, 5)
    assert got["31/12/99", "ny"]["utc_us"] == us(1999, 12, 31, 5)  # the year can't stand first there


def test_ten_digits(spark, senders):
    """Seconds or a date with an hour: the source's other values decide, by themselves they stay marked."""
    more = senders.unionByName(spark.createDataFrame([("e", "UTC", None), ("h", "UTC", None), ("x", "UTC", None)], senders.schema))
    rows = [(str(1748471859 + 999 * i), "e") for i in range(40)] + [(f"20250{m}{d:02d}{h:02d}", "h") for m in range(1, 8) for d in (5, 17) for h in (3, 21)]
    twice = "2013051207"  # 12 May 2013, 7 o'clock; or October 2033
    df = spark.createDataFrame([*rows, (twice, "e"), (twice, "x"), ("1748471859", "x"), ("2099123199", "h")], "v string, src string")
    got = {(r["v"], r["src"]): r for r in normalise_instants(df, "v", "src", more).collect()}
    assert got[twice, "e"]["utc_us"] == int(twice) * 1_000_000
    assert got[twice, "x"]["status"] == "ambiguous" and got["1748471859", "x"]["utc_us"] == 1748471859000000
    assert got["2099123199", "h"]["utc_us"] == 2099123199000000  # no hour of 99


def test_clashing_columns_repeats_and_empty(spark, senders):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", "sh", "kept", "old")] * 2, "status string, src string, extra string, utc_us string")
    rows = normalise_instants(df, "status", "src", senders).collect()
    assert len(rows) == 2 and all(r["utc_us"] == us(2025, 1, 1) and r["extra"] == "kept" and r["status"] == "ok" for r in rows)
    assert normalise_instants(df.limit(0), "status", "src", senders).count() == 0
    assert normalise_instants(df, "status", "src", senders.limit(0)).filter(F.col("status") == "ok").count() == 2
