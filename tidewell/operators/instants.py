"""Mixed timestamp formats and time zones, normalised to one UTC instant in microseconds.

A value may have several readings: the format of a run of ten digits (seconds since 1970, or year,
month, day and hour), the order of an all-number date (year, day or month first), the zone an
abbreviation stands for.  Each source gets a mixture over the readings of each kind, fitted by
expectation-maximisation: a value contributes likelihood to every reading under which it is possible,
the source's declared order enters as a Dirichlet prior, and the posterior chooses the reading, against
the declaration where the source's values do.  A year after ``LAST_YEAR`` makes a reading unlikely.
What stays undecided is marked, not guessed.

Defined results (column ``status``):

* ``missing``    the value is null, empty or blank
* ``invalid``    it has no reading, e.g. ``N/A``, 30 February, 25:61, or names an unknown zone
* ``ambiguous``  several readings, none with a posterior of ``min_posterior``
* ``skipped`` / ``repeated``  a clock reading that the zone left out or had twice
* ``ok``         ``utc_us`` holds the instant; in every other case it is null

A date alone is the start of that day in the source's zone.  Unknown or null sources have no zone
and no declared order: values with an offset or zone of their own still resolve.  Repeated rows each
get their result.  Extra columns pass through, those named like the results are replaced; the input
may not have columns that begin with ``_tw_``.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\u0001"
# Offsets in minutes of zone abbreviations; a second entry is another region's use.
ABBREVIATIONS = {
    "Z": (0,), "UTC": (0,), "GMT": (0,), "UT": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360), "CET": (60,),
    "CEST": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,), "IST": (330, 60, 120), "JST": (540,), "KST": (540,),
    "HKT": (480,), "SGT": (480,), "CST": (480, -360), "CDT": (-300,), "EST": (-300, 600), "EDT": (-240,),
    "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "AEST": (600,), "AEDT": (660,), "ACST": (570,),
    "ACDT": (630,), "AWST": (480,), "NZST": (720,), "NZDT": (780,),
}
NAMED_ZONES = {"北京时间": "Asia/Shanghai"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ORDERS = ("ymd", "dmy", "mdy")
FORMATS = ("seconds", "hour")
#: years that digits and two-digit years may plausibly mean, and the likelihood of others
FIRST_YEAR, LAST_YEAR, FAR = 1990, 2035, 0.01
_AREAS = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific")

_ZONE = r"((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}|北京时间)?\s*(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_HALF = r"(凌晨|清晨|早上|早晨|上午|中午|下午|傍晚|晚上|夜里|午夜)?"
_CLOCK = r"(?:(\d{1,2})(?:[:点時时](?:(\d{1,2})(?:[:分](?:(\d{1,2})(?:[.,](\d{1,9}))?秒?)?)?)?))?"
_CLOCK_EN = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
_AMPM = r"\s*([AaPp][Mm])?\s*\(?"
#: family -> pattern, and the groups that are y, m, d, half, h, mi, s, fraction, am/pm, zone, region (0: none)
_FAMILIES = {
    "iso": (rf"^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?[Tt ]*{_HALF}\s*{_CLOCK}{_AMPM}{_ZONE}\)?$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    "hour": (r"^(\d{4})(\d{2})(\d{2})(\d{2})$", (1, 2, 3, 0, 4, 0, 0, 0, 0, 0, 0)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?\s*{_ZONE}$", (1, 2, 3, 0, 4, 5, 6, 7, 0, 8, 9)),
    "day_month": (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}}) ([A-Za-z]{{3}})[a-z]*\.?,? (\d{{4}}),? ?{_CLOCK_EN}{_AMPM}{_ZONE}\)?$", (3, 2, 1, 0, 4, 5, 6, 7, 8, 9, 10)),
    "month_day": (rf"^(?:[A-Za-z]{{3,9}},? )?([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}),? (\d{{4}}),? ?{_CLOCK_EN}{_AMPM}{_ZONE}\)?$", (3, 1, 2, 0, 4, 5, 6, 7, 8, 9, 10)),
    "numeric": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?[Tt ]\s*{_CLOCK_EN})?{_AMPM}{_ZONE}\)?$", (4, 3, 1, 0, 5, 6, 7, 8, 9, 10, 11)),
}


def _clean(v: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
    v = F.trim(F.regexp_replace(F.translate(v, wide, half), r"\s+", " "))
    numerals = v.rlike("[〇零一二三四五六七八九十]+[年月日点时]")
    n = F.regexp_replace(v, "([二三四五])十([一二三四五六七八九])", "$1$2")
    n = F.regexp_replace(n, "([二三四五])十", "$10")
    n = F.regexp_replace(n, "十([一二三四五六七八九])", "1$1")
    n = F.translate(F.regexp_replace(n, "十", "10"), "〇零一二三四五六七八九", "00123456789")
    return F.when(numerals, n).otherwise(v)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _groups(v: Column) -> Column:
    """y, m, d, half, h, mi, s, fraction, am/pm, zone, region, family of the first family that fits, else null."""
    picks = []
    for name, (pattern, at) in _FAMILIES.items():
        out = _SEP.join(f"${g}" if g else "" for g in at) + _SEP + name
        hit = F.regexp_replace(v, pattern, out)
        picks.append(F.when(v.rlike(pattern), F.split(hit, _SEP)))
    return F.coalesce(*picks)


def _zone_ids() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if z.split("/")[0] in _AREAS and "/" in z) + ["UTC", "Etc/UTC"]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once: a generator stands between them and what uses them,
    so the optimizer can't copy their expressions into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _date_possible(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def fit_mixtures(counts: DataFrame, strength: float = 20.0, rounds: int = 50) -> DataFrame:
    """EM over readings, one mixture a (source, variable).

    counts: _tw_source, _tw_var, _tw_sig (likelihood of each reading), _tw_prior (declared reading or -1), n.
    A group has as many rows as there are distinct signatures, a handful, however many values it stands for.
    Returns the posterior of each reading for each signature.
    """

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        like = [list(x) for x in pdf["_tw_sig"]]
        n, k = list(pdf["n"]), len(like[0])
        alpha = [strength if i == pdf["_tw_prior"].iloc[0] else 0.5 for i in range(k)]
        w = [a / sum(alpha) for a in alpha]
        post = like
        for _ in range(rounds):
            post = []
            for row in like:
                joint = [a * b for a, b in zip(w, row, strict=True)]
                total = sum(joint)
                post.append([j / total for j in joint] if total > 0 else [0.0] * k)
            mass = [alpha[i] + sum(c * p[i] for c, p in zip(n, post, strict=True)) for i in range(k)]
            new = [m / sum(mass) for m in mass]
            if max(abs(a - b) for a, b in zip(new, w, strict=True)) < 1e-12:
                break
            w = new
        return pd.DataFrame({"_tw_source": pdf["_tw_source"], "_tw_var": pdf["_tw_var"], "_tw_sig": pdf["_tw_sig"], "_tw_post": post})

    schema = "_tw_source string, _tw_var string, _tw_sig array<double>, _tw_post array<double>"
    return counts.groupBy("_tw_source", "_tw_var").applyInPandas(em, schema)


def normalise_instants(
    df: DataFrame,
    value: str,
    source: str,
    senders: DataFrame,
    min_posterior: float = 0.95,
    strength: float = 20.0,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Adds ``utc_us`` BIGINT, ``status`` STRING and ``posterior`` DOUBLE to df.

    senders: code, zone_name (IANA zone of values without one), date_order (ymd, dmy or mdy; order of
    all-number dates that do not begin with the year); the first row of a code counts.
    keep: stores the posteriors (a few rows a source) once, as two steps use them.
    """
    who = senders.groupBy(F.col("code").alias("_tw_code")).agg(F.min_by("zone_name", F.struct("zone_name", "date_order")).alias("_tw_zone"), F.min_by("date_order", F.struct("zone_name", "date_order")).alias("_tw_order"))
    results = ("utc_us", "status", "posterior")
    kept = [c for c in df.columns if c not in results]
    base = computed(df, _tw_v=_clean(F.col(value).cast("string")), _tw_source=F.col(source).cast("string")).drop(*results)
    base = base.join(who, base["_tw_source"] == who["_tw_code"], "left").drop("_tw_code")
    g = F.col("_tw_g")
    base = computed(base, _tw_g=_groups(F.col("_tw_v")))
    month = F.when(g[1].rlike("^[0-9]+$"), _int(g[1])).otherwise(
        reduce(lambda acc, im: acc.when(F.lower(g[1]) == im[1], im[0] + 1), enumerate(MONTHS), F.when(F.lit(False), 0))
    )
    year = _int(g[0])
    zone_text = F.upper(F.regexp_replace(g[9], r"^(?i:UTC|GMT)(?=[+-])", ""))
    fields = computed(
        base,
        _tw_y=F.when(F.length(g[0]) == 2, F.when(year >= 70, year + 1900).otherwise(year + 2000)).otherwise(year),
        _tw_m=month,
        _tw_d=_int(g[2]),
        _tw_half=g[3],
        _tw_h0=_int(g[4]),
        _tw_mi=F.coalesce(_int(g[5]), F.lit(0)),
        _tw_s=F.coalesce(_int(g[6]), F.lit(0)),
        _tw_us=F.when(g[7] != "", F.rpad(F.substring(g[7], 1, 6), 6, "0").cast("int")).otherwise(0),
        _tw_ap=F.lower(g[8]),
        _tw_zt=zone_text,
        _tw_zt_d=F.regexp_replace(zone_text, "[^0-9]", ""),
        _tw_region=g[10],
        _tw_numeric=F.coalesce(g[11] == "numeric", F.lit(False)),
        _tw_last=F.when(F.length(g[0]) == 2, year),  # the last number of a date with two-digit parts only
        _tw_long=F.when(F.col("_tw_v").rlike(r"^\d{10}$"), F.col("_tw_v").cast("bigint")),
    )
    # hour on the 24-hour clock; null where the parts of the day and the hour disagree
    h, half, ap = F.col("_tw_h0"), F.col("_tw_half"), F.col("_tw_ap")
    hour = (
        F.when(h.isNull(), F.lit(0))
        .when(ap == "am", F.when(h.between(1, 12), h % 12))
        .when(ap == "pm", F.when(h.between(1, 12), h % 12 + 12))
        .when(half.isin("凌晨", "清晨", "早上", "早晨", "上午"), F.when(h == 12, F.when(half == "上午", 12).otherwise(0)).when(h < 12, h))
        .when(half == "中午", F.when(h < 4, h + 12).otherwise(h))
        .when(half.isin("下午", "傍晚"), F.when(h < 12, h + 12).otherwise(h))
        .when(half.isin("晚上", "夜里", "午夜"), F.when(h == 12, 24).when(h.between(5, 11), h + 12).otherwise(h))
        .otherwise(h)
    )
    fields = computed(fields, _tw_h=hour)
    a, b, y = F.col("_tw_d"), F.col("_tw_m"), F.col("_tw_y")  # of a numeric value: first and second number
    numeric = F.col("_tw_numeric")
    dmy = numeric & _date_possible(y, b, a)
    mdy = numeric & _date_possible(y, a, b)
    first = F.when(a >= 70, a + 1900).otherwise(a + 2000)  # the year, if it stands first
    ymd = numeric & _date_possible(first, b, F.col("_tw_last"))
    clock = F.col("_tw_h").isNotNull() & (F.col("_tw_mi") < 60) & (F.col("_tw_s") < 60) & ((F.col("_tw_h") < 24) | ((F.col("_tw_h") == 24) & (F.col("_tw_mi") == 0) & (F.col("_tw_s") == 0)))
    wall0 = F.expr("try_make_timestamp(_tw_y, _tw_m, _tw_d, least(_tw_h, 23), _tw_mi, cast(_tw_s as decimal(8,6)), 'UTC')")
    fields = computed(fields, _tw_clock=F.coalesce(clock, F.lit(False)), _tw_wall0=wall0, _tw_dmy=dmy, _tw_mdy=mdy, _tw_ymd=ymd)
    dmy, mdy, wall0 = F.col("_tw_dmy"), F.col("_tw_mdy"), F.col("_tw_wall0")
    # signature 1: which orders are possible; signature 2: which offset of an abbreviation the sender's zone has then
    likely = lambda ok, year: F.when(ok, F.when(year.between(FIRST_YEAR, LAST_YEAR), 1.0).otherwise(FAR)).otherwise(0.0)
    ymd = F.col("_tw_ymd")
    order_sig = F.array(likely(ymd, first), likely(dmy, y), likely(mdy, y))
    # ten digits: seconds, or a date with an hour
    seconds = F.col("_tw_long")
    clock_date = _date_possible(y, b, a) & F.coalesce(F.col("_tw_h0") < 24, F.lit(False))
    format_sig = F.array(likely(seconds.isNotNull(), F.year(F.timestamp_seconds(seconds))), likely(clock_date, y))
    prior = F.coalesce(F.array_position(F.array(*map(F.lit, ORDERS)), F.col("_tw_order")).cast("int") - 1, F.lit(-1))
    many = {k: v for k, v in ABBREVIATIONS.items() if len(v) > 1}
    zone_ok = F.col("_tw_zone").isin(_zone_ids())
    fields = computed(fields, _tw_own=F.when(zone_ok, (F.unix_micros(F.from_utc_timestamp(wall0, F.when(zone_ok, F.col("_tw_zone")).otherwise("UTC"))) - F.unix_micros(wall0)) / 60_000_000))
    own = F.col("_tw_own")
    abbr_sig = reduce(
        lambda acc, kv: acc.when(F.col("_tw_zt") == kv[0], F.array(*[F.when(F.abs(own - o) <= 60, F.lit(0.999)).when(own.isNull(), F.lit(0.5)).otherwise(F.lit(0.001)) for o in kv[1]])),
        many.items(),
        F.when(F.lit(False), F.array(F.lit(0.0))),
    )
    reading = F.when(numeric, "order").when(seconds.isNotNull(), "format")
    fields = computed(fields, _tw_ov=reading, _tw_os=F.when(numeric & (dmy | mdy | ymd), order_sig).when(seconds.isNotNull(), format_sig), _tw_prior=F.when(numeric, prior).otherwise(-1), _tw_zs=abbr_sig)

    var = lambda name, sig, pr: F.struct(name.alias("_tw_var"), F.col(sig).alias("_tw_sig"), pr.alias("_tw_prior"))
    counts = (
        fields.select(F.coalesce(F.col("_tw_source"), F.lit("")).alias("_tw_source"), F.inline(F.array(var(F.col("_tw_ov"), "_tw_os", F.col("_tw_prior")), var(F.col("_tw_zt"), "_tw_zs", F.lit(-1)))))
        .filter(F.col("_tw_sig").isNotNull())
        .groupBy("_tw_source", "_tw_var", "_tw_sig", "_tw_prior")
        .agg(F.count("*").alias("n"))
    )
    post = keep(fit_mixtures(counts, strength))

    def look(var: Column, sig: str, into: str) -> DataFrame:
        p = post.select(F.col("_tw_source").alias("_tw_ps"), F.col("_tw_var").alias("_tw_pv"), F.col("_tw_sig").alias("_tw_pg"), F.col("_tw_post").alias(into))
        return p, (F.coalesce(F.col("_tw_source"), F.lit("")) == p["_tw_ps"]) & (var == p["_tw_pv"]) & (F.col(sig) == p["_tw_pg"])

    p1, on1 = look(F.col("_tw_ov"), "_tw_os", "_tw_po")
    out = fields.join(p1, on1, "left").drop("_tw_ps", "_tw_pv", "_tw_pg")
    p2, on2 = look(F.col("_tw_zt"), "_tw_zs", "_tw_pz")
    out = out.join(p2, on2, "left").drop("_tw_ps", "_tw_pv", "_tw_pg")

    best = F.array_max("_tw_po")
    pick = F.array_position("_tw_po", best)
    swap, lead = numeric & (pick == 3), numeric & (pick == 1)  # the first number is the month, or the year
    out = computed(out, _tw_yr=F.when(lead, first).otherwise(y), _tw_mo=F.when(swap, a).otherwise(b), _tw_da=F.when(swap, b).when(lead, F.col("_tw_last")).otherwise(a))
    date_ok = _date_possible(F.col("_tw_yr"), F.col("_tw_mo"), F.col("_tw_da"))
    zt = F.col("_tw_zt")
    single = reduce(lambda acc, kv: acc.when(zt == kv[0], F.lit(kv[1][0])), [kv for kv in ABBREVIATIONS.items() if len(kv[1]) == 1], F.when(F.lit(False), 0))
    zbest = F.array_max("_tw_pz")
    multi = reduce(lambda acc, kv: acc.when(zt == kv[0], F.array(*map(F.lit, kv[1]))[F.array_position("_tw_pz", zbest).cast("int") - 1]), many.items(), F.when(F.lit(False), 0))
    sign = F.when(zt.startswith("-"), -1).otherwise(1)
    digits = F.col("_tw_zt_d")
    hh = F.when(F.length(digits) <= 2, digits).otherwise(F.expr("substr(_tw_zt_d, 1, length(_tw_zt_d) - 2)"))
    mm = F.when(F.length(digits) > 2, F.expr("right(_tw_zt_d, 2)")).otherwise("0")
    numeric_offset = F.when(zt.rlike(r"^[+-]\d") & (hh.try_cast("int") <= 14) & (mm.try_cast("int") < 60), sign * (hh.try_cast("int") * 60 + mm.try_cast("int")))
    offset = F.coalesce(numeric_offset, single, multi)
    named = reduce(lambda acc, kv: acc.when(zt == kv[0], F.lit(kv[1])), NAMED_ZONES.items(), F.when(F.lit(False), ""))
    has_zone, has_region = F.coalesce(zt != "", F.lit(False)), F.coalesce(F.col("_tw_region") != "", F.lit(False))
    region = F.when(has_zone & named.isNotNull(), named).when(has_region, F.col("_tw_region")).when(~has_zone, F.col("_tw_zone"))
    out = computed(out, _tw_off=offset, _tw_rg0=region)
    out = computed(
        out,
        _tw_rg=F.when(F.col("_tw_off").isNull(), F.when(F.col("_tw_rg0").isin(_zone_ids()), F.col("_tw_rg0"))),
        _tw_wall=F.when(date_ok & F.col("_tw_clock"), F.expr("try_make_timestamp(_tw_yr, _tw_mo, _tw_da, _tw_h % 24, _tw_mi, cast(_tw_s as decimal(8,6)), 'UTC') + make_interval(0, 0, 0, 0, 24 * (_tw_h div 24), 0, _tw_us / 1000000d)")),
    )
    rg = F.coalesce(F.col("_tw_rg"), F.lit("UTC"))
    out = computed(out, _tw_utc=F.to_utc_timestamp("_tw_wall", rg))
    utc = F.col("_tw_utc")
    back = F.from_utc_timestamp(utc, rg)
    again = reduce(lambda x, k: x | (F.from_utc_timestamp(utc + F.expr(f"INTERVAL '{k}' MINUTE"), rg) == F.col("_tw_wall")), (-120, -60, -30, 30, 60, 120), F.lit(False))
    date_only = F.col("_tw_h0").isNull()
    epoch = F.when(F.col("_tw_long").isNotNull() & (pick == 1), F.col("_tw_long") * 1_000_000).when(F.col("_tw_v").rlike(r"^\d{13}$"), F.col("_tw_v").cast("bigint") * 1000).when(F.col("_tw_v").rlike(r"^\d{16}$"), F.col("_tw_v").cast("bigint"))
    wall, off = F.col("_tw_wall"), F.col("_tw_off")
    doubt = F.least(F.coalesce(best, F.lit(1.0)), F.coalesce(zbest, F.lit(1.0)))
    status = (
        F.when(F.col("_tw_v").isNull() | (F.col("_tw_v") == ""), "missing")
        .when(epoch.isNotNull(), F.when(doubt < min_posterior, "ambiguous").otherwise("ok"))
        .when(wall.isNull(), "invalid")
        .when(off.isNull() & F.col("_tw_rg").isNull(), "invalid")
        .when(doubt < min_posterior, "ambiguous")
        .when(off.isNotNull() | date_only, "ok")
        .when(back != wall, "skipped")
        .when(again, "repeated")
        .otherwise("ok")
    )
    instant = F.coalesce(epoch, F.when(off.isNotNull(), F.unix_micros(wall) - off.cast("bigint") * 60_000_000).otherwise(F.unix_micros(utc)))
    out = computed(out, status=status, posterior=doubt, _tw_instant=instant).withColumn("utc_us", F.when(F.col("status") == "ok", F.col("_tw_instant")))
    return out.select(*kept, *results)
