"""Joins beyond equality: intervals, nearest neighbours in time, containment, integrity checks.

Interval joins are turned into equality joins on time bins, so they shuffle by (key, bin) and never
compare every row with every other; a bin width near the usual interval length keeps the copies few.
Nulls in keys or times match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def point_in_interval(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, key: list[str], width: float) -> DataFrame:
    """Every point with the spans of its key that hold it (start <= point < end)."""
    p = points.withColumn("_tw_bin", F.floor(F.col(at) / width))
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("_tw_bin", _bins(F.col(start), F.col(end), width))
    return p.join(s, [*key, "_tw_bin"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_tw_bin")


def overlapping(a: DataFrame, b: DataFrame, key: list[str], width: float, least: float = 0.0) -> DataFrame:
    """Pairs of intervals (a_start, a_end; b_start, b_end) of one key that share more than ``least``, with the shared length."""
    x = a.filter("a_start <= a_end").withColumn("_tw_bin", _bins(F.col("a_start"), F.col("a_end"), width))
    y = b.filter("b_start <= b_end").withColumn("_tw_bin", _bins(F.col("b_start"), F.col("b_end"), width))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    first = F.floor(F.greatest("a_start", "b_start") / width)  # a pair counts in the bin where it begins
    return x.join(y, [*key, "_tw_bin"]).filter((F.col("_tw_bin") == first) & (shared > least)).withColumn("shared", shared).drop("_tw_bin")


def as_of(left: DataFrame, right: DataFrame, key: list[str], on: str, take: list[str]) -> DataFrame:
    """left with the columns ``take`` of the right row of its key whose ``on`` is the latest not after its own.

    One union, one window: a sort per key instead of a range join.
    """
    a = left.select("*", F.lit(1).alias("_tw_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tw_{c}") for c in take])
    b = right.select(*key, on, F.lit(0).alias("_tw_side"), *[F.col(c).alias(f"_tw_{c}") for c in take])
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(on), F.col("_tw_side")).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_tw_side") == 0, F.struct(*[f"_tw_{c}" for c in take])), ignorenulls=True).over(w)
    return u.withColumn("_tw_held", held).filter("_tw_side = 1").select(*left.columns, *[F.col(f"_tw_held._tw_{c}").alias(f"asof_{c}") for c in take])


def nearest(points: DataFrame, windows: DataFrame, key: list[str], at: str, centre: str, k: int, point_id: str) -> DataFrame:
    """The k windows of its key nearest to each point in time.

    Only neighbours on the time line can be among the k nearest, so each point looks at the k windows before
    and the k after it; arrays of the k last centres are carried along by a window over the merged rows.
    """
    a = points.select(*key, F.col(at).alias("_tw_t"), F.col(point_id).alias("_tw_p"), F.lit(None).cast(windows.schema[centre].dataType).alias("_tw_c"))
    b = windows.select(*key, F.col(centre).alias("_tw_t"), F.lit(None).cast(points.schema[point_id].dataType).alias("_tw_p"), F.col(centre).alias("_tw_c"))
    u = a.unionByName(b)
    order = [F.col("_tw_t"), F.col("_tw_c").isNull(), F.col("_tw_p")]
    w = Window.partitionBy(*key).orderBy(*order)
    n = F.count("_tw_c").over(w.rowsBetween(Window.unboundedPreceding, 0))  # windows up to here
    u = u.withColumn("_tw_n", n)
    ranked = b.withColumn("_tw_n", F.row_number().over(Window.partitionBy(*key).orderBy("_tw_t")))
    asked = u.filter("_tw_p is not null").select(*key, "_tw_p", "_tw_t", F.explode(F.sequence(F.col("_tw_n") - (k - 1), F.col("_tw_n") + k)).alias("_tw_n"))
    near = asked.join(ranked.select(*key, F.col("_tw_n"), F.col("_tw_c").alias(centre)), [*key, "_tw_n"])
    r = F.row_number().over(Window.partitionBy(*key, "_tw_p").orderBy(F.abs(F.col(centre) - F.col("_tw_t")), centre))
    return near.withColumn("rank", r).filter(F.col("rank") <= k).select(*key, F.col("_tw_p").alias(point_id), centre, "rank")


PHRASE_KEYS = 20_000  # up to so many different beginnings of phrases the texts are cut to them before anything moves


def contains_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, gram: int = 4) -> DataFrame:
    """texts x phrases where the text contains the phrase, through an index on the phrase's first ``gram`` characters.

    Every place of a text gives a key, so the join is an equality join; shorter phrases have keys of their own length.
    Keys that no phrase begins with are dropped before a text is copied for its keys.
    """
    sized = phrases.filter(F.length(phrase) > 0).withColumn("_tw_len", F.least(F.length(phrase), F.lit(gram))).withColumn("_tw_key", F.substr(F.col(phrase), F.lit(1), F.col("_tw_len")))
    known = [r["_tw_key"] for r in sized.select("_tw_key").distinct().limit(PHRASE_KEYS + 1).collect()]
    few = len(known) <= PHRASE_KEYS
    lengths = sorted({len(k) for k in known}) if few else range(1, gram + 1)

    def grams(n: int) -> Column:
        return F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)  # one pass, unlike a substring a place

    keys = F.flatten(F.array(*[grams(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    keys = F.array_distinct(F.filter(keys, lambda k: k.isin(known)) if few else keys)
    exploded = texts.filter(F.length(text) > 0).withColumn("_tw_key", F.explode(keys))
    hit = exploded.join(sized, "_tw_key").filter(F.contains(F.col(text), F.col(phrase)))
    return hit.drop("_tw_key", "_tw_len")


def integrity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys with their counts on both sides where they don't match one to one."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n_left")), b.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = x.join(y, keys, "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.filter((F.col("n_left") != 1) | (F.col("n_right") != 1))


def all_verified(refs: DataFrame, item: str, facts: DataFrame, keys: list[str]) -> DataFrame:
    """item, n_refs, valid: whether every reference of an item has its fact."""
    seen = refs.join(facts.select(*keys).distinct().withColumn("_tw_ok", F.lit(True)), keys, "left")
    return seen.groupBy(item).agg(F.count("*").alias("n_refs"), F.bool_and(F.coalesce("_tw_ok", F.lit(False))).alias("valid"))
