"""Distances and evaluation metrics as column expressions, and what has to be computed per group."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewell.functions.text import alnum_only


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of normalised texts; null for an empty reference."""
    r, h = alnum_only(F.coalesce(reference, F.lit(""))), alnum_only(F.coalesce(hypothesis, F.lit("")))
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r))


def sequence_accuracy(reference: Column, hypothesis: Column) -> Column:
    """1 minus the edit distance of two strings of one-letter labels by the longer one; null for an empty reference."""
    return F.when(F.length(reference) > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.length(hypothesis))))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def bigram_overlap(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, precision, recall, f1 of the bigram multisets of two texts."""
    from tidewell.functions.text import bigrams

    one = lambda c, side: pairs.select(key, F.explode(bigrams(F.col(c))).alias("g")).groupBy(key, "g").agg(F.count("*").alias(side))
    both = one(a, "na").join(one(b, "nb"), [key, "g"], "full_outer").na.fill(0, ["na", "nb"])
    m = both.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("m"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    p, r = F.when(F.col("sb") > 0, F.col("m") / F.col("sb")).otherwise(0.0), F.when(F.col("sa") > 0, F.col("m") / F.col("sa")).otherwise(0.0)
    return pairs.select(key).join(m.select(key, p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")), key, "left").na.fill(0.0)


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, as in difflib."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def best_mapping(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns paired one to one with the largest total gain (shortest augmenting paths, cubic)."""
    rows, cols = gain.shape
    if rows > cols:
        return sorted((i, j) for j, i in best_mapping(gain.T))
    cost = gain.max(initial=0) - gain.astype(float)
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)  # potentials; row of a column, 0: free
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        short, way, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while owner[at]:
            done[at] = True
            r = owner[at]
            step = cost[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (step < short[1:])
            short[1:][better], way[1:][better] = step[better], at
            nxt = int(np.argmin(np.where(done, np.inf, short)))
            d = short[nxt]
            u[owner[done]] += d
            v[done] -= d
            short[~done] -= d
            at = nxt
        while at:
            owner[at], at = owner[way[at]], way[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, cols + 1) if owner[j])


def diarization_error(df: DataFrame, call: str, frame: float = 0.05) -> DataFrame:
    """call, der, miss, false_alarm, confusion: error by frames under the best one-to-one mapping of labels.

    df: call, side (ref or hyp), speaker, start, end.  Calls without both sides give no row.  The frames of a
    call are counted to a table of label pairs, and the mapping is the optimal assignment on that table, so that
    any number of labels is fine.  Of overlapping segments of a side the first to begin wins.
    """
    schema = f"`{call}` {df.schema[call].dataType.simpleString()}, der double, miss double, false_alarm double, confusion double"

    names = ["der", "miss", "false_alarm", "confusion"]

    def lane(segments: list, n: int) -> tuple[np.ndarray, int]:
        """Label of each frame (0: nobody), and how many labels there are."""
        number = {w: i + 1 for i, w in enumerate(sorted({str(s["speaker"]) for s in segments}))}
        out = np.zeros(n, np.int64)
        for s in reversed(segments):
            lo, hi = max(0, math.ceil(s["start"] / frame - 0.5 - 1e-9)), min(n, math.ceil(s["end"] / frame - 0.5 - 1e-9))
            out[lo : max(lo, hi)] = number[str(s["speaker"])]
        return out, len(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, segments in zip(pdf[call], pdf["segments"], strict=True):
                sides = {s: [x for x in segments if x["side"] == s] for s in ("ref", "hyp")}
                if not all(sides.values()):
                    continue
                n = max(1, math.ceil(max(x["end"] for x in segments) / frame - 1e-9))
                (ref, a), (hyp, b) = (lane(sides[s], n) for s in ("ref", "hyp"))
                pairs = np.bincount(ref * (b + 1) + hyp, minlength=(a + 1) * (b + 1)).reshape(a + 1, b + 1)
                right = sum(int(pairs[i + 1, j + 1]) for i, j in best_mapping(pairs[1:, 1:]))
                speech = max(1, int(pairs[1:].sum()))
                miss, alarm, wrong = int(pairs[1:, 0].sum()), int(pairs[0, 1:].sum()), int(pairs[1:, 1:].sum()) - right
                rows.append((key, (miss + wrong + alarm) / speech, miss / speech, alarm / speech, wrong / speech))
            yield pd.DataFrame(rows, columns=[call, *names])

    # a call's segments meet as one array, bounded by the call; of those that overlap the first to begin wins
    given = df.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    met = given.groupBy(call).agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "side"))).alias("segments"))
    return met.mapInPandas(run, schema)
