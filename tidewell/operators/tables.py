"""Mutable tables as sets: upsert, delete, counters, version chains, slowly changing rows, lookups.

Nulls in a key compare equal here (a missing key is a key); ties in the ordering column are broken by
a hash of the whole row, so results are stable; empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, limit: int = 0, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values; a null value asks for nulls."""
    for k, v in equal.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df.limit(limit) if limit else df


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins: of each key the row with the largest ``order``."""
    rows = base.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*[c for c in rest if not rows.schema[c].dataType.typeName().startswith("map")])))
    return rows.groupBy(*keys).agg(pick.alias("_tw")).select(*keys, "_tw.*").select(*base.columns)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    cond = [base[k].eqNullSafe(gone[k]) for k in keys]
    return base.join(gone, cond, "left_anti")


def insert_absent(base: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent seed: rows of seed whose key the base lacks are added."""
    seed = seed.dropDuplicates(keys)
    return base.unionByName(seed.join(base.select(*keys).distinct(), keys, "left_anti"))


def lookup_in_order(requests: DataFrame, ids: str, target: DataFrame, key: str) -> DataFrame:
    """Rows of target for arrays of ids, with their place in the request; misses drop out."""
    wanted = requests.select(*[c for c in requests.columns if c != ids], F.posexplode(ids).alias("pos", key))
    return wanted.join(target, key)


def version_chain(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Adds version ('1.0', '1.1', ...), supersedes (key of the version before) and status."""
    w = Window.partitionBy(*group).orderBy(*order)
    n = F.row_number().over(w)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order]))
    return df.select("*", F.concat(F.lit("1."), (n - 1).cast("string")).alias("version"), F.lag(key).over(w).alias("supersedes"), F.when(last == 1, "active").otherwise("archived").alias("status"))


def revisions(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds revision from 1, valid_to (the next row's order value) and status active or superseded."""
    w = Window.partitionBy(*group).orderBy(*order)
    nxt = F.lead(order[0]).over(w)
    return df.select("*", F.row_number().over(w).alias("revision"), nxt.alias("valid_to"), F.when(F.lead(F.lit(1)).over(w).isNull(), "active").otherwise("superseded").alias("status"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order."""
    return df.withColumn("_tw_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_tw_n = 1").drop("_tw_n")


def top(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def live(df: DataFrame, now: Column, expires: str) -> DataFrame:
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))
