"""Queries of problem 1: the instants that the senders' texts denote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.instants import normalise_instants
from tidewell.session import materialise, table

#: table, key, time field, field that names the sender
FIELDS = (
    ("manifest", "record_id", "published_at", "feed"),
    ("manifest", "record_id", "crawled_at", "crawl_node"),
    ("quality_rejected", "record_id", "published_at", "feed"),
    ("quality_rejected", "record_id", "crawled_at", "crawl_node"),
    ("intake_cases", "id", "received_at", "feed"),
)


def time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_key, field_name, sender and value of every time field."""
    parts = {}
    for src, key, field, sender in FIELDS:
        parts.setdefault((src, key), []).append(F.struct(F.lit(field).alias("field_name"), F.col(sender).alias("sender"), F.col(field).alias("value")))
    out = None
    for (src, key), structs in parts.items():  # one scan a table
        one = table(spark, sf_dir, src).select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_key"), F.explode(F.array(*structs)).alias("f")).select("src", "rec_key", "f.*")
        out = one if out is None else out.unionByName(one)
    return out


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its instant, status and posterior; repeats count once."""
    values = time_values(spark, sf_dir).dropDuplicates(["src", "rec_key", "field_name"])
    return normalise_instants(values, "value", "sender", table(spark, sf_dir, "feed_zones"), keep=lambda df: materialise(df, "p1"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_instants(spark, sf_dir).filter(F.col("status") == "ok").select("src", "rec_key", "field_name", "utc_us")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_instants": p1_instants}
