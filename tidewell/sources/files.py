"""File sources: JSON lines, tables below a preface, folders of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".txt", ".html", ".htm", ".pdf", ".docx")
QUARANTINE = "quarantine"


def read_jsonl(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """One object a line; blank and malformed lines drop out."""
    bad = "_tw_bad string"
    parsed = lines.filter(F.trim(column) != "").select(F.from_json(F.col(column), f"{schema}, {bad}", {"columnNameOfCorruptRecord": "_tw_bad", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter("r._tw_bad is null").select("r.*").drop("_tw_bad")


def table_below_preface(rows: DataFrame, order: str, cells: str, key: str) -> DataFrame:
    """A sheet as rows of cells: the first row that holds ``key`` names the columns.

    Returns order and a map from column name to cell for the rows below it.  Only the header row (one
    array) goes to every task.
    """
    head = rows.filter(F.array_contains(cells, key)).orderBy(order).limit(1).select(F.col(order).alias("_tw_at"), F.col(cells).alias("_tw_head"))
    below = rows.join(F.broadcast(head), F.col(order) > F.col("_tw_at"))  # one row
    pad = F.slice(F.concat(F.col(cells), F.array_repeat(F.lit(None).cast("string"), F.size("_tw_head"))), 1, F.size("_tw_head"))
    named = F.map_from_entries(F.filter(F.zip_with("_tw_head", pad, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda e: F.coalesce(F.trim(e["k"]) != "", F.lit(False))))
    return below.select(order, named.alias("row"))


def list_documents(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, quarantine: str = QUARANTINE) -> DataFrame:
    """path, length, suffix of the documents below root, without quarantined folders; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return with_suffix(files, F.col("path")).filter(F.col("suffix").isin(*suffixes) & ~F.col("path").contains(f"/{quarantine}/"))


def with_suffix(df: DataFrame, path: Column) -> DataFrame:
    return df.withColumn("suffix", F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))
