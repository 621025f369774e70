"""Compares a query with its SQL on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

NAMES = "region nation customer supplier part orders lineitem events embeddings documents manifest quality_rejected parsed_documents intake_cases workorders dialogue_turns transcript_segments departments feed_zones chunk_limits eval_items".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in NAMES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return v
    if hasattr(v, "asDict"):
        return [plain(x) for x in v.asDict().values()]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
