"""Streams: sessions, counters, de-duplication, retries, retention.

Each function takes and gives a streaming (or batch) DataFrame; ``run_once`` starts a query over what
is there, with a checkpoint in the shared folder, and returns the table it wrote.  Watermarks bound
the state: rows later than the watermark are left out, as the reference's own clock would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.session import shared_dir


def stream_of(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream of files."""
    schema = spark.read.parquet(path).schema
    pattern = path.replace(".parquet", "[.]parquet")  # a pattern may match a file, a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def with_heartbeat(df: DataFrame, at: str, ahead: str, what: str) -> DataFrame:
    """A stream of the rows of a batch table and, in a batch of its own after them, one row whose time lies ``ahead`` of
    all others and whose other columns are null: it moves the watermark on, so that append mode gives up every group.

    As a source that goes silent would be told apart from one that has nothing to say.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-beat-{what}-{uuid.uuid4().hex}"
    df.coalesce(8).write.parquet(f"{path}/a")  # files are read in the order in which they were written: the beat comes last
    last = df.agg((F.max(at) + F.expr(f"interval {ahead}")).alias(at)).filter(F.col(at).isNotNull())
    last.select(*[F.col(at) if c == at else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]).coalesce(1).write.parquet(f"{path}/b")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def with_order(df: DataFrame, at: str, what: str) -> DataFrame:
    """A stream of the rows of a batch table in files by time, as a queue delivers them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-queue-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run_once(df: DataFrame, what: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over all that is available and gives the result as a table.

    mode update with keys: each batch adds the rows that changed, and the table has the last version of each key, so that
    nothing is ever written twice and the stream may forget what its watermark has passed.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tidewell-stream-{what}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    elif mode == "update" and keys:

        def add(batch: DataFrame, n: int) -> None:
            batch.withColumn("_tw_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/{n:012d}")

        q = df.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        rest = [c for c in df.columns if c not in keys]
        schema = StructType([*df.schema.fields, StructField("_tw_batch", LongType())])
        every = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
        last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_tw_batch").alias("_tw_last"))
        return last.select(*[F.col(c) if c in keys else F.col(f"_tw_last.{c}") for c in df.columns])
    else:  # complete: the last version of each batch

        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def sessions(df: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """key, start, end, n: runs of rows without a pause as long as the gap."""
    if late:
        df = df.withWatermark(at, late)
    return df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_topics(df: DataFrame, group: str, at: str, topic: Column, late: str | None = None) -> DataFrame:
    """group, day, topic, n by tumbling days."""
    if late:
        df = df.withWatermark(at, late)
    return df.groupBy(group, F.window(at, "1 day").alias("w"), topic.alias("topic")).agg(F.count("*").alias("n")).select(group, F.to_date("w.start").alias("day"), "topic", "n")


def attempts(df: DataFrame, key: str, at: str, span: int, most: int) -> DataFrame:
    """Rows with the number of rows of their key in the last ``span`` seconds, and whether that is allowed."""
    from pyspark.sql import Window

    s = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(s).rangeBetween(-span * 1_000_000, 0)
    n = F.count("*").over(w)
    return df.select("*", n.alias("attempts"), (n <= most).alias("allowed"))


def once_each(df: DataFrame, keys: list[str], at: str | None = None, late: str = "1 day") -> DataFrame:
    """Drops deliveries of a key that was seen within the watermark."""
    if at:
        return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def prune(df: DataFrame, expires: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows went."""
    gone = expires.isNotNull() & (expires <= now)
    return df.filter(~gone), df.agg(F.count_if(gone).alias("pruned"))


def retries(df: DataFrame, job: str, at: str, ok: str, error: str, most: int = 3) -> DataFrame:
    """State of each job after its attempts in order: attempts, status (done, retrying, dead_letter), errors.

    Attempts after a success or after the last allowed failure are duplicates and don't count.
    """
    schema = f"`{job}` {df.schema[job].dataType.simpleString()}, attempts int, status string, errors array<string>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        n, status, errors = 0, "retrying", []
        for good, e in pdf.sort_values([at, error], kind="stable")[[ok, error]].itertuples(index=False):
            if status != "retrying":
                break
            n += 1
            if good:
                status = "done"
            else:
                errors.append((e or "")[:2000])
                if n >= most:
                    status = "dead_letter"
        return pd.DataFrame([(pdf[job].iloc[0], n, status, errors)], columns=[job, "attempts", "status", "errors"])

    return df.select(job, at, ok, error).groupBy(job).applyInPandas(fold, schema)


def retries_stream(df: DataFrame, job: str, at: str, ok: str, error: str, most: int = 3, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """The same on a stream (append): one row an attempt that counts, with the errors so far.

    State a job: attempts, whether closed, errors.  A closed job is remembered for ``keep_ms`` past its last row, so
    that redeliveries are dropped, and an open one that goes silent for as long is given up; then both are forgotten.
    """
    kind = df.schema[job].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, closed, errors = state.get
            state.remove()
            yield pd.DataFrame([] if closed else [(key[0], n, "given_up", list(errors))], columns=[job, "attempts", "status", "errors"])
            return
        n, closed, errors = state.get if state.exists else (0, False, [])
        errors, rows, last = list(errors), [], 0
        for pdf in batches:
            last = max(last, int(pdf["_tw_ms"].max()))
            for good, e in pdf.sort_values([at, error], kind="stable")[[ok, error]].itertuples(index=False):
                if closed:
                    continue
                n += 1
                if not good:
                    errors = [*errors, (e or "")[:2000]]
                closed = bool(good) or n >= most
                rows.append((key[0], n, "done" if good else "dead_letter" if closed else "retrying", list(errors)))
        state.update((n, closed, errors))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(rows, columns=[job, "attempts", "status", "errors"])

    src = df.select(job, at, ok, error, F.unix_millis(F.col(at)).alias("_tw_ms")).withWatermark(at, late)
    schema = f"`{job}` {kind}, attempts int, status string, errors array<string>"
    return src.groupBy(job).applyInPandasWithState(step, schema, "n int, closed boolean, errors array<string>", "append", "EventTimeTimeout")


def silent(df: DataFrame, key: str, at: str, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """key, since, n (append): keys without a row for ``idle_ms`` of event time, when that was last, and rows until then.

    A key is reported each time it goes silent: pending jobs to be taken over, workers that show no sign of life.  Its state
    is dropped with the report.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame([(k[0], last, n)], columns=[key, "since_ms", "n"])
            return
        n, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["_tw_ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=[key, "since_ms", "n"])

    src = df.withWatermark(at, late).select(key, at, F.unix_millis(F.col(at)).alias("_tw_ms"))
    out = src.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, since_ms bigint, n int", "n int, last bigint", "append", "EventTimeTimeout")
    return out


def dispatch(df: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], what: str, other: str = "unknown") -> DataFrame:
    """Micro-batches handed to a handler by type; what the handlers return (one schema) is kept, with the handler's name.

    Rows of a type without a handler are kept as type ``other`` by the handler of that name, if there is one.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tidewell-stream-{what}-{uuid.uuid4().hex}"
    known = [k for k in handlers if k != other]

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, handle in handlers.items():
            part = batch.filter(~F.coalesce(F.col(kind).isin(*known), F.lit(False))) if name == other else batch.filter(F.col(kind) == name)
            handle(part).withColumn("handler", F.lit(name)).write.mode("overwrite").parquet(f"{base}/out/{n:012d}-{known.index(name) if name in known else len(known)}")
        batch.unpersist()

    df.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out")
