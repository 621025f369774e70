"""Document transformation, sequences, streams (sections 2.5, 2.12, 2.17, 2.18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as S
from tidewell.operators import sequences as Q
from tidewell.plans.common import Family, once, tables
from tidewell.sources import readers
from tidewell.streaming import events as E

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
P = "(select distinct on (page_id) page_id, blocks, title from parsed_documents)"


@fam.query(rf"""
    with b as (select page_id, i, blocks[i].block_type as kind, regexp_replace(regexp_replace(translate(blocks[i].text, '{S._WIDE.replace("'", "''")}', '{S._HALF.replace("'", "''")}'), '[ \t\x0b\f\x{{00A0}}\x{{3000}}]+', ' ', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as t from (select *, unnest(range(1, len(blocks) + 1)) as i from {P})),
    c as (select * from b where t is not null and length(t) >= 2 and not regexp_matches(t, '^\s*第\s*\d+\s*页\s*共\s*\d+\s*页\s*$|^\s*\d+\s*$|^\s*(版权所有|内部资料|严禁外传)\s*$'))
    select page_id, count(*) as kept, sum(length(t))::bigint as chars from c group by page_id
""")
def x9_clean_documents(spark, d):
    """Blocks cleaned, noise dropped."""
    (p,) = tables(spark, d, "parsed_documents")
    clean = F.transform("blocks", lambda b: S.strip(F.regexp_replace(S.half_width(b["text"]), r"[ \t 　\u000b\f]+", " ")))
    kept = F.filter(clean, lambda t: F.coalesce(~S.is_noise(t), F.lit(False)))
    x = once(p, "page_id").select("page_id", kept.alias("k")).filter("size(k) > 0")
    return x.select("page_id", F.size("k").cast("bigint").alias("kept"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("chars"))


@fam.query(f"select page_id, count(*) as headings, max(blocks[i].level) as deepest from (select *, unnest(range(1, len(blocks) + 1)) as i from {P}) where blocks[i].block_type = 'heading' group by page_id")
def w13_headings(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    h = once(p, "page_id").select("page_id", F.explode("blocks").alias("b")).filter("b.block_type = 'heading'")
    return h.groupBy("page_id").agg(F.count("*").alias("headings"), F.max("b.level").alias("deepest"))


@fam.query()
def x10_chunks(spark, d):
    """Sections, clauses, greedy packing between 300 and 600 characters, short neighbours joined."""
    (p,) = tables(spark, d, "parsed_documents")
    return Q.chunk_blocks(once(p, "page_id"), "page_id", "blocks")


@fam.query()
def x1_markdown(spark, d):
    """Pages written as Markdown and read again."""
    (p,) = tables(spark, d, "parsed_documents")
    line = lambda b: F.when(b["block_type"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(b["level"], F.lit(2))), F.lit(" "), b["text"])).when(b["block_type"] == "list_item", F.concat(F.lit("- "), b["text"])).otherwise(b["text"])
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("blocks", line), "\n\n"))
    docs = once(p, "page_id").select("page_id", F.lit(".md").alias("suffix"), text.alias("text"))
    out = readers.parse_documents(docs, "page_id", "suffix", "text")
    return out.select("page_id", "title", F.size("blocks").alias("n_blocks"))


@fam.query()
def x3_html(spark, d):
    """Pages written as HTML and read again, furniture tags left out."""
    (p,) = tables(spark, d, "parsed_documents")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda b: F.when(b["block_type"] == "heading", "h2").when(b["block_type"] == "list_item", "li").otherwise("p")
    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<"), tag(b), F.lit(">"), esc(F.coalesce(b["text"], F.lit(""))), F.lit("</"), tag(b), F.lit(">"))), "\n")
    text = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav><p>menu</p></nav>"), F.coalesce(body, F.lit("")), F.lit("<footer><p>end</p></footer></body></html>"))
    docs = once(p, "page_id").select("page_id", F.lit(".html").alias("suffix"), text.alias("text"))
    out = readers.parse_documents(docs, "page_id", "suffix", "text")
    return out.select("page_id", "title", F.size("blocks").alias("n_blocks"))


@fam.query("select doc_id, count(*) as lines, count_if(length(line) <= 60 and regexp_matches(line, '^(第[一二三四五六七八九十百0-9]+[章节部分篇编]|[一二三四五六七八九十]+、|[0-9]+[.、．]\\s*[^0-9])')) as headings from (select doc_id, regexp_replace(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), '^[\\s\x0b]+|[\\s\x0b]+$', '', 'g') as line from documents where text is not null) where line <> '' group by doc_id")
def x2_text_lines(spark, d):
    (x,) = tables(spark, d, "documents")
    lines = x.filter("text is not null").select("doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line")).withColumn("line", S.strip(F.col("line")))
    head = (F.length("line") <= 60) & F.col("line").rlike(S.HEADING)
    return lines.filter("line <> ''").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(head).alias("headings"))


@fam.query("select page_id, regexp_extract(source_url, '^[a-z]+://[^/]+/([a-z]+)/', 1) as section, contains(source_url, '.html') as is_article from (select distinct on (page_id) page_id, source_url from parsed_documents)")
def x7_links(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    return once(p, "page_id").select("page_id", F.regexp_extract("source_url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("section"), F.col("source_url").contains(".html").alias("is_article"))


@fam.query("select doc_id, substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not (starts_with(x, '#') or starts_with(x, '- '))), chr(10)), 1, 1600) as body from documents where text is not null")
def x8_body(spark, d):
    (x,) = tables(spark, d, "documents")
    body = F.array_join(F.filter(F.split("text", "\n"), lambda s: ~(s.startswith("#") | s.startswith("- "))), "\n")
    return x.filter("text is not null").select("doc_id", F.substring(body, 1, 1600).alias("body"))


@fam.query("select 'pages' as what, count(distinct page_id) as n from parsed_documents union all select 'without blocks', count(distinct page_id) from parsed_documents where coalesce(len(blocks), 0) = 0 union all select 'not in manifest', count(distinct page_id) from parsed_documents where page_id not in (select record_id from manifest)")
def x16_ingestion_report(spark, d):
    p, m = tables(spark, d, "parsed_documents", "manifest")
    one = lambda df, w: df.agg(F.count_distinct("page_id").alias("n")).select(F.lit(w).alias("what"), "n")
    gone = p.join(m.select(F.col("record_id").alias("page_id")), "page_id", "left_anti")
    return one(p, "pages").unionByName(one(p.filter(F.coalesce(F.size("blocks"), F.lit(0)) <= 0), "without blocks")).unionByName(one(gone, "not in manifest"))


@fam.query()
def w16_decoding(spark, d):
    """Two speakers along each call by the cheapest path, a change costing more across a short pause."""
    (s,) = tables(spark, d, "transcript_segments")
    s = once(s.filter("start_sec is not null"), "call_id", "seg_idx")
    n = F.regexp_extract("speaker_id", r"(\d+)", 1).try_cast("int")
    return Q.decode_speakers(s.withColumn("score", F.coalesce((n % 2).cast("double"), F.lit(0.5))), "call_id", "start_sec", "end_sec", "score")


@fam.query()
def m19_two_means(spark, d):
    """Two clusters of standardised rows by k-means (seed 2026), with the sizes of the clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    (o,) = tables(spark, d, "orders")
    x = VectorAssembler(inputCols=["o_totalprice", "o_custkey"], outputCol="raw").transform(o.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = KMeans(k=2, seed=2026).fit(scaled)
    return model.transform(scaled).groupBy("prediction").agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------------------


@fam.query("""
    with x as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
    select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 1800000000 as end_us, count(*) as n from y group by user_id, s
""")
def z8_sessions(spark, d):
    """Sessions that end after thirty minutes without a row, computed by a stream in append mode."""
    (e,) = tables(spark, d, "events")
    s = E.with_heartbeat(e.select("user_id", F.col("ts").cast("timestamp").alias("at")), "at", "40 days", "z8")
    out = E.run_once(E.sessions(s, "user_id", "at", "30 minutes", "31 days"), "z8").filter("user_id is not null")  # the beat must reach the watermark
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@fam.query("select event_type, cast(ts as date)::varchar as day, (user_id % 10)::varchar as topic, count(*) as n from events group by 1, 2, 3")
def z9_daily_topics(spark, d):
    s = E.stream_of(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    days = E.daily_topics(s, "event_type", "at", (F.col("user_id") % 10).cast("string"), "31 days")
    out = E.run_once(days, "z9", "update", ["event_type", "day", "topic"])
    return out.select("event_type", F.col("day").cast("string").alias("day"), "topic", "n")


@fam.query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 300000000 preceding and current row) as attempts, count(*) over (partition by user_id order by epoch_us(ts) range between 300000000 preceding and current row) <= 5 as allowed from events")
def z10_attempts(spark, d):
    (e,) = tables(spark, d, "events")
    return E.attempts(e, "user_id", "ts", 300, 5).select("event_id", "attempts", "allowed")


@fam.query("select distinct record_id, title from manifest")
def z4_once_each(spark, d):
    """Deliveries of a key again are dropped by the stream's state, which the watermark clears."""
    s = E.stream_of(spark, f"{d}/manifest.parquet").select("record_id", "title", "ingested_at")
    return E.run_once(E.once_each(s, ["record_id"], "ingested_at", "60 days").select("record_id", "title"), "z4")


_ATTEMPTS = "(select event_id % 997 as job, ts, event_type <> 'error' as ok, props as error, row_number() over (partition by event_id % 997 order by ts, props) as k from events)"


@fam.query(f"""
    with a as {_ATTEMPTS}, f as (select job, min(k) filter (where ok) as first_ok from a group by 1), e as (select job, least(coalesce(first_ok, 3), 3, (select count(*) from a b where b.job = f.job)) as attempts, first_ok from f)
    select e.job, cast(attempts as int) as attempts, case when first_ok <= 3 then 'done' when attempts >= 3 then 'dead_letter' else 'retrying' end as status,
      (select coalesce(list(error order by k), []) from a where a.job = e.job and k <= attempts and not ok) as errors from e
""")
def z5_retries(spark, d):
    """Jobs with up to three attempts, then dead letter; errors kept in order (a stream with state that expires)."""
    (e,) = tables(spark, d, "events")
    x = e.select((F.col("event_id") % 997).alias("job"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    out = E.run_once(E.retries_stream(E.with_order(x, "at", "z5"), "job", "at", "ok", "error", late="60 days"), "z5")
    last = out.filter("status <> 'given_up'").groupBy("job").agg(F.max_by(F.struct("attempts", "status", "errors"), "attempts").alias("l"))
    return last.select("job", "l.*")


@fam.query("select count_if(ts + interval 14 day <= timestamp '2024-01-25') as pruned from events")
def z11_retention(spark, d):
    (e,) = tables(spark, d, "events")
    return E.prune(e, F.col("ts") + F.expr("INTERVAL 14 DAY"), F.lit("2024-01-25").cast("timestamp_ntz"))[1]


@fam.query("select distinct case_id, first_value(handoff_status) over (partition by case_id order by ingested_at desc) as last_status from workorders")
def e13_last_state(spark, d):
    """The state of each record after its last change."""
    (w,) = tables(spark, d, "workorders")
    return w.groupBy("case_id").agg(F.max_by("handoff_status", "ingested_at").alias("last_status"))


@fam.query("select case when event_type in ('purchase', 'error') then event_type else 'unknown' end as handler, event_id, case event_type when 'purchase' then 'value ' || (value > 10)::varchar when 'error' then coalesce(props, '') else event_type end as result from events")
def z7_dispatch(spark, d):
    """Micro-batches handed to a handler by type, each with its own work; unknown types are kept."""
    s = E.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "value", "props")
    done = lambda result: lambda part: part.select("event_id", result.cast("string").alias("result"))
    handlers = {"purchase": done(F.concat(F.lit("value "), (F.col("value") > 10).cast("string"))), "error": done(F.coalesce("props", F.lit(""))), "unknown": done(F.col("event_type"))}
    return E.dispatch(s, "event_type", handlers, "z7").select("handler", "event_id", "result")
