"""Aggregations, metrics roll-ups and scalar scores (sections 2.2, 2.4, 2.10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import stats as S
from tidewell.operators import tables as T
from tidewell.plans.common import Family, once, tables

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
TYPES = ("click", "error", "purchase", "signup", "view")


@fam.query("select doc_type, count(*) as n, count_if(n_chars > 500) as long_ones, count_if(source is null) as no_source from documents group by doc_type")
def a1_conditional_counts(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("long_ones"), F.count_if(F.col("source").isNull()).alias("no_source"))


@fam.query("select category, count(distinct record_id) as n from manifest group by category")
def a2_group_count(spark, d):
    (m,) = tables(spark, d, "manifest")
    return m.groupBy("category").agg(F.count_distinct("record_id").alias("n"))


@fam.query("select user_id, " + ", ".join(f"count_if(event_type = '{t}') as {t}" for t in TYPES) + " from events group by user_id")
def a3_pivot(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("user_id").pivot("event_type", list(TYPES)).count().na.fill(0, list(TYPES))


@fam.query("select user_id, round(count_if(event_type = 'purchase') / greatest(count_if(event_type in ('purchase', 'error')), 1), 6) as adoption from events group by user_id")
def a4_rate(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("user_id").agg(F.round(S.rate(F.col("event_type") == "purchase", F.col("event_type") == "error"), 6).alias("adoption"))


@fam.query("select event_type, count_if(ts < timestamp '2024-01-16') as before, count_if(ts >= timestamp '2024-01-16') as after, count_if(ts >= timestamp '2024-01-16') - count_if(ts < timestamp '2024-01-16') as delta from events group by event_type")
def a5_delta(spark, d):
    (e,) = tables(spark, d, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return e.groupBy("event_type").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


@fam.query("select region, round(avg(clarity), 6) as clarity, round(avg(completeness), 6) as completeness from (select distinct on (case_id) * from workorders) group by region")
def a6_mean_nonnull(spark, d):
    (w,) = tables(spark, d, "workorders")
    return once(w, "case_id").groupBy("region").agg(F.round(F.avg("clarity"), 6).alias("clarity"), F.round(F.avg("completeness"), 6).alias("completeness"))


@fam.query("select dept_id, doc_type, round(avg(n_chars), 4) as mean_chars, count(*) as n from documents group by grouping sets ((dept_id, doc_type), (dept_id), ())")
def a7_rollup(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.rollup("dept_id", "doc_type").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count("*").alias("n"))


@fam.query("select dept_id, median(n_chars) as m, quantile_cont(n_chars, 0.9) as p90, quantile_disc(n_chars, 0.95) as p95 from documents group by dept_id")
def a8_percentiles(spark, d):
    """Median, linear percentile and nearest-rank percentile."""
    (x,) = tables(spark, d, "documents")
    return x.groupBy("dept_id").agg(F.median("n_chars").alias("m"), S.percentile_linear("n_chars", 0.9).alias("p90"), S.percentile_rank("n_chars", 0.95).cast("bigint").alias("p95"))


@fam.query("select user_id, event_id, count_if(event_type <> 'error') over w as good, round(count_if(event_type <> 'error') over w / count(*) over w, 6) as accuracy from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def a11_running_accuracy(spark, d):
    (e,) = tables(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    good = F.count_if(F.col("event_type") != "error").over(w)
    return e.select("user_id", "event_id", good.alias("good"), F.round(good / F.count("*").over(w), 6).alias("accuracy"))


_BUCKET = "(('0x' || substr(sha256(cast(user_id as varchar)), 1, 8))::bigint / 4294967295.0)"


@fam.query(f"""
    with x as (select event_type, event_id % 10 as artifact, case when {_BUCKET} < 0.5 then 'treatment' else 'control' end as grp, (value > 10)::int as ok from events),
    g as (select artifact, avg(ok) filter (grp = 'treatment') as t, avg(ok) filter (grp = 'control') as c, count_if(grp = 'treatment') as nt, count_if(grp = 'control') as nc from x group by artifact)
    select artifact, round(t, 6) as treated, round(c, 6) as control, t < c - 0.1 as roll_back from g where nt >= 10 and nc >= 10
""")
def a12_ab_test(spark, d):
    """Treatment against control by stable bucket, with a least sample and a margin."""
    (e,) = tables(spark, d, "events")
    x = e.select((F.col("event_id") % 10).alias("artifact"), (S.bucket(F.col("user_id")) < 0.5).alias("t"), (F.col("value") > 10).cast("int").alias("ok"))
    t, c = F.col("t"), ~F.col("t")
    g = x.groupBy("artifact").agg(F.avg(F.when(t, F.col("ok"))).alias("a"), F.avg(F.when(c, F.col("ok"))).alias("b"), F.count_if(t).alias("nt"), F.count_if(c).alias("nc"))
    return g.filter("nt >= 10 and nc >= 10").select("artifact", F.round("a", 6).alias("treated"), F.round("b", 6).alias("control"), (F.col("a") < F.col("b") - 0.1).alias("roll_back"))


@fam.query("select artifact, trigger_count, success_count, round(success_count / trigger_count, 6) as success_rate from (select event_id % 25 as artifact, count(*) as trigger_count, count_if(event_type <> 'error') as success_count from events group by 1)")
def a13_usage(spark, d):
    (e,) = tables(spark, d, "events")
    g = e.groupBy((F.col("event_id") % 25).alias("artifact")).agg(F.count("*").alias("trigger_count"), F.count_if(F.col("event_type") != "error").alias("success_count"))
    return g.withColumn("success_rate", F.round(F.col("success_count") / F.col("trigger_count"), 6))


@fam.query("""
    with t as (select dept_id, elements.event as topic, count(*) as hits from (select distinct on (case_id) * from workorders) group by 1, 2)
    select dept_id, topic, hits, cast(r as int) as rank from (select *, row_number() over (partition by dept_id order by hits desc, topic) as r from t) where r <= 5
""")
def a14_topics(spark, d):
    (w,) = tables(spark, d, "workorders")
    t = once(w, "case_id").groupBy("dept_id", F.col("elements.event").alias("topic")).agg(F.count("*").alias("hits"))
    return T.top(t, ["dept_id"], [F.desc("hits"), F.col("topic")], 5)


@fam.query("select case_id, arg_min(text, turn_idx) as title, 2 * count(*) as messages, max(turn_idx) as last_turn from (select distinct case_id, turn_idx, text from dialogue_turns) group by case_id")
def a15_session_rollup(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    return once(t, "case_id", "turn_idx").groupBy("case_id").agg(F.min_by("text", "turn_idx").alias("title"), (2 * F.count("*")).alias("messages"), F.max("turn_idx").alias("last_turn"))


@fam.query("select dept_id, list_sort(list(distinct doc_type)) as kinds, list_sort(list(distinct source) filter (source is not null)) as sources from documents group by dept_id")
def a17_distinct_sets(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.groupBy("dept_id").agg(F.sort_array(F.collect_set("doc_type")).alias("kinds"), F.sort_array(F.collect_set("source")).alias("sources"))


@fam.query("select 'documents' as tbl, count(*) = count(distinct doc_id) as is_unique from documents union all select 'manifest', count(*) = count(distinct record_id) from manifest")
def a18_uniqueness(spark, d):
    x, m = tables(spark, d, "documents", "manifest")
    one = lambda df, k, n: df.agg((F.count("*") == F.count_distinct(k)).alias("is_unique")).select(F.lit(n).alias("tbl"), "is_unique")
    return one(x, "doc_id", "documents").unionByName(one(m, "record_id", "manifest"))


@fam.query("""
    select count(*) as documents, count(text) as with_text, count_if(text = '') as empty_text, count_if(title is null) as no_title, count_if(lang is null) as no_lang, count(distinct text) as distinct_texts,
           min(n_chars) as shortest, max(n_chars) as longest, sum(n_chars)::bigint as chars, count(distinct dept_id) as departments, count(distinct source) as sources, count_if(n_chars <> coalesce(length(text), 0)) as wrong_lengths, count(distinct doc_type) as kinds from documents
""")
def a19_audit(spark, d):
    (x,) = tables(spark, d, "documents")
    c = F.col
    return x.agg(
        F.count("*").alias("documents"), F.count("text").alias("with_text"), F.count_if(c("text") == "").alias("empty_text"), F.count_if(c("title").isNull()).alias("no_title"), F.count_if(c("lang").isNull()).alias("no_lang"),
        F.count_distinct("text").alias("distinct_texts"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.sum("n_chars").alias("chars"), F.count_distinct("dept_id").alias("departments"),
        F.count_distinct("source").alias("sources"), F.count_if(c("n_chars") != F.coalesce(F.length("text"), F.lit(0))).alias("wrong_lengths"), F.count_distinct("doc_type").alias("kinds"),
    )


@fam.query("select dept_id, round(avg(clarity), 6) as baseline, round(avg(completeness), 6) as candidate, round(avg(completeness - clarity), 6) as delta from (select distinct on (case_id) * from workorders) where clarity is not null and completeness is not null group by dept_id")
def a20_paired_delta(spark, d):
    (w,) = tables(spark, d, "workorders")
    x = once(w, "case_id").filter("clarity is not null and completeness is not null")
    return x.groupBy("dept_id").agg(F.round(F.avg("clarity"), 6).alias("baseline"), F.round(F.avg("completeness"), 6).alias("candidate"), F.round(F.avg(F.col("completeness") - F.col("clarity")), 6).alias("delta"))


@fam.query("select case_id, round(greatest(0.0, least(1.0, 0.2 * (1 - coalesce(clarity, 0)) + 0.2 * coalesce(completeness, 0) + 0.35 * (handoff_status = 'completed')::int + 0.25 * multiple_matters::int)), 6) as quality from (select distinct on (case_id) * from workorders)")
def a21_composite(spark, d):
    (w,) = tables(spark, d, "workorders")
    v = 0.2 * (1 - F.coalesce("clarity", F.lit(0.0))) + 0.2 * F.coalesce("completeness", F.lit(0.0)) + 0.35 * (F.col("handoff_status") == "completed").cast("int") + 0.25 * F.col("multiple_matters").cast("int")
    return once(w, "case_id").select("case_id", F.round(S.clamp(v, 0.0, 1.0), 6).alias("quality"))


@fam.query("select user_id, event_type, round(sum(1.0 / greatest(abs(value - 10.0), 0.05)), 4) as votes from events group by user_id, event_type")
def a23_weighted_vote(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.round(F.sum(1.0 / F.greatest(F.abs(F.col("value") - 10.0), F.lit(0.05))), 4).alias("votes"))


@fam.query("select id, len(coalesce(expected.event, [])) > 0 and len(list_filter(expected.event, lambda x: not contains(text, x))) = 0 as all_found, len(list_filter(coalesce(official_label.handling_units, []), lambda x: contains(x, '委员会'))) > 0 as any_committee from (select distinct on (id) * from intake_cases)")
def a24_all_any(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    events = F.coalesce("expected.event", F.array().cast("array<string>"))
    return once(c, "id").select("id", ((F.size(events) > 0) & F.coalesce(F.forall(events, lambda x: F.contains(F.col("text"), x)), F.lit(False))).alias("all_found"), F.coalesce(F.exists("official_label.handling_units", lambda x: x.contains("委员会")), F.lit(False)).alias("any_committee"))


@fam.query("select event_type, cast(least(floor(value / 5), 10) as bigint) as bin, count(*) as n from events group by 1, 2")
def a25_histogram(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("event_type", F.least(F.floor(F.col("value") / 5), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"))


@fam.query("select l_shipmode, gain from (select l_returnflag as l_shipmode, round(sum(l_quantity) filter (l_linestatus = 'F') / nullif(sum(l_quantity) filter (l_linestatus = 'O'), 0), 6) as gain from lineitem group by 1)")
def a26_gain(spark, d):
    (x,) = tables(spark, d, "lineitem")
    f, o = S.sum_if(F.col("l_quantity"), F.col("l_linestatus") == "F"), S.sum_if(F.col("l_quantity"), F.col("l_linestatus") == "O")
    return x.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(f / F.nullif(o, F.lit(0.0)), 6).alias("gain"))


@fam.query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def a_pricing_summary(spark, d):
    (x,) = tables(spark, d, "lineitem")
    x = x.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


# --- predicates and projections ----------------------------------------------------------------


@fam.query("select doc_id from documents where lang is not distinct from null and doc_type is not distinct from 'notice'")
def p_1_conjunctive(spark, d):
    (x,) = tables(spark, d, "documents")
    return T.scan(x, lang=None, doc_type="notice").select("doc_id")


@fam.query("select doc_id, dept_id from documents where dept_id = 'dept_health' or (dept_id is null) or source = 'portal_main'")
def p_2_scope(spark, d):
    """Own department, optionally what is global (here: the main portal's rows)."""
    (x,) = tables(spark, d, "documents")
    return x.filter((F.col("dept_id") == "dept_health") | F.col("dept_id").isNull() | (F.col("source") == "portal_main")).select("doc_id", "dept_id")


@fam.query("select distinct id from intake_cases where list_contains(official_label.handling_units, '市城市管理局')")
def p_4_array_contains(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return c.filter(F.array_contains("official_label.handling_units", "市城市管理局")).select("id").distinct()


@fam.query("""select distinct case_id from workorders where status = 'confirmed' and handoff_status in ('pending', 'processing') and created_at <= timestamptz '2025-06-01 00:00:00+00' and created_at + interval 180 day > timestamptz '2025-06-01 00:00:00+00'""")
def p_5_validity(spark, d):
    """Status, allowed state, started and not yet expired at a given instant."""
    (w,) = tables(spark, d, "workorders")
    now = F.lit("2025-06-01T00:00:00Z").cast("timestamp")
    return w.filter((F.col("status") == "confirmed") & F.col("handoff_status").isin("pending", "processing") & (F.col("created_at") <= now) & (F.col("created_at") + F.expr("INTERVAL 180 DAY") > now)).select("case_id").distinct()


@fam.query("select distinct case_id, turn_idx from dialogue_turns where regexp_matches(lower(coalesce(role, '') || coalesce(text, '')), '身份证|电话|手机|邮箱|password|token')")
def p_7_sensitive(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    both = F.lower(F.concat(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return t.filter(both.rlike("身份证|电话|手机|邮箱|password|token")).select("case_id", "turn_idx").distinct()


@fam.query("""
    with m as (select distinct record_id, category, title from manifest),
    f as (select *, regexp_matches(title, '热点|图解') or row_number() over (partition by category, title order by record_id) > 1 as weak from m),
    n as (select *, count_if(not weak) over (partition by category) as good, row_number() over (partition by category, weak order by record_id) as r from f)
    select record_id, weak and r > greatest(0, 20 - good) as rejected from n
""")
def p_8_quality_gate(spark, d):
    """Weak titles and repeats go, but only while their category keeps at least 20 rows."""
    (m,) = tables(spark, d, "manifest")
    x = m.select("record_id", "category", "title").distinct()
    again = F.row_number().over(Window.partitionBy("category", "title").orderBy("record_id")) > 1
    x = x.withColumn("weak", F.col("title").rlike("热点|图解") | again)
    good = F.count_if(~F.col("weak")).over(Window.partitionBy("category"))
    r = F.row_number().over(Window.partitionBy("category", "weak").orderBy("record_id"))
    return x.select("record_id", (F.col("weak") & (r > F.greatest(F.lit(0), 20 - good))).alias("rejected"))


WORDS = ("办理", "材料", "受理", "窗口", "通知", "申请")


@fam.query("select doc_id, score from (select doc_id, " + " + ".join(f"contains(title, '{w}')::int" for w in WORDS) + " + 2 * contains(substr(text, 1, 600), '受理')::int - 10 * (regexp_matches(title, '热点'))::int as score, n_chars from documents where title is not null and text is not null) where score >= 1 and n_chars >= 180")
def p_9_relevance(spark, d):
    from tidewell.functions.text import count_words

    (x,) = tables(spark, d, "documents")
    score = count_words(F.col("title"), list(WORDS)) + 2 * F.substring("text", 1, 600).contains("受理").cast("int") - 10 * F.col("title").rlike("热点").cast("int")
    return x.filter("title is not null and text is not null").select("doc_id", score.alias("score"), "n_chars").filter("score >= 1 and n_chars >= 180").drop("n_chars")


@fam.query(r"select distinct record_id, regexp_extract(source_url, '^[a-z]+://([^/?#:]+)', 1) as host from manifest where regexp_extract(source_url, '^[a-z]+://([^/?#:]+)', 1) like '%.lanchuan.example'")
def p_10_official_host(spark, d):
    (m,) = tables(spark, d, "manifest")
    host = F.regexp_extract("source_url", "^[a-z]+://([^/?#:]+)", 1)
    return m.select("record_id", host.alias("host")).filter(F.col("host").endswith(".lanchuan.example")).distinct()


@fam.query("select doc_id, case when doc_type in ('notice', 'guide', 'faq') then doc_type else 'other' end as doc_type from documents")
def p_11_allow_list(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", F.when(F.col("doc_type").isin("notice", "guide", "faq"), F.col("doc_type")).otherwise("other").alias("doc_type"))


@fam.query(r"select distinct case_id, substr(title, 1, 10) as title, substr(regexp_replace(coalesce(source.raw_text, ''), '[0-9]', '*', 'g'), 1, 60) as excerpt from workorders")
def p_12_public_projection(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.select("case_id", F.substring("title", 1, 10).alias("title"), F.substring(F.regexp_replace(F.coalesce("source.raw_text", F.lit("")), "[0-9]", "*"), 1, 60).alias("excerpt")).distinct()


@fam.query("select distinct case_id from workorders where contains(source.raw_text, '电梯') or contains(source.raw_text, '暖气') or contains(source.raw_text, '噪音')")
def p_15_triggers(spark, d):
    """Texts that contain any trigger phrase; the phrases are one small literal list."""
    (w,) = tables(spark, d, "workorders")
    hit = reduce(lambda a, p: a | F.col("source.raw_text").contains(p), ("电梯", "暖气", "噪音"), F.lit(False))
    return w.filter(hit).select("case_id").distinct()


# --- scalar scores -----------------------------------------------------------------------------


@fam.query("select case_id, round((4 - m) / 4.0, 6) as completeness, round(greatest(0.2, 1 - 0.15 * a), 6)::double as clarity, round(0.45 * (4 - m) / 4.0 + 0.25 * greatest(0.2, 1 - 0.15 * a) + 0.3, 6) as overall from (select case_id, (coalesce(elements.time_text, '') = '')::int + (coalesce(elements.location, '') = '')::int + (coalesce(elements.event, '') = '')::int + (coalesce(elements.request, '') = '')::int as m, len(elements.subjects) as a from (select distinct on (case_id) * from workorders))")
def m13_order_quality(spark, d):
    (w,) = tables(spark, d, "workorders")
    empty = lambda c: (F.coalesce(c, F.lit("")) == "").cast("int")
    missing = sum((empty(f"elements.{c}") for c in ("time_text", "location", "event", "request")), F.lit(0))
    complete, clear, overall = S.order_quality(missing, F.size("elements.subjects"))
    return once(w, "case_id").select("case_id", F.round(complete, 6).alias("completeness"), F.round(clear, 6).alias("clarity"), F.round(overall, 6).alias("overall"))


@fam.query("select user_id, round(('0x' || substr(sha256(cast(user_id as varchar)), 1, 8))::bigint / 4294967295.0, 9) as bucket from (select distinct user_id from events)")
def m8_bucket(spark, d):
    (e,) = tables(spark, d, "events")
    return e.select("user_id").distinct().select("user_id", F.round(S.bucket(F.col("user_id")), 9).alias("bucket"))


@fam.query("select doc_id, sha256(concat_ws('|', doc_id, coalesce(title, ''), coalesce(text, ''))) as fingerprint from documents")
def m17_fingerprint(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))


@fam.query("select doc_id, round((n_chars - avg(n_chars) over ()) / nullif(stddev_pop(n_chars) over (), 0), 6) as z from documents")
def m20_standard_scale(spark, d):
    """Mean and deviation in one aggregated row, joined back, instead of a window over everything."""
    (x,) = tables(spark, d, "documents")
    stats = x.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return x.join(F.broadcast(stats)).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / F.nullif("s", F.lit(0.0)), 6).alias("z"))
