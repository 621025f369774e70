"""Order-sensitive operators, top-k and date functions (sections 2.5, 2.6, 2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import sequences as Q
from tidewell.operators import tables as T
from tidewell.plans.common import Family, once, tables

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
TURNS = "(select distinct case_id, turn_idx, role, text from dialogue_turns)"


@fam.query("select user_id, event_id, round(1.0 / (60 + row_number() over (partition by user_id order by value desc, event_id)), 8)::double as share from events")
def w1_rank_share(spark, d):
    (e,) = tables(spark, d, "events")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return e.select("user_id", "event_id", F.round(1.0 / (60 + r), 8).alias("share"))


@fam.query("select user_id, coalesce(round(1.0 / min(r) filter (event_type = 'purchase'), 6), 0)::double as rr from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) group by user_id")
def w2_reciprocal_rank(spark, d):
    (e,) = tables(spark, d, "events")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return e.withColumn("r", r).groupBy("user_id").agg(F.coalesce(F.round(1.0 / F.min(F.when(F.col("event_type") == "purchase", F.col("r"))), 6), F.lit(0.0)).alias("rr"))


@fam.query("select event_id, (row_number() over (partition by user_id order by ts, event_id))::int as seq from events")
def w5_sequence(spark, d):
    (e,) = tables(spark, d, "events")
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@fam.query(f"select case_id, list(text order by turn_idx) as recent from (select *, row_number() over (partition by case_id order by turn_idx desc) as r from {TURNS}) where r <= 10 group by case_id")
def w6_last_n(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    x = T.top(once(t, "case_id", "turn_idx"), ["case_id"], [F.desc("turn_idx")], 10)
    return x.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", F.coalesce("text", F.lit("")).alias("x"), "text"))), lambda s: s["text"]).alias("recent"))


@fam.query(f"select case_id, turn_idx, string_agg(coalesce(role, '?') || ':' || substr(coalesce(text, ''), 1, 240), ' | ') over (partition by case_id order by turn_idx rows between 3 preceding and current row) as summary from {TURNS}")
def w7_rolling_summary(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    w = Window.partitionBy("case_id").orderBy("turn_idx").rowsBetween(-3, 0)
    line = F.concat(F.coalesce("role", F.lit("?")), F.lit(":"), F.substring(F.coalesce("text", F.lit("")), 1, 240))
    return once(t, "case_id", "turn_idx").select("case_id", "turn_idx", F.array_join(F.collect_list(line).over(w), " | ").alias("summary"))


@fam.query(f"select case_id, turn_idx from (select *, lag(role) over (partition by case_id order by turn_idx) as before from {TURNS}) where before = 'operator' and role = 'citizen'")
def w8_follow_up(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    before = F.lag("role").over(Window.partitionBy("case_id").orderBy("turn_idx"))
    return once(t, "case_id", "turn_idx").withColumn("before", before).filter("before = 'operator' and role = 'citizen'").select("case_id", "turn_idx")


@fam.query(f"""
    with x as (select *, case when role is not distinct from lag(role) over w and row_number() over w > 1 then 0 else 1 end as s from {TURNS} window w as (partition by case_id order by turn_idx)),
    y as (select *, (sum(s) over (partition by case_id order by turn_idx))::int as run from x)
    select case_id, run, any_value(role) as role, string_agg(coalesce(text, ''), '。' order by turn_idx) as text from y group by case_id, run
""")
def w9_merge_runs(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    x = Q.runs(once(t, "case_id", "turn_idx"), ["case_id"], ["turn_idx"], Q.differs("role", ["case_id"], ["turn_idx"]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", F.coalesce("text", F.lit("")).alias("x")))), lambda s: s["x"]), "。")
    return x.groupBy("case_id", "run").agg(F.max("role").alias("role"), joined.alias("text"))


@fam.query(f"select case_id, turn_idx, text from (select *, lag(text) over w as p, row_number() over w as r from {TURNS} window w as (partition by case_id order by turn_idx)) where r = 1 or text is distinct from p")
def w10_drop_repeats(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    x = once(t, "case_id", "turn_idx").withColumn("_new", Q.differs("text", ["case_id"], ["turn_idx"]))
    return x.filter("_new").select("case_id", "turn_idx", "text")


@fam.query(f"""
    with x as (select *, case when role in ('operator', 'citizen') then role end as known from {TURNS})
    select case_id, turn_idx, coalesce(last_value(known ignore nulls) over (partition by case_id order by turn_idx rows unbounded preceding), 'citizen') as held from x
""")
def w11_carried_role(spark, d):
    """The role held at each turn: a fold over the turns of a talk."""
    (t,) = tables(spark, d, "dialogue_turns")
    x = once(t, "case_id", "turn_idx").withColumn("known", F.when(F.col("role").isin("operator", "citizen"), F.col("role")))
    g = x.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "known"))).alias("a"))
    g = g.withColumn("held", Q.carried_state(F.transform("a", lambda s: s["known"]), "citizen"))
    return g.select("case_id", F.explode(F.arrays_zip(F.transform("a", lambda s: s["turn_idx"]).alias("turn_idx"), "held")).alias("z")).select("case_id", "z.turn_idx", "z.held")


@fam.query("select call_id, seg_idx, start_sec < max(end_sec) over (partition by call_id order by start_sec, seg_idx rows between unbounded preceding and 1 preceding) as overlaps from (select distinct on (call_id, seg_idx) call_id, seg_idx, start_sec, end_sec from transcript_segments where start_sec is not null)")
def w17_monotonic(spark, d):
    (s,) = tables(spark, d, "transcript_segments")
    w = Window.partitionBy("call_id").orderBy("start_sec", "seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return once(s.filter("start_sec is not null"), "call_id", "seg_idx").select("call_id", "seg_idx", (F.col("start_sec") < F.max("end_sec").over(w)).alias("overlaps"))


@fam.query("""
    with x as (select dept_id, doc_id, text, coalesce(sum(length(text)) over (partition by dept_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as used from documents where text is not null)
    select dept_id, doc_id, substr(text, 1, (6000 - used)::int) as text from x where used < 6000
""")
def w18_budget(spark, d):
    (x,) = tables(spark, d, "documents")
    return Q.running_budget(x.filter("text is not null").select("dept_id", "doc_id", "text"), ["dept_id"], [F.col("doc_id")], "text", 6000)


@fam.query(f"""
    with x as (select case_id, turn_idx, case when role = 'operator' then 2 when role = 'citizen' then 0 else 1 end as p, length(coalesce(text, '')) as n from {TURNS})
    select case_id, turn_idx from (select *, sum(n) over (partition by case_id order by p, turn_idx desc rows unbounded preceding) as used from x) where used <= 120
""")
def w19_eviction(spark, d):
    """A context of 120 characters filled by priority, the latest first, so that the least wanted are evicted."""
    (t,) = tables(spark, d, "dialogue_turns")
    p = F.when(F.col("role") == "operator", 2).when(F.col("role") == "citizen", 0).otherwise(1)
    w = Window.partitionBy("case_id").orderBy(p, F.desc("turn_idx")).rowsBetween(Window.unboundedPreceding, 0)
    return once(t, "case_id", "turn_idx").withColumn("used", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w)).filter("used <= 120").select("case_id", "turn_idx")


@fam.query("select distinct record_id from manifest where record_id not in (select record_id from quality_rejected union select page_id from parsed_documents where page_count > 3)")
def w20_resume(spark, d):
    m, q, p = tables(spark, d, "manifest", "quality_rejected", "parsed_documents")
    done = q.select("record_id").union(p.filter("page_count > 3").select("page_id"))
    return m.select("record_id").distinct().join(done, "record_id", "left_anti")


@fam.query("select dept_id, doc_id, (r)::int as rank from (select dept_id, doc_id, row_number() over (partition by dept_id order by n_chars desc, doc_id) as r from documents where doc_type = 'faq') where r <= 5")
def k1_filtered_top(spark, d):
    """The filter comes before the cut."""
    (x,) = tables(spark, d, "documents")
    return T.top(x.filter("doc_type = 'faq'").select("dept_id", "doc_id", "n_chars"), ["dept_id"], [F.desc("n_chars"), F.col("doc_id")], 5).drop("n_chars")


@fam.query("select case_id, epoch_us(created_at) as at_us from (select distinct case_id, created_at from workorders) order by created_at desc, case_id limit 50")
def k5_newest(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.select("case_id", "created_at").distinct().orderBy(F.desc("created_at"), "case_id").limit(50).select("case_id", F.unix_micros("created_at").alias("at_us"))


@fam.query("select user_id, round(avg(value), 6) as mean_top3 from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 3 group by user_id")
def k9_mean_of_top(spark, d):
    (e,) = tables(spark, d, "events")
    return T.top(e, ["user_id"], [F.desc("value"), F.col("event_id")], 3).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_top3"))


@fam.query("""
    with x as (select dept_id, unnest(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) as tok from documents where text is not null), c as (select dept_id, tok, count(*) as n from x group by 1, 2)
    select dept_id, tok, n, (r)::int as rank from (select *, row_number() over (partition by dept_id order by n desc, tok) as r from c) where r <= 6
""")
def k10_common_tokens(spark, d):
    from tidewell.functions.text import tokens

    (x,) = tables(spark, d, "documents")
    c = x.filter("text is not null").select("dept_id", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("dept_id", "tok").agg(F.count("*").alias("n"))
    return T.top(c, ["dept_id"], [F.desc("n"), F.col("tok")], 6)


@fam.query("select category, record_id from (select category, record_id, row_number() over (partition by category order by sha256('seed|' || relative_path), record_id) as r from (select distinct category, record_id, relative_path from manifest)) where r <= 2")
def k12_hash_sample(spark, d):
    """A sampling operator: two rows a category, the first by hash."""
    (m,) = tables(spark, d, "manifest")
    x = m.select("category", "record_id", "relative_path").distinct()
    return T.top(x, ["category"], [F.sha2(F.concat(F.lit("seed|"), F.col("relative_path")), 256), F.col("record_id")], 2).select("category", "record_id")


@fam.query("select category, record_id, case when r <= greatest(2, round_even(0.2 * n, 0)) then 'dev' else 'train' end as part from (select *, row_number() over (partition by category order by sha256('split|' || record_id), record_id) as r, count(*) over (partition by category) as n from (select distinct category, record_id from manifest))")
def k13_hash_split(spark, d):
    (m,) = tables(spark, d, "manifest")
    x = m.select("category", "record_id").distinct()
    r = F.row_number().over(Window.partitionBy("category").orderBy(F.sha2(F.concat(F.lit("split|"), F.col("record_id").cast("string")), 256), "record_id"))
    n = F.count("*").over(Window.partitionBy("category"))
    return x.select("category", "record_id", F.when(r <= F.greatest(F.lit(2.0), F.bround(0.2 * n, 0)), "dev").otherwise("train").alias("part"))


@fam.query("select doc_id, (list_position(['notice', 'guide', 'faq', 'policy', 'case'], doc_type))::int as place from documents")
def k14_custom_order(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", F.array_position(F.array(*map(F.lit, ["notice", "guide", "faq", "policy", "case"])), F.col("doc_type")).cast("int").alias("place"))


@fam.query("select dept_id, arg_max(doc_type, n * 1000000 - length(doc_type)) as best from (select dept_id, doc_type, count(*) as n from documents group by 1, 2) group by dept_id")
def k15_argmax(spark, d):
    (x,) = tables(spark, d, "documents")
    c = x.groupBy("dept_id", "doc_type").agg(F.count("*").alias("n"))
    return c.groupBy("dept_id").agg(F.max_by("doc_type", F.col("n") * 1000000 - F.length("doc_type")).alias("best"))


# --- dates ----------------------------------------------------------------------------------------


@fam.query("select distinct case_id, epoch_us(try_cast(source.received_at as timestamptz)) as at_us from workorders")
def t1_parse_iso(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.select("case_id", F.unix_micros(F.try_to_timestamp("source.received_at")).alias("at_us")).distinct()


@fam.query("select event_id, strftime(ts + interval 8 hour, '%Y年%-m月%-d日 %H:%M') as label from events")
def t2_label(spark, d):
    (e,) = tables(spark, d, "events")
    t = F.col("ts") + F.expr("INTERVAL 8 HOUR")
    return e.select("event_id", F.concat(F.year(t).cast("string"), F.lit("年"), F.month(t).cast("string"), F.lit("月"), F.day(t).cast("string"), F.lit("日 "), F.date_format(t, "HH:mm")).alias("label"))


@fam.query(r"select distinct case_id, cast(try_cast(replace(replace(nullif(regexp_extract(source.raw_text, '(\d{4}-\d{2}-\d{2})', 1), ''), '/', '-'), ' ', '') as date) as varchar) as found from workorders")
def t3_find_date(spark, d):
    (w,) = tables(spark, d, "workorders")
    found = F.nullif(F.regexp_extract(F.coalesce("source.raw_text", F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return w.select("case_id", found.try_cast("date").cast("string").alias("found")).distinct()


@fam.query("select event_id, epoch_us(ts + interval 90 day) as expires_us, ts + interval 14 day < timestamp '2024-01-25' as old from events")
def t4_expiry(spark, d):
    (e,) = tables(spark, d, "events")
    return e.select("event_id", F.unix_micros((F.col("ts") + F.expr("INTERVAL 90 DAY")).cast("timestamp")).alias("expires_us"), (F.col("ts") + F.expr("INTERVAL 14 DAY") < F.lit("2024-01-25").cast("timestamp_ntz")).alias("old"))


@fam.query("select cast(ts as date)::varchar as day, count(*) as n, epoch_us(max(ts)) - epoch_us(min(ts)) as span_us from events group by 1")
def t6_days(spark, d):
    (e,) = tables(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span_us"))
