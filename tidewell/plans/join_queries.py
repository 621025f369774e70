"""Joins (section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import joins as J
from tidewell.operators import tables as T
from tidewell.plans.common import Family, once, tables

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
SEG = "(select distinct on (call_id, seg_idx) call_id, seg_idx, start_sec, end_sec from transcript_segments where start_sec is not null)"


@fam.query("select distinct page_id, title from parsed_documents where page_id in (select record_id from manifest where char_count > 800)")
def j1_semi(spark, d):
    p, m = tables(spark, d, "parsed_documents", "manifest")
    return p.select("page_id", "title").distinct().join(m.filter("char_count > 800"), F.col("page_id") == F.col("record_id"), "left_semi")


@fam.query("select l.l_orderkey, l.l_linenumber, o.o_orderpriority, c.c_mktsegment from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey where l.l_discount > 0.08 and o.o_orderstatus = 'F'")
def j2_hydrate(spark, d):
    x, o, c = tables(spark, d, "lineitem", "orders", "customer")
    x = x.filter("l_discount > 0.08").select("l_orderkey", "l_linenumber")
    o = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@fam.query("select d.doc_id, coalesce(nullif(d.title, ''), x.name) as title, x.name_en from documents d left join departments x using (dept_id)")
def j3_fill(spark, d):
    x, dep = tables(spark, d, "documents", "departments")
    return x.join(dep.select("dept_id", "name", "name_en"), "dept_id", "left").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "name").alias("title"), "name_en")


@fam.query("select count(*) as citations, count_if(contains(p.raw_text, c.snippet)) as valid from (select page_id, unnest(blocks).text as snippet from (select distinct on (page_id) * from parsed_documents)) c join (select distinct on (page_id) * from parsed_documents) p using (page_id) where length(c.snippet) > 0 and p.raw_text is not null")
def j4_citations(spark, d):
    """Citations (blocks) that stand in the text they cite."""
    (p,) = tables(spark, d, "parsed_documents")
    p = once(p, "page_id")
    cited = p.select("page_id", F.explode("blocks.text").alias("snippet")).filter("length(snippet) > 0")
    j = cited.join(p.filter("raw_text is not null").select("page_id", "raw_text"), "page_id")
    return j.agg(F.count("*").alias("citations"), F.count_if(F.contains("raw_text", "snippet")).alias("valid"))


@fam.query("select distinct page_id from parsed_documents where page_id not in (select record_id from manifest)")
def j5_orphans(spark, d):
    p, m = tables(spark, d, "parsed_documents", "manifest")
    return p.select("page_id").distinct().join(m, F.col("page_id") == F.col("record_id"), "left_anti")


@fam.query("select distinct case_id from workorders where dept_id = 'dept_eco' or len(list_intersect(elements.subjects, ['物业', '学校'])) > 0")
def j6_overlap_semi(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.filter((F.col("dept_id") == "dept_eco") | F.arrays_overlap("elements.subjects", F.array(F.lit("物业"), F.lit("学校")))).select("case_id").distinct()


@fam.query("""
    with t as (select distinct elements.event as phrase from workorders), x as (select doc_id, text from documents where text is not null)
    select x.doc_id, t.phrase from x join t on contains(x.text, t.phrase)
""")
def j7_containment(spark, d):
    """Phrases that stand in other texts: a containment join by an index of two-character keys."""
    x, w = tables(spark, d, "documents", "workorders")
    phrases = w.select(F.col("elements.event").alias("phrase")).distinct()
    return J.contains_join(x.filter("text is not null").select("doc_id", "text"), "text", phrases, "phrase").select("doc_id", "phrase").distinct()


@fam.query("select event_type, count(*) as n, count_if(o_orderstatus = 'F') as finished from events join orders on event_id = o_orderkey group by event_type")
def j9_experiments(spark, d):
    e, o = tables(spark, d, "events", "orders")
    return e.join(o, F.col("event_id") == F.col("o_orderkey")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@fam.query("select distinct w.case_id from workorders w where w.case_id in (select case_id from dialogue_turns) or w.parent_case_id in (select case_id from dialogue_turns)")
def j10_semi_or(spark, d):
    """A disjunction as the union of two semi joins, not a join on OR."""
    w, t = tables(spark, d, "workorders", "dialogue_turns")
    seen = t.select("case_id").distinct()
    own = w.join(seen, "case_id", "left_semi").select("case_id")
    of_parent = w.join(seen.withColumnRenamed("case_id", "c"), F.col("parent_case_id") == F.col("c"), "left_semi").select("case_id")
    return own.union(of_parent).distinct()


@fam.query("""
    select x.dept_id, coalesce(a.docs, 0) as docs, coalesce(b.orders, 0) as orders from departments x
    left join (select dept_id, count(*) as docs from documents group by 1) a using (dept_id) left join (select dept_id, count(distinct case_id) as orders from workorders group by 1) b using (dept_id)
""")
def j12_group_join(spark, d):
    dep, x, w = tables(spark, d, "departments", "documents", "workorders")
    a = x.groupBy("dept_id").agg(F.count("*").alias("docs"))
    b = w.groupBy("dept_id").agg(F.count_distinct("case_id").alias("orders"))
    return dep.select("dept_id").join(a, "dept_id", "left").join(b, "dept_id", "left").na.fill(0)


@fam.query("""
    with a as (select category, title, count(*) as n_left from manifest group by 1, 2), b as (select category, title, count(*) as n_right from quality_rejected group by 1, 2)
    select category, title, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right from a full join b using (category, title) where coalesce(n_left, 0) <> 1 or coalesce(n_right, 0) <> 1
""")
def j13_integrity(spark, d):
    m, q = tables(spark, d, "manifest", "quality_rejected")
    return J.integrity(m, q, ["category", "title"])


@fam.query("select i.item_id, d.doc_id is not null as found from eval_items i left join documents d on i.item_id = d.doc_id")
def j14_gold(spark, d):
    i, x = tables(spark, d, "eval_items", "documents")
    return i.select("item_id").join(x.select("doc_id"), F.col("item_id") == F.col("doc_id"), "left").select("item_id", F.col("doc_id").isNotNull().alias("found"))


@fam.query(f"""
    with s as {SEG}, w as (select distinct a.call_id, a.seg_idx, a.start_sec as t, b.start_sec as c from s a join s b on a.call_id = b.call_id and a.seg_idx <> b.seg_idx)
    select call_id, seg_idx, c, cast(r as int) as rank from (select *, row_number() over (partition by call_id, seg_idx order by abs(c - t), c) as r from w) where r <= 5
""")
def j15_nearest(spark, d):
    """The five starts of other segments nearest to each segment's start."""
    (s,) = tables(spark, d, "transcript_segments")
    s = once(s.filter("start_sec is not null and seg_idx is not null"), "call_id", "seg_idx").select("call_id", "seg_idx", F.col("start_sec").alias("t"))
    starts = s.groupBy("call_id", "t").agg((F.count("*") == 1).alias("alone"))
    near = J.nearest(s, starts.select("call_id", F.col("t").alias("c")), ["call_id"], "t", "c", 6, "seg_idx")
    # a start that no other segment has is the segment's own, and first of the six
    near = near.join(s.join(starts, ["call_id", "t"]), ["call_id", "seg_idx"]).withColumn("rank", F.col("rank") - F.col("alone").cast("int"))
    return near.filter("rank between 1 and 5").select("call_id", "seg_idx", "c", "rank")


@fam.query(f"""
    with f as (select call_id, unnest(range(0, ceil(most)::bigint)) * 1.0 + 0.5 as t from (select call_id, max(end_sec) as most from {SEG} group by 1))
    select f.call_id, cast(t as double) as t, min(seg_idx) as seg_idx from f join {SEG} s on f.call_id = s.call_id and start_sec <= t and t < end_sec group by 1, 2
""")
def j16_point_in_interval(spark, d):
    """Frames (one a second, to the end of the call) with the first segment that holds them."""
    (s,) = tables(spark, d, "transcript_segments")
    s = once(s.filter("start_sec is not null"), "call_id", "seg_idx").select("call_id", "seg_idx", "start_sec", "end_sec")
    ends = s.groupBy("call_id").agg(F.ceil(F.max("end_sec")).alias("most")).filter("most > 0")
    frames = ends.select("call_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most") - 1)).alias("t")).withColumn("t", (F.col("t") + 0.5).cast("double"))
    return J.point_in_interval(frames, "t", s, "start_sec", "end_sec", ["call_id"], 8.0).groupBy("call_id", "t").agg(F.min("seg_idx").alias("seg_idx"))


@fam.query(f"""
    with s as {SEG} select a.call_id, a.seg_idx, round(sum(least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)), 4) as shared, count(*) as n
    from s a join s b on a.call_id = b.call_id and a.seg_idx <> b.seg_idx and least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) > 0.05 where a.start_sec <= a.end_sec and b.start_sec <= b.end_sec group by 1, 2
""")
def j17_overlap(spark, d):
    """Each segment's overlap with all other segments of its call."""
    (s,) = tables(spark, d, "transcript_segments")
    s = once(s.filter("start_sec is not null"), "call_id", "seg_idx")
    a = s.select("call_id", "seg_idx", F.col("start_sec").alias("a_start"), F.col("end_sec").alias("a_end"))
    b = s.select("call_id", F.col("seg_idx").alias("other"), F.col("start_sec").alias("b_start"), F.col("end_sec").alias("b_end"))
    pairs = J.overlapping(a, b, ["call_id"], 8.0, 0.05).filter("seg_idx <> other")
    return pairs.groupBy("call_id", "seg_idx").agg(F.round(F.sum("shared"), 4).alias("shared"), F.count("*").alias("n"))


@fam.query("select c.case_id, c.n as n_refs, c.n = c.ok as valid from (select t.case_id, count(*) as n, count(w.case_id) as ok from (select distinct case_id, turn_idx from dialogue_turns) t left join (select distinct case_id from workorders where status = 'confirmed') w on t.case_id = w.case_id group by 1) c")
def j18_all_verified(spark, d):
    t, w = tables(spark, d, "dialogue_turns", "workorders")
    refs = once(t, "case_id", "turn_idx").select("case_id", "turn_idx").withColumn("item", F.col("case_id"))
    out = J.all_verified(refs, "item", w.filter("status = 'confirmed'"), ["case_id"])
    return out.withColumnRenamed("item", "case_id")


@fam.query("select m.record_id, coalesce(q.department, m.department) as department, q.record_id is not null as curated from (select distinct record_id, title, department from manifest) m left join (select title, min(department) as department, min(record_id) as record_id from quality_rejected group by title) q using (title)")
def j19_overwrite(spark, d):
    m, q = tables(spark, d, "manifest", "quality_rejected")
    cur = q.groupBy("title").agg(F.min("department").alias("cd"), F.min("record_id").alias("cr"))
    return m.select("record_id", "title", "department").distinct().join(cur, "title", "left").select("record_id", F.coalesce("cd", "department").alias("department"), F.col("cr").isNotNull().alias("curated"))


@fam.query("select distinct m.record_id from manifest m where exists (select 1 from quality_rejected q where q.category = m.category and q.title = m.title)")
def j20_composite_semi(spark, d):
    m, q = tables(spark, d, "manifest", "quality_rejected")
    return m.join(q, ["category", "title"], "left_semi").select("record_id").distinct()


@fam.query("""
    with t as (select distinct case_id, dept_id, elements.subjects as s from workorders), x as (select dept_id, list_sort(list_distinct(s)) as s, min(case_id) as head, count(*) as n from t where len(s) > 0 group by 1, 2)
    select a.head as a, b.head as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) as jaccard from x a join x b on a.dept_id = b.dept_id and a.head < b.head where len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) >= 0.5
""")
def j21_similar_sets(spark, d):
    """Pairs of distinct sets of one department with Jaccard of a half: candidates share an element, copies stand behind their representative."""
    from tidewell.functions.arrays import jaccard

    (w,) = tables(spark, d, "workorders")
    t = w.select("case_id", "dept_id", F.array_sort(F.array_distinct("elements.subjects")).alias("s")).distinct().filter("size(s) > 0")
    x = t.groupBy("dept_id", "s").agg(F.min("case_id").alias("head"))
    e = x.withColumn("e", F.explode("s"))
    pair = e.select("dept_id", "e", F.col("head").alias("a"), F.col("s").alias("sa")).join(e.select("dept_id", "e", F.col("head").alias("b"), F.col("s").alias("sb")), ["dept_id", "e"]).filter("a < b")
    return pair.select("a", "b", F.round(jaccard("sa", "sb"), 6).alias("jaccard")).distinct().filter("jaccard >= 0.5")


@fam.query("select distinct c.id, x.dept_id from (select id, unnest(official_label.handling_units) as unit from intake_cases) c join departments x on contains(c.unit, x.name)")
def j22_alias_containment(spark, d):
    """Unit names that contain a department's name: the alias is what stands behind the prefix."""
    c, dep = tables(spark, d, "intake_cases", "departments")
    units = c.select("id", F.explode("official_label.handling_units").alias("unit")).distinct()
    return J.contains_join(units, "unit", dep.select("dept_id", "name"), "name").select("id", "dept_id").distinct()


@fam.query("select record_id, title from (select *, row_number() over (partition by content_sha256 order by record_id) as r from (select distinct record_id, title, content_sha256, source_url from manifest)) m where r = 1 and source_url not in (select source_url from quality_rejected where source_url is not null)")
def j24_known(spark, d):
    """New rows only: neither a known address nor a known content."""
    m, q = tables(spark, d, "manifest", "quality_rejected")
    x = m.select("record_id", "title", "content_sha256", "source_url").distinct()
    x = T.first_of(x, ["content_sha256"], [F.col("record_id")])
    return x.join(q.select("source_url"), "source_url", "left_anti").select("record_id", "title")


@fam.query("select x.dept_id, w.handoff_status as answer, coalesce(n, 0) as n from departments x left join (select dept_id, handoff_status, count(distinct case_id) as n from workorders where multiple_matters group by 1, 2) w using (dept_id)")
def j25_fan_out(spark, d):
    """Answers of every department, one row also where none came; answers are counted before the join."""
    dep, w = tables(spark, d, "departments", "workorders")
    g = w.filter("multiple_matters").groupBy("dept_id", F.col("handoff_status").alias("answer")).agg(F.count_distinct("case_id").alias("n"))
    return dep.select("dept_id").join(g, "dept_id", "left").select("dept_id", "answer", F.coalesce("n", F.lit(0)).alias("n"))


@fam.query("select p.event_id, v.event_id as view_id from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, event_id from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts")
def j_as_of(spark, d):
    """The last view before each purchase."""
    (e,) = tables(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return J.as_of(left, right, ["user_id"], "ts", ["view_id"]).select("event_id", F.col("asof_view_id").alias("view_id"))


@fam.query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name")
def j_local_supplier(spark, d):
    c, o, x, s, n, r = tables(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    nat = n.join(r.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    j = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
