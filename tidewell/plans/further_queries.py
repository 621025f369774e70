"""The rest of the inventory: sources, policies, routing, evaluation roll-ups, ingestion, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import arrays as AR
from tidewell.functions import extraction as X
from tidewell.functions import stats as ST
from tidewell.functions import text as S
from tidewell.operators import joins as J
from tidewell.operators import retrieval as R
from tidewell.operators import sequences as Q
from tidewell.operators import tables as T
from tidewell.plans.common import Family, once, tables
from tidewell.plans.retrieval_queries import _BM25, _lexical
from tidewell.session import materialise, shared_dir
from tidewell.sources import files, readers
from tidewell.streaming import events as E

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
W = "(select distinct on (case_id) case_id, dept_id, title, summary, region, source.raw_text as t, elements, clarity, completeness, multiple_matters, handoff_status from workorders)"
C = "(select distinct on (id) * from intake_cases)"
_TOK = "regexp_extract_all(lower({0}), '[一-鿿]|[a-z0-9]+')"


def _orders(spark, d):
    (w,) = tables(spark, d, "workorders")
    return once(w, "case_id").select("case_id", "dept_id", "title", "summary", "region", F.col("source.raw_text").alias("t"), "elements", "clarity", "completeness", "multiple_matters", "handoff_status")


# --- sources and sinks --------------------------------------------------------------------------------


@fam.query("select dept_id, name from departments")
def s8_json_array(spark, d):
    """A JSON array over several lines, written and read back."""
    (x,) = tables(spark, d, "departments")
    path = f"{shared_dir(spark)}/tidewell-s8-{uuid.uuid4().hex}"
    whole = x.select(F.struct("dept_id", "name").alias("r")).agg(F.to_json(F.collect_list("r")).alias("value"))  # twelve fixed rows
    whole.select(F.replace("value", F.lit("},{"), F.lit("},\n{")).alias("value")).coalesce(1).write.text(path)
    return spark.read.option("multiLine", True).schema("dept_id string, name string").json(path)


@fam.query("select dept_id, category from departments")
def s10_sheet(spark, d):
    """A sheet with a preface above its header row."""
    (x,) = tables(spark, d, "departments")
    body = x.select(F.col("dept_id").alias("o"), F.array("dept_id", "name", "category").alias("cells"))
    head = spark.createDataFrame([("!0", ["List", None, None]), ("!1", ["编号", "名称", "类别"])], "o string, cells array<string>")
    rows = files.table_below_preface(head.unionByName(body), "o", "cells", "编号")
    return rows.select(F.col("row")["编号"].alias("dept_id"), F.col("row")["类别"].alias("category"))


@fam.query("select '.csv' as suffix, 1::bigint as n where false union all select '.txt', 1")
def s11_listing(spark, d):
    """Documents below a folder by suffix, without what isn't one."""
    (x,) = tables(spark, d, "departments")
    path = f"{shared_dir(spark)}/tidewell-s11-{uuid.uuid4().hex}"
    x.agg(F.count("*").cast("string").alias("value")).coalesce(1).write.text(path)
    return files.list_documents(spark, path).groupBy("suffix").agg(F.count("*").alias("n"))


@fam.query("select page_id, case when page_id % 3 = 2 then 'no reader for .bin' end as error from (select distinct page_id from parsed_documents)")
def s12_dispatch(spark, d):
    """Readers by suffix; an unknown suffix is an error of its row."""
    (p,) = tables(spark, d, "parsed_documents")
    suffix = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit(".bin")), (F.col("page_id") % 3 + 1).cast("int"))
    docs = once(p, "page_id").select("page_id", suffix.alias("suffix"), F.coalesce("raw_text", F.lit("")).alias("text"))
    return readers.parse_documents(docs, "page_id", "suffix", "text").select("page_id", "error")


@fam.query("select e.event_id, o.o_orderpriority from events e left join orders o on e.event_id = o.o_orderkey")
def s15_snapshot_join(spark, d):
    """A stream joined with a table that is read anew for every micro-batch."""
    s = E.stream_of(spark, f"{d}/events.parquet").select("event_id")
    (o,) = tables(spark, d, "orders")
    return E.run_once(s.join(o.select("o_orderkey", "o_orderpriority"), F.col("event_id") == F.col("o_orderkey"), "left").select("event_id", "o_orderpriority"), "s15")


@fam.query("select 'documents' as tbl, 0::bigint as restricted union all select 'workorders', 0 union all select 'intake_cases', 0")
def p_13_restricted_fields(spark, d):
    """Names of columns, nested ones too, that may not be published: found by walking the schema."""
    banned = {"password", "token", "secret", "audio_path"}

    def names(kind):
        for f in getattr(kind, "fields", ()):
            yield f.name
            yield from names(f.dataType)
        if hasattr(kind, "elementType"):
            yield from names(kind.elementType)

    rows = [(n, sum(x in banned for x in names(t.schema))) for n, t in zip(("documents", "workorders", "intake_cases"), tables(spark, d, "documents", "workorders", "intake_cases"), strict=True)]
    return spark.createDataFrame(rows, "tbl string, restricted long")


@fam.query("select doc_id, (row_number() over (partition by dept_id order by n_chars desc, doc_id))::int as place from documents where dept_id in ('dept_eco', 'dept_health') and doc_type = 'policy'")
def p_14_rule_order(spark, d):
    """Rules in scope, numbered by priority within their department."""
    (x,) = tables(spark, d, "documents")
    y = x.filter(F.col("dept_id").isin("dept_eco", "dept_health") & (F.col("doc_type") == "policy")).select("dept_id", "doc_id", "n_chars")
    return y.withColumn("place", F.row_number().over(Window.partitionBy("dept_id").orderBy(F.desc("n_chars"), "doc_id"))).select("doc_id", "place")


@fam.query("select vec_id, event_id is not null as seen from embeddings left join (select distinct user_id, min(event_id) as event_id from events group by 1) on vec_id = user_id")
def j11_sessions(spark, d):
    v, e = tables(spark, d, "embeddings", "events")
    return v.select("vec_id").join(e.select(F.col("user_id").alias("vec_id")).distinct().withColumn("k", F.lit(True)), "vec_id", "left").select("vec_id", F.coalesce("k", F.lit(False)).alias("seen"))


@fam.query("""
    with q as (select vec_id as query_id, label as ql, embedding as e from embeddings where vec_id % 100 = 0), s as (select query_id, ql, b.vec_id, b.label, round(list_cosine_similarity(q.e::double[], b.embedding::double[]), 9) as score from q, embeddings b where b.vec_id <> query_id),
    t as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s)
    select query_id, vec_id, round(score, 6) as score from t where r <= 8 and label <> ql and score >= 0.2
""")
def j8_similar_elsewhere(spark, d):
    """Of the eight nearest, those of another label and near enough."""
    (e,) = tables(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = R.vector_top_k(e, "vec_id", "embedding", q, "query_id", "q", 9).filter("vec_id <> query_id")
    near = T.top(near, ["query_id"], [F.desc("score"), F.col("vec_id")], 8, "r")
    lab = e.select("vec_id", "label")
    out = near.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return out.filter("label <> ql and score >= 0.2").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@fam.query("with q as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id as a, b.vec_id as b, round(1 - list_cosine_similarity(a.v, b.v), 6) as distance from q a join q b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.v, b.v), 9) >= 0.05")
def j23_near_pairs(spark, d):
    """Near pairs of all rows, each against every other; the threshold works inside the tasks."""
    (e,) = tables(spark, d, "embeddings")
    return R.near_pairs(e, "vec_id", "embedding", 0.05).select("a", "b", F.round(1 - F.col("score"), 6).alias("distance"))


@fam.query("select dept_id, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.75) as q3 from documents group by dept_id")
def a9_linear_percentile(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.groupBy("dept_id").agg(ST.percentile_linear("n_chars", 0.25).alias("q1"), ST.percentile_linear("n_chars", 0.75).alias("q3"))


@fam.query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99 from events group by event_type")
def a10_nearest_rank(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("event_type").agg(ST.percentile_rank("value", 0.5).alias("p50"), ST.percentile_rank("value", 0.99).alias("p99"))


# --- order ----------------------------------------------------------------------------------------------


@fam.query("select o_orderkey, '1.' || (row_number() over w - 1) as version, lag(o_orderkey) over w as supersedes from orders window w as (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey)")
def w3_versions(spark, d):
    (o,) = tables(spark, d, "orders")
    return T.version_chain(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "version", "supersedes")


@fam.query("select o_orderkey, (row_number() over w)::int as revision from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def w4_revisions(spark, d):
    (o,) = tables(spark, d, "orders")
    return T.revisions(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "revision")


@fam.query("""
    with t as (select distinct case_id, turn_idx, text from dialogue_turns), x as (select case_id, turn_idx, text, lead(text) over (partition by case_id order by turn_idx) as nxt from t)
    select case_id, turn_idx from x where right(text, 1) = '，' or (right(text, 2) = '市民' and left(nxt, 1) in ('：', ':'))
""")
def w12_broken_turns(spark, d):
    """Turns whose end and next beginning belong together."""
    (t,) = tables(spark, d, "dialogue_turns")
    nxt = F.lead("text").over(Window.partitionBy("case_id").orderBy("turn_idx"))
    x = once(t, "case_id", "turn_idx").select("case_id", "turn_idx", "text", nxt.alias("nxt"))
    return x.filter(F.col("text").endswith("，") | (F.col("text").endswith("市民") & F.left("nxt", F.lit(1)).isin("：", ":"))).select("case_id", "turn_idx")


@fam.query()
def w14_packing(spark, d):
    """How many chunks each page gives and how long they are."""
    (p,) = tables(spark, d, "parsed_documents")
    return Q.chunk_blocks(once(p, "page_id"), "page_id", "blocks").groupBy("page_id").agg(F.count("*").alias("chunks"), F.max("char_count").alias("longest"))


@fam.query("""
    with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 100 = 0), s as (select query_id, b.vec_id, round(list_cosine_similarity(q.e::double[], b.embedding::double[]), 9) as score from q, embeddings b where b.label = 1)
    select query_id, vec_id, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 5
""")
def k2_vector_filtered(spark, d):
    """The filter comes before the cut: the nearest of one label."""
    (e,) = tables(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_top_k(e.filter("label = 1"), "vec_id", "embedding", q, "query_id", "q", 5).select("query_id", "vec_id", "rank")


@fam.query(f"with {_BM25}, c as (select * from lex where rank <= 10), z as (select item_id, doc_id, round(score + (doc_id % 7) * 0.5, 4) as s2 from c) select item_id, doc_id, r::int as rank from (select *, row_number() over (partition by item_id order by s2 desc, doc_id) as r from z) where r <= 3")
def k3_two_stages(spark, d):
    """Ten candidates a query, scored again, three kept."""
    c = _lexical(spark, d, 10).select("item_id", "doc_id", F.round(F.col("score") + (F.col("doc_id") % 7) * 0.5, 4).alias("s2"))
    return R.top_k(c, "item_id", "doc_id", 3, "s2").select("item_id", "doc_id", "rank")


_AUTH = "case doc_type when 'policy' then 1.0 when 'guide' then 0.9 when 'notice' then 0.8 when 'faq' then 0.65 else 0.4 end"


@fam.query(f"select dept_id, doc_id, round(w, 6) as weight, r::int as rank from (select *, row_number() over (partition by dept_id order by round(w, 6) desc, doc_id) as r from (select dept_id, doc_id, ({_AUTH})::double * n_chars / 1000 as w from documents where n_chars > 0)) where r <= 8")
def k7_recall(spark, d):
    """The eight best a department by relevance times authority."""
    (x,) = tables(spark, d, "documents")
    kind = F.col("doc_type")
    a = F.when(kind == "policy", 1.0).when(kind == "guide", 0.9).when(kind == "notice", 0.8).when(kind == "faq", 0.65).otherwise(0.4)
    w = x.filter("n_chars > 0").select("dept_id", "doc_id", (a * F.col("n_chars") / 1000.0).alias("w"))
    t = T.top(w, ["dept_id"], [F.desc(F.round("w", 6)), F.col("doc_id")], 8)
    return t.select("dept_id", "doc_id", F.round("w", 6).alias("weight"), "rank")


@fam.query(f"select case_id, r::int as place from (select case_id, row_number() over (partition by dept_id order by contains(coalesce(t, ''), '电梯') desc, clarity desc nulls last, case_id) as r from {W}) where r <= 8")
def k8_many_keys(spark, d):
    w = Window.partitionBy("dept_id").orderBy(F.desc(F.coalesce("t", F.lit("")).contains("电梯")), F.col("clarity").desc_nulls_last(), "case_id")
    return _orders(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 8").select("case_id", "place")


@fam.query(f"""
    with u as (select case_id, elements.event as q, unnest(range(1, len(s) + 1)) as i, s from (select case_id, elements, list_filter(regexp_split_to_array(t, '[。；;！？!?\\n]'), lambda x: x <> '') as s from {W} where t is not null)),
    v as (select case_id, i, s[i] as s, 3 * len(list_filter(list_distinct(list_transform(range(1, length(q)), lambda j: substr(q, j::int, 2))), lambda g: contains(s[i], g))) + contains(s[i], '请')::int as score from u where length(q) > 1)
    select case_id, list(s order by score desc, i desc) as best from (select *, row_number() over (partition by case_id order by score desc, i desc) as r from v) where r <= 3 group by case_id
""")
def k11_best_units(spark, d):
    """The three sentences that share most bigrams with the matter."""
    x = _orders(spark, d).filter("t is not null").select("case_id", F.col("elements.event").alias("q"), F.posexplode(F.filter(F.split("t", S.SENTENCE_ENDS), lambda s: s != "")).alias("i", "s")).filter("length(q) > 1")
    grams = F.array_distinct(S.bigrams(F.col("q")))
    score = 3 * F.size(F.filter(grams, lambda g: F.contains(F.col("s"), g))) + F.col("s").contains("请").cast("int")
    t = T.top(x.withColumn("score", score), ["case_id"], [F.desc("score"), F.desc("i")], 3, "r")
    return t.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda z: z["s"]).alias("best"))


# --- sets -------------------------------------------------------------------------------------------------


@fam.query("select page_id, cast(i - 1 as int) as block_no, sha256(blocks[i].text) as hash from (select *, unnest(range(1, len(blocks) + 1)) as i from (select distinct on (page_id) page_id, blocks from parsed_documents)) where blocks[i].text is not null")
def d4_block_hashes(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    return once(p, "page_id").select("page_id", F.posexplode("blocks").alias("block_no", "b")).filter("b.text is not null").select("page_id", "block_no", F.sha2("b.text", 256).alias("hash"))


@fam.query("select a.case_id, round(len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(a.s || b.s)), 0), 6) as jaccard from (select distinct case_id, elements.subjects as s, parent_case_id as p from workorders) a join (select distinct case_id, elements.subjects as s from workorders) b on a.p = b.case_id")
def d9_jaccard_to_parent(spark, d):
    (w,) = tables(spark, d, "workorders")
    x = w.select("case_id", F.col("elements.subjects").alias("s"), F.col("parent_case_id").alias("p")).distinct()
    return x.join(x.select(F.col("case_id").alias("p"), F.col("s").alias("ps")), "p").select("case_id", F.round(AR.jaccard("s", "ps"), 6).alias("jaccard"))


@fam.query("select dept_id, len(list_filter(['notice', 'guide', 'faq', 'policy', 'case'], lambda x: not list_contains(k, x))) = 0 as covered, list_filter(['notice', 'guide', 'faq', 'policy', 'case', 'law'], lambda x: not list_contains(k, x)) as missing from (select dept_id, list(distinct doc_type) as k from documents group by 1)")
def d10_coverage(spark, d):
    """Expected kinds of every department, and what is missing."""
    (x,) = tables(spark, d, "documents")
    kinds = F.array(*map(F.lit, ["notice", "guide", "faq", "policy", "case"]))
    g = x.groupBy("dept_id").agg(F.collect_set("doc_type").alias("k"))
    return g.select("dept_id", (F.size(F.array_except(kinds, "k")) == 0).alias("covered"), F.array_except(F.concat(kinds, F.array(F.lit("law"))), "k").alias("missing"))


@fam.query("select page_id, list_distinct(list_concat([regexp_extract(source_url, '^[a-z]+://[^/]+', 0)], [regexp_replace(source_url, '[?#].*$', '')])) as frontier from (select distinct on (page_id) page_id, source_url from parsed_documents) where source_url is not null and false union all select page_id, list_sort(list_distinct([regexp_extract(source_url, '^[a-z]+://[^/]+', 0), regexp_replace(source_url, '[?#].*$', '')])) from (select distinct on (page_id) page_id, source_url from parsed_documents) where source_url is not null")
def d13_frontier(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    u = F.col("source_url")
    return once(p, "page_id").filter("source_url is not null").select("page_id", F.array_sort(F.array_distinct(F.array(F.regexp_extract(u, "^[a-z]+://[^/]+", 0), F.regexp_replace(u, "[?#].*$", "")))).alias("frontier"))


# --- strings and scores --------------------------------------------------------------------------------------


@fam.query(rf"select case_id, coalesce(nullif(regexp_extract(t, '[一-鿿]{{2,3}}[东西南北]?(?:路|街|巷|大道)[0-9]+号', 0), ''), nullif(regexp_extract(t, '[一-鿿]{{2}}(?:区|县|街道|镇)', 0), ''), '未知') as place from {W} where t is not null")
def f9_place_cascade(spark, d):
    """The first pattern that finds a place, from the most to the least specific."""
    t = F.col("t")
    pick = [F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in ("[一-鿿]{2,3}[东西南北]?(?:路|街|巷|大道)[0-9]+号", "[一-鿿]{2}(?:区|县|街道|镇)")]
    return _orders(spark, d).filter("t is not null").select("case_id", F.coalesce(*pick, F.lit("未知")).alias("place"))


@fam.query(f"select case_id, list_distinct(regexp_extract_all(t, '(物业|公交公司|学校|施工方|街道)'))[1:5] as n, len(list_distinct(regexp_extract_all(t, '(物业|公交公司|学校|施工方|街道)'))) as k from {W} where t is not null and false union all select case_id, list_sort(list_distinct(regexp_extract_all(t, '(物业|公交公司|学校|施工方|街道)'))), len(list_distinct(regexp_extract_all(t, '(物业|公交公司|学校|施工方|街道)'))) from {W} where t is not null")
def f14_subjects(spark, d):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col("t"), F.lit("(物业|公交公司|学校|施工方|街道)"), 1)))
    return _orders(spark, d).filter("t is not null").select("case_id", found.alias("n"), F.size(found).cast("bigint").alias("k"))


@fam.query()
def f18_units(spark, d):
    """Dialogue text split before each speaker's label, the labels kept."""
    (t,) = tables(spark, d, "dialogue_turns")
    return once(t, "case_id", "turn_idx").filter("text is not null").select("case_id", "turn_idx", F.filter(F.split("text", r"(?=(?:接线员|市民|群众|客服|坐席)\s*[:：])"), lambda x: x != "").alias("units"))


@fam.query(f"select case_id, case when region is null or region = '' then '未知' when right(region, 1) in ('区', '县') then region else region || '区' end as region from {W}")
def f20_regions(spark, d):
    r = F.col("region")
    return _orders(spark, d).select("case_id", F.when(r.isNull() | (r == ""), "未知").when(F.right(r, F.lit(1)).isin("区", "县"), r).otherwise(F.concat(r, F.lit("区"))).alias("region"))


_INTENTS = [("怎么|如何|什么|吗", "question"), ("投诉|反映|举报", "complaint"), ("办理|申请|登记", "service"), ("谢谢|感谢", "thanks")]


@fam.query("select id, case " + " ".join(f"when regexp_matches(text, '{p}') then '{v}'" for p, v in _INTENTS) + f" else 'other' end as intent from {C}")
def f25_intent(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").select("id", S.first_rule(F.col("text"), _INTENTS, "other").alias("intent"))


@fam.query(r"select distinct record_id, regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '([^:])/+', '\1/', 'g') as url, regexp_matches(regexp_replace(source_url, '[?#].*$', ''), '\.(html?|pdf|docx?)$') as wanted from manifest")
def f29_links(spark, d):
    (m,) = tables(spark, d, "manifest")
    u = S.canonical_url(F.col("source_url"))
    return m.select("record_id", u.alias("url"), u.rlike(r"\.(html?|pdf|docx?)$").alias("wanted")).distinct()


@fam.query("select dept_id, replace(replace(dept_id, 'dept_', ''), '_', '-') as slug, list_distinct([name, regexp_replace(name, '^市', ''), regexp_replace(name, '(局|委员会|中心)$', '')]) as names from departments where false union all select dept_id, replace(replace(dept_id, 'dept_', ''), '_', '-'), list_sort(list_filter(list_distinct([name, regexp_replace(name, '^市', ''), regexp_replace(name, '(局|委员会|中心)$', '')]), lambda x: length(x) >= 3)) from departments")
def f30_slugs(spark, d):
    """Slugs, and the alias names of units, at least three characters long."""
    (x,) = tables(spark, d, "departments")
    names = F.array("name", F.regexp_replace("name", "^市", ""), F.regexp_replace("name", "(局|委员会|中心)$", ""))
    return x.select("dept_id", F.replace(F.replace("dept_id", F.lit("dept_"), F.lit("")), F.lit("_"), F.lit("-")).alias("slug"), F.array_sort(F.filter(F.array_distinct(names), lambda n: F.length(n) >= 3)).alias("names"))


@fam.query("select event_id, ts + interval 14 day < timestamp '2024-01-20' as stale, (epoch_us(timestamp '2024-02-01') - epoch_us(ts)) // 1000 as age_ms from events")
def t5_age(spark, d):
    """Older than fourteen days, and the age in milliseconds."""
    (e,) = tables(spark, d, "events")
    age = F.floor((F.unix_micros(F.lit("2024-02-01T00:00:00Z").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000)
    return e.select("event_id", (F.col("ts") + F.expr("INTERVAL 14 DAY") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("stale"), age.alias("age_ms"))


@fam.query("select dept_id, round(least(0.95, greatest(0.5, 0.6 + 0.08 * (n > 20)::int + 0.001 * n)), 4)::double as confidence, round(least(0.95, 0.6 + 0.1 * k), 4)::double as by_words, round(least(0.95, 0.5 + 0.02 * n), 4)::double as by_size from (select dept_id, count(*) as n, count(distinct doc_type) as k from documents group by 1)")
def m10_confidences(spark, d):
    """Confidence formulas, clamped and rounded."""
    (x,) = tables(spark, d, "documents")
    g = x.groupBy("dept_id").agg(F.count("*").alias("n"), F.count_distinct("doc_type").alias("k"))
    n = F.col("n")
    return g.select("dept_id", F.round(ST.clamp(0.6 + 0.08 * (n > 20).cast("int") + 0.001 * n, 0.5, 0.95), 4).alias("confidence"), F.round(F.least(F.lit(0.95), 0.6 + 0.1 * F.col("k")), 4).alias("by_words"), F.round(F.least(F.lit(0.95), 0.5 + 0.02 * n), 4).alias("by_size"))


@fam.query("with q as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 5) as dot from q a join q b on b.vec_id = a.vec_id + 1")
def m3_dot(spark, d):
    """Dot products of all vectors of neighbouring ids, in the JVM."""
    (e,) = tables(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    pair = q.join(q.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("v").alias("w")), "a")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pair.select("a", "b", F.round(dot, 5).alias("dot"))


# --- documents ------------------------------------------------------------------------------------------------


@fam.query()
def x6_main_content(spark, d):
    """Title and main content of pages written as HTML: furniture tags dropped, equal neighbours once."""
    (p,) = tables(spark, d, "parsed_documents")
    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<p>"), F.replace(F.coalesce(b["text"], F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))), "")
    docs = once(p, "page_id").select("page_id", F.lit(".html").alias("suffix"), F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title><header><nav><p>x</p></nav></header><script>y()</script>"), F.coalesce(body, F.lit(""))).alias("text"))
    out = readers.parse_documents(docs, "page_id", "suffix", "text")
    return out.select("page_id", F.when(F.length("title").between(3, 180), F.col("title")).alias("title"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("content"))


@fam.query(r"select doc_id, len(regexp_extract_all(text, '(第[一二三四五六七八九十百0-9]+条|（[一二三四五六七八九十]+）|\([0-9]+\))')) as clauses from documents where text is not null")
def x11_clauses(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.filter("text is not null").select("doc_id", F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(第[一二三四五六七八九十百0-9]+条|（[一二三四五六七八九十]+）|\([0-9]+\))"), 1)).cast("bigint").alias("clauses"))


@fam.query()
def x12_hard_split(spark, d):
    """Texts beyond 600 characters cut at sentence ends once 300 are reached, then at 600."""
    (x,) = tables(spark, d, "documents")
    cut = F.udf(lambda t: Q.cut_long(t, 300, 600) if t else [], "array<string>", useArrow=True)
    return x.select("doc_id", cut("text").alias("parts"))


@fam.query("""
    with u as (select record_id, content_sha256, department, title, min(ingested_at) as at from manifest group by 1, 2, 3, 4), k as (select *, row_number() over (partition by content_sha256 order by record_id) as r from u)
    select record_id, '1.' || (row_number() over (partition by department, title order by record_id) - 1) as version, row_number() over (partition by department, title order by record_id desc) = 1 as active from k where r = 1
""")
def x14_ingest(spark, d):
    """One load: exact copies dropped, versions chained, the newest active."""
    (m,) = tables(spark, d, "manifest")
    u = m.select("record_id", "content_sha256", "department", "title").distinct()
    k = T.first_of(u, ["content_sha256"], [F.col("record_id")])
    v = T.version_chain(k, ["department", "title"], ["record_id"], "record_id")
    return v.select("record_id", "version", (F.col("status") == "active").alias("active"))


# --- retrieval and routing -------------------------------------------------------------------------------------


@fam.query(f"with {_BM25}, h as (select i.dept_id, l.item_id, l.doc_id, l.rank from lex l join eval_items i using (item_id) join documents x on x.doc_id = l.doc_id and x.dept_id is not distinct from i.dept_id where l.rank <= 20) select item_id, count(*) as own, min(rank)::int as first from h group by 1")
def r4_own_department(spark, d):
    """Hits of each query in its own department and the rank of the first."""
    i, x = tables(spark, d, "eval_items", "documents")
    h = _lexical(spark, d).select("item_id", "doc_id", "rank").join(i.select("item_id", F.col("dept_id").alias("a")), "item_id").join(x.select("doc_id", F.col("dept_id").alias("b")), "doc_id").filter(F.col("a").eqNullSafe(F.col("b")))
    return h.groupBy("item_id").agg(F.count("*").alias("own"), F.min("rank").alias("first"))


@fam.query("select d.doc_id, x.dept_id as mentioned from documents d join departments x on contains(d.text, x.name) where d.dept_id is distinct from x.dept_id")
def r5_references(spark, d):
    """Documents that mention another department: edges of a reference graph."""
    x, dep = tables(spark, d, "documents", "departments")
    hit = J.contains_join(x.select("doc_id", "text", F.col("dept_id").alias("own")), "text", dep.select("dept_id", "name"), "name")
    return hit.filter(~F.col("own").eqNullSafe(F.col("dept_id"))).select("doc_id", F.col("dept_id").alias("mentioned")).distinct()


@fam.query(f"with {_BM25}, h as (select item_id // 10 as grp, doc_id, min(item_id * 100 + rank) as o from lex where rank <= 5 group by 1, 2) select grp, doc_id, r::int as place from (select *, row_number() over (partition by grp order by o, doc_id) as r from h) where r <= 8")
def r10_union(spark, d):
    """Hits of several queries, the first mention wins, eight kept."""
    h = _lexical(spark, d, 5).groupBy(F.floor(F.col("item_id") / 10).alias("grp"), "doc_id").agg(F.min(F.col("item_id") * 100 + F.col("rank")).alias("o"))
    return T.top(h, ["grp"], [F.col("o"), F.col("doc_id")], 8, "place").select("grp", "doc_id", "place")


@fam.query("select distinct m.record_id, x.dept_id from manifest m join departments x on contains(m.relative_path, x.category)")
def g6_path_route(spark, d):
    m, dep = tables(spark, d, "manifest", "departments")
    paths = m.select("record_id", "relative_path").distinct()
    return J.contains_join(paths, "relative_path", dep.select("dept_id", "category"), "category").select("record_id", "dept_id").distinct()


@fam.query("with g as (select unnest([1, 2, 3]) as n, 0.0 as z), s as (select event_type, value, row_number() over (partition by event_type order by value desc, event_id) as r from events) select n::int as n, event_type, round(avg(value), 6) as mean from g join s on s.r <= 5 * n group by 1, 2")
def g7_grid(spark, d):
    """A small grid of parameters scored on one ranked table."""
    (e,) = tables(spark, d, "events")
    t = T.top(e, ["event_type"], [F.desc("value"), F.col("event_id")], 15, "r").select("event_type", "value", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.col("r") <= 5 * n)).alias("n"))
    return t.groupBy("n", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@fam.query("select artifact, n < 5 as stale, n >= 20 and good / n < 0.6 as split, case when good = 0 then 'content' when good < n then 'routing' else 'none' end as cause from (select event_id % 500 as artifact, count(*) as n, count_if(event_type <> 'error' and event_type <> 'view') as good from events group by 1)")
def g9_lifecycle(spark, d):
    """Stale and too broad artifacts, and a first guess at the cause."""
    (e,) = tables(spark, d, "events")
    g = e.groupBy((F.col("event_id") % 500).alias("artifact")).agg(F.count("*").alias("n"), F.count_if(~F.col("event_type").isin("error", "view")).alias("good"))
    n, ok = F.col("n"), F.col("good")
    return g.select("artifact", (n < 5).alias("stale"), ((n >= 20) & (ok / n < 0.6)).alias("split"), F.when(ok == 0, "content").when(ok < n, "routing").otherwise("none").alias("cause"))


# --- extraction and evaluation ----------------------------------------------------------------------------------


@fam.query(f"select case_id, cast(i - 1 as int) as part, s[i] as subject from (select case_id, elements.subjects as s, unnest(range(1, len(elements.subjects) + 1)) as i from {W} where multiple_matters) where len(s) >= 2")
def e2_split(spark, d):
    """A record about several matters gives a draft each."""
    x = _orders(spark, d).filter("multiple_matters and size(elements.subjects) >= 2")
    return x.select("case_id", F.posexplode("elements.subjects").alias("part", "subject"))


@fam.query(rf"select case_id, len(list_filter(regexp_extract_all(summary || '[来源3]', '\[来源\s*(\d+)\]', 1), lambda m: not (m::int between 1 and 2))) = 0 as in_range from {W} where summary is not null")
def e6_markers(spark, d):
    return _orders(spark, d).filter("summary is not null").select("case_id", X.markers_in_range(F.concat("summary", F.lit("[来源3]")), F.lit(2)).alias("in_range"))


@fam.query(r"select doc_id, count_if(regexp_matches(s, '应当|必须|不得') and not contains(s, '[来源')) as ungrounded, count(*) as sentences from (select doc_id, unnest(regexp_extract_all(text, '[^。！？\n]+[。！？]?')) as s from documents where text is not null) where regexp_matches(s, '[一-鿿A-Za-z]') group by 1")
def e7_grounding(spark, d):
    """Claims without a marker, by sentence."""
    (x,) = tables(spark, d, "documents")
    s = x.filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit("([^。！？\\n]+[。！？]?)"), 1)).alias("s")).filter(F.col("s").rlike("[一-鿿A-Za-z]"))
    return s.groupBy("doc_id").agg(F.count_if(F.col("s").rlike("应当|必须|不得") & ~F.col("s").contains("[来源")).alias("ungrounded"), F.count("*").alias("sentences"))


@fam.query(rf"select case_id, list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(summary, '') || '，共30处', '(\d+(?:\.\d+)?%?)', 1)), lambda n: n not in ('12345', '110', '119', '120') and not contains(coalesce(t, ''), n))) as unsupported from {W}")
def e8_numbers(spark, d):
    return _orders(spark, d).select("case_id", X.unsupported_numbers(F.concat(F.coalesce("summary", F.lit("")), F.lit("，共30处")), F.coalesce("t", F.lit(""))).alias("unsupported"))


@fam.query(f"select case_id, list_sort(list_distinct(regexp_extract_all(coalesce(t, '') || '一定解决', '({X.OVERPROMISE})', 1))) as promises, regexp_matches(coalesce(t, ''), '1[3-9][0-9]{{9}}') as has_number, round(1 - 0.3 * ((length(coalesce(t, '')) < 20)::int + (coalesce(summary, '') = '')::int), 2)::double as verified from {W}")
def e9_detectors(spark, d):
    """Overpromises, phone-like numbers, and a heuristic verifier."""
    t = F.coalesce("t", F.lit(""))
    issues = (F.length(t) < 20).cast("int") + (F.coalesce("summary", F.lit("")) == "").cast("int")
    return _orders(spark, d).select("case_id", X.overpromises(F.concat(t, F.lit("一定解决"))).alias("promises"), t.rlike("1[3-9][0-9]{9}").alias("has_number"), F.round(1 - 0.3 * issues, 2).alias("verified"))


@fam.query(f"with {_BM25} select item_id, string_agg(rank || '. ' || substr(x.text, 1, 40), chr(10) order by rank) as answer from lex join documents x using (doc_id) where rank <= 5 group by item_id")
def e11_extractive(spark, d):
    """An answer of the first forty characters of the five best sources."""
    (x,) = tables(spark, d, "documents")
    h = _lexical(spark, d, 5).join(x.select("doc_id", F.substring("text", 1, 40).alias("t")), "doc_id")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("t"))
    return h.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda z: z["l"]), "\n").alias("answer"))


@fam.query(f"with {_BM25}, h as (select i.item_id, min(l.rank) filter (contains(x.text, substr(i.passage, 1, 12))) as first from eval_items i left join lex l on i.item_id = l.item_id and l.rank <= 20 left join documents x on l.doc_id = x.doc_id group by 1) select count(*) as n, round(avg((coalesce(first, 99) <= 5)::int), 6) as recall_at_5, round(avg(coalesce(1.0 / first, 0)), 6)::double as mrr from h")
def v1_retrieval(spark, d):
    """Recall at five and mean reciprocal rank, a hit being a document that holds the passage's beginning."""
    i, x = tables(spark, d, "eval_items", "documents")
    l = _lexical(spark, d).select("item_id", "doc_id", "rank").join(x.select("doc_id", "text"), "doc_id")
    h = i.select("item_id", F.substring("passage", 1, 12).alias("p")).join(l, "item_id", "left").groupBy("item_id").agg(F.min(F.when(F.contains("text", "p"), F.col("rank"))).alias("first"))
    return h.agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("first", F.lit(99)) <= 5).cast("int")), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@fam.query("select dept_id, round(sum((contains(raw_text, s))::int) / count(*), 6) as correct from (select p.page_id, m.department as dept_id, p.raw_text, unnest(p.blocks).text as s from (select distinct on (page_id) * from parsed_documents where raw_text is not null) p join (select distinct record_id, department from manifest) m on p.page_id = m.record_id) where length(s) > 0 group by 1")
def v2_citations(spark, d):
    p, m = tables(spark, d, "parsed_documents", "manifest")
    x = once(p.filter("raw_text is not null"), "page_id").join(m.select(F.col("record_id").alias("page_id"), F.col("department").alias("dept_id")).distinct(), "page_id")
    s = x.select("dept_id", "raw_text", F.explode("blocks.text").alias("s")).filter("length(s) > 0")
    return s.groupBy("dept_id").agg(F.round(F.sum(F.contains("raw_text", "s").cast("int")) / F.count("*"), 6).alias("correct"))


@fam.query(f"select category, region, round(avg(hit), 6) as hit_rate, count(*) as n from (select official_label.category as category, official_label.region as region, (len(list_filter(expected.event, lambda x: contains(text, x))) > 0)::int as hit from {C} where len(expected.event) > 0 and text is not null) group by grouping sets ((category, region), (category), ())")
def v17_rollup(spark, d):
    """Answer consistency by category and region with subtotals."""
    (c,) = tables(spark, d, "intake_cases")
    x = once(c, "id").filter("size(expected.event) > 0 and text is not null").select(F.col("official_label.category").alias("category"), F.col("official_label.region").alias("region"), F.exists("expected.event", lambda e: F.contains(F.col("text"), e)).cast("int").alias("hit"))
    return x.rollup("category", "region").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.count("*").alias("n"))


@fam.query("""
    with g as (select label, vec_id, embedding::double[] as v from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) where r <= 5), u as (select vec_id, label, embedding::double[] as v from embeddings),
    m as (select u.vec_id, u.label, max(round(list_cosine_similarity(u.v, g.v), 9)) as best from u join g on u.label = g.label and u.vec_id <> g.vec_id group by 1, 2) select vec_id, round(best, 6) as best, best >= 0.3 as ok from m
""")
def v9_semantic(spark, d):
    """Every row's best similarity to the references of its label, which are the model: the first five rows a label."""
    (e,) = tables(spark, d, "embeddings")
    gold = T.top(e, ["label"], [F.col("vec_id")], 5).select("label", F.col("vec_id").alias("proto"), F.col("embedding").alias("pv"))
    s = R.prototype_scores(e, "vec_id", "embedding", gold, "proto", "label", "pv", 1).withColumnRenamed("label", "pl")
    m = s.join(e.select("vec_id", "label"), "vec_id").filter("pl = label").withColumn("best", F.round("score", 9))
    return m.select("vec_id", F.round("best", 6).alias("best"), (F.col("best") >= 0.3).alias("ok"))


@fam.query("select event_type, round(avg((value > 10)::int), 6) as baseline, round(avg((value > 8)::int), 6) as candidate, round(avg((value > 8)::int) - avg((value > 10)::int), 6) as gain from events group by 1")
def v15_replay(spark, d):
    """Two policies replayed over the same rows."""
    (e,) = tables(spark, d, "events")
    a, b = F.avg((F.col("value") > 10).cast("int")), F.avg((F.col("value") > 8).cast("int"))
    return e.groupBy("event_type").agg(F.round(a, 6).alias("baseline"), F.round(b, 6).alias("candidate"), F.round(b - a, 6).alias("gain"))


@fam.query("""
    with t as (select doc_type, unnest(regexp_extract_all(lower(title), '[一-鿿]|[a-z0-9]+')) as tok from documents where title is not null), c as (select doc_type, tok, count(*) as n from t group by 1, 2)
    select doc_type, list(tok order by n desc, tok) as top6, (select count(*) from documents x where x.doc_type = c.doc_type) >= 20 as large from (select *, row_number() over (partition by doc_type order by n desc, tok) as r from c) c where r <= 6 group by doc_type
""")
def q3_mined(spark, d):
    """Groups large enough with their six commonest tokens."""
    (x,) = tables(spark, d, "documents")
    c = x.filter("title is not null").select("doc_type", F.explode(S.tokens(F.col("title"))).alias("tok")).groupBy("doc_type", "tok").agg(F.count("*").alias("n"))
    t = T.top(c, ["doc_type"], [F.desc("n"), F.col("tok")], 6).groupBy("doc_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tok"))), lambda z: z["tok"]).alias("top6"))
    return t.join(x.groupBy("doc_type").agg((F.count("*") >= 20).alias("large")), "doc_type")


@fam.query("select label::int as label, list(vec_id order by vec_id) as members, count(*) as n from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) where r <= 12 group by label")
def q5_prototypes(spark, d):
    (e,) = tables(spark, d, "embeddings")
    p = T.top(e, ["label"], [F.col("vec_id")], 12)
    return p.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------------------------------


@fam.query("select event_id, event_type from events")
def z2_consume(spark, d):
    """Everything appended to a queue is read once, with a checkpoint."""
    s = E.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type")
    queue = f"{shared_dir(spark)}/tidewell-z2-{uuid.uuid4().hex}.parquet"
    E.run_once(s, "z1").write.parquet(queue)
    return E.run_once(E.stream_of(spark, queue), "z2")


@fam.query("select user_id, epoch_us(max(ts)) // 1000 as since_ms, cast(count(*) as int) as n from events where user_id is not null group by user_id")
def z3_stale(spark, d):
    """Owners that have been silent for a minute, by a stream whose timer fires on event time: pending rows to take over."""
    (e,) = tables(spark, d, "events")
    s = E.with_heartbeat(e.select("user_id", F.col("ts").cast("timestamp").alias("at")), "at", "40 days", "z3")
    return E.run_once(E.silent(s, "user_id", "at", 60_000, "31 days"), "z3").filter("user_id is not null")


@fam.query("select cast(ts as date)::varchar as day, count(*) as signals, count_if(event_type = 'error') as bad, count_if(event_type = 'error') > 0.2 * count(*) as adapt from events group by 1")
def z13_cycle(spark, d):
    """One cycle a day over what came: observed, counted, decided."""
    s = E.stream_of(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "31 days")
    g = s.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("signals"), F.count_if(F.col("event_type") == "error").alias("bad"))
    out = E.run_once(g.select(F.to_date("w.start").cast("string").alias("day"), "signals", "bad"), "z13", "update", ["day"])
    return out.withColumn("adapt", F.col("bad") > 0.2 * F.col("signals"))


@fam.query("select case_id, cast(i as int) as part, substr(summary, (i * 16 + 1)::int, 16) as slice from (select case_id, summary, unnest(range(0, (length(summary) + 15) // 16)) as i from " + W + " where summary is not null)")
def z14_slices(spark, d):
    """Output in slices of sixteen characters."""
    return _orders(spark, d).filter("summary is not null").select("case_id", F.posexplode(S.pieces(F.col("summary"), 16)).alias("part", "slice"))


@fam.query("select user_id, count(*) as n, false as audit from events where user_id % 10 <> 3 group by 1 union all select user_id, count(*), true from events where user_id % 10 = 3 group by 1")
def z15_erasure(spark, d):
    """Users erased from a log, an audit row with the count left for each."""
    (e,) = tables(spark, d, "events")
    gone = e.filter("user_id % 10 = 3").select("user_id").distinct()
    left = T.delete(e, gone, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.lit(False).alias("audit"))
    return left.unionByName(e.join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.lit(True).alias("audit")))


@fam.query("select 'a' as snapshot, count(*) as n from documents union all select 'b', count(*) from documents where doc_type <> 'case'")
def h5_snapshots(spark, d):
    """Versions appended as snapshots, none overwritten."""
    (x,) = tables(spark, d, "documents")
    both = x.select(F.lit("a").alias("snapshot"), "doc_id").unionByName(x.filter("doc_type <> 'case'").select(F.lit("b").alias("snapshot"), "doc_id"))
    return materialise(both, "h5").groupBy("snapshot").agg(F.count("*").alias("n"))


# --- what the inventory lists under several names -----------------------------------------------------------------


@fam.query(f"with {_BM25} select item_id, count(*) as scored, round(max(score), 4) as best from sc group by item_id")
def m1_bm25_scores(spark, d):
    """How many documents each query scores, and its best score."""
    x, q = tables(spark, d, "documents", "eval_items")
    s = R.bm25(x.filter("text is not null"), "doc_id", "text", q, "item_id", "query")
    return s.groupBy("item_id").agg(F.count("*").alias("scored"), F.round(F.max("score"), 4).alias("best"))


@fam.query("select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double) / n * (x::double) / n)), 6) as length2 from (select vec_id, embedding, coalesce(nullif(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 0), 1) as n from embeddings)")
def m2_normalise(spark, d):
    """Vectors brought to length 1 (a zero vector stays), and their squared length."""
    (e,) = tables(spark, d, "embeddings")
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    x = e.withColumn("n", F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))).withColumn("u", F.transform("embedding", lambda v: v.cast("double") / F.col("n")))
    return x.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v), 6).alias("length2"))


@fam.query("with r as (select user_id, event_type, row_number() over (partition by user_id order by n desc, event_type) as a, row_number() over (partition by user_id order by v desc, event_type) as b from (select user_id, event_type, count(*) as n, round(sum(value), 3) as v from events group by 1, 2)) select user_id, event_type, round(1.0 / (60 + a) + 1.0 / (60 + b), 8)::double as score from r")
def m4_rank_fusion(spark, d):
    """Two orders of one set, fused."""
    (e,) = tables(spark, d, "events")
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v"))
    one = R.top_k(g, "user_id", "event_type", 1000, "n")
    two = R.top_k(g, "user_id", "event_type", 1000, "v")
    return R.fuse([one, two], "user_id", "event_type").withColumn("score", F.round("score", 8))


@fam.query("select doc_id, round(case doc_type when 'policy' then 1.0 when 'guide' then 0.9 when 'notice' then 0.8 when 'faq' then 0.65 else 0.4 end * 0.5, 4)::double as weight from documents")
def m14_authority(spark, d):
    (x,) = tables(spark, d, "documents")
    weights = F.create_map(*[F.lit(v) for kv in (("policy", 1.0), ("guide", 0.9), ("notice", 0.8), ("faq", 0.65)) for v in kv])
    return x.select("doc_id", F.round(F.coalesce(F.try_element_at(weights, F.col("doc_type")), F.lit(0.4)) * 0.5, 4).alias("weight"))


@fam.query()
def m16_match_ratio(spark, d):
    from tidewell.functions.metrics import match_ratio

    x = _orders(spark, d)
    return x.select("case_id", F.round(match_ratio(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), 6).alias("ratio"))


@fam.query("select page_id, page_id % 5 <> 0 as indexed from (select distinct page_id from parsed_documents)")
def x15_reindex(spark, d):
    """Derived rows recomputed from the status of their document."""
    (p,) = tables(spark, d, "parsed_documents")
    gone = p.filter("page_id % 5 = 0").select("page_id")
    base = p.select("page_id").distinct()
    return T.delete(base, gone, ["page_id"]).withColumn("indexed", F.lit(True)).unionByName(base.join(gone, "page_id", "left_semi").withColumn("indexed", F.lit(False)))


@fam.query("select event_type, count(*) as n, round(avg((value > 10)::int), 6) as success from events where event_type in ('click', 'view') group by 1")
def v16_backtest(spark, d):
    """Success of the rows a trigger would have caught."""
    (e,) = tables(spark, d, "events")
    return e.filter(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("success"))


@fam.query("select id, (len(expected.event) > 0)::int + (len(expected.request) > 0)::int + (len(expected.location) > 0)::int as filled, round(((coalesce(len(expected.event), 0) > 0)::int + (coalesce(len(expected.request), 0) > 0)::int + (coalesce(len(expected.location), 0) > 0)::int) / 3.0, 4)::double as share from " + C + " where expected.event is not null and expected.request is not null and expected.location is not null")
def v3_completeness(spark, d):
    """Filled fields of each record and their share."""
    (c,) = tables(spark, d, "intake_cases")
    x = once(c, "id").filter("expected.event is not null and expected.request is not null and expected.location is not null")
    n = sum(((F.size(f"expected.{k}") > 0).cast("int") for k in ("event", "request", "location")), F.lit(0))
    return x.select("id", n.alias("filled"), F.round(n / 3.0, 4).alias("share"))
