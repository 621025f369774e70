"""Scans, sinks, mutable tables, set operations, arrays and JSON (sections 2.1, 2.7, 2.11, 2.19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import tables as T
from tidewell.plans.common import Family, once, tables
from tidewell.session import materialise, shared_dir

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
LATEST = "(select * from (select *, row_number() over (partition by record_id order by ingested_at desc) as rn from {0}) where rn = 1)"


@fam.query("select doc_id, title from documents where source = 'portal_main' and doc_type = 'faq'")
def s1_scan(spark, d):
    (docs,) = tables(spark, d, "documents")
    return T.scan(docs, source="portal_main", doc_type="faq").select("doc_id", "title")


@fam.query("select r.doc_id, d.doc_type, d.n_chars from (select distinct doc_id + 3 as doc_id from documents) r left join documents d on r.doc_id = d.doc_id")
def s2_lookup(spark, d):
    (docs,) = tables(spark, d, "documents")
    asked = docs.select((F.col("doc_id") + 3).alias("doc_id")).distinct()
    return asked.join(docs.select("doc_id", "doc_type", "n_chars"), "doc_id", "left")


@fam.query(f"""
    with m as {LATEST.format('manifest')}, req as (select category, list(record_id order by record_id desc)[1:5] as ids from m group by category),
    x as (select category, unnest(range(0, len(ids))) as pos, ids from req)
    select x.category, cast(x.pos as int) as pos, p.page_id, p.page_count from x join (select page_id, max(page_count) as page_count from parsed_documents group by 1) p on p.page_id = x.ids[x.pos + 1]
""")
def s3_batch_lookup(spark, d):
    m, p = tables(spark, d, "manifest", "parsed_documents")
    ids = F.slice(F.sort_array(F.collect_set("record_id"), asc=False), 1, 5)
    req = m.groupBy("category").agg(ids.alias("ids"))
    return T.lookup_in_order(req, "ids", once(p, "page_id").select("page_id", "page_count"), "page_id").select("category", "pos", "page_id", "page_count")


@fam.query("""
    with u as (select record_id, title, ingested_at from manifest union all select record_id, upper(title) || '!', ingested_at + interval 1 day from manifest where record_id % 7 = 0)
    select record_id, arg_max(title, ingested_at) as title, epoch_us(max(ingested_at)) as at_us from u group by record_id
""")
def s4_upsert(spark, d):
    (m,) = tables(spark, d, "manifest")
    base = m.select("record_id", "title", "ingested_at")
    late = base.filter("record_id % 7 = 0").select("record_id", F.concat(F.upper("title"), F.lit("!")).alias("title"), (F.col("ingested_at") + F.expr("INTERVAL 1 DAY")).alias("ingested_at"))
    return T.upsert(base, late, ["record_id"], "ingested_at").select("record_id", "title", F.unix_micros("ingested_at").alias("at_us"))


@fam.query("select distinct record_id, title from manifest where record_id not in (select page_id from parsed_documents)")
def s5_delete(spark, d):
    m, p = tables(spark, d, "manifest", "parsed_documents")
    gone = p.select(F.col("page_id").alias("record_id"))
    return T.delete(m.select("record_id", "title").distinct(), gone, ["record_id"])


@fam.query("select user_id, event_type, count(*) as hits, round(sum(value), 4) as total from events group by user_id, event_type")
def s6_increment(spark, d):
    (e,) = tables(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("hits"), F.round(F.sum("value"), 4).alias("total"))


@fam.query("select distinct record_id, title, char_count from manifest where record_id % 10 <> 0")
def s7_jsonl(spark, d):
    """JSON lines written and read back; malformed lines (every record divisible by 10 is cut) are dropped."""
    from tidewell.sources.files import read_jsonl

    (m,) = tables(spark, d, "manifest")
    rows = m.select("record_id", "title", "char_count").distinct()
    line = F.to_json(F.struct("record_id", "title", "char_count"))
    line = F.when(F.col("record_id") % 10 == 0, F.expr("left(_line, length(_line) - 3)")).otherwise(F.col("_line"))
    lines = materialise(rows.withColumn("_line", F.to_json(F.struct("record_id", "title", "char_count"))).select(line.alias("value")), "s7")
    return read_jsonl(lines, "value", "record_id bigint, title string, char_count bigint")


@fam.query("select dept_id, name, name_en, category from departments")
def s9_csv(spark, d):
    """CSV with a header, written to the shared folder and read back."""
    import uuid

    (x,) = tables(spark, d, "departments")
    path = f"{shared_dir(spark)}/tidewell-s9-{uuid.uuid4().hex}"
    x.select("dept_id", "name", "name_en", "category").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="dept_id string, name string, name_en string, category string")


@fam.query("select category, bit_xor(('0x' || substr(sha256(record_id || '|' || content_sha256), 1, 15))::bigint) as fingerprint, count(*) as n from (select distinct category, record_id, content_sha256 from manifest) group by category")
def s14_fingerprint(spark, d):
    """Fingerprint of a group whatever its size: hashes of the rows, combined by a mergeable aggregate."""
    (m,) = tables(spark, d, "manifest")
    rows = m.select("category", "record_id", "content_sha256").distinct()
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), "content_sha256"), 256), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy("category").agg(F.bit_xor(h).alias("fingerprint"), F.count("*").alias("n"))


@fam.query("""
    with m as (select distinct record_id, department, title from manifest where department is not null)
    select record_id, '1.' || (row_number() over w - 1) as version, lag(record_id) over w as supersedes,
           case when row_number() over (partition by department, title order by record_id desc) = 1 then 'active' else 'archived' end as status
    from m window w as (partition by department, title order by record_id)
""")
def h1_versions(spark, d):
    (m,) = tables(spark, d, "manifest")
    rows = m.filter("department is not null").select("record_id", "department", "title").distinct()
    return T.version_chain(rows, ["department", "title"], ["record_id"], "record_id").select("record_id", "version", "supersedes", "status")


@fam.query("""
    select event_id, (row_number() over w)::int as revision, epoch_us(lead(ts) over w) as valid_to_us, case when lead(event_id) over w is null then 'active' else 'superseded' end as status
    from events window w as (partition by user_id, event_type order by ts, event_id)
""")
def h2_revisions(spark, d):
    (e,) = tables(spark, d, "events")
    out = T.revisions(e, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("event_id", "revision", F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to_us"), "status")


@fam.query("""
    with active as (select record_id from (select *, row_number() over (partition by department, title order by record_id desc) as r from (select distinct record_id, department, title from manifest)) where r = 1)
    select distinct page_id, page_id in (select record_id from active) as fresh from parsed_documents
""")
def h3_dependents(spark, d):
    """Rows that depend on a document turn stale when it leaves the active set."""
    m, p = tables(spark, d, "manifest", "parsed_documents")
    active = T.first_of(m.select("record_id", "department", "title").distinct(), ["department", "title"], [F.desc("record_id")]).select("record_id", F.lit(True).alias("on"))
    return p.select("page_id").distinct().join(active, F.col("page_id") == F.col("record_id"), "left").select("page_id", F.coalesce("on", F.lit(False)).alias("fresh"))


@fam.query("select distinct record_id, 'manifest' as src from manifest union select distinct page_id, 'seed' from parsed_documents where page_id not in (select record_id from manifest)")
def h4_seed(spark, d):
    m, p = tables(spark, d, "manifest", "parsed_documents")
    base = m.select("record_id", F.lit("manifest").alias("src")).distinct()
    return T.insert_absent(base, p.select(F.col("page_id").alias("record_id"), F.lit("seed").alias("src")), ["record_id"])


@fam.query("select doc_id, coalesce(source, 'unknown') as source, coalesce(nullif(title, ''), '(untitled)') as title, coalesce(lang, 'und') as lang from documents")
def h6_backfill(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"), F.coalesce("lang", F.lit("und")).alias("lang"))


@fam.query("select distinct case_id, list_filter(elements.subjects, lambda x, i: list_position(elements.subjects, x) = i) as subjects from workorders")
def d1_distinct_order(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.select("case_id", F.array_distinct("elements.subjects").alias("subjects")).distinct()


@fam.query("""
    with u as (select title, record_id, 0 as p from quality_rejected union all select title, record_id, 1 from manifest)
    select title, record_id, p as priority from (select *, row_number() over (partition by title order by p, record_id) as r from (select distinct * from u)) where r = 1
""")
def d2_priority_union(spark, d):
    q, m = tables(spark, d, "quality_rejected", "manifest")
    u = q.select("title", "record_id", F.lit(0).alias("priority")).unionByName(m.select("title", "record_id", F.lit(1).alias("priority")))
    return T.first_of(u, ["title"], [F.col("priority"), F.col("record_id")]).select("title", "record_id", "priority")


@fam.query("select sha256(text) as hash, min(doc_id) as kept, count(*) as copies from documents where text is not null group by 1")
def d3_exact_copies(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.filter("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@fam.query("select record_id from (select record_id, row_number() over (partition by category, title order by record_id) as r from (select distinct record_id, category, title from manifest)) where r > 1")
def d5_repeated_titles(spark, d):
    (m,) = tables(spark, d, "manifest")
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("category", "title").orderBy("record_id"))
    return m.select("record_id", "category", "title").distinct().withColumn("r", r).filter("r > 1").select("record_id")


@fam.query(r"""
    select url, min(record_id) as record_id, count(distinct content_sha256) as versions
    from (select regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '([^:])/+', '\1/', 'g') as url, record_id, content_sha256 from manifest) group by url
""")
def d6_canonical_urls(spark, d):
    from tidewell.functions.text import canonical_url

    (m,) = tables(spark, d, "manifest")
    return m.groupBy(canonical_url(F.col("source_url")).alias("url")).agg(F.min("record_id").alias("record_id"), F.count_distinct("content_sha256").alias("versions"))


@fam.query("select record_id, count(*) as n from manifest group by record_id having count(*) > 1")
def d7_repeated_ids(spark, d):
    (m,) = tables(spark, d, "manifest")
    return m.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1")


@fam.query("""
    with t as (select distinct case_id, list_distinct(elements.subjects) as a from workorders), u as (select list_distinct(flatten(list(a))) as b from t where case_id like '%0')
    select case_id, case when len(a) = 0 then 0.0 else round(len(list_intersect(a, b)) / len(a), 4) end as overlap, round(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 4) as jaccard, len(list_filter(b, lambda x: not list_contains(a, x))) as missing
    from t, u where a is not null
""")
def d8_set_ratios(spark, d):
    """Overlap, Jaccard and missing elements of each array against a reference set (one row)."""
    from tidewell.functions.arrays import jaccard, overlap

    (w,) = tables(spark, d, "workorders")
    t = w.select("case_id", F.array_distinct("elements.subjects").alias("a")).distinct().filter("a is not null")
    ref = t.filter("case_id like '%0'").select(F.explode("a").alias("x")).distinct().agg(F.collect_list("x").alias("b"))
    both = t.join(ref)  # one row
    return both.select("case_id", F.round(overlap("a", "b"), 4).alias("overlap"), F.round(jaccard("a", "b"), 4).alias("jaccard"), F.size(F.array_except("b", "a")).cast("bigint").alias("missing"))


@fam.query("select distinct title from manifest except select title from quality_rejected")
def d12_except(spark, d):
    m, q = tables(spark, d, "manifest", "quality_rejected")
    return m.select("title").distinct().join(q.select("title"), "title", "left_anti")


@fam.query("select doc_id, coalesce(title, '') as title, coalesce(cast(json_extract(props, '$.k') as int), -1) as k from documents left join events on doc_id = event_id")
def c1_nested_default(spark, d):
    x, e = tables(spark, d, "documents", "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1))
    return x.join(e, F.col("doc_id") == F.col("event_id"), "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), k.alias("k"))


@fam.query("select distinct case_id, elements.event as event, 'clerk' as hint, 1 + (multiple_matters)::int as matters from workorders")
def c2_nested_set(spark, d):
    (w,) = tables(spark, d, "workorders")
    e = F.col("elements").withField("contact_hint", F.lit("clerk"))
    return w.select("case_id", e["event"].alias("event"), e["contact_hint"].alias("hint"), (1 + F.col("multiple_matters").cast("int")).alias("matters")).distinct()


@fam.query("select page_id, map_concat(coalesce(meta, map{}), map{'host': 'x', 'seen': cast(page_count as varchar)})['seen'] as seen, len(map_keys(map_concat(coalesce(meta, map{}), map{'host': 'x', 'seen': cast(page_count as varchar)}))) as n from (select distinct on (page_id) * from parsed_documents)")
def c3_map_merge(spark, d):
    from tidewell.functions.arrays import merge_maps

    (p,) = tables(spark, d, "parsed_documents")
    extra = F.create_map(F.lit("host"), F.lit("x"), F.lit("seen"), F.col("page_count").cast("string"))
    m = merge_maps("meta", extra)
    return once(p, "page_id").select("page_id", m["seen"].alias("seen"), F.size(m).cast("bigint").alias("n"))


@fam.query("select page_id, cast(i - 1 as int) as block_no, blocks[i].block_type as block_type, length(blocks[i].text) as chars from (select *, unnest(range(1, len(blocks) + 1)) as i from (select distinct on (page_id) page_id, blocks from parsed_documents))")
def c4_explode(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    return once(p, "page_id").select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", "b.block_type", F.length("b.text").cast("bigint").alias("chars"))


@fam.query("select user_id, list(event_id order by ts, event_id)[-5:] as last5, list(event_id order by ts, event_id)[1] as head from events group by user_id")
def c5_cap_append(spark, d):
    """The last five of an ordered list, and its head; the list itself is never built."""
    (e,) = tables(spark, d, "events")
    last = T.top(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "event_id"))), lambda x: x["event_id"]).alias("last5"))
    head = e.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("head"))
    return last.join(head, "user_id")


@fam.query("select event_id, cast(json_extract(props, '$.k') as int) as k, user_id * 2 as doubled from events")
def c6_json_state(spark, d):
    (e,) = tables(spark, d, "events")
    state = F.from_json(F.to_json(F.struct(F.from_json("props", "k int")["k"].alias("k"), (F.col("user_id") * 2).alias("doubled"))), "k int, doubled bigint")
    return e.select("event_id", state.alias("s")).select("event_id", "s.k", "s.doubled")


@fam.query("select page_id, array_to_string(list_transform(coalesce(blocks, []), lambda b: coalesce(b.block_type, '?') || ':' || coalesce(cast(length(b.text) as varchar), '0')), ';') as outline from (select distinct on (page_id) page_id, blocks from parsed_documents)")
def c7_join_structs(spark, d):
    (p,) = tables(spark, d, "parsed_documents")
    part = lambda b: F.concat(F.coalesce(b["block_type"], F.lit("?")), F.lit(":"), F.coalesce(F.length(b["text"]).cast("string"), F.lit("0")))
    return once(p, "page_id").select("page_id", F.coalesce(F.array_join(F.transform("blocks", part), ";"), F.lit("")).alias("outline"))


@fam.query("select id, list_filter(list_transform(coalesce(expected.location, []), lambda x: trim(x)), lambda x: x <> '') as places from (select distinct on (id) * from intake_cases)")
def c8_as_list(spark, d):
    from tidewell.functions.arrays import as_list

    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").select("id", as_list("expected.location").alias("places"))


@fam.query("select vec_id, round(list_sum(list_transform(embedding, lambda x: round(cast(x as double) * 10000) / 10000)), 2) as total from embeddings")
def c9_round_deep(spark, d):
    (e,) = tables(spark, d, "embeddings")
    s = F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000) / 10000), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(s, 2).alias("total"))


@fam.query("select distinct case_id, replace('Matter: {matter}', '{matter}', coalesce(elements.event, '')) as step from workorders")
def c10_template(spark, d):
    (w,) = tables(spark, d, "workorders")
    return w.select("case_id", F.replace(F.lit("Matter: {matter}"), F.lit("{matter}"), F.coalesce("elements.event", F.lit(""))).alias("step")).distinct()
