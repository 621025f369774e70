"""Routing by rule tables, confidences, guarded states, durations and set differences over whole tables.

Rules are rows (a phrase, a target, an order), so that any vocabulary is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats as ST
from tidewell.operators import joins as J
from tidewell.plans.common import Family, once, tables

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
W = "(select distinct on (case_id) case_id, dept_id, title, source.raw_text as t, elements, created_at, clarity, completeness from workorders)"
_RULES = "(select row_number() over (order by dept_id) as o, dept_id, name as phrase, substr(category, 1, 2) as word from departments)"


def _orders(spark, d):
    (w,) = tables(spark, d, "workorders")
    return once(w, "case_id").select("case_id", "dept_id", "title", F.col("source.raw_text").alias("t"), "elements", "created_at", "clarity", "completeness")


def _documents(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents with words, and the rule table: order, target, priority phrase, keyword."""
    x, dep = tables(spark, d, "documents", "departments")
    rules = dep.select(F.row_number().over(Window.orderBy("dept_id")).alias("o"), F.col("dept_id").alias("target"), F.col("name").alias("phrase"), F.substring("category", 1, 2).alias("word"))  # twelve fixed rows
    return x.filter("text is not null").select("doc_id", "dept_id", F.col("text").alias("t")), rules


def _hits(docs: DataFrame, rules: DataFrame, phrase: str) -> DataFrame:
    return J.contains_join(docs.select("doc_id", "t"), "t", rules.select("o", "target", F.col(phrase).alias("p")), "p").groupBy("doc_id", "target").agg(F.min("o").alias("o"))


@fam.query(f"select doc_id, arg_min(r.dept_id, o) as routed, count(*) as hits from documents d join {_RULES} r on contains(d.text, r.phrase) group by doc_id")
def g1_phrase_route(spark, d):
    """The first priority phrase in table order decides."""
    docs, rules = _documents(spark, d)
    return _hits(docs, rules, "phrase").groupBy("doc_id").agg(F.min_by("target", "o").alias("routed"), F.count("*").alias("hits"))


@fam.query(f"""
    with x as (select doc_id, dept_id, text from documents where text is not null),
    p as (select doc_id, arg_min(r.dept_id, o) as phrase from x join {_RULES} r on contains(x.text, r.phrase) group by 1), k as (select doc_id, arg_min(r.dept_id, o) as word, count(*) as n from x join {_RULES} r on contains(x.text, r.word) group by 1)
    select x.doc_id, coalesce(phrase, word, x.dept_id, 'dept_urban') as routed, case when phrase is not null then 'phrase' when word is not null then 'keyword' when x.dept_id is not null then 'declared' else 'default' end as step,
      round(case when phrase is not null then 0.95 when word is not null then least(0.95, 0.6 + 0.1 * n) when x.dept_id is not null then 0.5 else 0.3 end, 2)::double as confidence
    from x left join p using (doc_id) left join k using (doc_id)
""")
def g4_cascade(spark, d):
    """Priority phrase, then keywords, then what is declared, then a default: the first step that knows decides."""
    docs, rules = _documents(spark, d)
    first = _hits(docs, rules, "phrase").groupBy("doc_id").agg(F.min_by("target", "o").alias("phrase"))
    word = _hits(docs, rules, "word").groupBy("doc_id").agg(F.min_by("target", "o").alias("word"), F.count("*").alias("n"))
    x = docs.select("doc_id", "dept_id").join(first, "doc_id", "left").join(word, "doc_id", "left")
    step = lambda a, b, c, e: F.when(F.col("phrase").isNotNull(), a).when(F.col("word").isNotNull(), b).when(F.col("dept_id").isNotNull(), c).otherwise(e)
    sure = step(F.lit(0.95), F.least(F.lit(0.95), 0.6 + 0.1 * F.col("n")), F.lit(0.5), F.lit(0.3))
    return x.select("doc_id", F.coalesce("phrase", "word", "dept_id", F.lit("dept_urban")).alias("routed"), step(F.lit("phrase"), F.lit("keyword"), F.lit("declared"), F.lit("default")).alias("step"), F.round(sure, 2).alias("confidence"))


@fam.query(f"select doc_id, list_sort(list_distinct(list(r.dept_id) || case when any_value(d.dept_id) is null then []::varchar[] else [any_value(d.dept_id)] end)) as depts from documents d join {_RULES} r on contains(d.text, r.word) group by doc_id")
def g5_expansion(spark, d):
    """What keywords add to the declared target, each once."""
    docs, rules = _documents(spark, d)
    found = _hits(docs, rules, "word").groupBy("doc_id").agg(F.collect_set("target").alias("s"))  # at most the targets of the table
    both = F.array_union("s", F.filter(F.array("dept_id"), lambda x: x.isNotNull()))
    return found.join(docs.select("doc_id", "dept_id"), "doc_id").select("doc_id", F.array_sort(both).alias("depts"))


@fam.query(f"select x.doc_id, round(least(0.95, greatest(0.5, 0.45 + 0.08 * count(r.dept_id))), 4)::double as with_bonus, round(least(0.95, 0.6 + 0.1 * count(r.dept_id)), 4)::double as by_words from (select doc_id, text from documents where text is not null) x left join {_RULES} r on contains(x.text, r.word) group by x.doc_id")
def m11_keyword_confidence(spark, d):
    """A bonus a keyword, clamped; and keywords alone."""
    docs, rules = _documents(spark, d)
    n = F.coalesce("n", F.lit(0))
    x = docs.select("doc_id").join(_hits(docs, rules, "word").groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return x.select("doc_id", F.round(ST.clamp(0.45 + 0.08 * n, 0.5, 0.95), 4).alias("with_bonus"), F.round(F.least(F.lit(0.95), 0.6 + 0.1 * n), 4).alias("by_words"))


@fam.query("select title, count(*) as size, round(least(0.95, 0.5 + 0.02 * count(*)), 4)::double as confidence from documents where title is not null group by title having count(*) >= 2")
def m12_cluster_confidence(spark, d):
    """Confidence of a cluster by its size."""
    (x,) = tables(spark, d, "documents")
    g = x.filter("title is not null").groupBy("title").agg(F.count("*").alias("size")).filter("size >= 2")
    return g.select("title", "size", F.round(F.least(F.lit(0.95), 0.5 + 0.02 * F.col("size")), 4).alias("confidence"))


@fam.query(f"select case_id, round(greatest(0.0, 1 - 0.3 * ((coalesce(t, '') = '')::int + (coalesce(title, '') = '')::int + (coalesce(clarity, 0) < 0.5)::int + (coalesce(completeness, 0) < 0.5)::int)), 2)::double as score from {W}")
def e10_verifier(spark, d):
    """Three tenths off for every issue, not below zero."""
    blank, low = lambda c: F.coalesce(c, F.lit("")) == "", lambda c: F.coalesce(c, F.lit(0.0)) < 0.5
    issues = F.lit(0)
    for x in (blank(F.col("t")), blank(F.col("title")), low(F.col("clarity")), low(F.col("completeness"))):
        issues = issues + x.cast("int")
    return _orders(spark, d).select("case_id", F.round(F.greatest(F.lit(0.0), 1 - 0.3 * issues), 2).alias("score"))


_ALLOWED = (("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("view", "error"), ("error", "view"))


@fam.query(f"""
    with x as (select user_id, event_id, event_type as now, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
    select user_id, count(*) filter (where before is not null) as changes, count(*) filter (where before is not null and (before, now) not in ({", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED)})) as refused from x group by user_id
""")
def e13_transitions(spark, d):
    """Changes of state and those that the guard refuses."""
    (e,) = tables(spark, d, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = e.select("user_id", "event_type", before.alias("before"))
    change = F.concat_ws(">", "before", "event_type")
    known = F.col("before").isNotNull()
    return x.groupBy("user_id").agg(F.count_if(known).alias("changes"), F.count_if(known & ~change.isin([f"{a}>{b}" for a, b in _ALLOWED])).alias("refused"))


@fam.query("select case_id, min((epoch_us(ingested_at) - epoch_us(created_at)) // 1000) as ms from workorders group by case_id")
def t7_duration(spark, d):
    """Milliseconds from one time to another, the shortest of repeated deliveries."""
    (w,) = tables(spark, d, "workorders")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return w.groupBy("case_id").agg(F.min(F.floor((us("ingested_at") - us("created_at")) / 1000).cast("bigint")).alias("ms"))


@fam.query("select p_partkey, levenshtein(p_name, p_brand)::int as name_brand, levenshtein(p_name, p_type)::int as name_type from part")
def m15_edit_distance(spark, d):
    """Edit distances of two columns."""
    (p,) = tables(spark, d, "part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_brand").alias("name_brand"), F.levenshtein("p_name", "p_type").alias("name_type"))


@fam.query("""
    with x as (select distinct on (id) id, coalesce(expected.event, []) as a, coalesce(expected.request, []) as b from intake_cases)
    select id, list_sort(list_distinct(list_filter(a, lambda z: z is not null and not list_contains(b, z)))) as missing, list_sort(list_distinct(list_filter(b, lambda z: z is not null and not list_contains(a, z)))) as extra from x
""")
def d11_difference(spark, d):
    """What one list has and the other lacks, both ways."""
    (c,) = tables(spark, d, "intake_cases")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("expected.event", none), F.coalesce("expected.request", none)
    only = lambda x, y: F.array_sort(F.filter(F.array_except(x, y), lambda z: z.isNotNull()))
    return once(c, "id").select("id", only(a, b).alias("missing"), only(b, a).alias("extra"))

