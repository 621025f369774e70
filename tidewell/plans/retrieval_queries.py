"""Retrieval, vectors, clustering, routing by tables (sections 2.10, 2.13, 2.14, 2.17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import bigrams, tokens
from tidewell.operators import graphs as G
from tidewell.operators import retrieval as R
from tidewell.operators import tables as T
from tidewell.plans.common import Family, tables
from tidewell.session import materialise, spread

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
_TOK = "regexp_extract_all(lower({0}), '[一-鿿]|[a-z0-9]+')"
_BM25 = f"""
    d as (select doc_id, {_TOK.format('text')} as t from documents where text is not null), l as (select doc_id, len(t) as dl, t from d where len(t) > 0),
    p as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(t) as term from l) group by 1, 2, 3), s as (select count(*) as n, avg(dl) as avgdl from l),
    q as (select item_id, term, count(*) as qtf from (select item_id, unnest({_TOK.format('query')}) as term from eval_items) group by 1, 2), df as (select term, count(*) as df from p group by term),
    sc as (select item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) as score from q join p using (term) join df using (term), s group by 1, 2),
    lex as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from sc)
"""


@fam.query("select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(" + _TOK.format("text") + ") as term from documents where text is not null) group by 1, 2) group by term")
def a22_term_statistics(spark, d):
    (x,) = tables(spark, d, "documents")
    return R.term_statistics(spread(x), "text")


def _lexical(spark, d, k=20):
    x, q = tables(spark, d, "documents", "eval_items")
    scored = R.bm25(spread(x).filter("text is not null"), "doc_id", "text", q, "item_id", "query").withColumn("score", F.round("score", 9))
    return R.top_k(scored, "item_id", "doc_id", k)


@fam.query(f"with {_BM25} select item_id, doc_id, round(score, 5) as score, rank::int as rank from lex where rank <= 20")
def r1_lexical(spark, d):
    """BM25 of every evaluation query against every document, the 20 best each."""
    return _lexical(spark, d).select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


_COS = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9)"


@fam.query(f"""
    with q as (select vec_id as query_id, embedding from embeddings where vec_id % 100 = 0), s as (select query_id, b.vec_id, {_COS} as score from q a, embeddings b)
    select query_id, vec_id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 10
""")
def r2_vector(spark, d):
    """Every vector whose id is divisible by 100 against all vectors, the ten nearest."""
    (e,) = tables(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_top_k(e, "vec_id", "embedding", q, "query_id", "q", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@fam.query(f"""
    with {_BM25}, alt as (select item_id, doc_id, row_number() over (partition by item_id order by round(0.5 * score + 0.001 * (doc_id % 97), 9) desc, doc_id) as rank from sc),
    u as (select item_id, doc_id, 1.0 / (60 + rank) as w from lex where rank <= 20 union all select item_id, doc_id, 0.7 / (60 + rank) from alt where rank <= 20),
    f as (select item_id, doc_id, round(sum(w), 9) as score from u group by 1, 2)
    select item_id, doc_id, score::double as score, r::int as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from f) where r <= 5
""")
def r3_fused(spark, d):
    """Two rankings of one query table, fused with weights 1.0 and 0.7."""
    x, q = tables(spark, d, "documents", "eval_items")
    scored = R.bm25(spread(x).filter("text is not null"), "doc_id", "text", q, "item_id", "query")
    lex = R.top_k(scored.withColumn("score", F.round("score", 9)), "item_id", "doc_id", 20)
    alt = R.top_k(scored.withColumn("score", F.round(0.5 * F.col("score") + 0.001 * (F.col("doc_id") % 97), 9)), "item_id", "doc_id", 20)
    fused = R.fuse([lex, alt], "item_id", "doc_id", [1.0, 0.7]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, "item_id", "doc_id", 5)


@fam.query(f"""
    with {_BM25}, h as (select (item_id // 10) as grp, item_id as part, doc_id, round(score, 4) as score from lex where rank <= 20),
    f as (select *, row_number() over (partition by grp, part order by score desc, doc_id) as b from h), g as (select grp, doc_id, max(score) as score, min(part) filter (b = 1) as first from f group by 1, 2)
    select grp, doc_id, score, r::int as rank from (select *, row_number() over (partition by grp order by first nulls last, score desc, doc_id) as r from g) where r <= 8
""")
def k4_coverage(spark, d):
    """Of queries that belong together, the best hit of each comes first."""
    h = _lexical(spark, d).select(F.floor(F.col("item_id") / 10).alias("grp"), F.col("item_id").alias("part"), "doc_id", F.round("score", 4).alias("score"))
    return R.coverage_top_k(h, "grp", "part", "doc_id", "score", 8)


@fam.query(f"""
    with {_BM25}, h as (select (item_id // 10) as grp, item_id, doc_id, round(score, 4) as score, 1.0 / (60 + rank) as w from lex where rank <= 20)
    select grp, doc_id, round(sum(w), 8)::double as evidence, list_sort(list(distinct item_id)) as matched, max(score) as best from h group by 1, 2
""")
def a16_multi_query(spark, d):
    h = _lexical(spark, d).select(F.floor(F.col("item_id") / 10).alias("grp"), "item_id", "doc_id", F.round("score", 4).alias("score"), (1.0 / (60 + F.col("rank"))).alias("w"))
    return h.groupBy("grp", "doc_id").agg(F.round(F.sum("w"), 8).alias("evidence"), F.sort_array(F.collect_set("item_id")).alias("matched"), F.max("score").alias("best"))


@fam.query(f"with {_BM25}, h as (select * from lex where rank <= 10) select h.item_id, h.doc_id, round(h.score + 0.3 * len(list_intersect(list_distinct({_TOK.format('i.query')}), list_distinct({_TOK.format('x.text')}))) / greatest(len(list_distinct({_TOK.format('i.query')})), 1) + 0.2 * regexp_matches(x.text, '第[一二三四五六七八九十百0-9]+条')::int, 5) as score from h join eval_items i using (item_id) join documents x using (doc_id)")
def m5_rerank(spark, d):
    x, q = tables(spark, d, "documents", "eval_items")
    h = _lexical(spark, d, 10).join(q.select("item_id", "query"), "item_id").join(x.select("doc_id", "text"), "doc_id")
    return h.select("item_id", "doc_id", F.round(R.rerank_score(F.col("score"), F.col("query"), F.col("text")), 5).alias("score"))


@fam.query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 as finite from embeddings")
def m7_vector_check(spark, d):
    """Norm and finiteness of each vector (M2, M7)."""
    (e,) = tables(spark, d, "embeddings")
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(n, 5).alias("norm"), F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@fam.query("""
    with t as (select dept_id, regexp_replace(lower(name), '\\s+', '', 'g') as t from departments), g as (select dept_id, t as g from t union all select dept_id, substr(t, i, 2) from (select dept_id, t, unnest(range(1, length(t))) as i from t where length(t) > 2)),
    s as (select dept_id, g from g union all select dept_id, g || ' ' from g), c as (select dept_id, (('0x' || substr(md5(g), 1, 8))::bigint % 128)::int as cell, case when ('0x' || substr(md5(g), 9, 2))::int % 2 = 0 then 1.0 else -1.0 end as v from s)
    select dept_id, cell, sum(v)::double as v from c group by 1, 2
""")
def m6_hash_embedding(spark, d):
    """The cells of the hash vector of each department's name, before normalising."""
    (dep,) = tables(spark, d, "departments")
    return dep.select("dept_id", F.explode(R.hash_vector(F.col("name"))).alias("c")).groupBy("dept_id", F.col("c.i").alias("cell")).agg(F.sum("c.s").alias("v"))


@fam.query("""
    with p as (select label, vec_id, embedding from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) where r <= 12),
    s as (select b.vec_id, p.label, list_cosine_similarity(p.embedding::double[], b.embedding::double[]) as sim from embeddings b, p where b.vec_id <> p.vec_id),
    t as (select vec_id, label, avg(sim) as score from (select *, row_number() over (partition by vec_id, label order by sim desc) as r from s) where r <= 3 group by 1, 2)
    select vec_id, label::int as label, round(score, 5) as score from (select *, row_number() over (partition by vec_id order by round(score, 9) desc, label) as r from t) where r = 1
""")
def m9_prototypes(spark, d):
    """Each vector by its mean similarity to the three nearest prototypes of a label; prototypes are twelve rows a label."""
    (e,) = tables(spark, d, "embeddings")
    proto = T.top(e, ["label"], [F.col("vec_id")], 12).select("label", F.col("vec_id").alias("proto"), F.col("embedding").alias("pv"))
    best = R.prototype_scores(e, "vec_id", "embedding", proto, "proto", "label", "pv", 3)
    return T.top(best, ["vec_id"], [F.desc(F.round("score", 9)), F.col("label")], 1, "r").select("vec_id", "label", F.round("score", 5).alias("score"))


@fam.query()
def q1_clusters(spark, d):
    """Density clusters of all vectors; every row meets every other, and tasks return spanning forests of their edges."""
    (e,) = tables(spark, d, "embeddings")
    near = materialise(R.near_pairs(e, "vec_id", "embedding", 0.1, forest=True), "q1_edges")
    return G.components(near, "a", "b", lambda df: materialise(df, "q1")).select(F.col("vertex").alias("vec_id"), F.col("component").alias("cluster"))


@fam.query("select grp, count(*) as n from (select regexp_extract(lower(title), '[一-鿿]|[a-z0-9]+', 0) as grp from documents where title is not null) where grp <> '' group by grp having count(*) >= 2")
def q2_first_token_groups(spark, d):
    (x,) = tables(spark, d, "documents")
    g = x.filter("title is not null").select(F.try_element_at(tokens(F.col("title")), F.lit(1)).alias("grp"))
    return g.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).filter("n >= 2")


@fam.query("select d.doc_id, min(x.dept_id) as routed, count(*) as hits from documents d join departments x on contains(d.text, x.name) group by d.doc_id")
def g2_keyword_route(spark, d):
    """The first department, in table order, whose name the text contains, and how many are named."""
    from tidewell.operators.joins import contains_join

    x, dep = tables(spark, d, "documents", "departments")
    hit = contains_join(x.select("doc_id", "text"), "text", dep.select("dept_id", "name"), "name").select("doc_id", "dept_id").distinct()
    return hit.groupBy("doc_id").agg(F.min("dept_id").alias("routed"), F.count("*").alias("hits"))


@fam.query("""
    with x as (select distinct case_id, elements.event as t from workorders where case_id is not null and length(elements.event) > 1), k as (select t, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i::int, 2))) as b from (select distinct t from x)),
    p as (select a.t, b.t as other, len(list_intersect(a.b, b.b)) as shared from k a join k b on len(list_intersect(a.b, b.b)) > 0), m as (select h.case_id, p.other, p.shared, min(x.case_id) as match from x h join p using (t) join x on x.t = p.other and x.case_id <> h.case_id where h.case_id like '%0' group by 1, 2, 3),
    g as (select case_id, match, max(shared) as shared from m group by 1, 2)
    select case_id, match, shared from g qualify row_number() over (partition by case_id order by shared desc, match) <= 3
""")
def r7_history(spark, d):
    """The three matters among all others that share most bigrams, one row standing for equal texts."""
    (w,) = tables(spark, d, "workorders")
    x = w.select("case_id", F.col("elements.event").alias("t")).distinct().filter("case_id is not null and length(t) > 1")
    grams = x.select("t").distinct().select("t", F.explode(F.array_distinct(bigrams(F.col("t")))).alias("g"))
    new = x.filter("case_id like '%0'")
    asked = grams.join(new.select("t").distinct(), "t")
    shared = asked.join(grams.withColumnRenamed("t", "other"), "g").groupBy("t", "other").agg(F.count("*").alias("shared"))
    # the two smallest cases of a text: one of them isn't the asking case
    stands = T.top(x, ["t"], [F.col("case_id")], 2).select(F.col("t").alias("other"), F.col("case_id").alias("match"))
    found = new.join(shared, "t").join(stands, "other").filter("match <> case_id").groupBy("case_id", "other", "shared").agg(F.min("match").alias("match"))
    found = found.groupBy("case_id", "match").agg(F.max("shared").alias("shared"))
    return T.top(found, ["case_id"], [F.desc("shared"), F.col("match")], 3).drop("rank")


@fam.query("select dept_id, case when n >= 5 and acc >= 0.8 then 'out' when acc >= 0.8 then 'on' else 'in' end as phase from (select dept_id, count(*) as n, avg((handoff_status = 'completed')::int + 0.6 * (handoff_status = 'processing')::int) as acc from (select distinct on (case_id) * from workorders) group by 1)")
def g8_phase(spark, d):
    (w,) = tables(spark, d, "workorders")
    w = w.dropDuplicates(["case_id"])
    acc = F.avg((F.col("handoff_status") == "completed").cast("int") + 0.6 * (F.col("handoff_status") == "processing").cast("int"))
    g = w.groupBy("dept_id").agg(F.count("*").alias("n"), acc.alias("acc"))
    return g.select("dept_id", F.when((F.col("n") >= 5) & (F.col("acc") >= 0.8), "out").when(F.col("acc") >= 0.8, "on").otherwise("in").alias("phase"))
