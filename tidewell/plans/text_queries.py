"""String functions, extraction, compliance checks and metrics (sections 2.8, 2.15, 2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import extraction as X
from tidewell.functions import metrics as M
from tidewell.functions import text as S
from tidewell.plans.common import Family, once, tables

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
W = "(select distinct on (case_id) case_id, dept_id, title, summary, source.raw_text as t, elements, clarity, completeness from workorders)"
C = "(select distinct on (id) * from intake_cases)"
L = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null)"


def _orders(spark, d):
    (w,) = tables(spark, d, "workorders")
    return once(w, "case_id").select("case_id", "dept_id", "title", "summary", F.col("source.raw_text").alias("t"), "elements", "clarity", "completeness")


@fam.query("select distinct on (id) id, translate(received_at, '" + S._WIDE.replace("'", "''") + "', '" + S._HALF.replace("'", "''") + "') as half from intake_cases")
def f1_half_width(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").select("id", S.half_width(F.col("received_at")).alias("half"))


@fam.query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x0b\f\x{00A0}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as tidy from documents")
def f2_tidy(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", S.tidy_space(F.col("text")).alias("tidy"))


@fam.query(r"select doc_id, count(*) as lines, count_if(regexp_matches(line, '^\s*第\s*\d+\s*页\s*共\s*\d+\s*页\s*$|^\s*\d+\s*$|^\s*(版权所有|内部资料|严禁外传)\s*$') or length(regexp_replace(line, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) < 2) as noise from " + L + " group by doc_id")
def f3_noise_lines(spark, d):
    (x,) = tables(spark, d, "documents")
    lines = x.filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(S.is_noise(F.col("line"))).alias("noise"))


@fam.query("select doc_id, len(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) as tokens from documents where text is not null")
def f5_tokens(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.filter("text is not null").select("doc_id", F.size(S.tokens(F.col("text"))).cast("bigint").alias("tokens"))


@fam.query("""
    with p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) as term from documents where text is not null) group by 1, 2),
    n as (select count(*) as n from documents where text is not null and len(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) > 0), f as (select term, count(*) as df from p group by 1), s as (select doc_id, term, round(tf * ln(n / df), 6) as w from p join f using (term), n)
    select doc_id, list(term order by w desc, term) as keywords from (select *, row_number() over (partition by doc_id order by w desc, term) as r from s) where r <= 6 group by doc_id
""")
def f6_keywords(spark, d):
    from tidewell.operators.retrieval import postings
    from tidewell.operators.tables import top
    from tidewell.session import materialise, spread

    (x,) = tables(spark, d, "documents")
    p = materialise(postings(spread(x).filter("text is not null"), "doc_id", "text"), "f6")  # tokenised once, used three times
    n = p.select("doc_id").distinct().agg(F.count("*").alias("n"))
    f = p.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    s = p.join(f, "term").select("doc_id", "term", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6).alias("w"))
    t = top(s, ["doc_id"], [F.desc("w"), F.col("term")], 6)
    return t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda z: z["term"]).alias("keywords"))


@fam.query(rf"select case_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|[^0-9])(\d{{17}}[0-9Xx])($|[^0-9])', '\1[身份证]\3', 'g'), '(^|[^0-9])(\d{{17}}[0-9Xx])($|[^0-9])', '\1[身份证]\3', 'g'), '(^|[^0-9])(1[3-9]\d{{9}}|0\d{{2,3}}[- ]?\d{{7,8}})($|[^0-9])', '\1[电话]\3', 'g'), '(^|[^0-9])(1[3-9]\d{{9}}|0\d{{2,3}}[- ]?\d{{7,8}})($|[^0-9])', '\1[电话]\3', 'g') as masked from {W}")
def f7_mask(spark, d):
    return _orders(spark, d).select("case_id", S.mask_numbers(F.col("t")).alias("masked"))


@fam.query("select case_id, coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 0), '')" for p in S.TIMES) + f") as time_text from {W}")
def f8_time(spark, d):
    return _orders(spark, d).select("case_id", S.first_time(F.col("t")).alias("time_text"))


_ALIAS = [("街办", "街道"), ("号楼", "幢"), ("栋", "幢"), ("座", "幢"), ("#", "号")]


@fam.query(f"select case_id, replace(replace(replace(replace(replace(elements.location, '街办', '街道'), '号楼', '幢'), '栋', '幢'), '座', '幢'), '#', '号') as place from {W}")
def f10_aliases(spark, d):
    return _orders(spark, d).select("case_id", S.replace_all(F.col("elements.location"), _ALIAS).alias("place"))


_SENT = r"list_filter(list_transform(regexp_split_to_array({0}, '[。；;！？!?\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@fam.query(f"select case_id, {_SENT.format('t')} as sentences from {W} where t is not null")
def f11_sentences(spark, d):
    return _orders(spark, d).filter("t is not null").select("case_id", S.sentences(F.col("t")).alias("sentences"))


@fam.query(rf"""
    select id, substr(regexp_replace(case when len(h) > 0 then h[-1] when len(q) > 0 then q[-1] end, '^\s+|\s+$', '', 'g'), 1, 180) as request from (
    select id, regexp_extract_all(text, '(?:{"|".join(X.REQUEST_MARKS)})([^。！？!?\n；;]+)', 1) as h, regexp_extract_all(text, '([^。！？!?\n；;]+[？?])', 1) as q from {C})
""")
def f12_request(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").select("id", X.request_of(F.col("text")).alias("request"))


_TOPICS = ["噪音", "电梯", "垃圾", "路灯", "停车", "拖欠"]


@fam.query(f"""
    select case_id, case when len(h) > 0 then array_to_string(h[1:3], '；') else list_sort(list_transform(s, lambda x: {{'n': length(x), 's': x}}), 'desc')[1].s end as event from (
    select case_id, s, list_filter(s, lambda x: {" or ".join(f"contains(x, '{w}')" for w in _TOPICS)}) as h from (select case_id, {_SENT.format("t")} as s from {W} where t is not null))
""")
def f13_event(spark, d):
    return _orders(spark, d).filter("t is not null").select("case_id", X.event_of(F.col("t"), _TOPICS).alias("event"))


@fam.query(f"select case_id, list_filter([case when {' or '.join(f"contains(t, '{w}')" for w in X.DEIXIS)} then 'deixis' end, case when length(t) > 80 and regexp_matches(t, '并且|同时|另外|以及') then 'several' end, case when length(coalesce(elements.location, '')) < 4 then 'location' end], lambda x: x is not null) as flags from {W} where t is not null")
def f15_ambiguity(spark, d):
    return _orders(spark, d).filter("t is not null").select("case_id", X.ambiguity(F.col("t"), F.col("elements.location")).alias("flags"))


@fam.query(f"with x as (select case_id, unnest({_SENT.format('t')}) as s from {W} where t is not null), k as (select unnest({_TOPICS}) as w) select case_id, w as topic, count(*) as n from x join k on contains(s, w) group by 1, 2")
def f16_matters(spark, d):
    """Sentences by topic word; the words are a short literal list."""
    s = _orders(spark, d).filter("t is not null").select("case_id", F.explode(S.sentences(F.col("t"))).alias("s"))
    hit = F.explode(F.filter(F.array(*map(F.lit, _TOPICS)), lambda w: F.contains(F.col("s"), w)))
    return s.select("case_id", hit.alias("topic")).groupBy("case_id", "topic").agg(F.count("*").alias("n"))


@fam.query()
def f17_undouble(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    return once(t, "case_id", "turn_idx").select("case_id", "turn_idx", S.undouble(F.col("text")).alias("text"))


@fam.query(r"select distinct case_id, turn_idx, regexp_extract(trim(text), '^(接线员|市民|群众|客服|坐席)\s*[:：]', 1) as label from dialogue_turns where text is not null")
def f19_labels(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    return t.filter("text is not null").select("case_id", "turn_idx", F.regexp_extract(F.trim("text"), r"^(接线员|市民|群众|客服|坐席)\s*[:：]", 1).alias("label")).distinct()


@fam.query(f"select case_id, substr(concat_ws('：', elements.event, elements.request), 1, 48) as title, substr(concat_ws(' ', elements.time_text, elements.location, elements.event, elements.request), 1, 300) as summary from {W}")
def f21_templates(spark, d):
    e = "elements."
    return _orders(spark, d).select("case_id", F.substring(F.concat_ws("：", e + "event", e + "request"), 1, 48).alias("title"), F.substring(F.concat_ws(" ", e + "time_text", e + "location", e + "event", e + "request"), 1, 300).alias("summary"))


_KINDS = [("办法|规定", "policy"), ("指南|怎么办", "guide"), ("通知|公告", "notice"), ("回应|推进", "news")]


@fam.query("select doc_id, case " + " ".join(f"when regexp_matches(title, '{p}') then '{v}'" for p, v in _KINDS) + " else 'other' end as kind from documents")
def f22_kind(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", S.first_rule(F.col("title"), _KINDS, "other").alias("kind"))


@fam.query("select doc_id, concat_ws(chr(10), nullif(title, ''), nullif(doc_type, ''), nullif(text, '')) as retrieval_text from documents")
def f23_retrieval_text(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("title", "doc_type", "text")]).alias("retrieval_text"))


@fam.query("select item_id, list_distinct([query] || list_filter(regexp_split_to_array(query, '[，、和]'), lambda x: length(x) >= 6)[1:3] || [replace(query, '按什么', '依据什么')]) as n from eval_items where false union all select item_id, list_sort(list_distinct([query] || list_filter(regexp_split_to_array(query, '[，、和]'), lambda x: length(x) >= 6)[1:3] || [replace(query, '按什么', '依据什么')])) from eval_items")
def f24_expand(spark, d):
    """A query, its parts, and a rewording, without repeats."""
    (i,) = tables(spark, d, "eval_items")
    q = F.col("query")
    parts = F.slice(F.filter(F.split(q, "[，、和]"), lambda x: F.length(x) >= 6), 1, 3)
    return i.select("item_id", F.array_sort(F.array_distinct(F.concat(F.array(q), parts, F.array(F.replace(q, F.lit("按什么"), F.lit("依据什么")))))).alias("n"))


@fam.query("select doc_id, regexp_replace(lower(title), '[^一-鿿a-z0-9]', '', 'g') as plain from documents")
def f26_normal(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.select("doc_id", S.alnum_only(F.col("title")).alias("plain"))


@fam.query("select doc_id, case when length(title) < 2 then []::varchar[] else list_transform(range(1, length(title)), lambda i: substr(title, i::int, 2)) end as grams from documents where title is not null")
def f27_bigrams(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.filter("title is not null").select("doc_id", S.bigrams(F.col("title")).alias("grams"))


@fam.query(r"""select distinct record_id, substr(regexp_replace(regexp_replace(translate(title, '""" + S._WIDE.replace("'", "''") + "', '" + S._HALF.replace("'", "''") + r"""'), '[\\/:*?"<>|\s]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 92) as name from manifest""")
def f28_safe_name(spark, d):
    (m,) = tables(spark, d, "manifest")
    return m.select("record_id", S.safe_name(F.col("title")).alias("name")).distinct()


@fam.query(r"select distinct record_id, regexp_replace(replace(source_url, '://', '://user:pw@'), '//[^/@\s]+@', '//***@', 'g') as safe from manifest")
def f31_redact(spark, d):
    (m,) = tables(spark, d, "manifest")
    return m.select("record_id", S.redact_credentials(F.replace("source_url", F.lit("://"), F.lit("://user:pw@"))).alias("safe")).distinct()


@fam.query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def f32_json_inside(spark, d):
    (e,) = tables(spark, d, "events")
    wrapped = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", S.json_inside(wrapped, "k int")["k"].alias("k"))


@fam.query("select doc_id, list_transform(range(0, (length(text) + 599) // 600), lambda i: substr(text, (i * 600 + 1)::int, 600)) as slices from documents where text is not null")
def x13_slices(spark, d):
    (x,) = tables(spark, d, "documents")
    return x.filter("text is not null").select("doc_id", S.pieces(F.col("text"), 600).alias("slices"))


# --- extraction and checks -------------------------------------------------------------------------


@fam.query(f"select id, round(len(list_filter(q, lambda x: contains(text, x))) / nullif(len(q), 0), 6) as ratio, coalesce(len(list_filter(q, lambda x: contains(text, x))) / nullif(len(q), 0) >= 0.75, false) as enough from (select id, text, coalesce(expected.event, []) || coalesce(expected.request, []) as q from {C})")
def e3_evidence(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    q = F.concat(F.coalesce("expected.event", F.array().cast("array<string>")), F.coalesce("expected.request", F.array().cast("array<string>")))
    r = X.evidence_ratio(q, F.col("text"))
    return once(c, "id").select("id", F.round(r, 6).alias("ratio"), F.coalesce(r >= 0.75, F.lit(False)).alias("enough"))


@fam.query(f"select case_id, case when length(coalesce(elements.location, '')) > length(coalesce(title, '')) then elements.location else title end as longer, coalesce(nullif(elements.time_text, ''), 'unknown') as time_text from {W}")
def e4_merge(spark, d):
    e = F.col("elements.location")
    return _orders(spark, d).select("case_id", F.when(F.length(F.coalesce(e, F.lit(""))) > F.length(F.coalesce("title", F.lit(""))), e).otherwise(F.col("title")).alias("longer"), F.coalesce(F.nullif("elements.time_text", F.lit("")), F.lit("unknown")).alias("time_text"))


@fam.query("select id, coalesce(text, '') || chr(10) || array_to_string(coalesce(expected.request, []), '；') as answer from " + C)
def e12_structure(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").select("id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce(F.array_join("expected.request", "；"), F.lit(""))).alias("answer"))


# --- metrics ------------------------------------------------------------------------------------------


@fam.query()
def v6_error_rate(spark, d):
    return _orders(spark, d).select("case_id", F.round(M.error_rate(F.col("title"), F.col("summary")), 6).alias("cer"))


@fam.query("select case_id, round(greatest(0.0, 1 - levenshtein(a, b) / greatest(length(a), length(b))), 6)::double as accuracy from (select case_id, string_agg(case when role in ('operator', 'agent', '坐席') then 'o' else 'c' end, '' order by turn_idx) as a, string_agg(case when turn_idx % 2 = 0 then 'o' else 'c' end, '' order by turn_idx) as b from (select distinct case_id, turn_idx, role from dialogue_turns) group by 1)")
def v7_role_accuracy(spark, d):
    (t,) = tables(spark, d, "dialogue_turns")
    letter = F.when(F.col("role").isin("operator", "agent", "坐席"), "o").otherwise("c")
    guess = F.when(F.col("turn_idx") % 2 == 0, "o").otherwise("c")
    g = once(t, "case_id", "turn_idx").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", letter.alias("a"), guess.alias("b")))).alias("x"))
    s = lambda c: F.array_join(F.transform("x", lambda z: z[c]), "")
    return g.select("case_id", F.round(M.sequence_accuracy(s("a"), s("b")), 6).alias("accuracy"))


@fam.query()
def v8_diarization(spark, d):
    """Error of the segments with odd index moved by a fifth of a second, against themselves."""
    (s,) = tables(spark, d, "transcript_segments")
    s = once(s.filter("start_sec is not null and speaker_id is not null"), "call_id", "seg_idx")
    who = F.regexp_extract("speaker_id", r"(\d+)", 1)
    ref = s.select("call_id", F.lit("ref").alias("side"), who.alias("speaker"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    hyp = s.select("call_id", F.lit("hyp").alias("side"), F.concat(F.lit("x"), who).alias("speaker"), (F.col("start_sec") + 0.2).alias("start"), (F.col("end_sec") + 0.2).alias("end"))
    out = M.diarization_error(ref.unionByName(hyp), "call_id")
    return out.select("call_id", *[F.round(c, 6).alias(c) for c in ("der", "miss", "false_alarm", "confusion")])


_G = "(select case_id, g, count(*) as n from (select case_id, unnest(list_transform(range(1, length({0})), lambda i: substr({0}, i::int, 2))) as g from {1} where length({0}) >= 2) group by 1, 2)"


@fam.query(f"""
    with a as {_G.format('title', W)}, b as {_G.format('summary', W)}, m as (select case_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) as m, sum(coalesce(a.n, 0)) as sa, sum(coalesce(b.n, 0)) as sb from a full join b using (case_id, g) group by case_id)
    select w.case_id, round(coalesce(m / nullif(sb, 0), 0), 6)::double as precision, round(coalesce(m / nullif(sa, 0), 0), 6)::double as recall, round(coalesce(2 * m / nullif(sa + sb, 0), 0), 6)::double as f1 from {W} w left join m using (case_id)
""")
def v10_bigram_f1(spark, d):
    out = M.bigram_overlap(_orders(spark, d).select("case_id", "title", "summary"), "case_id", "title", "summary")
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@fam.query()
def v11_similarity(spark, d):
    """Best of containment and ratio of matching blocks."""
    x = _orders(spark, d).select("case_id", F.coalesce("title", F.lit("")).alias("a"), F.coalesce("summary", F.lit("")).alias("b"))
    inside = (F.contains("b", "a") & (F.length("a") > 0)).cast("double")
    return x.select("case_id", F.round(F.greatest(inside, M.match_ratio("a", "b")), 6).alias("similarity"))


@fam.query(f"select id, round(len(list_filter(e, lambda x: contains(text, x))) / len(e), 6) as accuracy from (select id, text, expected.event as e from {C}) where len(e) > 0 and text is not null")
def v4_field_accuracy(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    return once(c, "id").filter("size(expected.event) > 0 and text is not null").select("id", F.round(X.evidence_ratio(F.col("expected.event"), F.col("text")), 6).alias("accuracy"))


@fam.query(f"select count(*) as n, round(avg((official_label.handling_units[1] = '市' || official_label.category)::int), 6) as top1, round(avg(list_contains(official_label.handling_units, '市城市管理局')::int), 6) as topk from {C} where len(official_label.handling_units) > 0")
def v5_routing(spark, d):
    (c,) = tables(spark, d, "intake_cases")
    u = F.col("official_label.handling_units")
    top1 = (F.element_at(u, 1) == F.concat(F.lit("市"), "official_label.category")).cast("int")
    return once(c, "id").filter("size(official_label.handling_units) > 0").agg(F.count("*").alias("n"), F.round(F.avg(top1), 6).alias("top1"), F.round(F.avg(F.array_contains(u, "市城市管理局").cast("int")), 6).alias("topk"))


@fam.query(f"select metric, value, case when metric = 'cer' then value <= bar else value >= bar end as ok from (select 'clarity' as metric, round(avg(clarity), 6) as value, 0.6::double as bar from {W} union all select 'completeness', round(avg(completeness), 6), 0.5 from {W} union all select 'cer', round(1 - avg(clarity), 6), 0.4 from {W})")
def v13_gate_table(spark, d):
    w = _orders(spark, d)
    m = w.agg(F.round(F.avg("clarity"), 6).alias("clarity"), F.round(F.avg("completeness"), 6).alias("completeness"), F.round(1 - F.avg("clarity"), 6).alias("cer"))
    long = m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(b).alias("bar")) for k, b in (("clarity", 0.6), ("completeness", 0.5), ("cer", 0.4))])))
    return long.select("metric", "value", F.when(F.col("metric") == "cer", F.col("value") <= F.col("bar")).otherwise(F.col("value") >= F.col("bar")).alias("ok"))


@fam.query("select 'repeated id' as issue, count(*) as n from (select call_id, seg_idx from transcript_segments group by 1, 2 having count(*) > 1) union all select 'no text', count(*) from transcript_segments where coalesce(trim(text), '') = '' union all select 'end before start', count(*) from transcript_segments where end_sec < start_sec union all select 'no time', count(*) from transcript_segments where start_sec is null")
def v18_validation(spark, d):
    (s,) = tables(spark, d, "transcript_segments")
    rep = s.groupBy("call_id", "seg_idx").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id").alias("issue"), "n")
    one = s.agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("a"), F.count_if(F.col("end_sec") < F.col("start_sec")).alias("b"), F.count_if(F.col("start_sec").isNull()).alias("c"))
    rest = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(c).alias("n")) for k, c in (("no text", "a"), ("end before start", "b"), ("no time", "c"))])))
    return rep.unionByName(rest)
