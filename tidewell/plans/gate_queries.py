"""The gate for drafted replies, filters on either end and on time, whole records, and word-processor documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import extraction as X
from tidewell.functions import stats as ST
from tidewell.functions import text as S
from tidewell.plans.common import Family, once, tables
from tidewell.sources import office

fam = Family()
queries, oracle_sql = lambda: fam.found, lambda: fam.sql
W = "(select distinct on (case_id) case_id, dept_id, title, summary, region, source.raw_text as t, elements, clarity, completeness from workorders)"


def _orders(spark, d):
    (w,) = tables(spark, d, "workorders")
    return once(w, "case_id").select("case_id", "dept_id", "title", "summary", "region", F.col("source.raw_text").alias("t"), "elements", "clarity", "completeness")


def _failed_sql(draft: str, malformed: str, unknown: str, support: str, verified: str) -> str:
    """The eight checks in SQL, for one citation."""
    text = f"regexp_replace(coalesce({draft}, ''), '^\\s+|\\s+$', '', 'g')"
    line_ok = f"(regexp_matches(x, '{X.SOURCE_MARKER}') or regexp_matches(trim(x), '^\\*\\*.*\\*\\*$') or trim(x) like '%如下：' or trim(x) like '%如下:')"
    none = " or ".join(f"contains(s, '{m}')" for m in X.NO_EVIDENCE)
    claims = f"len(list_filter(regexp_extract_all(x, '[^。！？\\n]+[。！？]?'), lambda s: regexp_matches(s, '{X.POLICY_CLAIM}') and not ({none}))) > 0"
    moved = f"regexp_replace({text}, '([。！？])\\s*(\\[来源\\s*\\d+\\])', '\\2\\1', 'g')"
    public = ", ".join(f"'{n}'" for n in X.PUBLIC_NUMBERS)
    tests = (
        f"{text} = ''", f"{malformed} or {unknown}",
        f"len(list_filter(regexp_extract_all({text}, '{X.SOURCE_MARKER}', 1), lambda m: m::int < 1 or m::int > 1)) > 0",
        f"len(list_filter(string_split({moved}, chr(10)), lambda x: not {line_ok} and {claims})) > 0",
        f"len(list_filter(regexp_extract_all(regexp_replace({text}, '{X.SOURCE_MARKER}', '', 'g'), '\\d+(?:\\.\\d+)?%?'), lambda n: n not in ({public}) and not contains({support}, n))) > 0",
        f"regexp_matches({text}, '{X.OVERPROMISE}')",
        f"regexp_matches({text}, '(^|[^0-9])1[3-9][0-9]{{9}}($|[^0-9])|(^|[^0-9A-Za-z])[0-9]{{17}}[0-9Xx]($|[^0-9A-Za-z])')",
        f"not ({verified})",
    )
    return "list_filter([" + ", ".join(f"case when {t} then '{n}' end" for n, t in zip(X.CHECKS, tests, strict=True)) + "], lambda z: z is not null)"


_DRAFT = "coalesce(summary, '') || chr(10) || '应当在' || (length(coalesce(t, '')) % 9)::varchar || '日内答复。' || case when coalesce(clarity, 0) > 0.5 then '[来源1]' else '' end"
_BLANK = "coalesce(trim({0}) = '', true)"
_MALFORMED = " or ".join(_BLANK.format(x) for x in ("dept_id", "title", "substr(t, 1, 20)"))


@fam.query(f"""
    with x as (select case_id, {_failed_sql(_DRAFT, f'({_MALFORMED})', "right(coalesce(dept_id, ''), 1) not in ('1', '2', '3', '4', '5', '6')", "coalesce(t, '')", "coalesce(completeness, 0) >= 0.5")} as failed from {W})
    select case_id, failed, len(failed) = 0 as passed, round((8 - len(failed)) / 8.0, 4)::double as score from x
""")
def e5_reply_gate(spark, d):
    """All eight checks of a drafted reply (E5 to E10): which fail, and the share that passes."""
    x = _orders(spark, d)
    t = F.coalesce("t", F.lit(""))
    draft = F.concat(F.coalesce("summary", F.lit("")), F.lit("\n应当在"), (F.length(t) % 9).cast("string"), F.lit("日内答复。"), F.when(F.coalesce("clarity", F.lit(0.0)) > 0.5, "[来源1]").otherwise(""))
    cited = F.array(F.struct(F.col("dept_id").alias("doc_id"), F.col("title").alias("doc_title"), F.substring("t", 1, 20).alias("snippet")))
    ends = F.array(*[F.lit(c) for c in "123456"])
    failed = X.reply_checks(draft, cited, F.array(F.right(F.coalesce("dept_id", F.lit("")), F.lit(1))), ends, t, F.coalesce("completeness", F.lit(0.0)) >= 0.5)
    y = x.select("case_id", failed.alias("failed"))
    return y.select("case_id", "failed", (F.size("failed") == 0).alias("passed"), F.round((8 - F.size("failed")) / 8.0, 4).alias("score"))


#: drafts made to fail (or pass) one check each
ADVERSARIAL = (
    ("grounded", "您反映的问题已登记，依据所附材料办理[来源1]。", True), ("cited_after", "申请条件见附件。[来源1]", True), ("disclaimed", "未找到明确依据，需人工核实。", True),
    ("uncited", "依据相关规定应当办理。", False), ("promise", "一定解决[来源1]。", False), ("number", "将在99887766日内办结[来源1]。", False), ("phone", "请拨13800001111[来源1]。", False),
    ("marker", "已办理[来源9]。", False), ("empty", "  ", False),
)


@fam.query(f"""
    with v as (select * from (values {", ".join(f"('{n}', '{t}', {str(p).lower()})" for n, t, p in ADVERSARIAL)}) as v(variant, draft, expected)),
    x as (select variant, expected, {_failed_sql("draft", "false", "false", "coalesce(t, '')", "true")} as failed from {W}, v)
    select variant, count(*) as n, sum(((len(failed) = 0) = expected)::int)::bigint as correct, round(avg(((len(failed) = 0) = expected)::int), 4)::double as accuracy, max(len(failed)) as most_failed from x group by variant
""")
def v14_adversarial(spark, d):
    """Drafts made to fail, put to the gate with every case: share judged as expected, by kind of attack."""
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(t).alias("draft"), F.lit(p).alias("expected")) for n, t, p in ADVERSARIAL])
    x = _orders(spark, d).select(F.coalesce("t", F.lit("")).alias("t"), F.inline(variants))
    cited = F.array(F.struct(F.lit("a").alias("doc_id"), F.lit("b").alias("doc_title"), F.lit("c").alias("snippet")))
    failed = X.reply_checks(F.col("draft"), cited, F.array(F.lit("a")), F.lit(None).cast("array<string>"), F.col("t"), F.lit(True))
    right = ((F.size(failed) == 0) == F.col("expected")).cast("int")
    return x.groupBy("variant").agg(F.count("*").alias("n"), F.sum(right).alias("correct"), F.round(F.avg(right), 4).alias("accuracy"), F.max(F.size(failed)).cast("bigint").alias("most_failed"))


@fam.query("select name, count(*) as n, count(distinct record_id) as records from (select distinct on (record_id) * from manifest) m join departments on lead_department = name or department = name group by name")
def p_3_endpoints(spark, d):
    """Relations that touch a department at either end: one equality join over the ends instead of a disjunction."""
    m, dep = tables(spark, d, "manifest", "departments")
    ends = once(m, "record_id").select("record_id", F.explode(F.array_distinct(F.array("lead_department", "department"))).alias("name"))
    return ends.join(dep.select("name"), "name").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


@fam.query("select user_id, count(*) as readable from events where event_type <> 'error' and (value is null or value < 1 or ts + interval 30 day > timestamp '2024-02-15') group by user_id")
def p_6_unexpired(spark, d):
    """Own rows that are active and not expired, where some never expire."""
    (e,) = tables(spark, d, "events")
    kept = (F.col("event_type") != "error") & (F.col("value").isNull() | (F.col("value") < 1) | (F.col("ts") + F.expr("interval 30 day") > F.lit("2024-02-15").cast("timestamp_ntz")))
    return e.filter(kept).groupBy("user_id").agg(F.count("*").alias("readable"))


_TOPICS, _SUBJECTS = ("噪音", "电梯", "垃圾", "路灯"), "(物业|公交公司|学校|施工方|街道)"
_PLACES = ("[一-鿿]{2,3}[东西南北]?(?:路|街|巷|大道)[0-9]+号", "[一-鿿]{2}(?:区|县|街道|镇)")


@fam.query()
def e1_analyze(spark, d):
    """Every text to a whole record: masked text, time, place, subjects, event, request, region, title and summary, flags, quality
    (E1 with F1, F7 to F16, F20, F21, M13)."""
    x = _orders(spark, d).filter("t is not null")
    t = F.col("t")
    x = x.select("case_id", S.mask_numbers(S.half_width(t)).alias("t"), "elements", "region")
    place = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in _PLACES])
    r = F.col("region")
    region = F.when(r.isNull() | (r == ""), "未知").when(F.right(r, F.lit(1)).isin("区", "县"), r).otherwise(F.concat(r, F.lit("区")))
    subjects = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(_SUBJECTS), 1))), 1, 5)
    y = x.select("case_id", "t", S.first_time(t).alias("time_text"), place.alias("location"), subjects.alias("subjects"), X.event_of(t, list(_TOPICS)).alias("event"), X.request_of(t).alias("request"), region.alias("region"), X.ambiguity(t, place).alias("flags"))
    matters = sum((t.contains(w).cast("int") for w in _TOPICS), F.lit(0))
    missing = sum((F.col(c).isNull().cast("int") for c in ("time_text", "location", "event", "request")), F.lit(0))
    complete, clear, overall = ST.order_quality(missing, F.size("flags"), 4)
    shown = y.withColumn("title", F.substring(F.concat_ws(" ", "location", F.substring("event", 1, 30)), 1, 48)).withColumn("summary", F.substring(F.concat_ws("；", "time_text", "location", "event", "request"), 1, 300))
    return shown.select("*", (matters > 1).alias("several"), F.round(complete, 4).alias("completeness"), F.round(clear, 4).alias("clarity"), F.round(overall, 4).alias("overall"))


_P = "(select distinct on (page_id) page_id, blocks from parsed_documents)"


@fam.query(rf"""
    with b as (select page_id, blocks[i].block_type as kind, regexp_replace(regexp_replace(coalesce(blocks[i].text, ''), '[^\x{{09}}\x{{0A}}\x{{20}}-\x{{D7FF}}\x{{E000}}-\x{{FFFD}}\x{{10000}}-\x{{10FFFF}}]|\r', '', 'g'), '^\s+|\s+$', '', 'g') as t from (select *, unnest(range(1, len(blocks) + 1)) as i from {_P}))
    select page_id, count(*) filter (where kind = 'heading') as headings, count(*) filter (where kind = 'table') as tables, count(*) filter (where kind not in ('heading', 'table')) as paragraphs, sum(length(t))::bigint as chars from b where t <> '' group by page_id
""")
def x4_docx(spark, d):
    """Blocks written as word-processor documents (zip and XML) and read again: headings, tables, paragraphs, text."""
    (p,) = tables(spark, d, "parsed_documents")
    files = office.write_docx(once(p, "page_id").filter("size(blocks) > 0"), "page_id", "blocks")
    b = office.read_docx_files(files, "page_id", "content").select("page_id", F.explode("blocks").alias("b"))
    kind = F.col("b.block_type")
    return b.groupBy("page_id").agg(
        F.count_if(kind == "heading").alias("headings"), F.count_if(kind == "table").alias("tables"), F.count_if(~kind.isin("heading", "table")).alias("paragraphs"), F.sum(F.length("b.text")).alias("chars")
    )
