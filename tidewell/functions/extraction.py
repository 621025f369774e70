"""Structured fields out of complaint texts, and checks of drafted replies, as column expressions.

Patterns are parameters; the defaults are general Chinese function words, no business rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import sentences, strip

REQUEST_MARKS = ("希望", "要求", "请求", "建议", "恳请", "麻烦", "诉求：")
DEIXIS = ("这里", "那里", "我家楼下", "小区里", "附近")
# Fixed value: the promises that a reply may not make.
OVERPROMISE = "保证(?:解决|办结|通过|赔偿)|肯定(?:解决|办结|处罚|赔偿)|一定(?:解决|办结|通过|赔偿)|立即(?:处罚|赔偿)|百分之百"
NUMBER = r"\d+(?:\.\d+)?%?"


def request_of(c: Column, marks: tuple[str, ...] = REQUEST_MARKS, most: int = 180) -> Column:
    """The last sentence part after a mark of request, else the last question, else null."""
    pattern = f"(?:{'|'.join(marks)})([^。！？!?\\n；;]+)"
    hits = F.regexp_extract_all(c, F.lit(pattern), 1)
    asked = F.regexp_extract_all(c, F.lit(r"([^。！？!?\n；;]+[？?])"), 1)
    pick = F.when(F.size(hits) > 0, F.element_at(hits, -1)).when(F.size(asked) > 0, F.element_at(asked, -1))
    return F.substring(strip(pick), 1, most)


def event_of(c: Column, topics: list[str], most: int = 3) -> Column:
    """Up to three sentences that name a topic, else the longest sentence."""
    s = sentences(c)
    hit = F.filter(s, lambda x: reduce(lambda a, t: a | x.contains(t), topics, F.lit(False)))
    longest = F.array_max(F.transform(s, lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]
    return F.when(F.size(hit) > 0, F.array_join(F.slice(hit, 1, most), "；")).otherwise(longest)


def ambiguity(c: Column, location: Column) -> Column:
    """Flags: points at a place without naming it, long and joined by connectives, short location."""
    flags = F.array(
        F.when(reduce(lambda a, w: a | c.contains(w), DEIXIS, F.lit(False)), "deixis"),
        F.when((F.length(c) > 80) & c.rlike("并且|同时|另外|以及"), "several"),
        F.when(F.length(F.coalesce(location, F.lit(""))) < 4, "location"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def evidence_ratio(quotes: Column, source: Column) -> Column:
    """Share of the quotes that stand in the source; null without quotes."""
    return F.when(F.size(quotes) > 0, F.size(F.filter(quotes, lambda q: F.contains(source, q))) / F.size(quotes))


def markers_in_range(draft: Column, n_sources: Column, pattern: str = r"\[来源\s*(\d+)\]") -> Column:
    """Whether every citation marker points at a source."""
    return F.forall(F.regexp_extract_all(draft, F.lit(pattern), 1), lambda m: (m.cast("int") >= 1) & (m.cast("int") <= n_sources))


def unsupported_numbers(draft: Column, support: Column, allowed: tuple[str, ...] = ("12345", "110", "119", "120")) -> Column:
    """Numbers of the draft that stand nowhere in the support, sorted."""
    found = F.array_distinct(F.regexp_extract_all(draft, F.lit(f"({NUMBER})"), 1))
    return F.array_sort(F.filter(found, lambda x: ~x.isin(*allowed) & ~F.contains(support, x)))


def overpromises(draft: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(draft, F.lit(f"({OVERPROMISE})"), 1)))


def check_score(*passed: Column) -> Column:
    """Share of the checks that passed, four places."""
    return F.round(sum((p.cast("int") for p in passed), F.lit(0)) / F.lit(float(len(passed))), 4)


# --- the gate for drafted replies --------------------------------------------------------------------

# What results must agree on. Markers of sources, policy claims, promises, private and public numbers, and disclaimers.
SOURCE_MARKER = r"\[来源\s*(\d+)\]"
POLICY_CLAIM = "依据|根据.{0,12}(?:规定|政策|条例|办法|通知)|政策规定|条例规定|应当|不得|须提交|需要提交|申请条件|办理条件|办理期限|处罚|罚款|补贴标准"
PRIVATE_NUMBER = r"(?<!\d)1[3-9]\d{9}(?!\d)|(?<![0-9A-Za-z])\d{17}[0-9Xx](?![0-9A-Za-z])"
PUBLIC_NUMBERS = ("110", "120", "12315", "12345")
NO_EVIDENCE = ("未找到明确", "未找到直接", "无法据此", "未包含该直接依据", "需人工核实")
CHECKS = ("non_empty", "citation_integrity", "citation_marker_integrity", "policy_claim_grounding", "numeric_fact_support", "no_overpromise", "privacy_safe", "semantic_verification")


def ungrounded(draft: Column) -> Column:
    """Whether a line without a source marker makes a policy claim; headings in bold and lines that announce a list are left out."""
    moved = F.regexp_replace(draft, r"([。！？])\s*(\[来源\s*\d+\])", "$2$1")
    heading = lambda line: (line.startswith("**") & line.endswith("**")) | line.endswith("如下：") | line.endswith("如下:")
    claims = lambda s: s.rlike(POLICY_CLAIM) & ~reduce(lambda a, m: a | s.contains(m), NO_EVIDENCE, F.lit(False))
    lines = F.split(moved, "\n")
    return F.exists(lines, lambda x: ~heading(strip(x)) & ~x.rlike(SOURCE_MARKER) & F.exists(F.regexp_extract_all(x, F.lit("([^。！？\n]+[。！？]?)"), 1), claims))


def reply_checks(draft: Column, citations: Column, keys: Column, known: Column, support: Column, verified: Column) -> Column:
    """Names of the checks that a drafted reply fails, in the order of ``CHECKS``.

    citations: ARRAY<STRUCT<doc_id, doc_title, snippet>>; keys: their keys; known: the keys that exist, null to leave that
    open; support: evidence and the case's text; verified: verdict of a later model, null if there is none.
    """
    text = strip(F.coalesce(draft, F.lit("")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    malformed = F.exists(citations, lambda c: blank(c["doc_id"]) | blank(c["doc_title"]) | blank(c["snippet"]))
    unknown = F.coalesce(F.exists(keys, lambda k: ~F.array_contains(known, k)), F.lit(False))
    markers = F.regexp_extract_all(text, F.lit(SOURCE_MARKER), 1)
    beyond = F.exists(markers, lambda m: (m.cast("int") < 1) | (m.cast("int") > F.size(citations)))
    numbers = F.regexp_extract_all(F.regexp_replace(text, SOURCE_MARKER, ""), F.lit(r"((?<!\d)\d+(?:\.\d+)?%?(?!\d))"), 1)
    unsupported = F.exists(numbers, lambda n: ~n.isin(*PUBLIC_NUMBERS) & ~F.contains(support, n))
    failed = (text == "", malformed | unknown, beyond, ungrounded(text), unsupported, text.rlike(OVERPROMISE), text.rlike(PRIVATE_NUMBER), F.coalesce(~verified, F.lit(False)))
    return F.filter(F.array(*[F.when(f, n) for n, f in zip(CHECKS, failed, strict=True)]), lambda x: x.isNotNull())
