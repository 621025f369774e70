"""String functions as column expressions; lengths and positions are code points; null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Patterns that results must agree on.
NOISE_LINES = r"^\s*第\s*\d+\s*页\s*共\s*\d+\s*页\s*$|^\s*\d+\s*$|^\s*(版权所有|内部资料|严禁外传)\s*$"
HEADING = r"^(第[一二三四五六七八九十百0-9]+[章节部分篇编]|[一二三四五六七八九十]+、|[0-9]+[.、．]\s*[^0-9])"
PHONE = r"(?<!\d)(?:1[3-9]\d{9}|0\d{2,3}[- ]?\d{7,8})(?!\d)"
IDENTITY = r"(?<!\d)\d{17}[\dXx](?!\d)"
TOKEN = "[一-鿿]|[a-z0-9]+"
SENTENCE_ENDS = "[。；;！？!?\n]"
TIMES = (
    r"\d{4}年\d{1,2}月(?:\d{1,2}日)?(?:凌晨|上午|中午|下午|晚上)?(?:\d{1,2}(?:[:：]\d{1,2}|[点时](?:\d{1,2}分?)?))?",
    r"\d{1,2}月\d{1,2}日(?:凌晨|上午|中午|下午|晚上)?(?:\d{1,2}(?:[:：]\d{1,2}|[点时](?:\d{1,2}分?)?))?",
    r"(?:今天|昨日|昨天|前天|今晚|昨晚|今早|近期|最近)(?:凌晨|上午|中午|下午|晚上)?(?:\d{1,2}[点时](?:\d{1,2}分?)?)?",
    r"(?:凌晨|上午|中午|下午|晚上|夜间|晚间)",
)
CLAUSE = "第[一二三四五六七八九十百0-9]+条"


def half_width(c: Column) -> Column:
    return F.translate(c, _WIDE, _HALF)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tidy_space(c: Column) -> Column:
    """Runs of blanks (no-break and ideographic ones too) to one, three or more line ends to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\u00a0\u3000\u000b\f]+", " "), r"\n{3,}", "\n\n"))


def is_noise(line: Column) -> Column:
    """Page numbers, confidentiality lines, and lines of fewer than two characters."""
    return line.rlike(NOISE_LINES) | (F.length(strip(line)) < 2)


def clean_block(c: Column) -> Column:
    return tidy_space(half_width(c))


def tokens(c: Column) -> Column:
    """Han characters one by one, runs of letters and digits; lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def mask_numbers(c: Column) -> Column:
    """Identity numbers first, as they contain what looks like phone numbers."""
    return F.regexp_replace(F.regexp_replace(c, IDENTITY, "[身份证]"), PHONE, "[电话]")


def first_time(c: Column) -> Column:
    """The first time expression, of the first pattern that finds one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in TIMES])


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_ENDS), lambda s: strip(s)), lambda s: s != "")


def bigrams(c: Column) -> Column:
    """Two-character runs; empty for texts shorter than two."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), 1)


def pieces(c: Column, width: int) -> Column:
    """Fixed-width slices."""
    n = F.length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.substr(c, i * width + 1, F.lit(width))))


def alnum_only(c: Column) -> Column:
    """For comparisons: Han, letters and digits, lower case."""
    return F.regexp_replace(F.lower(c), "[^一-鿿a-z0-9]", "")


def canonical_url(c: Column) -> Column:
    """Without query and fragment, doubled slashes joined."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"([^:])/+", "$1/")


def redact_credentials(c: Column) -> Column:
    return F.regexp_replace(c, r"//[^/@\s]+@", "//***@")


def json_inside(c: Column, schema: str) -> Column:
    """The object between the outermost braces of a text, fences or not."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def safe_name(c: Column, most: int = 92) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(half_width(c), r'[\\/:*?"<>|\s]+', "_"), r"^[_.]+|[_.]+$", ""), 1, most)


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another in the given order."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda acc, w: acc | c.contains(w), words, F.lit(False))


def count_words(c: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return reduce(lambda acc, w: acc + c.contains(w).cast("int"), words, F.lit(0))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern is found."""
    out = F.when(F.lit(False), "")
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(default)


def undouble(c: Column) -> Column:
    """Stutters of two or more characters, said again at once, are said once."""
    return F.regexp_replace(c, r"(.{2,8}?)\1+", "$1")
