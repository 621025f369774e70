"""Personal data in free text: overlapping candidates, boosted trees, calibrated thresholds.

Generators propose spans with high recall: digit runs in all the ways people write numbers, mail
addresses plain and spelled out, every family name with one or two characters behind it, names in
other scripts, and chains of address parts, from every place where the first name of the chain may
begin.  No list of roads, estates or given names is used.  Each span is described by its format and its
context; boosted trees, one model a type, give a probability; a threshold calibrated on held-out
sentences selects, and of overlapping selections the surest stays.  The selected spans are replaced by
typed placeholders.

Context is measured, not listed: ``Contexts`` counts, over all texts (``count_contexts``), what stands
before and behind family names (how often, and how varied), how often pairs of characters occur, and in
how many texts strings of three recur.

Labels do not come from the features.  ``pii_samples`` inserts generated names, numbers, mail addresses
and addresses, and things that only look like them, at known places into the sample's own sentences; the
carrier sentences are split into those that fit and those that calibrate.  For addresses the location
field that comes with a text gives real spans (``located``), each also with its names replaced by
random characters and without its leading parts.  The name model is fitted twice: the second time with
the sample's own candidates of which the first is sure (self-training), so that wordings no carrier has
are learned from what stands around names.

The trees and thresholds are fitted on a bounded sample (``SAMPLE_ROWS`` texts, by hash of the key) under the
contexts of all texts; the texts in it are whole, and every text of the corpus is read whole.  Positions are code points.  Defined results: null and empty texts have
no spans and stay as they are; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import boosting, pii_samples
from tidewell.llm.address_parse import ADMIN_NAMES, ESTATE_KINDS, ESTATE_KINDS_EN

TYPES = ("name", "phone", "email", "id_number", "address")
SAMPLE_ROWS = 6000

# Family names.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳"
    "鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于傅皮卞齐康伍余元卜顾孟黄穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒"
    "屈项祝董梁杜阮蓝闵席季贾路娄江童颜郭梅盛林钟徐邱骆高夏蔡田樊胡凌霍"
)
DOUBLE_SURNAMES = ("欧阳", "上官", "司马", "司徒", "诸葛", "尉迟", "慕容", "东方", "皇甫", "公孙", "令狐", "夏侯", "长孙", "宇文", "端木", "轩辕", "南宫", "西门", "独孤", "呼延")
# Words that stand near numbers, and titles and trades behind a family name.
ID_WORDS = ("身份证", "证件", "证号")
PHONE_WORDS = ("电话", "手机", "回电", "联系", "号码", "拨", "记一下", "打")
NUMBER_WORDS = ("编号", "单号", "取件码", "尾号", "金额", "受理", "验证码", "订单", "批次", "元", "码")
TITLES = ("女士", "先生", "阿姨", "师傅", "老师", "同志", "大爷", "大妈", "小姐", "经理", "医生", "主任")
TRADES = "记氏家某"

_CN_DIGIT = {**{c: str(i) for i, c in enumerate("零一二三四五六七八九")}, "〇": "0", "幺": "1", "两": "2"}


def half_width(text: str) -> str:
    """Same length, wide forms narrowed."""
    if text.isascii():
        return text
    return text.translate(_NARROW)


_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_TITLE = re.compile("|".join(TITLES))
_PHONE_WORD, _ID_WORD, _NUMBER_WORD = (re.compile("|".join(w)) for w in (PHONE_WORDS, ID_WORDS, NUMBER_WORDS))
_NUM_CN = "零〇幺一二三四五六七八九"
_MOBILE = re.compile(r"(?<![\dA-Za-z_.])(?:(?:\+|00)[ -]?86[ -]?)?1\d{2}[ -]?\d{4}[ -]?\d{4}(?!\d)")
_LAND = re.compile(r"(?<![\dA-Za-z_.])(?:\(0\d{2,3}\)|0\d{2,3})[ -]?\d{7,8}(?!\d)")
_SPOKEN = re.compile(rf"(?<![{_NUM_CN}])[{_NUM_CN}]{{7,12}}(?![{_NUM_CN}十百千号])")
_RUN = re.compile(r"(?<![\dA-Za-z_.-])\d[\d -]{4,24}[\dXx](?![\dA-Za-z])")
_DASHED = re.compile(r"\d{1,3}-\d{1,2}-\d{3,4}")
_ID = re.compile(r"(?<![\dA-Za-z])(?:\d{6}[ -]?\d{8}[ -]?\d{3}[\dXx]|\d{15})(?![\dA-Za-z])")
_MAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|\(at\)|\[at\]|艾特|(?<=\s)at(?=\s))\s?[A-Za-z0-9-]+(?:\s?(?:\.|点|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)*", re.I
)
_HAN = "一-鿿"
_SURNAME = re.compile(rf"{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}]")
_SURNAME_SET = frozenset(SURNAMES)
_DOTTED = re.compile(rf"[{_HAN}]{{2,5}}[·•・][{_HAN}]{{2,5}}")
_WORD = r"[A-ZÀ-Þ][a-zß-ÿ'’]+(?:-[A-ZÀ-Þ]?[a-zß-ÿ'’]+)?"
_LATIN = re.compile(rf"(?<![A-Za-z-]){_WORD}(?: {_WORD}){{1,2}}(?![A-Za-z-])")
_STOPS = frozenset("，。！？、；：,.!?;:\n\t []【】（）()<>{}♪*…/-“”\"'～~")


# --- contexts --------------------------------------------------------------------------------------------


class Contexts:
    """Counts over texts."""

    def __init__(self, texts: list[str]) -> None:
        self.pairs: Counter[str] = Counter()
        self.triples: Counter[str] = Counter()
        before: dict[str, list] = {}
        behind: dict[str, list] = {}

        def count(into: dict[str, list], context: str, name: bool, beside: str) -> None:
            c = into.setdefault(context, [0, 0, set()])
            c[0] += 1
            c[1] += name
            if len(c[2]) < _VARIED:
                c[2].add(beside)

        for raw in texts:
            t = "\n" + half_width(raw) + "\n"
            self.triples.update({t[i : i + 3] for i in range(len(t) - 2)})
            self.pairs.update(t[i : i + 2] for i in range(len(t) - 1))
            family = [c in _SURNAME_SET for c in t]
            for i in range(2, len(t)):
                count(before, t[i - 2 : i], family[i], t[i : i + 2])
                count(before, t[i - 1], family[i], t[i : i + 2])
            for i in range(3, len(t) - 1):
                name = family[i - 3] or family[i - 2]
                count(behind, t[i : i + 2], name, t[i - 2 : i])
                count(behind, t[i], name, t[i - 2 : i])
        self.pairs = Counter({k: n for k, n in self.pairs.items() if n > 1})
        self.triples = Counter({k: n for k, n in self.triples.items() if n > 1 and k[0] in _SURNAME_SET})
        self.left, self.right = (self._shares({k: (n, s, len(v), n) for k, (n, s, v) in c.items()}) for c in (before, behind))

    @staticmethod
    def _shares(counts: dict[str, tuple[float, float, int, int]]) -> dict[str, tuple[float, float, float]]:
        """Share of family names, how varied what follows (precedes) is, how frequent the context is; two characters, or one where two are rare."""
        return {k: (s / n, min(v, _VARIED) / min(raw, _VARIED), math.log(max(n, 1))) for k, (n, s, v, raw) in counts.items() if raw >= (_RARE if len(k) == 2 else 2)}

    @classmethod
    def counted(cls, pairs: dict[str, float], triples: dict[str, float], before: dict[str, tuple[float, float, int, int]], behind: dict[str, tuple[float, float, int, int]]) -> Contexts:
        """From counts over all texts, of what occurs more than once: of contexts how often, with a family name, beside how many
        others, and how often before scaling."""
        out = cls([])
        out.pairs, out.triples = Counter(pairs), Counter(triples)
        out.left, out.right = cls._shares(before), cls._shares(behind)
        return out

    def share_before(self, t: str, a: int) -> tuple[float, float, float]:
        two = t[a - 2 : a] if a > 1 else "\n" + t[:a]
        return self.left.get(two) or self.left.get(two[-1], _UNSEEN)

    def share_behind(self, t: str, b: int) -> tuple[float, float, float]:
        two = t[b : b + 2] if b + 2 <= len(t) else t[b:] + "\n"
        return self.right.get(two) or self.right.get(two[0], _UNSEEN)


_UNSEEN = (-1.0, -1.0, -1.0)
#: how many different neighbours of a context are told apart; a context of two characters that is rarer gives way to its nearer one
_VARIED, _RARE = 200, 2
#: below these shares on both sides a family-name character inside a word isn't proposed
LEAST_SHARE = 0.15


_CODE = 21  # bits of a code point
_GRAM = ("kind", "a", "b", "n", "before", "behind", "named")


def grams(texts: list[str]) -> pd.DataFrame:
    """The counts behind ``Contexts`` of a batch of texts.

    kind 0: two characters a and the two behind them, b (code points in one number): how often (n), how often as a context
    before and behind a place, and how often behind a family name; kind 1: three characters that begin with a family
    name, a: in how many texts (n).
    """
    wrapped = ["\n" + half_width(t) + "\n" for t in texts]
    size = np.array([len(t) for t in wrapped], np.int64)
    end = chr(0x10FFFF) * 2
    c = np.frombuffer("".join(t + end for t in wrapped).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size + 2)
    place = np.arange(len(c)) - np.repeat(np.cumsum(size + 2) - size - 2, size + 2)
    long, family = size[text], np.isin(c, _FAMILY_CODES)
    at = np.nonzero((place >= 2) & (place <= long))[0]
    p, n = place[at], long[at]
    two = lambda i: c[i] << _CODE | c[i + 1]
    (a, ia), (b, ib) = (np.unique(x, return_inverse=True) for x in (two(at - 2), two(at)))
    both, k = np.unique(ia.astype(np.int64) << 32 | ib, return_inverse=True)
    behind = (p >= 3) & (p <= n - 2)
    flags = (np.ones(len(at), bool), p <= n - 1, behind, behind & (family[at - 3] | family[at - 2]))
    sums = [np.bincount(k[x], minlength=len(both)) for x in flags]
    one = pd.DataFrame({"kind": 0, "a": a[both >> 32], "b": b[both & 0xFFFFFFFF], **dict(zip(_GRAM[3:], sums, strict=True))})
    at = np.nonzero(family & (place <= long - 3))[0]
    held = pd.DataFrame({"text": text[at], "a": c[at] << 2 * _CODE | two(at + 1)}).drop_duplicates()
    three = held.groupby("a").size().rename("n").reset_index().assign(kind=1, b=0, before=0, behind=0, named=0)
    return pd.concat([one, three[list(_GRAM)]], ignore_index=True)


_FAMILY_CODES = np.array(sorted(map(ord, _SURNAME_SET)), np.int64)


def count_contexts(df: DataFrame, text: str, more: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Contexts:
    """The contexts of all texts of a column and of ``more``, counted where the texts are.

    Features must not depend on the size of the corpus, as generated names recur no more often in a larger one: the
    counts of more than ``SAMPLE_ROWS`` texts are given for so many.  Those of ``more`` are not scaled.  What comes to the
    driver is what occurs more than once, and grows with the characters in use.  keep: stores what it is given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for made, part in pdf.groupby("made"):
                size = pd.DataFrame([(2, 0, 0, len(part), 0, 0, 0)], columns=_GRAM)
                yield pd.concat([grams(part["t"].to_list()), size]).assign(made=made)

    extra = df.sparkSession.createDataFrame(pd.DataFrame({"t": pd.Series(more, dtype=object)}), "t string")
    texts = df.select(F.col(text).alias("t"), F.lit(False).alias("made")).filter(F.length("t") > 0).unionByName(extra.withColumn("made", F.lit(True)))
    counted = texts.mapInPandas(run, "kind int, " + ", ".join(f"{x} bigint" for x in _GRAM[1:]) + ", made boolean")
    counted = keep(counted.groupBy(*_GRAM[:3], "made").agg(*[F.sum(x).alias(x) for x in _GRAM[3:]]))
    total = counted.filter("kind = 2 and not made").agg(F.max("n")).first()[0] or 0
    share = F.when(F.col("made"), 1.0).otherwise(min(1.0, SAMPLE_ROWS / max(total, 1)))
    quads = counted.filter("kind = 0")
    family = F.shiftright("b", _CODE).isin([int(x) for x in _FAMILY_CODES])

    def spelled(code: int, size: int) -> str:
        return "".join(chr(code >> _CODE * i & (1 << _CODE) - 1) for i in reversed(range(size)))

    sums = [F.sum(x).alias(x) for x in ("n", "s", "raw")]

    def often(rows: DataFrame, size: int) -> dict[str, float]:
        rows = rows.select("a", (F.col("n") * share).alias("n"), F.lit(0).alias("s"), F.col("n").alias("raw")).groupBy("a").agg(*sums)
        return {spelled(r["a"], size): r["n"] for r in rows.filter("raw > 1").collect()}

    def contexts(key: Column, beside: str, n: str, named: Column, size: int) -> dict[str, tuple[float, float, int, int]]:
        rows = quads.filter(F.col(n) > 0).select(key.alias("key"), F.col(beside).alias("beside"), (F.col(n) * share).alias("n"), (named * share).alias("s"), F.col(n).alias("raw"))
        rows = rows.groupBy("key", "beside").agg(*sums).groupBy("key").agg(*sums, F.count("*").alias("v")).filter("raw > 1")
        return {spelled(r["key"], size): (r["n"], r["s"], r["v"], r["raw"]) for r in rows.collect()}

    a, b, led = F.col("a"), F.col("b"), F.when(family, F.col("before")).otherwise(0)
    nearest = a.bitwiseAND(F.lit((1 << _CODE) - 1))
    before = contexts(a, "b", "before", led, 2) | contexts(nearest, "b", "before", led, 1)
    behind = contexts(b, "a", "behind", F.col("named"), 2) | contexts(F.shiftright("b", _CODE), "a", "behind", F.col("named"), 1)
    return Contexts.counted(often(quads, 2), often(counted.filter("kind = 1"), 3), before, behind)


# --- address parts ---------------------------------------------------------------------------------------

_N = r"(?:\d{1,4}|[零〇一二三四五六七八九十百]{1,7})"
_ADMIN = "|".join(f"{a}|{a[:-1]}" for a in ADMIN_NAMES)
_KINDS = "|".join(ESTATE_KINDS)
_ROAD = r"(?:[东西南北中]?(?:路(?!口)|街(?![道办])|巷)|大道)"
ROAD_STEM, ESTATE_STEM = 5, 6  # the most characters that a road's or an estate's name may have


def address_part(districts: tuple[str, ...]) -> re.Pattern:
    bare = sorted({d[:-1] for d in districts}, key=len, reverse=True)
    # a road may be called like a district
    dist = "|".join(f"{b}(?:[区县市旗]|(?!{_ROAD}))" for b in bare) or r"(?!)"
    stem = rf"(?:(?!{_ADMIN}{''.join('|' + b + '[区县市旗]' for b in bare)})[{_HAN}])"
    no_digit = r"(?![零〇一二三四五六七八九十百]{2})"
    return re.compile(
        rf"(?P<time>\d{{1,2}}:\d{{2}}(?=[^\d]|\d)|\d+月\d+日|{_N}点)"
        rf"|(?P<admin>{_ADMIN})|(?P<dist>{dist})"
        rf"|(?P<town>(?P<tstem>{stem}{{2,4}}?)(?:街道|街办|镇区|镇))"
        rf"|(?P<dash>(?<![\d-])\d{{1,3}}-\d{{1,2}}-\d{{3,4}}(?![\d-]))"
        rf"|(?P<bldg>{_N}\s?(?:号楼|號楼|#楼|栋楼?|幢楼?|座))"
        rf"|(?P<unit>{_N}\s?单元?)(?P<room>\s?\d{{3,4}}(?:室|(?!\d)))?"
        rf"|(?P<lone>\d{{3,4}}室)"
        rf"|(?P<numroad>{_N}(?:号|號|#)(?=[{_HAN}]{{1,{ROAD_STEM}}}?{_ROAD}))"
        rf"|(?P<road>{no_digit}(?P<rstem>{stem}{{1,{ROAD_STEM}}}?){_ROAD})(?P<no>\s?{_N}(?:(?:号|號|#)(?!\s?楼)|(?![\d零〇一二三四五六七八九十百号號#字])(?!\s?(?:栋|幢|座|单|月|日|点|:|楼|个|次|户|天|元|年))))?"
        rf"|(?P<estate>{no_digit}(?P<estem>{stem}{{2,{ESTATE_STEM}}}?)(?:{_KINDS})(?:[一二三四五六七八九十\d]期)?)"
    )


_ENGLISH = re.compile(
    r"(?:(?:Rm|Room) ?\d+, ?)?(?:Unit ?\d+, ?)?Bldg ?\d+, ?[A-Za-z]+ (?:" + "|".join(ESTATE_KINDS_EN) + r")(?: Phase ?\d+)?, ?\d+ [A-Za-z]+(?: (?:East|West|South|North))? (?:Road|Street|Lane|Avenue)(?:, ?[A-Za-z]+ (?:District|County))?"
    r"|(?:(?:Rm|Room) ?\d+, ?)?(?:Unit ?\d+, ?)?(?:Bldg ?\d+, ?)?\d+ [A-Z][a-z]+(?: (?:East|West|South|North))? (?:Road|Street|Lane|Avenue)(?:, ?[A-Za-z]+ (?:District|County))?"
)
_BETWEEN = re.compile(r"[)）]?[，,、\s]{0,3}[(（]?\s?")
_MAY_HOLD = re.compile(r"[号號#栋幢座楼路街巷]|大道|\d-\d")
_CROSSING = re.compile(rf"\s?(?:[和与跟/&、]\s?[{_HAN}]{{1,6}}?{_ROAD}|交|路口|口)")
_PLACE = re.compile(rf"{_ROAD}|{_KINDS}|街道|[区县镇乡村桥站]")
_STEMS = {"rstem": 1, "estem": 2, "tstem": 2}


def addresses(text: str, part: re.Pattern) -> Iterator[tuple[int, int, dict]]:
    """Chains of address parts with what they hold, from every place where the first name may begin."""
    for m in _ENGLISH.finditer(text):
        yield m.start(), m.end(), {"number": 1, "building": int("Bldg" in m[0]), "parts": m[0].count(",") + 1, "roads": 1, "latin": 1, "full": 1}
    if not _MAY_HOLD.search(text):
        return
    chain: list[tuple[re.Match, set[str]]] = []

    def close() -> Iterator[tuple[int, int, dict]]:
        while len(chain) > 1 and "road" in chain[-1][1] and "no" not in chain[-1][1] and "numroad" not in chain[-2][1]:  # a road that no number follows is no part of it
            chain.pop()
        kinds = [k for _, ks in chain for k in ks]
        if not chain or not ({"no", "numroad", "bldg", "dash"} & set(kinds)):
            return
        start, end = chain[0][0].start(), chain[-1][0].end()
        inner = text[start:end]
        if inner.count("(") + inner.count("（") > inner.count(")") + inner.count("）") and end < len(text) and text[end] in ")）":
            end += 1
        first = next((k for k in _STEMS if chain[0][0][k]), None)
        info = {
            "number": kinds.count("no") + kinds.count("numroad"), "building": kinds.count("bldg") + kinds.count("dash"), "parts": len(kinds), "roads": kinds.count("road"),
            "estate": kinds.count("estate"), "latin": 0, "full": int("dist" in kinds) + int("town" in kinds) + int("admin" in kinds), "crossing": int(bool(_CROSSING.match(text, end))),
        }
        if first is None:
            yield start, end, info
            return
        stem_end = chain[0][0].end(first)
        for a in range(start, stem_end - _STEMS[first] + 1):
            yield a, end, {**info, "stem": stem_end - a, "first": 1 + list(_STEMS).index(first), "shift": a - start}

    for m in part.finditer(text):
        kinds = {k for k, v in m.groupdict().items() if v is not None} - set(_STEMS)
        if "time" in kinds:
            yield from close()
            chain = []
            continue
        if chain:
            have = {k for _, ks in chain for k in ks}
            gap = text[chain[-1][0].end() : m.start()]
            if len(gap) > 4 or not _BETWEEN.fullmatch(gap) or kinds & have & {"road", "estate", "bldg", "dash", "dist", "town"}:
                yield from close()
                chain = []
        chain.append((m, kinds))
    yield from close()


def valid_birth(digits: str) -> bool:
    try:
        if len(digits) == 18:
            day = datetime.date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14]))
        elif len(digits) == 15:
            day = datetime.date(1900 + int(digits[6:8]), int(digits[8:10]), int(digits[10:12]))
        else:
            return False
    except ValueError:
        return False
    return 1900 <= day.year <= 2030


FEATURES = {
    "phone": ("length", "digits", "format", "word_before", "other_word", "stop_before", "stop_after", "near_digit", "prefix"),
    "id_number": ("length", "digits", "format", "word_before", "other_word", "stop_before", "stop_after", "near_digit", "birth"),
    "email": ("length", "sign", "dots", "top", "stop_before", "stop_after", "digits", "spaced"),
    "address": ("length", "latin", "number", "building", "parts", "roads", "estate", "full", "crossing", "stem", "first", "shift", "stop_before", "stop_after", "varied", "frequent", "pair", "inner", "next", "left_in_stem"),
    "name": ("script", "length", "spaced", "left_share", "left_varied", "left_n", "right_share", "right_varied", "right_n", "shorter_share", "shorter_varied", "shorter_n", "longer_share", "longer_varied", "longer_n", "han_after", "stop_next", "stop_before", "stop_after", "title", "trade", "place", "whole", "pair_before", "pair_after"),
}


def candidates(text: str, part: re.Pattern, seen: Contexts) -> list[tuple[str, int, int, list[float]]]:
    """Type, start, end and features of every span that might be personal data; spans overlap."""
    t = half_width(text)
    out: list[tuple[str, int, int, list[float]]] = []

    def add(kind: str, a: int, b: int, **f: float) -> None:
        f["length"] = b - a
        f["stop_before"] = float(a == 0 or t[a - 1] in _STOPS)
        f["stop_after"] = float(b >= len(t) or t[b] in _STOPS)
        out.append((kind, a, b, [float(f.get(x, 0)) for x in FEATURES[kind]]))

    def number(kind: str, a: int, b: int, word: re.Pattern, **f: float) -> None:
        near = t[max(0, a - 8) : a]
        beside = (a > 0 and t[a - 1].isdigit()) or (b < len(t) and t[b].isdigit())
        f.setdefault("digits", sum(c.isdigit() for c in t[a:b]))
        add(kind, a, b, word_before=float(bool(word.search(near))), other_word=float(bool(_NUMBER_WORD.search(near) or _NUMBER_WORD.match(t, b))), near_digit=float(beside), **f)

    if any(c.isdigit() for c in t):
        for k, p in ((1, _MOBILE), (2, _LAND)):
            for m in p.finditer(t):
                number("phone", m.start(), m.end(), _PHONE_WORD, format=k, prefix=float(m[0][0] in "+0("))
        for m in _RUN.finditer(t):
            d = re.sub(r"[^\dXx]", "", m[0])
            if _DASHED.fullmatch(m[0]):  # building, unit and room
                continue
            if len(d) in (7, 8, 10, 12, 13, 14) or (len(d) == 11 and d[0] != "1"):
                number("phone", m.start(), m.end(), _PHONE_WORD, format=5)
            if len(d) in (14, 15, 16, 17, 18, 19) and not _ID.fullmatch(m[0]):
                number("id_number", m.start(), m.end(), _ID_WORD, format=3)
        for m in _ID.finditer(t):
            d = re.sub(r"[ -]", "", m[0])
            number("id_number", m.start(), m.end(), _ID_WORD, format=1 if len(d) == 18 else 2, birth=float(valid_birth(d)))
    for m in _SPOKEN.finditer(t):
        d = "".join(_CN_DIGIT[c] for c in m[0])
        number("phone", m.start(), m.end(), _PHONE_WORD, format=3 if len(d) == 11 and d[0] == "1" else 4, digits=len(d))
    if "@" in t or "at" in t.lower() or "艾特" in t:
        for m in _MAIL.finditer(t):
            dots = re.split(r"\s?(?:\.|点|\(dot\)|\[dot\])\s?", re.split(r"@|\(at\)|\[at\]|艾特|\sat\s", m[0], flags=re.I)[-1].strip())
            add("email", m.start(), m.end(), sign=1.0 if "@" in m[0] else 2.0 if "艾特" in m[0] else 3.0 if "(" in m[0] or "[" in m[0] else 4.0, dots=len(dots) - 1, top=len(dots[-1]) if dots[-1].isalpha() else 0, digits=sum(c.isdigit() for c in m[0]), spaced=m[0].count(" "))
    for a, b, info in addresses(t, part):
        _, varied, frequent = seen.share_before(t, a)
        before, inside, after = (math.log1p(seen.pairs.get(t[i - 1 : i + 1], 0)) if i > 0 else 0.0 for i in (a, a + 1, b))
        # what the name would be joined with if it began earlier: a pair that recurs belongs together
        left = math.log1p(seen.pairs.get(t[a - 2 : a], 0)) if a > 1 and info.get("shift", 0) else 0.0
        add("address", a, b, varied=varied, frequent=frequent, pair=before, inner=inside, next=after, left_in_stem=left, **info)
    size, pairs, triples, log = len(t), seen.pairs, seen.triples, math.log1p
    for k, a, b, letters in _name_spans(t, seen):
        # the contexts around it, and behind it if it ended one character earlier or later; in the order of FEATURES
        han = b < size and "一" <= t[b] <= "鿿"
        short, long = seen.share_behind(t, b - 1) if letters > 2 else _UNSEEN, seen.share_behind(t, b + 1) if han else _UNSEEN
        span = t[a:b]
        body = span.replace(" ", "") if " " in span else span
        n = len(body)
        whole = pairs.get(body, 0) if n == 2 else triples.get(body, 0)
        f = [
            k, b - a, float(body is not span), *seen.share_before(t, a), *seen.share_behind(t, b), *short, *long, han, han and (b + 1 >= size or t[b + 1] in _STOPS),
            a == 0 or t[a - 1] in _STOPS, b >= size or t[b] in _STOPS, bool(_TITLE.match(t, b) or _TITLE.match(t, a + 1) or _TITLE.match(t, a + 2)),
            n > 1 and (body[1] in TRADES or (b < size and t[b] in TRADES)), bool(_PLACE.match(t, b) or _PLACE.match(t, b - 1) or _PLACE.match(t, b + 1)),
            log(whole) if whole else 0.0, log(pairs.get(t[a - 1 : a + 1], 0)) if a else 0.0, log(pairs.get(t[b - 1 : b + 1], 0)) if b < size else 0.0,
        ]
        out.append(("name", a, b, f))
    return out


def _name_spans(t: str, seen: Contexts) -> Iterator[tuple[int, int, int, int]]:
    """Kind (1 family name of one, 2 of two characters, 3 dotted, 4 capitals), start, end and letters of possible names."""
    n = len(t)
    for m in _SURNAME.finditer(t):
        a = m.start()
        for surname in {1, 2} if len(m[0]) == 2 and m[0][0] in _SURNAME_SET else {len(m[0])}:
            letters, b = surname, a + surname
            free = a == 0 or t[a - 1] in _STOPS or seen.share_before(t, a)[0] >= LEAST_SHARE
            while letters < surname + 2 and b < n:
                if t[b] == " " and letters >= 1 and b + 1 < n and "一" <= t[b + 1] <= "鿿":
                    b += 1
                if not ("一" <= t[b] <= "鿿"):
                    break
                b, letters = b + 1, letters + 1
                if free or seen.share_behind(t, b)[0] >= LEAST_SHARE:
                    yield min(surname, 2), a, b, letters
    if "·" in t or "•" in t or "・" in t:
        for m in _DOTTED.finditer(t):
            dot = next(i for i in range(m.start(), m.end()) if t[i] in "·•・")
            for a in range(m.start(), dot - 1):
                for b in range(dot + 3, m.end() + 1):
                    yield 3, a, b, b - a
    for m in _LATIN.finditer(t):
        yield 4, m.start(), m.end(), m.end() - m.start()


# --- models ----------------------------------------------------------------------------------------------


class Redactor:
    """One boosted model and threshold a type, with the contexts and districts its features need."""

    def __init__(self, models: dict[str, boosting.Boosted], thresholds: dict[str, float], districts: tuple[str, ...], seen: Contexts) -> None:
        self.models, self.thresholds, self.districts, self.seen = models, thresholds, districts, seen

    def scored(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
        """Text number, type, start, end and probability of every candidate."""
        part = address_part(self.districts)
        by: dict[str, list] = {k: [] for k in TYPES}
        for i, t in enumerate(texts):
            for k, a, b, f in candidates(t, part, self.seen) if t else ():
                by[k].append((i, a, b, f))
        out = []
        for k, rows in by.items():
            if rows:
                p = self.models[k].probability(np.array([r[3] for r in rows]))
                out += [(i, k, a, b, float(q)) for (i, a, b, _), q in zip(rows, p, strict=True)]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Start, end, type and probability of the redactions of each text, in order."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        chosen: dict[int, list[tuple[float, int, int, str]]] = {}
        for i, k, a, b, q in self.scored(texts):
            if q > self.thresholds[k]:
                chosen.setdefault(i, []).append((q, a, b, k))
        for i, spans in chosen.items():
            # numbers first, then addresses, as places are called like people, then names; of a type the surest, then the longest
            spans.sort(key=lambda s: ({"address": 1, "name": 2}.get(s[3], 0), -s[0], s[1] - s[2], s[1]))
            taken: list[tuple[int, int]] = []
            for q, a, b, k in spans:
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    out[i].append((a, b, k, q))
            out[i].sort()
        return out


def _labelled(rows: list[tuple[str, list[tuple[int, int, str]]]], part: re.Pattern, seen: Contexts, types: tuple[str, ...]) -> dict[str, tuple[list, list]]:
    """Features and labels of the candidates of texts with known spans: (text, spans), where spans of a type '' only say
    that what overlaps them is to be left out."""
    by: dict[str, tuple[list, list]] = {k: ([], []) for k in types}
    for t, known in rows:
        exact = {(a, b, k) for a, b, k in known}
        for k, a, b, f in candidates(t, part, seen):
            if k in by and ((a, b, k) in exact or not any(z == "" and a < y and b > x for x, y, z in known)):
                by[k][0].append(f)
                by[k][1].append(float((a, b, k) in exact))
    return by


def located(texts: list[str], locations: list[list[str]], part: re.Pattern, rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the address that their location field names: as it is, with other names, and without leading parts.

    What stands elsewhere in such a text is unknown: it is left out of the labels.
    """
    out = []
    for t, places in zip(texts, locations, strict=True):
        for place in places:
            a = t.find(place) if place and len(place) > 4 else -1
            if a < 0 or t.find(place, a + 1) >= 0:
                continue
            b = a + len(place)
            reaches = any((x, y) == (a, b) for x, y, _ in addresses(half_width(t), part))
            kind = "address" if reaches else "-"  # vague places and crossings are no addresses
            unknown = [(0, max(0, a - 12), ""), (min(len(t), b + 12), len(t), "")]
            out.append((t, [(a, b, kind), *unknown]))
            if not reaches:
                continue
            changed, first = list(t), None
            for m in part.finditer(half_width(t), a, b):
                for k in _STEMS:
                    if m[k]:
                        first = m.start() if first is None and k != "tstem" else first
                        for i in range(m.start(k), m.end(k)):
                            changed[i] = pii_samples.any_char(rng)
            new = "".join(changed)
            out.append((new, [(a, b, kind), *unknown]))
            if first is not None and first > a and not re.search(r"\d|号", t[a:first]):
                out.append((new[:a] + new[first:], [(a, b - (first - a), kind), (0, max(0, a - 12), ""), (min(len(t), b + 12) - (first - a), len(t), "")]))
    return out


def train(texts: list[str], districts: tuple[str, ...], locations: list[list[str]] | None = None, seed: int = 7, count: Callable[[list[str]], Contexts] | None = None) -> Redactor:
    """Fits on a bounded sample of texts and the locations that come with them.

    count: the contexts of all texts and of the generated ones that it is given; without it those of the sample.
    """
    rng = random.Random(seed)
    part = address_part(districts)
    fit, held = pii_samples.sentences(texts, rng)
    made = [t for t, _ in (*fit, *held)]
    seen = count(made) if count else Contexts([*texts, *made])
    real = located(texts, locations or [[] for _ in texts], part, rng)
    rng.shuffle(real)
    cut = len(real) * 4 // 5
    train_on, test_on = _labelled(fit, part, seen, TYPES), _labelled(held, part, seen, TYPES)
    for rows, by in ((real[:cut], train_on), (real[cut:], test_on)):
        more = _labelled(rows, part, seen, ("address",))
        for i in range(2):
            by["address"][i].extend(more["address"][i])
    x, y = train_on["name"]
    own = [(i, t[a:b], a, b, f) for i, t in enumerate(texts) for k, a, b, f in candidates(t, part, seen) if k == "name"]
    for f in _recurring(own):
        x.append(f)
        y.append(0.0)
    models = {k: boosting.fit(np.array(x).reshape(-1, len(FEATURES[k])), np.array(y)) for k, (x, y) in train_on.items()}
    _self_train(models, train_on, own)
    thresholds = {}
    for k, (x, y) in test_on.items():
        p = models[k].probability(np.array(x).reshape(-1, len(FEATURES[k])))
        thresholds[k] = min(0.9, max(0.1, boosting.calibrated_threshold(p, np.array(y))))
    return Redactor(models, thresholds, districts, seen)


def _recurring(own: list[tuple[int, str, int, int, list[float]]], least: int = 8, most: int = 20) -> list[list[float]]:
    """Features of candidates for names that so many of the texts hold word for word: no person's name does that.

    own: text number, span text, start, end and features of the sample's candidates for names.
    """
    texts: dict[str, set[int]] = {}
    found: dict[str, list] = {}
    for i, x, _, _, f in own:
        texts.setdefault(x, set()).add(i)
        if len(found.setdefault(x, [])) < most:
            found[x].append(f)
    return [f for x, v in texts.items() if len(v) >= least for f in found[x]]


def _self_train(models: dict[str, boosting.Boosted], train_on: dict, own: list[tuple[int, str, int, int, list[float]]], sure: tuple[float, ...] = (0.8, 0.6, 0.5), surely_not: float = 0.02) -> None:
    """Fits the name model again with the sample's own candidates: those of which it is sure, the best of each overlap,
    are names; what overlaps them, and what it surely rejects, is none."""
    features = np.array([r[4] for r in own])
    for least in sure if own else ():
        p = models["name"].probability(features)
        taken: dict[int, list[tuple[int, int]]] = {}
        x, y = list(train_on["name"][0]), list(train_on["name"][1])
        for j in np.argsort(-p, kind="stable"):
            i, _, a, b, f = own[j]
            over = any(a < d and b > c for c, d in taken.get(i, ()))
            if p[j] >= least and not over:
                taken.setdefault(i, []).append((a, b))
                x.append(f)
                y.append(1.0)
            elif over or (p[j] <= surely_not and j % 4 == 0):  # most are rejected: every fourth is enough to fit on
                x.append(f)
                y.append(0.0)
        models["name"] = boosting.fit(np.array(x), np.array(y), rounds=80, rate=0.2) if least == sure[-1] else boosting.fit(np.array(x), np.array(y))


def sample_texts(df: DataFrame, key: list[str], text: str, locations: str | None = None, most: int = SAMPLE_ROWS) -> tuple[list[str], list[list[str]]]:
    """At most ``most`` texts, those with the least hash of their key, and the locations (a column of arrays) with them."""
    place = F.col(locations) if locations else F.array().cast("array<string>")
    rows = df.filter(F.length(text) > 0).select(F.xxhash64(*key).alias("h"), F.col(text).alias("t"), place.alias("p")).orderBy("h", "t").limit(most).collect()
    return [r["t"] for r in rows], [[x for x in r["p"] or () if x] for r in rows]


def find_pii(df: DataFrame, keys: list[str], text: str, redactor: Redactor, masked: bool = False) -> DataFrame:
    """keys, pii_type, start_pos, end_pos, probability of each piece; with masked, instead keys and the
    text with each piece replaced by a placeholder of its type."""
    src = df.select(*keys, F.col(text).alias("_tw_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keys)])
    schema = head + (", masked string, n_pieces int" if masked else ", pii_type string, start_pos int, end_pos int, probability double")
    names = [*keys, *(("masked", "n_pieces") if masked else ("pii_type", "start_pos", "end_pos", "probability"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["_tw_text"].to_list()
            found = redactor.spans(texts)
            rows = []
            for row, t, spans in zip(pdf[keys].itertuples(index=False, name=None), texts, found, strict=True):
                if masked:
                    rows.append((*row, mask(t, spans), len(spans)))
                else:
                    rows += [(*row, k, a, b, q) for a, b, k, q in spans]
            yield pd.DataFrame(rows, columns=names)

    return (src if masked else src.filter(F.length("_tw_text") > 0)).mapInPandas(run, schema)


def mask(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, k, _ in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
