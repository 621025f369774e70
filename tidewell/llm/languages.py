"""Language of documents and of the one-language stretches of mixed ones, by rank-order profiles.

A profile lists the n-grams of a language by frequency (runs of one to three letters within a word,
with its edges, for alphabets; of one or two characters for Han, kana and hangul).  A text, be it a
document, a stretch or a sentence, is ranked the same way: its different n-grams by how often they
occur in it, equal counts sharing a rank, the ``PROFILE`` most frequent ones.  The out-of-place distance
adds, for each of them, how far its rank in the text is from its rank in the profile, or the whole
length of the profile if it isn't listed; the nearest profile wins.

Sentences are judged first; weak ones take the language of the stretch they stand in, and a stretch
that is not clearly nearer to its own profile than to its neighbour's joins the neighbour.  A document
of one stretch has the language nearest to the ranks of the whole document; a mixed one that of most
letters.

The confidence is the share of texts of that size and relative lead (of the nearest profile on the
second) that were judged rightly among held-out documents: calibrated by isotonic regression, one curve
for each class of ``SIZES`` letters.

Profiles are fitted on a bounded sample of labelled documents (``sample_docs`` a language, taken by
hash of the key): fit, let the profiles relabel the sample, and fit again, twice, with the
sentences that agree with their document, so that wrong labels and mixed texts drop out.  Everything else reads every document whole.

Sentences end at 。！？!?… , at line ends, at a full stop before anything but a small letter or a digit,
and at one between scripts.

Defined results: null, empty and wordless texts give no rows; unknown label spellings count as
missing; ties between languages go to the first in the order of ``LANGS``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("zh", "en", "de", "fr", "es", "pt", "ja", "ko")
# How languages are named, besides the code itself and the code with a region.
NAMES = {
    "zh": ("chi", "zho", "chinese", "mandarin", "中文", "汉语", "漢語", "简体中文", "cn"),
    "en": ("eng", "english", "英语", "英文"),
    "de": ("ger", "deu", "german", "deutsch", "德语"),
    "fr": ("fra", "fre", "french", "français", "francais", "法语"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "西班牙语"),
    "pt": ("por", "portuguese", "português", "portugues", "葡萄牙语"),
    "ja": ("jpn", "japanese", "日本語", "日语", "jp"),
    "ko": ("kor", "korean", "한국어", "韩语", "kr"),
}
PROFILE, SAMPLE_DOCS = 1500, 200
#: upper bounds of the letters of a text, a calibration curve each (Han, kana and hangul count double)
SIZES = (40, 120, 400, 1 << 62)
#: a stretch is at least by this share nearer to its own language than to its neighbour's
LEAST_LEAD = 0.12
_SLOT_BITS = 20
_ENDS = "。！？!?…\n\r"
_EDGE = 1  # stands for both edges of a word


def label_code(c: Column) -> Column:
    """Code of a written language label; null if missing or no language."""
    w = F.lower(F.trim(c))
    base = F.regexp_replace(w, r"^([a-z]{2,3})[-_].*$", "$1")
    codes = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in (code, *names) for x in (name, code)])
    return F.coalesce(F.try_element_at(codes, w), F.try_element_at(codes, base))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Folded lower-case code point (0: no letter), and class: 0 none, 1 alphabet, 2 Han, kana, hangul."""
    fold = np.zeros(0x110000, np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if 0x3400 <= cp < 0x4DC0 or 0x4E00 <= cp < 0xA000 or 0x20000 <= cp < 0x32000 or 0xAC00 <= cp < 0xD7A4 or 0x3041 <= cp < 0x3097 or 0x30A1 <= cp < 0x30FB:
            fold[cp], kind[cp] = cp, 2
        elif cp < 0x20000 and c.isalpha():
            n = unicodedata.normalize("NFKC", c).lower()[:1]
            if n and n.isalpha():
                fold[cp] = ord(n)
                k = ord(n)
                kind[cp] = 2 if (0x3041 <= k < 0x30FB or 0x4E00 <= k < 0xA000 or 0xAC00 <= k < 0xD7A4) else 1
    return fold, kind


@functools.cache
def _case() -> np.ndarray:
    """1: small letter, 2: capital letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x250):
        out[cp] = 1 if chr(cp).islower() else 2 if chr(cp).isupper() else 0
    return out


@dataclass
class Text:
    """Letters of many texts: folded code points, classes, places in the joined code points."""

    code: np.ndarray
    kind: np.ndarray
    sent: np.ndarray  # sentence number of each letter
    sent_doc: np.ndarray  # document of each sentence
    sent_start: np.ndarray  # place in its document
    sent_end: np.ndarray
    word: np.ndarray  # whether a letter begins a word


def read(texts: list[str | None]) -> Text:
    fold, kind = _classes()
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    flat = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(texts)), lens)
    first = np.zeros(len(flat), np.bool_)
    starts = np.cumsum(lens) - lens
    first[starts[lens > 0]] = True
    end = np.isin(flat, np.array([ord(c) for c in _ENDS], np.uint32))
    dot = np.nonzero(flat == ord("."))[0]
    nxt = np.minimum(dot + 1, len(flat) - 1)
    word = (kind[flat[nxt]] > 0) | ((flat[nxt] >= 48) & (flat[nxt] <= 57))  # odd code points may stand for the blank
    blank = ~word | (dot + 1 >= len(flat)) | first[nxt]
    end[dot[blank]] = True
    # sentences of two languages may be joined without a blank: a stop between a small and a capital letter
    inner = dot[(dot > 0) & (dot + 1 < len(flat))]
    joined = _case()[flat[inner - 1]] == 1
    joined &= (_case()[flat[inner + 1]] == 2) | (kind[flat[inner + 1]] == 2)
    # and one between Han, kana or hangul and any letter
    before, behind = kind[flat[inner - 1]], kind[flat[inner + 1]]
    joined |= ((before == 2) & (behind > 0)) | ((before > 0) & (behind == 2))
    end[inner[joined]] = True
    new = first.copy()
    new[1:] |= end[:-1]
    sent = np.cumsum(new) - 1
    at = np.nonzero(new)[0]
    k = kind[flat]
    # apostrophes inside words are no edges; marks that follow a letter belong to it
    letters = np.nonzero(k)[0]
    gap = np.ones(len(letters), np.bool_)
    if len(letters) > 1:
        gap[1:] = (np.diff(letters) > 1) | (sent[letters[1:]] != sent[letters[:-1]])
    sd = doc[at] if len(at) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(flat)) if len(at) else at
    return Text(fold[flat[letters]], k[letters], sent[letters], sd, at - starts[sd] if len(at) else at, ends - starts[sd] if len(at) else at, gap)


def grams(t: Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of n-grams, and the number of the letter where each begins."""
    n = len(t.code)
    c = t.code.astype(np.uint64)
    alpha, han = t.kind == 1, t.kind == 2
    idx = np.arange(n)
    s21, s42 = np.uint64(21), np.uint64(42)
    begins = t.word.copy()
    if n > 1:
        begins[1:] |= t.kind[1:] != t.kind[:-1]
    ends = np.append(begins[1:], True) if n else begins
    i = idx[han]
    yield c[i], i
    if n > 1:
        i = idx[:-1][han[:-1] & han[1:] & ~begins[1:]]
        yield c[i] | c[i + 1] << s21, i
    i = idx[alpha & ~begins]  # two letters, the first may be an edge
    yield c[i - 1] | c[i] << s21, i
    i = idx[alpha & begins]
    yield np.uint64(_EDGE) | c[i] << s21, i
    i = idx[alpha & ends]
    yield c[i] | np.uint64(_EDGE) << s21, i
    if n > 2:
        i = idx[:-2][alpha[:-2] & ~begins[1:-1] & ~begins[2:] & alpha[2:]]
        yield c[i] | c[i + 1] << s21 | c[i + 2] << s42, i
    if n > 1:
        i = idx[:-1][alpha[:-1] & begins[:-1] & ~begins[1:]]
        yield np.uint64(_EDGE) | c[i] << s21 | c[i + 1] << s42, i
        i = idx[1:][alpha[1:] & ends[1:] & ~begins[1:]]
        yield c[i - 1] | c[i] << s21 | np.uint64(_EDGE) << s42, i


@dataclass
class Profiles:
    """The listed n-grams in order, their ranks in each language's profile, and a table that finds them."""

    keys: np.ndarray  # sorted
    ranks: np.ndarray
    curves: list[tuple[np.ndarray, np.ndarray]]  # of each size class: leads, and the share judged rightly from there on
    slot: np.ndarray = field(default=None, repr=False)  # place of the n-gram of a slot, -1: none, -2: several

    def __post_init__(self) -> None:
        self.slot = np.full(1 << _SLOT_BITS, -1, np.int32)
        s = self._slots(self.keys)
        self.slot[s] = np.arange(len(s))
        several = np.bincount(s, minlength=1 << _SLOT_BITS) > 1
        self.slot[several] = -2

    def __getstate__(self):
        return (self.keys, self.ranks, self.curves)

    def __setstate__(self, state) -> None:
        self.keys, self.ranks, self.curves = state
        self.__post_init__()

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Place of each n-gram, len(self.keys) where it isn't listed."""
        at = self.slot[self._slots(keys)].astype(np.int64)
        many = np.nonzero(at == -2)[0]
        at[many] = np.minimum(np.searchsorted(self.keys, keys[many]), max(0, len(self.keys) - 1))
        at[at < 0] = len(self.keys)
        listed = np.nonzero(at < len(self.keys))[0]
        at[listed[self.keys[at[listed]] != keys[listed]]] = len(self.keys)
        return at

    def confidence(self, lead: float, letters: float) -> float:
        x, y = self.curves[next(i for i, m in enumerate(SIZES) if letters < m)]
        return float(y[max(0, np.searchsorted(x, lead, side="right") - 1)]) if len(x) else float(min(1.0, max(0.0, lead)))


def fit(texts: list[str], labels: list[int], rounds: int = 3, size: int = PROFILE, calibrate: bool = True) -> Profiles:
    """Profiles of LANGS from labelled texts; labels are places in LANGS."""
    t = read(texts)
    o = occurrences(t)
    parts = [(k, t.sent[i]) for k, i in grams(t)]
    keys = np.concatenate([k for k, _ in parts])
    sents = np.concatenate([d for _, d in parts])
    kinds, inv = np.unique(keys, return_inverse=True)
    lab = np.array(labels)
    of = lab[t.sent_doc] if len(t.sent_doc) else np.zeros(0, np.int64)  # language of each sentence, -1: not used
    prof = None
    for r in range(rounds):
        counts = np.zeros((len(kinds), len(LANGS)), np.int64)
        for j in range(len(LANGS)):
            counts[:, j] = np.bincount(inv[of[sents] == j], minlength=len(kinds))
        rank = np.full((len(kinds), len(LANGS)), size, np.int16)
        for j in range(len(LANGS)):
            top = np.lexsort((kinds, -counts[:, j]))[:size]
            top = top[counts[top, j] > 0]
            rank[top, j] = np.arange(len(top))
        listed = np.nonzero((rank < size).any(axis=1))[0]
        prof = Profiles(kinds[listed], rank[listed], [(np.zeros(0), np.zeros(0))] * len(SIZES))
        if r + 1 < rounds:
            dist, total, _ = distances(prof, o, t.sent_doc, len(texts), size)
            lab = np.where(total > 0, dist.argmin(axis=1), lab)
            # sentences of a mixed text that are in another language don't count for the text's
            one, n, _ = distances(prof, o, np.arange(len(t.sent_doc)), len(t.sent_doc), size)
            of = np.where((n > 0) & (one.argmin(axis=1) == lab[t.sent_doc]), lab[t.sent_doc], -1)
    if calibrate:
        prof.curves = _calibrated(texts, lab, size)
    return prof


def leads(dist: np.ndarray) -> np.ndarray:
    """Relative lead of the nearest profile on the second."""
    two = np.partition(dist, 1, axis=1)
    return np.where(two[:, 1] > 0, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1), 0)


def _calibrated(texts: list[str], lab: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Curves from sentences and documents of every fifth text, judged by profiles of the others."""
    held = np.arange(len(texts)) % 5 == 4
    if held.sum() < 5:
        return [(np.zeros(0), np.zeros(0))] * len(SIZES)
    p = fit([x for x, h in zip(texts, held, strict=True) if not h], list(lab[~held]), rounds=1, size=size, calibrate=False)
    t, want = read([x for x, h in zip(texts, held, strict=True) if h]), lab[held]
    o = occurrences(t)
    one, n, letters = distances(p, o, np.arange(len(t.sent_doc)), len(t.sent_doc), size)
    all_, m, all_letters = distances(p, o, t.sent_doc, len(want), size)
    # of a mixed text a sentence may rightly be in another language than the text: such texts don't calibrate
    agree = np.bincount(t.sent_doc, weights=(one.argmin(axis=1) == want[t.sent_doc]) | (n == 0), minlength=len(want)) >= 0.8 * np.bincount(t.sent_doc, minlength=len(want))
    s = (n > 0) & agree[t.sent_doc]
    lead = np.concatenate([leads(one)[s], leads(all_)[m > 0]])
    right = np.concatenate([one.argmin(axis=1)[s] == want[t.sent_doc[s]], all_.argmin(axis=1)[m > 0] == want[m > 0]]).astype(float)
    amount = np.concatenate([letters[s], all_letters[m > 0]])
    out, low = [], -1
    for high in SIZES:
        here = (amount > low) & (amount < high)
        out.append(isotonic(lead[here], right[here]))
        low = high - 1
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to the points (pool adjacent violators): where steps begin, and their heights.

    Each step holds one imagined wrong answer and one right one, so that no height is 0 or 1.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # begin, right, number
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 1) / (b[2] + 2) for b in blocks])


@dataclass
class Occurrences:
    """The n-grams of many texts in the script of their sentence, with their sentences; letters of each sentence."""

    keys: np.ndarray
    sent: np.ndarray
    letters: np.ndarray  # Han, kana and hangul count double


def occurrences(t: Text) -> Occurrences:
    n = len(t.sent_doc)
    han = np.bincount(t.sent[t.kind == 2], minlength=n) * 2.0
    alpha = np.bincount(t.sent[t.kind == 1], minlength=n)
    main = np.where(han >= alpha, 2, 1)  # a foreign name in another script says nothing about the sentence
    own = t.kind == main[t.sent]
    keys, sent = [], []
    for k, i in grams(t):
        fit = own[i]
        keys.append(k[fit])
        sent.append(t.sent[i[fit]])
    return Occurrences(np.concatenate(keys), np.concatenate(sent), han + alpha)


def distances(p: Profiles, o: Occurrences, unit: np.ndarray, n: int, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n units: out-of-place distance to each profile, n-grams, letters.

    unit: the unit of each sentence, -1: of none.
    """
    dist, letters = np.zeros((n, len(LANGS))), np.bincount(unit[unit >= 0], weights=o.letters[unit >= 0], minlength=n)
    owner, keys = unit[o.sent].astype(np.int64), o.keys
    if len(unit) and unit.min() < 0:
        owner, keys = owner[owner >= 0], keys[owner >= 0]
    total = np.bincount(owner, minlength=n).astype(float)
    if not len(keys):
        return dist, total, letters
    # each different n-gram of a unit with its count: sorted by unit, then by a hash of the rest of the 64 bits
    bits = np.uint64(max(1, int(n).bit_length()))
    with np.errstate(over="ignore"):
        both = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> bits
    both |= owner.astype(np.uint64) << (np.uint64(64) - bits)
    order = np.argsort(both)
    both = both[order]
    first = np.nonzero(np.append(True, both[1:] != both[:-1]))[0]
    count = np.diff(np.append(first, len(order)))
    one = order[first]
    u = owner[one]
    # equal counts share a rank: the number of more frequent ones
    rank, higher = np.zeros(len(one), np.int64), np.zeros(n, np.int64)
    often = np.nonzero(count > 1)[0]
    often = often[np.argsort(-count[often], kind="stable")]
    for here in np.split(often, np.nonzero(np.diff(count[often]))[0] + 1) if len(often) else ():
        rank[here] = higher[u[here]]
        np.add.at(higher, u[here], 1)
    once = count == 1
    rank[once] = higher[u[once]]
    top = rank < size
    if not top.all():
        one, u, rank = one[top], u[top], rank[top]
    place = p.look(keys[one])
    listed = place < len(p.keys)
    dist += (np.bincount(u[~listed], minlength=n) * float(size))[:, None]
    u, rank, r = u[listed], rank[listed].astype(np.int32), p.ranks[place[listed]].astype(np.int32)
    away = np.where(r < size, np.abs(r - rank[:, None]), size)
    if len(u):
        begin = np.nonzero(np.append(True, u[1:] != u[:-1]))[0]
        dist[u[begin]] += np.add.reduceat(away, begin, axis=0)
    return dist, total, letters


def stretches(dist: np.ndarray, total: np.ndarray, letters: np.ndarray, least: float = 16.0, sure: float = 0.06, short: float = 40.0) -> np.ndarray:
    """Language of each sentence of one document, weak sentences joined to their neighbours; -1: no letters at all."""
    n = len(total)
    lang = np.full(n, -1)
    good = total > 0
    if not good.any():
        return lang
    best = dist.argmin(axis=1)
    two = np.partition(dist, 1, axis=1)
    lead = np.where(two[:, 1] > 0, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1), 0)
    firm = good & (letters >= least) & ((letters >= short) | (lead >= sure)) & (lead > 0.01)
    if not firm.any():
        lang[:] = dist[good].sum(axis=0).argmin()
        return lang
    where = np.nonzero(firm)[0]
    lang[where] = best[where]
    for i in range(n):
        if firm[i]:
            continue
        k = np.searchsorted(where, i)
        left = best[where[k - 1]] if k > 0 else None
        right = best[where[k]] if k < len(where) else None
        if left is None or right is None or left == right:
            lang[i] = left if right is None else right if left is None else left
        else:  # between two languages: the nearer of the two
            lang[i] = left if dist[i, left] <= dist[i, right] else right
    return lang


def joined(lang: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """The languages of a document's sentences, where stretches that are hardly nearer to their own language than to a
    neighbour's have taken the neighbour's; the weakest first."""
    lang = lang.copy()
    while True:
        cut = np.append(0, np.nonzero(np.diff(lang))[0] + 1)
        ends = np.append(cut[1:], len(lang))
        weakest = None
        for k, (x, y) in enumerate(zip(cut, ends, strict=True)):
            d = dist[x:y].sum(axis=0)
            for m in (k - 1, k + 1):
                if 0 <= m < len(cut):
                    other = lang[cut[m]]
                    lead = (d[other] - d[lang[x]]) / d[other] if d[other] > 0 else 0.0
                    if lead < LEAST_LEAD and (weakest is None or lead < weakest[0]):
                        weakest = (lead, x, y, other)
        if weakest is None:
            return lang
        lang[weakest[1] : weakest[2]] = weakest[3]


def detect(p: Profiles, texts: list[str | None]) -> list[list[tuple[int, int, int, float, float]]]:
    """Of each text its stretches: language, start, end, letters, confidence."""
    t = read(texts)
    n, o = len(t.sent_doc), occurrences(t)
    dist, total, letters = distances(p, o, np.arange(n), n)
    whole, grams_of, _ = distances(p, o, t.sent_doc, len(texts))
    at = np.searchsorted(t.sent_doc, np.arange(len(texts) + 1))
    best, nearest, lead = dist.argmin(axis=1), whole.argmin(axis=1), leads(whole)
    out: list[list[tuple[int, int, int, float, float]]] = [[] for _ in texts]
    parts, unit = [], np.full(n, -1)  # stretches of mixed texts
    for d in np.nonzero(grams_of > 0)[0]:
        a, b = at[d], at[d + 1]
        g = total[a:b] > 0
        lang = None
        if (best[a:b][g] != best[a:b][g][0]).any():
            lang = joined(stretches(dist[a:b], total[a:b], letters[a:b]), dist[a:b])
        if lang is None or (lang == lang[0]).all():
            amount = float(letters[a:b].sum())
            out[d].append((int(nearest[d]), int(t.sent_start[a]), int(t.sent_end[b - 1]), amount, p.confidence(lead[d], amount)))
            continue
        cut = np.append(0, np.nonzero(np.diff(lang))[0] + 1)
        for x, y in zip(a + cut, a + np.append(cut[1:], b - a), strict=True):
            unit[x:y] = len(parts)
            parts.append((int(d), int(lang[x - a]), int(x), int(y)))
    if parts:  # the stretches are texts of their own: ranked again for their confidence
        lead = leads(distances(p, o, unit, len(parts))[0])
        for k, (d, lang, x, y) in enumerate(parts):
            amount = float(letters[x:y].sum())
            out[d].append((lang, int(t.sent_start[x]), int(t.sent_end[y - 1]), amount, p.confidence(lead[k], amount)))
    return out


def sample_labelled(docs: DataFrame, key: str, text: str, label: str, per_lang: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """At most per_lang labelled texts a language, whole, chosen by hash of the key."""
    base = docs.select(F.xxhash64(key).alias("h"), label_code(F.col(label)).alias("code"), F.col(text).alias("t")).filter(F.col("code").isNotNull())
    n = {r["code"]: r["n"] for r in base.groupBy("code").agg(F.count("*").alias("n")).collect()}
    part = F.lit(False)
    for code, m in n.items():  # twice the share needed, so that too few are rare
        part = part | ((F.col("code") == code) & (F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, 2.0 * per_lang / m) * (1 << 30))))
    rows = base.filter(part & (F.length("t") > 0)).select("h", "code", "t").orderBy("h").limit(4 * per_lang * len(LANGS)).collect()
    texts, labels, had = [], [], dict.fromkeys(LANGS, 0)
    for r in rows:
        if had[r["code"]] < per_lang:
            had[r["code"]] += 1
            texts.append(r["t"])
            labels.append(LANGS.index(r["code"]))
    return texts, labels


def label_documents(docs: DataFrame, key: str, text: str, label: str, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """key, seg_no, lang_code, confidence, start_pos, end_pos, declared.

    seg_no 0 is the whole document with its main language (most letters); a document in several languages
    also has its stretches from 1 on.  declared: code of the label, null if missing.
    """
    texts, labels = sample_labelled(docs, key, text, label, per_lang)
    profiles = fit(texts, labels) if texts else None
    src = docs.select(F.col(key), label_code(F.col(label)).alias("declared"), F.col(text).alias("_tw_text"))
    schema = f"`{key}` {src.schema[0].dataType.simpleString()}, seg_no int, lang_code string, confidence double, start_pos int, end_pos int, declared string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [key, "seg_no", "lang_code", "confidence", "start_pos", "end_pos", "declared"]
        p = profiles
        for pdf in batches:
            rows = []
            keys, said, all_texts = pdf[key].to_list(), pdf["declared"].to_list(), pdf["_tw_text"].to_list()
            for a in range(0, len(keys) if p else 0, 1000):
                for d, parts in enumerate(detect(p, all_texts[a : a + 1000])):
                    if not parts:
                        continue
                    weight = {}
                    for lang, _, _, n, _ in parts:
                        weight[lang] = weight.get(lang, 0.0) + n
                    main = max(weight, key=lambda x: (weight[x], -x))
                    k, s = keys[a + d], said[a + d]
                    conf = sum(n * c for lang, _, _, n, c in parts if lang == main) / max(sum(weight.values()), 1e-9)
                    rows.append((k, 0, LANGS[main], conf, 0, parts[-1][2], s))
                    if len(parts) > 1:
                        rows += [(k, i + 1, LANGS[lang], c, x, y, s) for i, (lang, x, y, _, c) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=cols)

    return src.mapInPandas(run, schema)
