"""Evaluation passages inside a training corpus: a distributed positional inverted index.

Text is normalised to letters and digits (width, case, accents, signs and spacing go), and its terms
are the overlapping runs of ``GRAM_HAN`` characters (Han, kana, hangul) or ``GRAM`` characters
(anything).

1. ``test_terms``: the passages' terms with their offsets, one row each.  Equal passages are one.
2. ``postings``: the index of the corpus, stored by term: (term, document, places).  Terms that a
   bitmap of the test terms (``BITS`` bits, whatever the test set) rules out can match nothing and
   are not stored.  Stored lists of a hot term are split over files and tasks.
3. ``ranked``: each passage's terms from the rarest to the most frequent in the corpus.  A leak takes
   at least ``need`` of a passage's terms (a term adds at most its own length to the agreeing part,
   and that is at least ``agree`` x ``share`` of the passage), so that every document with a leak has
   one of all but the ``need - 1`` most frequent: those nominate.  No other cut is made.
4. The lists of a document are brought together and shifted by the terms' offsets: postings that
   agree on one shift form exact phrases, phrases whose shifts differ by a few characters are joined
   by proximity.  A joined stretch counts if it is long enough and the agreeing part of it is large,
   which keeps passages apart that only share a form of words; a document leaks a passage if at
   least ``share`` of the passage is covered, in one place or several.

Scale: neither the test set nor the corpus reaches the driver, only the bitmap.  Both sides meet by
term; a term of very many passages has its list in parts of ``PART`` entries, and a term of very many
documents is split by the rebalanced index and the skew handling of the join.

Defined results: null or empty documents and passages match nothing; a document that holds a passage
twice gives one row; passages shorter than a term (``GRAM_HAN`` or ``GRAM`` letters and digits) match
nothing; equal passages are all reported, however many; repeated rows count once; texts under one
doc_id are searched apart.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM_HAN, GRAM = 6, 14
#: bits of the bitmap of test terms, and how many passages' entries travel in one row of a term's list
BITS, PART = 22, 64
_B = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _fold() -> np.ndarray:
    """Code point to folded code point; 0 for what is not a letter or digit."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        if 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0x4DC0 or 0x4E00 <= cp < 0xA000 or 0x20000 <= cp < 0x32000:
            out[cp] = cp
            continue
        c = chr(cp)
        if cp >= 0x20000 or (cp >= 0x3000 and not c.isprintable()):
            continue
        for x in unicodedata.normalize("NFKD", c).casefold():
            if x.isalnum():
                out[cp] = ord(x)
                break
    return out


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts one after another, and where each text begins (and the last ends)."""
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    folded = _fold()[np.concatenate(raw)] if raw else np.zeros(0, np.uint32)
    keep = folded != 0
    owner = np.repeat(np.arange(len(texts)), lens)[keep]
    return folded[keep], np.searchsorted(owner, np.arange(len(texts) + 1))


def _terms(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that begin at each place."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h *= _B
            h += c[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _wide(codes: np.ndarray) -> np.ndarray:
    return codes >= 0x2E80


def _slack(han: bool) -> tuple[int, int, int]:
    """Largest gap inside a stretch, largest change of shift across it, least length of a stretch."""
    return (10, 6, 16) if han else (24, 14, 40)


def covered(place: np.ndarray, off: np.ndarray, size: int, han: bool, share: float, agree: float) -> np.ndarray:
    """Stretches (first and last offset, exclusive) of the passage that stand in the document.

    place, off: a posting's place in the document and its term's offset in the passage.
    """
    k = GRAM_HAN if han else GRAM
    gap, drift, least = _slack(han)
    least = min(least, max(k, math.ceil(share * size)))
    order = np.lexsort((place, place - off))
    p, o = place[order], off[order]
    shift = p - o
    cut = np.nonzero((np.diff(shift) != 0) | (np.diff(p) > k))[0] + 1  # exact phrases
    a, b = np.append(0, cut), np.append(cut, len(p)) - 1
    ps, pe, os_, oe = p[a], p[b] + k, o[a], o[b] + k
    order = np.argsort(ps, kind="stable")
    out = []
    open_: list[list[int]] = []  # stretches that may go on: document end, offset start, offset end, agreeing
    for i in order:
        s, e, x, y = int(ps[i]), int(pe[i]), int(os_[i]), int(oe[i])
        best = None
        for st in open_:
            d, q = s - st[0], x - st[2]
            if -k <= d <= gap and -k <= q <= gap and abs(d - q) <= drift and y > st[2] and (best is None or st[3] > best[3]):
                best = st
        if best is None:
            open_.append([e, x, y, y - x])
        else:
            best[3] += y - max(x, best[2])
            best[0], best[2] = e, y
        if len(open_) > 64:
            done = [st for st in open_ if s - st[0] > gap]
            out += done
            open_ = [st for st in open_ if s - st[0] <= gap]
    out += open_
    keep = [(x, y) for _, x, y, n in out if y - x >= least and n >= agree * (y - x)]
    return np.array(keep, dtype=np.int64).reshape(-1, 2)


def _is_han(codes: np.ndarray) -> bool:
    return bool(len(codes)) and bool(_wide(codes).mean() > 0.3)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def test_terms(passages: DataFrame) -> DataFrame:
    """passages: p INT, passage STRING.  Returns p, size (negative: not Han), term, off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at = _codes(batch.column("passage").to_pylist())
            for p, a, b in zip(batch.column("p").to_pylist(), at[:-1], at[1:], strict=True):
                han = _is_han(codes[a:b])
                k = GRAM_HAN if han else GRAM
                h = (_terms(codes[a:b], k) ^ np.uint64(k)).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, (b - a) if han else a - b, np.int32)), pa.array(h), pa.array(np.arange(n, dtype=np.int32))],
                    names=["p", "size", "term", "off"],
                )

    return passages.mapInArrow(run, "p int, size int, term bigint, off int")


test_terms.__test__ = False


def bitmap(terms: DataFrame) -> np.ndarray:
    """2^BITS flags of the terms' leading bits; at most 2^BITS / 64 rows reach the driver."""
    lead = F.shiftrightunsigned("term", 64 - BITS)
    words = terms.groupBy(F.shiftright(lead, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros((1 << BITS) // 64, np.int64)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(np.bool_)


def postings(docs: DataFrame, doc_id: str, text: str, flags: np.ndarray) -> DataFrame:
    """term, doc_id, tag (tells texts under one id apart), at ARRAY<INT>: where a term stands in a document."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    src = src.select("doc_id", F.expr("cast(xxhash64(text) & 2147483647 as int)").alias("tag"), "text")
    packed = np.packbits(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(packed).astype(np.bool_)
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):  # bounds the arrays, not the rows
                batch = whole.slice(a, 1000)
                codes, at = _codes(batch.column("text").to_pylist())
                places, terms = [], []
                for k in (GRAM_HAN, GRAM):
                    h = _terms(codes, k) ^ np.uint64(k)
                    here = np.nonzero(may[(h >> np.uint64(64 - BITS)).astype(np.int64)])[0]
                    owner = np.searchsorted(at, here, side="right") - 1
                    here = here[here + k <= at[owner + 1]]  # a term doesn't reach into the next text
                    places.append(here)
                    terms.append(h[here].view(np.int64))
                place, term = np.concatenate(places), np.concatenate(terms)
                doc = np.searchsorted(at, place, side="right") - 1
                order = np.lexsort((place, term, doc))
                place, term, doc = place[order], term[order], doc[order]
                first = np.nonzero(np.append(True, (np.diff(term) != 0) | (np.diff(doc) != 0)))[0] if len(term) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), pa.array((place - at[doc]).astype(np.int32)))
                rows = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays([pa.array(term[first]), batch.column("doc_id").take(rows), batch.column("tag").take(rows), lists], names=["term", "doc_id", "tag", "at"])

    return src.mapInArrow(run, f"term bigint, doc_id {src.schema[0].dataType.simpleString()}, tag int, at array<int>")


def _need(size: str, share: float, agree: float) -> str:
    """Least number of a passage's terms that a leak has."""
    return f"greatest(1, cast(ceil(abs({size}) * {agree * share} / if({size} > 0, {GRAM_HAN}, {GRAM}) - 1e-9) as int))"


def ranked(terms: DataFrame, index: DataFrame, share: float, agree: float) -> DataFrame:
    """terms that the corpus has, with df and rare: whether the term nominates."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    frequent = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("df"), "off"))
    return known.withColumn("rare", frequent >= F.expr(_need("size", share, agree))).filter("df > 0")


def find_leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, keep: Callable[[DataFrame], DataFrame], share: float = 0.5, agree: float = 0.7
) -> DataFrame:
    """doc_id, item_id, covered DOUBLE: the documents that hold at least ``share`` of a passage.

    keep: stores the numbered passages and the index once, as several steps use them.
    """
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).filter(F.length("passage") > 0).distinct()
    bucket = F.pmod(F.xxhash64("passage"), F.lit(256)).cast("int")
    number = F.row_number().over(Window.partitionBy("b").orderBy("passage"))
    passages = keep(wanted.select("passage", bucket.alias("b")).distinct().select("passage", (number * 256 + F.col("b")).alias("p")))
    terms = test_terms(passages.select("p", "passage"))
    index = keep(postings(docs, doc_id, text, bitmap(terms)).hint("rebalance", "term").sortWithinPartitions("term"))
    known = ranked(terms, index, share, agree)
    part = F.floor((F.row_number().over(Window.partitionBy("term").orderBy("p", "off")) - 1) / PART)
    lists = known.withColumn("part", part).groupBy("term", "part").agg(F.collect_list(F.struct("p", "size", F.when(F.col("rare"), F.col("off")).otherwise(-1 - F.col("off")).alias("off"))).alias("e"))
    lists = lists.select("term", F.col("e.p").alias("p"), F.col("e.size").alias("size"), F.col("e.off").alias("off"))
    # the lists of a document together: bounded by its length
    by_doc = index.join(lists, "term").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "p", "size", "off")).alias("hits"))
    found = by_doc.mapInArrow(functools.partial(_verified, share=share, agree=agree), f"doc_id {index.schema['doc_id'].dataType.simpleString()}, p int, covered double")
    pairs = found.join(passages, "p").join(wanted, "passage")
    return pairs.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array, and the number of each list's."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch], share: float, agree: float) -> Iterator[pa.RecordBatch]:
    """The leaks among the documents' lists."""
    for whole in batches:
        for s in range(0, whole.num_rows, 500):
            batch = whole.slice(s, 500)
            hits, n_hits = batch.column("hits"), batch.column("hits").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = hits.flatten()
            (at, n_at), (p, n_p), (size, _), (off, _) = (_flat(flat.field(i)) for i in range(4))
            # every place of a posting with every entry of its term's list
            doc = np.repeat(np.arange(batch.num_rows), n_hits)
            n = n_at * n_p
            which = np.repeat(np.arange(len(n)), n)
            within = _ranges(n)
            a = np.repeat(np.cumsum(n_at) - n_at, n) + within // n_p[which]
            e = np.repeat(np.cumsum(n_p) - n_p, n) + within % n_p[which]
            d, place, q, z, o = doc[which], at[a].astype(np.int64), p[e], size[e].astype(np.int64), off[e].astype(np.int64)
            order = np.lexsort((q, d))
            d, place, q, z, o = d[order], place[order], q[order], z[order], o[order]
            if not len(d):
                continue
            first = np.nonzero(np.append(True, (np.diff(d) != 0) | (np.diff(q) != 0)))[0]
            nominated = np.add.reduceat((o >= 0).astype(np.int64), first) > 0
            k = np.where(z[first] > 0, GRAM_HAN, GRAM)
            enough = np.diff(np.append(first, len(d))) * k >= agree * share * np.abs(z[first]) - 1e-9
            docs, ps, shares = [], [], []
            ends = np.append(first[1:], len(d))
            for i in np.nonzero(nominated & enough)[0]:
                x, y = first[i], ends[i]
                length = int(abs(z[x]))
                spans = covered(place[x:y], np.where(o[x:y] < 0, -1 - o[x:y], o[x:y]), length, bool(z[x] > 0), share, agree)
                mask = np.zeros(length, np.bool_)
                for u, v in spans:
                    mask[u:v] = True
                if mask.mean() >= share:
                    docs.append(d[x])
                    ps.append(q[x])
                    shares.append(float(mask.mean()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(ps, pa.int32()), pa.array(shares, pa.float64())], names=["doc_id", "p", "covered"])
