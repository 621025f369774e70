"""Retrieval over whole query tables: lexical, vector and fused rankings.

BM25: an inverted index as tables (postings, document lengths, document frequencies, corpus row),
joined with the terms of all queries at once; corpus statistics cover all documents.
Vectors: the query set goes to every task in blocks of bounded size, each corpus partition keeps its
own best k a query (a matrix product per batch), and one window merges them: the shuffle is k rows a
query and partition, never a pair of every row with every other.  Where every row is to meet every
other (``near_pairs``), blocks of rows do, and only near pairs leave a task.

Null and empty texts have no terms; vectors of another length than the query's are skipped; ties go
to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import tokens

K1, B, RRF_K = 1.5, 0.75, 60
QUERY_BLOCK = 4096
QUERY_TERMS = 20_000  # up to so many different query terms the scan filters by them
PAIR_BLOCK = 4096


def postings(docs: DataFrame, key: str, text: str, words: list[str] | None = None) -> DataFrame:
    """key, term, tf, dl: one row a document and term; words: the only terms wanted, cut before anything is exploded."""
    toks = docs.select(key, tokens(F.col(text)).alias("_tw_t")).filter(F.size("_tw_t") > 0)
    kept = F.col("_tw_t")
    if words is not None:  # tokens are Han characters, letters and digits: nothing to quote
        kept = F.expr(f"filter(_tw_t, x -> x in ({', '.join(repr(w) for w in words)}))") if words else F.array().cast("array<string>")
    return toks.select(key, F.size("_tw_t").alias("dl"), F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_statistics(docs: DataFrame, text: str) -> DataFrame:
    """term, df, cf; what moves is one partial sum a task and term, never a row a document and term."""
    t = tokens(F.col(text))
    one = lambda x, first: F.transform(x, lambda y: F.struct(y.alias("term"), F.lit(first).alias("first")))
    both = docs.select(t.alias("_tw_t")).select(F.explode(F.concat(one(F.col("_tw_t"), False), one(F.array_distinct("_tw_t"), True))).alias("x"))
    return both.groupBy("x.term").agg(F.count_if("x.first").alias("df"), F.count_if(~F.col("x.first")).alias("cf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """query_id, key, score of all documents that share a term with the query."""
    terms = queries.select(query_id, F.explode(tokens(F.col(query))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    # the index is cut to the query terms before it is counted or joined: inside the scan if they are few enough, else by a join
    wanted = terms.select("term").distinct()
    words = [r["term"] for r in wanted.limit(QUERY_TERMS + 1).collect()]
    post = postings(docs, key, text, sorted(words)) if len(words) <= QUERY_TERMS else postings(docs, key, text).join(wanted, "term")
    lengths = docs.select(F.size(tokens(F.col(text))).alias("dl")).filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stats = df.join(F.broadcast(lengths))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(stats.select("term", idf.alias("idf"), "avgdl"), "term")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return post.join(weighted, "term").groupBy(query_id, key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query_id: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, rank from 1."""
    r = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(score), key))
    return scored.withColumn("rank", r).filter(F.col("rank") <= k)


def vector_blocks(queries: DataFrame, query_id: str, vector: str, size: int = QUERY_BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """The query set in blocks, streamed to the driver; vectors normalised to length 1."""
    ids, rows = [], []
    for r in queries.select(query_id, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield ids, unit(np.array(rows, dtype=np.float64))
            ids, rows = [], []
    if ids:
        yield ids, unit(np.array(rows, dtype=np.float64))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def vector_top_k(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """query_id, key, score, rank: the k rows of largest cosine for every query."""
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = None
    for ids, matrix in vector_blocks(queries, query_id, query_vector):

        def best(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            top_s = np.full((len(ids), k), -np.inf)
            top_i: np.ndarray = np.zeros((len(ids), k), dtype=object)
            for pdf in batches:
                ok = pdf[vector].map(lambda v: v is not None and len(v) == matrix.shape[1])
                pdf = pdf[ok]
                for a in range(0, len(pdf), 2048):
                    part = pdf.iloc[a : a + 2048]
                    scores = np.round(matrix @ unit(np.stack(part[vector].to_list()).astype(np.float64)).T, 9)
                    all_s = np.concatenate([top_s, scores], axis=1)
                    all_i = np.concatenate([top_i, np.broadcast_to(part[key].to_numpy(dtype=object), scores.shape)], axis=1)
                    pick = np.argpartition(-all_s, min(k, all_s.shape[1] - 1), axis=1)[:, :k] if all_s.shape[1] > k else np.argsort(-all_s, axis=1)
                    # keep ties with the k-th score out of luck's hands: take the smaller id
                    edge = np.take_along_axis(all_s, pick, axis=1).min(axis=1)
                    for q in np.nonzero((all_s == edge[:, None]).sum(axis=1) > 1)[0]:
                        order = sorted(range(all_s.shape[1]), key=lambda j, q=q: (-all_s[q, j], all_i[q, j] if all_s[q, j] > -np.inf else 0))
                        pick[q] = order[: pick.shape[1]]
                    top_s, top_i = np.take_along_axis(all_s, pick, axis=1), np.take_along_axis(all_i, pick, axis=1)
            q, j = np.nonzero(top_s > -np.inf)
            yield pd.DataFrame({query_id: [ids[x] for x in q], key: list(top_i[q, j]), "score": top_s[q, j]})

        one = corpus.select(key, vector).mapInPandas(best, f"`{query_id}` {qkind}, `{key}` {kind}, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], f"`{query_id}` {qkind}, `{key}` {kind}, score double")
    return top_k(out, query_id, key, k)


def vector_within(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, least: float) -> DataFrame:
    """query_id, key, score of all rows whose cosine with a query is at least ``least``; nothing else leaves a task."""
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"`{query_id}` {qkind}, `{key}` {kind}, score double"
    out = None
    for ids, matrix in vector_blocks(queries, query_id, query_vector):

        def near(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == matrix.shape[1])]
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a : a + 1024]
                    s = np.round(matrix @ unit(np.stack(part[vector].to_list()).astype(np.float64)).T, 9)
                    q, j = np.nonzero(s >= least)
                    yield pd.DataFrame({query_id: [ids[x] for x in q], key: part[key].to_numpy()[j], "score": s[q, j]})

        one = corpus.select(key, vector).mapInPandas(near, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else corpus.sparkSession.createDataFrame([], schema)


def near_pairs(df: DataFrame, key: str, vector: str, least: float, forest: bool = False, block: int = PAIR_BLOCK) -> DataFrame:
    """a, b, score of all pairs of rows (a < b) whose cosine is at least ``least``: exact, every row against every other.

    Rows are dealt into blocks of about ``block``; each two blocks of vectors of one length meet in one task, where
    only near pairs are kept. forest: of those, each task keeps a spanning forest, which joins the same rows into the
    same components with fewer rows than it was given, so that dense graphs stay small.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.size(vector).alias("dim")).filter(F.col("k").isNotNull() & (F.col("dim") > 0))
    blocks = max(1, -(-rows.count() // block))
    side = rows.withColumn("side", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = side.select("k", "v", "side", "dim", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = pdf[pdf["side"] == x], pdf[pdf["side"] == y]
        keys, others = left["k"].to_numpy(dtype=object), right["k"].to_numpy(dtype=object)
        m, w = (unit(np.stack(p["v"].to_list()).astype(np.float64)) if len(p) else None for p in (left, right))
        parts = []
        root: dict = {}

        def find(n: object) -> object:
            while root.setdefault(n, n) != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for a in range(0, len(keys), 512) if m is not None and w is not None else ():
            s = m[a : a + 512] @ w.T
            i, j = np.nonzero(np.round(s, 9) >= least)
            score, p, q = s[i, j], keys[a + i], others[j]
            ok = (p < q).astype(bool) if x == y else (p != q).astype(bool)
            p, q, score = p[ok], q[ok], score[ok]
            if forest:
                kept = []
                for n, (u, v) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    u, v = find(u), find(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        kept.append(n)
                p, q, score = p[kept], q[kept], score[kept]
            low = (p < q).astype(bool)
            parts.append(pd.DataFrame({"a": np.where(low, p, q), "b": np.where(low, q, p), "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "score": []})

    return dealt.groupBy("x", "y", "dim").applyInPandas(near, f"a {kind}, b {kind}, score double")


def prototype_scores(corpus: DataFrame, key: str, vector: str, prototypes: DataFrame, proto: str, label: str, proto_vector: str, n: int, most: int = 50_000) -> DataFrame:
    """key, label, score: mean cosine to the n nearest prototypes of each label, a row not counting as its own prototype.

    Prototypes are a model, not data: more than ``most`` of them are an error.
    """
    rows = prototypes.select(proto, label, proto_vector).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} prototypes")
    kind, lkind = corpus.schema[key].dataType.simpleString(), prototypes.schema[label].dataType.simpleString()
    ids, labels = np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows], dtype=object)
    matrix = unit(np.array([r[2] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))
    kinds = sorted(set(labels.tolist()))
    of = [np.nonzero(labels == k)[0] for k in kinds]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == matrix.shape[1])]
            for a in range(0, len(pdf), 2048):
                part = pdf.iloc[a : a + 2048]
                keys = part[key].to_numpy(dtype=object)
                s = unit(np.stack(part[vector].to_list()).astype(np.float64)) @ matrix.T
                s[keys[:, None] == ids[None, :]] = -np.inf
                for k, cols in zip(kinds, of, strict=True):
                    best = -np.sort(-s[:, cols], axis=1)[:, :n]
                    ok = np.isfinite(best)
                    some = ok.any(axis=1)
                    mean = np.where(ok, best, 0).sum(axis=1)[some] / ok.sum(axis=1)[some]
                    yield pd.DataFrame({key: keys[some], label: [k] * int(some.sum()), "score": mean})

    return corpus.select(key, vector).mapInPandas(score, f"`{key}` {kind}, `{label}` {lkind}, score double")


def fuse(rankings: list[DataFrame], query_id: str, key: str, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: query_id, key, score = sum of weight / (60 + rank)."""
    parts = [r.select(query_id, key, (F.lit(w) / (RRF_K + F.col("rank"))).alias("_tw")) for r, w in zip(rankings, weights or [1.0] * len(rankings), strict=True)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(query_id, key).agg(F.sum("_tw").alias("score"))


def rerank_score(score: Column, query: Column, content: Column) -> Column:
    """Base score, a bonus for the share of query tokens found and one for a numbered clause."""
    q, c = F.array_distinct(tokens(query)), F.array_distinct(tokens(content))
    share = F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))
    return score + 0.3 * share + 0.2 * content.rlike("第[一二三四五六七八九十百0-9]+条").cast("double")


def coverage_top_k(hits: DataFrame, query_id: str, part: str, key: str, score: str, k: int) -> DataFrame:
    """k hits a query, first the best hit of every part in order, then the rest by score.

    hits: query_id, part (number of the sub-query), key, score.  A key counts once, with its best score.
    """
    best = F.row_number().over(Window.partitionBy(query_id, part).orderBy(F.desc(score), key))
    h = hits.withColumn("_tw_first", F.when(best == 1, F.col(part)))
    g = h.groupBy(query_id, key).agg(F.max(score).alias(score), F.min("_tw_first").alias("_tw_first"))
    r = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("_tw_first").asc_nulls_last(), F.desc(score), key))
    return g.withColumn("rank", r).filter(F.col("rank") <= k).drop("_tw_first")


def hash_vector(c: Column, dim: int = 128) -> Column:
    """Deterministic vector of a text: character bigrams and the text itself, two salted hashes each; length 1."""
    t = F.lower(F.regexp_replace(c, r"\s+", ""))
    grams = F.when(F.length(t) > 2, F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2))))).otherwise(F.array(t))
    salted = F.concat(grams, F.transform(grams, lambda g: F.concat(g, F.lit(" "))))
    cell = F.transform(salted, lambda g: F.struct((F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("i"), F.when(F.conv(F.substring(F.md5(g), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    return cell
