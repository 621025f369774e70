"""Extension points: model-backed steps as Arrow functions behind deterministic defaults.

A provider is a function from columns of strings to a column; ``use`` registers one by name, ``get``
gives it or the default.  Defaults need no model: the rerank bonus on shared tokens, the hash vector,
and the extractive answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewell.operators.retrieval import rerank_score

_providers: dict[str, Callable[..., Column]] = {}


def use(step: str, provider: Callable[..., Column]) -> None:
    """step: rerank (score, query, content), embed (text) or answer (query, contents)."""
    _providers[step] = provider


def get(step: str) -> Callable[..., Column]:
    return _providers.get(step) or DEFAULTS[step]


def arrow_vector(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """An embedding provider from a function on a batch of texts; null and empty texts give null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        out: list = [None] * len(text)
        some = [i for i, t in enumerate(text) if t]
        if some:
            for i, v in zip(some, encode([text.iloc[i] for i in some]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    return run


def hash_embed(texts: list[str], dim: int = 128) -> np.ndarray:
    """The deterministic vector of each text: the text and its bigrams, two salted MD5 hashes each, length 1."""
    import hashlib
    import re

    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        t = re.sub(r"\s+", "", text).lower()
        for gram in [t, *(t[i : i + 2] for i in range(len(t) - 1) if len(t) > 2)]:
            for salt in ("", " "):
                h = hashlib.md5((gram + salt).encode()).digest()
                row[int.from_bytes(h[:4], "big") % dim] += -1.0 if h[4] % 2 else 1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def extract(query: Column, contents: Column, most: int = 5, width: int = 80) -> Column:
    """The beginnings of the first sources, numbered."""
    return F.array_join(F.transform(F.slice(contents, 1, most), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(c, 1, width))), "\n")


DEFAULTS: dict[str, Callable[..., Column]] = {"rerank": rerank_score, "embed": arrow_vector(hash_embed), "answer": extract}
