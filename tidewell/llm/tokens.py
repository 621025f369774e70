"""Encoding of a corpus with a public byte-level BPE tokenizer.

A backtracking encoder on tokens instead of merges: an Aho-Corasick automaton over the vocabulary
finds the tokens that end at each byte, longest first; the one whose neighbour on the left is a
compatible pair (BPE would not have merged across the two otherwise) is the last token of the exact
encoding of that prefix, and walking back from the end gives the ids in linear time.

Pieces (the tokenizer's own pre-split) repeat a lot, so ids are kept per distinct piece in a bounded
memo.  Long runs of letters without spaces are first cut at code points that no token of the
vocabulary straddles; no merge can cross such a place, so the ids are those of the uncut run.

Defined results: null and empty texts give an empty list; the spellings of special tokens are plain
text; every string has ids, since every byte is a token.  Lone surrogates can't occur in a column.
Decoding concatenates slices of one byte string by an offset table.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: how many distinct pieces a worker remembers before it starts afresh, and up to which length
MEMO_PIECES, MEMO_CHARS = 400_000, 24


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Default place of a vocabulary file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = _unicode_bytes()
        raw = {t: bytes(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
        self.bytes_of = {model["vocab"][t]: b for t, b in raw.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; bytes come before all merges
        self.halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = self.id_of[raw[a]], self.id_of[raw[b]]
            made = self.id_of[raw[a] + raw[b]]
            self.pair[left, right] = made
            self.rank.setdefault(made, r)
            self.halves.setdefault(made, (left, right))
        self.tokens = {i: b for i, b in self.bytes_of.items() if len(b) == 1 or i in self.rank}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.tokens.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.compatible = functools.lru_cache(maxsize=500_000)(self._compatible)
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, np.ndarray] = {}
        self._straddle()
        ids = range(max(self.bytes_of) + 1)
        self.blob = b"".join(self.bytes_of.get(i, b"") for i in ids)
        self.offset = np.concatenate([[0], np.cumsum([len(self.bytes_of.get(i, b"")) for i in ids])])

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two tokens apart where they meet.

        Merges of the two are undone from the latest; at each step the tokens that face each other must
        not have formed a merge that would have come before the one just undone.
        """
        rank, halves, pair = self.rank, self.halves, self.pair
        never = len(pair) + 1
        bound = never
        while True:
            made = pair.get((left, right))
            if made is not None and rank[made] < bound:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            # the later merge goes first; of two equal ones the left was made first
            if of_left > of_right:
                bound, left = of_left, halves[left][1]
            else:
                # a merge of the same rank further left wins, so equality counts as earlier
                bound, right = of_right + 1, halves[right][0]

    def _straddle(self) -> None:
        """Code points at which a long run may be cut: nothing in the vocabulary reaches across either side."""
        left, right = set(), set()
        for b in self.tokens.values():
            for i in range(1, len(b)):
                if b[i] & 0xC0 != 0x80 and (b[i] >= 0x80 or b[i - 1] >= 0x80):  # a code point begins here
                    k = i - 1
                    while k > 0 and b[k] & 0xC0 == 0x80:
                        k -= 1
                    j = i + 1
                    while j < len(b) and b[j] & 0xC0 == 0x80:
                        j += 1
                    left.add(b[k:i])
                    right.add(b[i:j])
        ends = {e for e in left}
        heads = {h for h in right}

        def lonely(c: str) -> bool:
            u = c.encode()
            return not any(u[k:] in ends for k in range(len(u))) and not any(u[:k] in heads for k in range(1, len(u) + 1))

        self.lonely = frozenset(c for c in map(chr, range(0x2E80, 0xD800)) if lonely(c))

    def parts(self, piece: str) -> list[str]:
        """A run cut around its code points that nothing straddles."""
        lonely = self.lonely
        out, at = [], 0
        for i, c in enumerate(piece):
            if c in lonely:
                if at < i:
                    out.append(piece[at:i])
                out.append(c)
                at = i + 1
        if at < len(piece):
            out.append(piece[at:])
        return out

    def encode_piece(self, piece: str) -> list[int]:
        b = piece.encode().decode("latin-1") if not piece.isascii() else piece
        n = len(b)
        if n == 1:
            return [self.id_of[b.encode("latin-1")]]
        last: list[tuple[int, int] | None] = [None] * n
        compatible = self.compatible
        for end, token in self.automaton.iter(b):
            if last[end] is None:
                at = end - token[1]
                if at < 0 or (last[at] is not None and compatible(last[at][0], token[0])):
                    last[end] = token
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at][0])
            at -= last[at][1]
        return out[::-1]

    def _ids(self, piece: str) -> list[int]:
        memo = self.memo
        got = memo.get(piece)
        if got is not None:
            return got
        if len(piece) > 1 and not piece.isascii():
            parts = self.parts(piece)
            if len(parts) > 1:
                try:
                    got = list(chain.from_iterable(map(memo.__getitem__, parts)))
                except KeyError:
                    got = []
                    for p in parts:
                        one = memo.get(p)
                        got += self._keep(p, self.encode_piece(p)) if one is None else one
                return self._keep(piece, got)
        return self._keep(piece, self.encode_piece(piece))

    def _keep(self, piece: str, ids: list[int]) -> list[int]:
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, ids = self.memo.get, self._ids
            for piece in self.pattern.findall(text):
                out += get(piece) or ids(piece)
        return out

    def decode(self, ids) -> str:
        a = self.offset
        return b"".join(self.blob[a[i] : a[i + 1]] for i in ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, ids ARRAY<INT> of each row of df, in any order; nothing is shuffled."""
    path, pattern = path or tokenizer_file(), pattern or split_pattern()
    src = df.select(F.col(key), F.col(text).alias("_tw_text"))
    schema = f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat += enc.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return src.mapInArrow(run, schema)
