"""Page furniture in crawled text: wrapper induction over the pages of a host.

A page's raw text is read as a tree: the page, sections (runs of lines of one shape), lines, and the
leaves that separators part inside a line.  ``induce`` reads every page of each host,
aligns each with its next ``PARTNERS`` ones by simple tree matching (roots must agree,
children keep their order, the largest matching wins) and counts, for every node, how often it was
matched with an equal node, how often with another text in the same slot, and where it stands: inside
the varying content of its page or outside, between constants.  Then

* nodes that the alignments find equal are the first constants of the wrapper;
* a node that recurs and stands outside the content often enough is a constant too, and one that
  practically never does is not (headings and stock sentences of articles recur as well, but only
  inside content); this is repeated until it settles (``ROUNDS``);
* a constant that is mostly followed by several varying short lines heads a list of links, whose
  slots belong to the wrapper;
* everything else is a varying slot, i.e. content.

The wrapper of a host holds the constants found on its own pages and, for rare ones, those of all
hosts together ('*', the roll-up of the hosts' counts).

Then ``judge`` reads each page: constants are furniture; sentences, table rows, long lines and nodes
that recur inside content are body; short titles are furniture where they fill the slots of a list,
and body where the headline stands: above the content or the line with date and origin.

Quoted lines of another record about the same page are aligned with the page's lines as one run
(quotes may be cut) and take the verdicts there; without such a page they are judged by the wrapper
and the slot rules alone.

Scale: a host's pages are dealt by hash of the text to blocks of about ``BLOCK_PAGES``, so that no task
gathers a large host; a page's partners are the next ones of its block.  A host of one block is counted
in one task.  Of larger hosts each block leaves its counts and its pages as arrays of node hashes
(``pack``); the counts are summed a host, and the rounds are passes over these arrays with the host's
constants so far.  All counts are summed for '*' before a wrapper is built.  Wrappers are
joined to the pages by host; a host that holds a third of all pages is one row on the joined side.
Every page is counted and judged, whole.

Defined results: null, empty and blank texts have no lines; blank lines have no verdict; null urls
form one host; repeated rows count once; a host or corpus with fewer than ``LEAST_PAGES`` pages that
share a node has no constants, and every line of it but the titles of lists is body.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: about so many pages of a host are aligned with each other in one task, each with its next ones
BLOCK_PAGES, PARTNERS = 400, 3
#: a constant recurs on this share of the pages and on so many of them
LEAST_SHARE, LEAST_PAGES = 0.003, 3
#: share (and number) of equal matches that makes a constant; shares of places outside content, not followed by
#: content, and among slots that make or unmake one
EQUAL_SHARE, LEAST_EQUAL, OUTSIDE_SHARE, ENDS_SHARE, AMONG_SHARE, ROUNDS = 0.05, 4, 0.2, 0.6, 0.5, 4
_LEAVES = re.compile(r"\s*[|·>›»/　]+\s*|\s{2,}|\s+(?=[^\s：:]{1,6}[：:])")
_LIST_MARK = re.compile(r"^(?:[-*•·▪]\s*|[（(]?\d{1,3}[)）.、．]\s*)")
_LABEL = re.compile(r"^(.{1,14}?)[：:]")
_SENTENCE = re.compile(r"[。！？!?；;]|\.(?:\s|$)")
_DATE_TAIL = re.compile(r"\s+\d{1,2}-\d{1,2}$")
_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
LONG = 60
#: share of its places where the head of a list is followed by several slots; pages from which on a host decides a name alone
HEAD_SHARE, OWN_PAGES = 0.25, 20


def normal(line: str) -> str:
    return _DIGITS.sub("0", _SPACES.sub(" ", line.strip()))


class Line:
    """One line as a node of the page's tree: its shape (the tag), its leaves and the names it is counted under."""

    __slots__ = ("at", "bare", "leaves", "names", "parts", "sentence", "shape", "text")

    def __init__(self, at: int, line: str) -> None:
        self.at, text = at, line.strip()
        marked = _LIST_MARK.match(text)
        inner = text[marked.end() :] if marked else text
        self.bare = normal(_DATE_TAIL.sub("", inner))
        self.text = text
        self.sentence = bool(_SENTENCE.search(inner))
        self.leaves = [x for x in (normal(p) for p in _LEAVES.split(inner)) if x] or [self.bare]
        table = " | " in text
        self.shape = ("m" if marked else "") + ("s" if self.sentence else "r" if table else "g" if len(self.leaves) > 1 else "w" if len(text) > LONG else "t")
        # names: b the line without mark and date; d its label; of several leaves t each leaf and c each leaf's label; r a leaf between bars
        self.names, self.parts = ["b" + self.bare], []
        if table:
            self.parts = [("r" + p, "t" + p, "b" + p) for p in self.leaves]
            self.names += [x[0] for x in self.parts]
        elif len(self.leaves) > 1:
            for p in self.leaves:
                m = _LABEL.match(p)
                self.parts.append(("t" + p, "b" + p, "c" + m[1], "d" + m[1]) if m else ("t" + p, "b" + p))
            self.names += [x for names in self.parts for x in names if x[0] in "tc"]
        elif not self.sentence and (m := _LABEL.match(self.bare)):
            self.names.append("d" + m[1])


def read_lines(text: str | None) -> list[Line]:
    return [Line(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]


def sections(lines: list[Line]) -> list[list[Line]]:
    out: list[list[Line]] = []
    for x in lines:
        if out and out[-1][-1].shape == x.shape:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _align(n: int, m: int, weight: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """Largest order-preserving matching of two child lists, and its pairs."""
    best = [[0] * (m + 1)]
    take = [[0] * m for _ in range(n)]
    for i in range(n):
        above, row, at, taken = best[-1], [0], 0, take[i]
        for j in range(m):
            taken[j] = w = weight(i, j)
            if above[j + 1] > at:
                at = above[j + 1]
            if w and above[j] + w > at:
                at = above[j] + w
            row.append(at)
        best.append(row)
    pairs, i, j = [], n, m
    while i and j:
        w = take[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m], pairs[::-1]


def match_trees(a: list[list[Line]], b: list[list[Line]]) -> list[tuple[Line, Line]]:
    """Pairs of lines that simple tree matching of two pages (their sections) puts together."""

    def line_weight(x: Line, y: Line) -> int:
        if x.shape != y.shape:
            return 0
        if x.bare == y.bare:
            return 2 + len(x.leaves)
        if len(x.leaves) == 1 or len(y.leaves) == 1 or not any(leaf in y.leaves for leaf in x.leaves):
            return 1
        return 1 + _align(len(x.leaves), len(y.leaves), lambda i, j: int(x.leaves[i] == y.leaves[j]))[0]

    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def section_weight(i: int, j: int) -> int:
        if a[i][0].shape != b[j][0].shape:
            return 0
        if (i, j) not in found:
            x, y = a[i], b[j]
            found[i, j] = _align(len(x), len(y), lambda k, m: line_weight(x[k], y[m]))
        return 1 + found[i, j][0]

    pairs = _align(len(a), len(b), section_weight)[1]
    return [(a[i][k], b[j][m]) for i, j in pairs for k, m in found[i, j][1]]


def is_constant(x: Line, template: set[str]) -> bool:
    """Whether a line is made of constants only: itself, its label, or every leaf or its label."""
    n = x.names
    if n[0] in template:
        return True
    if x.parts:
        return all(any(name in template for name in leaf) for leaf in x.parts)
    return len(n) > 1 and n[1] in template


def is_slot_of_list(x: Line) -> bool:
    return x.shape in ("t", "mt")


def _places(lines: list[Line], constant: list[bool]) -> list[tuple[bool, bool, bool]]:
    """Of each line: whether it stands outside content (next to nothing but constants or the page's edge, and not
    right above the date, where the headline stands); whether no content follows it (but a constant, the slots of a
    list or the end); whether it is one of several such slots."""
    n = len(lines)
    edge = [True, *constant, True]
    dated = [False, *(c and len(x.parts) > 1 and is_dated(x) for x, c in zip(lines, constant, strict=True)), False]
    slot = [False, *(is_slot_of_list(x) and not c for x, c in zip(lines, constant, strict=True)), False]
    return [(edge[i - 1] and edge[i + 1] and not dated[i + 1], edge[i + 1] or slot[i + 1], slot[i - 1] or slot[i + 1]) for i in range(1, n + 1)]


def constants(pages: int, counts: dict[str, tuple[int, int, int, int, int, int]]) -> set[str]:
    """The names of a wrapper's constants; counts: seen, equal, other, outside, ends, among of each name.

    Matched as equal often enough, a leaf is constant (lines with date and origin stand next to content), and so
    is a line that content doesn't follow.  Rarer lines must stand outside content, but not among slots.
    """
    least = max(LEAST_PAGES, LEAST_SHARE * pages)
    out = set()
    for x, (seen, equal, other, outside, ends, among) in counts.items():
        if seen >= least:
            firm = equal >= LEAST_EQUAL and equal >= EQUAL_SHARE * (equal + other)
            if (firm and (x[0] in "tc" or (x[0] == "b" and ends >= ENDS_SHARE * seen))) or (outside >= OUTSIDE_SHARE * seen and among <= AMONG_SHARE * seen):
                out.add(x)
    return out


def read_pages(texts: list[str]) -> list[list[Line]]:
    """The pages of a block, in the order of the texts' hashes: neighbours by chance."""
    ordered = sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")), t))
    return [p for p in (read_lines(t) for t in ordered) if p]


def block_counts(pages: list[list[Line]]) -> tuple[Counter[str], Counter[str], Counter[str]]:
    """On how many pages of a block each node was seen, and how often it was matched as equal and with another."""
    seen: Counter[str] = Counter()
    equal: Counter[str] = Counter()
    other: Counter[str] = Counter()
    for p in pages:
        seen.update({x for line in p for x in line.names})
    cut = [sections(p) for p in pages]
    for i in range(len(pages)):
        for j in range(i + 1, min(len(pages), i + 1 + PARTNERS)):
            for x, y in match_trees(cut[i], cut[j]):
                a, b = set(x.names), set(y.names)
                equal.update(a & b)
                other.update(a ^ b)
    return seen, equal, other


def first_constants(counts: dict[str, tuple[int, int, int]]) -> set[str]:
    """What is matched as equal, of the names seen often enough; counts: seen, equal, other of each name."""
    return {x for x, (_, equal, other) in counts.items() if x[:1] in ("b", "t", "c") and equal >= LEAST_EQUAL and equal >= EQUAL_SHARE * (equal + other)}


def host_counts(blocks: list[list[str]]) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """node and ``_MEASURES`` of one host's pages, block by block; under '' the number of pages."""
    cut = [read_pages(texts) for texts in blocks]
    parts = [block_counts(pages) for pages in cut]
    seen, equal, other = (sum((p[k] for p in parts), Counter()) for k in range(3))
    pages = [p for block in cut for p in block]
    # first constants: what is matched as equal; then also what stands outside content, until that settles
    least = max(LEAST_PAGES, LEAST_SHARE * len(pages))
    template = first_constants({x: (n, equal[x], other[x]) for x, n in seen.items() if n >= least})
    at: list[Counter[str]] = []
    for _ in range(ROUNDS):
        at = [Counter(), Counter(), Counter()]
        for p in pages:
            on_page: list[set[str]] = [set(), set(), set()]
            for x, place in zip(p, _places(p, [is_constant(x, template) for x in p]), strict=True):
                for names, hit in zip(on_page, place, strict=True):
                    if hit:
                        names.update(x.names)
            for c, names in zip(at, on_page, strict=True):
                c.update(names)
        new = constants(len(pages), {x: (n, equal[x], other[x], at[0][x], at[1][x], at[2][x]) for x, n in seen.items() if n >= least})
        if new == template:
            break
        template = new
    heads: Counter[str] = Counter()
    for p in pages:
        fixed = [is_constant(x, template) for x in p]
        for i in range(len(p) - 2):
            if fixed[i] and all(not fixed[k] and is_slot_of_list(p[k]) for k in (i + 1, i + 2)):
                heads[p[i].names[0]] += 1
    return [("", len(pages), *(0,) * 6), *((x, seen[x], equal[x], other[x], *(c[x] for c in at), heads[x]) for x in seen)]


def node_of(name: str) -> int:
    """A name's hash, as a signed number of 64 bits."""
    h = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def pack(pages: list[list[Line]]) -> bytes:
    """What the rounds need of a block's pages, as flat arrays.

    Of each line: the node of its first name, whether it may be a slot, whether it is dated, whether a page begins
    with it, where its leaves begin; of each leaf (a line without parts is one, under its own names) its nodes;
    of each node of a page, counted once there, the lines that hold it.
    """
    node: dict[str, int] = {}

    def of(name: str) -> int:
        if name not in node:
            node[name] = node_of(name)
        return node[name]

    first, slot, dated, begins, leaves, leaf_nodes, leaf_at = [], [], [], [], [], [], []
    pairs: dict[tuple[int, int], int] = {}
    pair_of, line_of = [], []
    for k, page in enumerate(pages):
        for i, x in enumerate(page):
            first.append(of(x.names[0]))
            slot.append(is_slot_of_list(x))
            dated.append(len(x.parts) > 1 and is_dated(x))
            begins.append(i == 0)
            leaves.append(len(leaf_at))
            for leaf in x.parts or [tuple(x.names)]:
                leaf_at.append(len(leaf_nodes))
                leaf_nodes += map(of, leaf)
            for name in x.names:
                pair_of.append(pairs.setdefault((k, of(name)), len(pairs)))
                line_of.append(len(first) - 1)
    ints = lambda x: np.array(x, np.int32)
    flags = tuple(np.array(x, bool) for x in (slot, dated, begins))
    return pickle.dumps((np.array(first, np.int64), *flags, ints(leaves), np.array(leaf_nodes, np.int64), ints(leaf_at), np.array([n for _, n in pairs], np.int64), ints(pair_of), ints(line_of)))


def packed_places(packed: bytes, template: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a packed block, under the constants' nodes: the nodes seen at a place, on how many pages at each (as
    ``_places``), and the nodes of the lines that head several slots (as ``host_counts``)."""
    first, slot, dated, begins, leaves, leaf_nodes, leaf_at, pair_node, pair_of, line_of = pickle.loads(packed)
    known = np.logical_or.reduceat(np.isin(leaf_nodes, template), leaf_at)
    constant = np.logical_and.reduceat(known, leaves) | np.isin(first, template)
    ends_page = np.append(begins[1:], True)
    shifted = lambda x, edge: (np.where(begins, edge, np.roll(x, 1)), np.where(ends_page, edge, np.roll(x, -1)))
    free = slot & ~constant
    (left, right), (_, date_next), (slot_left, slot_right) = shifted(constant, True), shifted(constant & dated, False), shifted(free, False)
    counts, nodes, at = [], *np.unique(pair_node, return_inverse=True)
    for flag in (left & right & ~date_next, right | slot_right, slot_left | slot_right):
        hit = np.zeros(len(pair_node), bool)
        hit[pair_of[flag[line_of]]] = True
        counts.append(np.bincount(at[hit], minlength=len(nodes)))
    second = np.where(ends_page, False, np.roll(slot_right, -1))
    return nodes, counts, first[constant & slot_right & second]


class Wrapper:
    """Names of constants, of heads of lists, and of lines that recur inside content."""

    def __init__(self, template: set[str], heads: set[str], usual: set[str]) -> None:
        self.template, self.heads, self.usual = template, heads, usual


def judge(lines: list[Line], w: Wrapper) -> list[bool]:
    """Whether each line is body."""
    n = len(lines)
    fixed: list[bool | None] = [None] * n
    for i, x in enumerate(lines):
        if is_constant(x, w.template):
            fixed[i] = False
        elif not is_slot_of_list(x) or x.names[0] in w.usual:
            fixed[i] = True
    out = [bool(f) for f in fixed]
    i, begun = 0, False
    while i < n:
        if fixed[i] is not None:
            begun = begun or bool(fixed[i])
            i += 1
            continue
        j = i
        while j < n and fixed[j] is None:
            j += 1
        head = i > 0 and fixed[i - 1] is False and lines[i - 1].names[0] in w.heads
        dated = j < n and fixed[j] is False and len(lines[j].parts) > 1 and is_dated(lines[j])
        above = j < n and bool(fixed[j])
        # the slots of a list are furniture; the headline stands right above the date or, once a page, the content
        last = lines[j - 1]
        marked = last.shape == "mt" or bool(_DATE_TAIL.search(last.text))
        if dated and not marked:
            out[j - 1] = True
        elif above and not marked and not begun and not (head and j - i == 1):
            out[j - 1] = True
        elif not head and j - i == 1 and not marked and (above or (i > 0 and fixed[i - 1] is True) or (i > 0 and not begun)):
            out[j - 1] = True
        begun = begun or dated or (above and out[j - 1])
        i = j
    return out


def is_dated(x: Line) -> bool:
    return any("0-0-0" in p for p in x.leaves)


def align_quote(quoted: list[str], lines: list[str]) -> list[int | None]:
    """For each quoted line the page line it repeats: the run of page lines that agrees with most of them."""
    q = [(i, x.strip()) for i, x in enumerate(quoted) if x.strip()]
    p = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    out: list[int | None] = [None] * len(quoted)
    if not q or not p:
        return out
    first: dict[str, list[int]] = {}
    for k, (_, x) in enumerate(p):
        first.setdefault(x, []).append(k)
        if len(x) > 60:
            first.setdefault(x[:60], []).append(k)
    votes: dict[int, int] = {}
    for n, (_, x) in enumerate(q):
        for k in first.get(x, ()) or first.get(x[:60], ()):
            votes[k - n] = votes.get(k - n, 0) + 1
    if not votes:
        return out
    shift = max(votes, key=lambda s: (votes[s], -s))
    for n, (i, x) in enumerate(q):
        k = n + shift
        if 0 <= k < len(p) and (p[k][1] == x or p[k][1].startswith(x)):
            out[i] = p[k][0]
    return out


_MEASURES = ("seen", "equal", "other", "outside", "ends", "among", "heads")


def _host(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))


def sample_pages(pages: DataFrame, most: int | None = None) -> DataFrame:
    """host, raw_text of all pages that have text; with ``most``, of at most so many a host, those with the least hash of the text.

    No query sets ``most``.
    """
    p = pages.select(_host("url").alias("host"), F.col("raw_text")).filter(F.length(F.trim("raw_text")) > 0)
    if most is None:
        return p
    # ranked before the exchange as well (a group limit), so that of a large host no more than ``most`` pages a task move
    by_hash = Window.partitionBy("host").orderBy(F.xxhash64("raw_text"))
    return p.withColumn("_tw_r", F.row_number().over(by_hash)).filter(F.col("_tw_r") <= most).select("host", "raw_text").distinct()


def induce(pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, most: int | None = None, block: int = BLOCK_PAGES) -> DataFrame:
    """host, name and the counts behind each wrapper, of the hosts and of all hosts together ('*').

    pages: url, raw_text; equal texts of a host count once.  keep: stores what it is given.
    """
    p = sample_pages(pages, most)
    text = F.xxhash64("raw_text")
    large = keep(p.groupBy("host").agg(F.count_distinct(text).alias("n")).filter(F.col("n") > block).select("host", F.ceil(F.col("n") / block).alias("blocks")))
    dealt = p.join(large, "host", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(text, F.col("blocks")))
    # a fixed number of tasks: alignment takes long for its bytes
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "host", "block").dropDuplicates(["host", "block", "raw_text"])
    columns = ["host", "name", *_MEASURES, "node", "packed"]

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        host, _, blocks = key
        if blocks == 1:
            return pd.DataFrame([(host, *r, None, None) for r in host_counts([pdf["raw_text"].to_list()])], columns=columns)
        read = read_pages(pdf["raw_text"].to_list())
        seen, equal, other = block_counts(read)
        # the pages' row has a node too: nulls would make the nodes floats
        rows = [(host, x, n, equal[x], other[x], 0, 0, 0, 0, node_of(x), None) for x, n in [("", len(read)), *seen.items()]]
        return pd.DataFrame([*rows, (host, None, *(0,) * 8, pack(read))] if read else rows, columns=columns)

    schema = "host string, name string, " + ", ".join(f"{m} bigint" for m in _MEASURES)
    counted = keep(dealt.groupBy("host", "block", "blocks").applyInPandas(count, schema + ", node bigint, packed binary"))
    own = every = counted.filter("node is null").select("host", "name", *_MEASURES)
    if not large.isEmpty():
        often, of_large = _large_hosts(counted, keep)
        own, every = own.unionByName(often), own.unionByName(of_large)
    every = every.groupBy("name").agg(*[F.sum(m).alias(m) for m in _MEASURES]).select(F.lit("*").alias("host"), "name", *_MEASURES)
    return own.unionByName(every).filter((F.col("seen") >= LEAST_PAGES) | (F.col("name") == ""))


def _large_hosts(counted: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The counts of hosts of several blocks, as ``host_counts`` has them: of the names a host sees often enough, and of all."""
    base = keep(counted.filter("node is not null and name is not null").groupBy("host", "node").agg(F.max("name").alias("name"), *[F.sum(m).alias(m) for m in _MEASURES[:3]]))
    pages = base.filter("name = ''").select("host", F.col("seen").alias("pages"))
    enough = (F.col("name") == "") | (F.col("seen") >= F.greatest(F.lit(float(LEAST_PAGES)), LEAST_SHARE * F.col("pages")))
    often = keep(base.join(pages, "host").filter(enough))
    packed = counted.filter("packed is not null").select("host", "packed")

    def template(rows: DataFrame, choose: Callable[[int, pd.DataFrame], set[str]]) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            chosen = choose(int(pdf["pages"].iloc[0]), pdf[pdf["name"] != ""])
            return pd.DataFrame([(key[0], sorted(map(node_of, chosen)))], columns=["host", "nodes"])

        return keep(rows.groupBy("host").applyInPandas(run, "host string, nodes array<bigint>"))

    def rows_of(names: list[str], pdf: pd.DataFrame) -> dict[str, tuple[int, ...]]:
        return {r[0]: tuple(map(int, r[1:])) for r in pdf[["name", *names]].itertuples(index=False, name=None)}

    def passed(nodes: DataFrame, heads: bool) -> DataFrame:
        """host, node and on how many pages it stands at each place, or how often it heads slots."""
        measures = _MEASURES[6:] if heads else _MEASURES[3:6]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for host, data, known in pdf[["host", "packed", "nodes"]].itertuples(index=False, name=None):
                    found, counts, headed = packed_places(data, np.array(known, np.int64))
                    if heads:
                        found, n = np.unique(headed, return_counts=True)
                        counts = [n]
                    some = np.any(counts, axis=0)
                    yield pd.DataFrame({"host": host, "node": found[some], **{m: c[some] for m, c in zip(measures, counts, strict=True)}})

        out = packed.join(nodes, "host").mapInPandas(run, "host string, node bigint, " + ", ".join(f"{m} bigint" for m in measures))
        return out.groupBy("host", "node").agg(*[F.sum(m).alias(m) for m in measures])

    now = template(often, lambda _, pdf: first_constants(rows_of(_MEASURES[:3], pdf)))
    for _ in range(ROUNDS):
        places = keep(passed(now, heads=False))
        new = template(often.join(places, ["host", "node"], "left").fillna(0, _MEASURES[3:6]), lambda n, pdf: constants(n, rows_of(_MEASURES[:6], pdf)))
        settled = now.join(new.withColumnRenamed("nodes", "then"), "host").filter("nodes <> then").isEmpty()
        now = new
        if settled:
            break
    parts = [base, places, passed(now, heads=True)]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    full = keep(merged.groupBy("host", "node").agg(F.max("name").alias("name"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in _MEASURES]))
    columns = ["host", "name", *_MEASURES]
    return full.join(pages, "host").filter(enough).select(columns), full.select(columns)


def wrapper_of(counts: dict[str, tuple[int, ...]]) -> tuple[set[str], set[str], set[str]]:
    """Constants, heads and usual names from counts (of ``_MEASURES``) by name."""
    pages = counts.get("", (0,))[0]
    fixed = constants(pages, {x: c[:6] for x, c in counts.items() if x})
    heads = {x for x in fixed if counts[x][6] >= max(LEAST_PAGES, HEAD_SHARE * counts[x][0])}
    least = max(2 * LEAST_PAGES, LEAST_SHARE * pages)
    usual = {x for x, c in counts.items() if x[:1] == "b" and x not in fixed and c[0] >= least and c[3] < OUTSIDE_SHARE / 2 * c[0] and c[4] < ENDS_SHARE * c[0]}
    return fixed, heads, usual


def wrappers(counts: DataFrame) -> tuple[Wrapper, DataFrame]:
    """The wrapper of all hosts together, which is bounded (a constant recurs on ``LEAST_SHARE`` of the pages), and
    host, plus, minus, heads, usual: what a host with enough pages of its own adds, and the constants that it
    keeps inside its content (names, one a line)."""
    every = counts.filter("host = '*'")
    total = every.filter("name = ''").agg(F.max("seen")).first()[0] or 0
    often = every.filter((F.col("name") == "") | (F.col("seen") >= max(LEAST_PAGES, LEAST_SHARE * total)))
    general = Wrapper(*wrapper_of({r["name"]: tuple(r[m] for m in _MEASURES) for r in often.collect()}))

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = {r[0]: tuple(r[1:]) for r in pdf[["name", *_MEASURES]].itertuples(index=False, name=None)}
        fixed, heads, usual = wrapper_of(found)
        sure = {x for x, c in found.items() if x and c[0] >= OWN_PAGES}
        sets = ((fixed & sure) - general.template, general.template & usual & sure, (heads & sure) - general.heads, (usual & sure) - general.usual)
        return pd.DataFrame([(key[0], *("\n".join(sorted(s)) for s in sets))], columns=["host", "plus", "minus", "heads", "usual"])

    return general, counts.filter("host <> '*'").groupBy("host").applyInPandas(own, "host string, plus string, minus string, heads string, usual string")


def strip_boilerplate(pages: DataFrame, general: Wrapper, hosts: DataFrame) -> DataFrame:
    """src STRING, rec_key STRING, line_no INT, body BOOLEAN of every non-blank line.

    pages: rec_key, url, raw_text, quote_key, quote.  quote: lines about the page under quote_key, of which
    line 0 is no quotation; both may be null.  general, hosts: from ``wrappers``.
    """
    pages = pages.select("rec_key", "raw_text", "quote_key", "quote", _host("url").alias("host"))  # other columns are ignored
    joined = pages.join(hosts, "host", "left")
    cols = ["rec_key", "raw_text", "quote_key", "quote", "host", "plus", "minus", "heads", "usual"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        names = lambda x: set(x.split("\n")) if x else set()
        for pdf in batches:
            rows = []
            for key, raw, quote_key, quote, host, *own in pdf[cols].itertuples(index=False, name=None):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    plus, minus, heads, usual = map(names, own)
                    template = (general.template | plus) - minus
                    known[host] = Wrapper(template, general.heads | heads, (general.usual | usual) - template)
                w = known[host]
                lines = read_lines(raw)
                verdict = {x.at: v for x, v in zip(lines, judge(lines, w), strict=True)}
                if key is not None:
                    rows += [("page", key, i, v) for i, v in verdict.items()]
                if quote_key is not None and quote:
                    quoted = quote.split("\n")[1:]
                    same = align_quote(quoted, (raw or "").split("\n"))
                    alone = read_lines("\n".join(quoted))
                    for x, v in zip(alone, judge(alone, w), strict=True):
                        s = same[x.at]
                        rows.append(("quote", quote_key, x.at + 1, v if s is None else verdict[s]))
            yield pd.DataFrame(rows, columns=["src", "rec_key", "line_no", "body"])

    return joined.select(*cols).mapInPandas(run, "src string, rec_key string, line_no int, body boolean")
