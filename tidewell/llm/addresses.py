"""Which address records denote the same place: building, house number or crossing.

1. Each location is read into components (``address_parse``).  Names become tokens: the syllables of
   their characters by a general reading table (``readings``), or of a romanised name by cutting it
   into syllables of that table in every way that fits.
2. A deletion-neighbourhood index takes all names, inside blocks that stand in for postcodes: a road
   with its kind and house number, an estate with its building and again with its road's number, a
   crossing with the kinds of both roads in both orders.  Two names of a block and locality, or of a
   neighbouring one (a locality left out), are candidates if they agree once one token is left out
   of either or both (``candidates``).
3. Which syllables are written for one another is learned from the candidates: pairs that turn up far
   more often than their other pairings, at equal house numbers (``confusions``).
4. A name's tokens are assigned to a candidate's at least cost (``assignment_cost``): the same
   character is free, a slip of the pen or a romanisation of the same reading cheap, a lost or wrong
   token dear, two different well-established characters never; the cheapest, then most frequent,
   established name of the block is what the name means.
5. Estates and house numbers are assigned to one another over all records: of a house number's
   estates the one with most records; records that name only one side get the other.
6. Records of one parcel and building (or one house number, or one crossing) share a place
   (``members``) and are paired under hard vetoes: house number, building, phase, district, town, and
   the kinds of estates and roads.  Unit and room do not matter.

Places are joined by key; no pair outside a place is ever formed.  Inside a place, records with the
same components form classes; vetoes are looked at once a pair of classes (``same_place_pairs``).
The list of district names (an error beyond ``MAX_DISTRICTS``), the counts of characters and those of
syllable pairs reach the driver: all bounded by the script, not by the records.

Defined results: null, empty and vague locations match nothing; repeated rows count once; parts left
out never veto; an address that reaches only an estate or a road matches nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.address_parse import parse_location

MAX_DISTRICTS = 5000
#: a character with less than this share of the most frequent one of its reading is a slip
SLIP_SHARE = 0.25
#: least number, and least share of a syllable's pairings, that make two syllables confusable
LEAST_CONFUSED, CONFUSED_SHARE = 3, 0.25
#: costs of an assignment: a slip or romanisation of the same reading, another token or a lost one; the most that is accepted
SLIP_COST, TOKEN_COST, MOST_COST = 0.1, 1.0, 1.2
_NEVER = 9.0


def district_names(*columns: DataFrame, most: int = MAX_DISTRICTS) -> dict[str, str]:
    """Bare to full name of the districts that region columns (one-column frames) use, longest first."""
    union = columns[0].toDF("r")
    for c in columns[1:]:
        union = union.unionByName(c.toDF("r"))
    rows = union.filter(F.col("r").rlike("^.{2,8}[区县市旗]$")).select("r").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} district names: pass a larger bound or clean the region column")
    return dict(sorted(((r["r"][:-1], r["r"]) for r in rows), key=lambda x: (-len(x[0]), x)))


@functools.cache
def _readings(_: str, jvm) -> dict[str, str]:
    han = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    rules = jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    spelled = rules.transliterate("\n".join(han)).split("\n")
    return {c: s for c, s in zip(han, (x.strip().replace(" ", "") for x in spelled), strict=True) if s.isascii() and s.isalpha()}


def readings(spark: SparkSession) -> dict[str, str]:
    """Character to romanised syllable, by the public transliteration rules that the JVM's Unicode library brings."""
    return _readings(spark.sparkContext.applicationId, spark._jvm)


def segment(word: str, inventory: frozenset[str], want: int) -> list[str]:
    """Ways to cut a romanised word into syllables, spaced; those of ``want`` syllables, else of fewest; else the word."""
    longest = max(map(len, inventory), default=0)
    ways: list[list[list[str]]] = [[[]]] + [[] for _ in word]
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            if ways[start] and word[start:end] in inventory:
                ways[end] += [[*w, word[start:end]] for w in ways[start] if len(w) <= want]
    found = ways[len(word)]
    fit = [w for w in found if len(w) == want] or [w for w in found if len(w) == min(map(len, found))]
    return [" ".join(w) for w in fit] or [word]


_PARSED = (
    "rec_key string, kind string, district string, town string, latin boolean, road string, road_kind string, road_syl array<string>, number int, "
    "estate string, estate_kind string, estate_syl array<string>, phase int, building int, road2 string, road2_kind string, road2_syl array<string>"
)


def parse_records(records: DataFrame, districts: dict[str, str], reading: dict[str, str]) -> DataFrame:
    """records: rec_key, location.  Locations without a place are dropped.  *_syl: the ways to spell a name."""
    inventory = frozenset(reading.values())
    spelled = {"".join(reading.get(c, c) for c in bare): full for bare, full in districts.items()}

    def district_of(name: str) -> str:
        """The district that a romanised name means: the one nearest in letters, if only one is near."""
        if name in spelled:
            return spelled[name]
        near = [full for s, full in spelled.items() if len(s) == len(name) and sum(x != y for x, y in zip(s, name, strict=True)) == 1]
        return near[0] if len(near) == 1 else name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(100_000)
        def ways(name: str | None, latin: bool, want: int) -> list[str] | None:
            if name is None:
                return None
            return segment(name, inventory, want) if latin else [" ".join(reading.get(c, c) for c in name)]

        def halves(x: str | None) -> tuple[str | None, str | None]:
            return tuple(x.split("|", 1)) if x and "|" in x else (x, None)

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["rec_key"], pdf["location"], strict=True):
                p = parse_location(text, districts)
                if p.kind is None:
                    continue
                (r, rk), (e, ek), (r2, rk2) = halves(p.road), halves(p.estate), halves(p.road2)
                d = district_of(p.district) if p.latin and p.district else p.district
                rows.append((key, p.kind, d, p.town, p.latin, r, rk, ways(r, p.latin, 2), p.number, e, ek, ways(e, p.latin, 3), p.phase, p.building, r2, rk2, ways(r2, p.latin, 2)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")]).astype({c: "Int32" for c in ("number", "phase", "building")})

    return records.select("rec_key", "location").filter(F.length(F.trim("location")) > 0).mapInPandas(run, _PARSED)


def _road_block() -> Column:
    return F.concat_ws("|", F.lit("R"), "road_kind", F.col("number").cast("string"))


def _estate_blocks() -> tuple[Column, Column]:
    at = F.when(F.col("road").isNotNull() & F.col("number").isNotNull(), F.concat_ws("|", F.lit("N"), "road_kind", F.col("number").cast("string")))
    return F.concat_ws("|", F.lit("E"), F.col("building").cast("string")), at


def names(parsed: DataFrame) -> DataFrame:
    """block, loc (district or null), kind (of a written estate), written, latin, spelled, n of every name in each of its blocks."""
    building, at = _estate_blocks()
    zh_kind = F.when(~F.col("latin"), F.col("estate_kind"))
    item = lambda block, kind, written, spelled: F.struct(block.alias("block"), kind.cast("string").alias("kind"), written.alias("written"), spelled.alias("spelled"))
    none = F.lit(None)
    both = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws(" ", x, y))))
    crossing = F.col("kind") == "crossing"
    items = F.array(
        F.when(~crossing & F.col("road").isNotNull() & F.col("number").isNotNull(), item(_road_block(), none, F.col("road"), F.col("road_syl"))),
        F.when(F.col("estate").isNotNull() & F.col("building").isNotNull(), item(building, zh_kind, F.col("estate"), F.col("estate_syl"))),
        F.when(F.col("estate").isNotNull() & at.isNotNull(), item(at, zh_kind, F.col("estate"), F.col("estate_syl"))),
        F.when(crossing, item(F.concat_ws("|", F.lit("X"), "road_kind", "road2_kind"), none, F.concat_ws("/", "road", "road2"), both(F.col("road_syl"), F.col("road2_syl")))),
        F.when(crossing, item(F.concat_ws("|", F.lit("X"), "road2_kind", "road_kind"), none, F.concat_ws("/", "road2", "road"), both(F.col("road2_syl"), F.col("road_syl")))),
    )
    flat = parsed.select(F.col("district").alias("loc"), "latin", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i"))
    return flat.groupBy("i.block", "loc", "i.kind", "i.written", "latin").agg(F.first("i.spelled").alias("spelled"), F.count("*").alias("n"))


def candidates(all_names: DataFrame, asking: Column | None = None) -> DataFrame:
    """Pairs (a_..., b_...) of names of one block, neighbouring localities and kinds that agree once one token is left out.

    The deletion neighbourhood: a name stands under itself, under itself with each token replaced by a
    blank (another token), and under itself without each token (a lost one, met by whole names only; of a road's
    two tokens none may be lost).  asking: which names ask (a); every name answers (b).
    """
    s = F.split("s", " ")
    at = F.sequence(F.lit(1), F.size(s))
    without = lambda i, mark: F.array_join(F.concat(F.slice(s, F.lit(1), i - 1), mark, F.slice(s, i + 1, F.size(s))), " ")
    blank, lost = F.transform(at, lambda i: without(i, F.array(F.lit("*")))), F.transform(at, lambda i: without(i, F.array().cast("array<string>")))
    sign = lambda m, x: F.transform(x, lambda y: F.concat(F.lit(m), y))
    spelled = all_names.select("*", F.explode("spelled").alias("s"))
    short = F.array("s")
    left, right = (F.when(F.col("block").startswith("R"), F.concat(short, blank)).otherwise(F.concat(short, blank, sign(m, lost), sign(w, short))) for m, w in ("-+", "+-"))
    cols = ("loc", "kind", "written", "latin", "s", "n")
    ask = spelled if asking is None else spelled.filter(asking)
    a = ask.select("block", F.explode(left).alias("key"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = spelled.select("block", F.explode(right).alias("key"), *[F.col(c).alias(f"b_{c}") for c in cols])
    near = a.join(b, ["block", "key"]).filter(F.col("a_written") != F.col("b_written"))
    for c in ("loc", "kind"):
        near = near.filter(F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(True)))
    return near.drop("key").distinct()


def confusions(near: DataFrame) -> dict[str, str]:
    """Syllable to the least of those it is written for: pairings at equal house numbers and in crossings, where all
    other tokens agree, that are far more frequent than the syllable's other ones."""
    x, y = F.split("a_s", " "), F.split("b_s", " ")
    one = near.filter(F.col("block").rlike("^[NX]") & (F.size(x) == F.size(y)) & (F.col("a_s") < F.col("b_s")))
    diff = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"] != z["y"])
    pairs = one.select(diff.alias("d")).filter("size(d) = 1").select(F.least("d.x", "d.y")[0].alias("p"), F.greatest("d.x", "d.y")[0].alias("q"))
    counts = {(r["p"], r["q"]): r["n"] for r in pairs.groupBy("p", "q").agg(F.count("*").alias("n")).collect()}
    total: dict[str, int] = {}
    for (p, q), n in counts.items():
        total[p], total[q] = total.get(p, 0) + n, total.get(q, 0) + n
    root: dict[str, str] = {}

    def find(v: str) -> str:
        while root.get(v, v) != v:
            v = root[v]
        return v

    for (p, q), n in sorted(counts.items()):
        if n >= LEAST_CONFUSED and n >= CONFUSED_SHARE * min(total[p], total[q]):
            u, v = sorted((find(p), find(q)))
            root[v] = u
    return {v: find(v) for v in root if find(v) != v}


def name_characters(parsed: DataFrame) -> dict[str, int]:
    """How often each character stands in a written name; the script bounds the result."""
    written = parsed.filter(~F.col("latin")).select(F.explode(F.array("road", "estate", "road2")).alias("s")).filter(F.col("s").isNotNull())
    chars = written.select(F.explode(F.split("s", "")).alias("c")).filter(F.col("c") != "")
    return {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.count("*").alias("n")).collect()}


def slips(counts: dict[str, int], sound: Callable[[str], str]) -> frozenset[str]:
    """Characters that are rare beside another of the same sound: written by a slip."""
    top: dict[str, int] = {}
    for c, n in counts.items():
        top[sound(c)] = max(top.get(sound(c), 0), n)
    return frozenset(c for c, n in counts.items() if n < SLIP_SHARE * top[sound(c)])


def assignment_cost(a: list[tuple[str, str | None]], b: list[tuple[str, str | None]], slip: frozenset[str], firm: bool) -> float:
    """Least cost of assigning the tokens (sound, character or None) of two names to each other in order.

    firm: house number and road agree as well, so that one established character may stand for another.
    """

    def cost(x: tuple[str, str | None], y: tuple[str, str | None]) -> float:
        (s, c), (t, d) = x, y
        if c is not None and c == d:
            return 0.0
        sure = c is not None and d is not None and c not in slip and d not in slip
        if s == t:
            return _NEVER if sure else SLIP_COST
        if c is None or d is None or sure:
            return TOKEN_COST if firm else _NEVER
        return TOKEN_COST

    row = [TOKEN_COST * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        last, row = row, [TOKEN_COST * (i + 1)]
        for j, y in enumerate(b):
            row.append(min(last[j] + cost(x, y), last[j + 1] + TOKEN_COST, row[j] + TOKEN_COST))
    return row[-1]


def assigned(near: DataFrame, slip: frozenset[str], same: dict[str, str]) -> DataFrame:
    """block, loc, kind, written, latin, means, cost: the name that each name means, where it is another one."""
    keys = ["block", "a_loc", "a_kind", "a_written", "a_latin"]
    schema = ", ".join([*(f"{k} {'boolean' if k == 'a_latin' else 'string'}" for k in keys), "b_written string", "cost double", "odd boolean", "n bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(200_000)
        def tokens(written: str, latin: bool, s: str) -> tuple[tuple[str, str | None], ...]:
            chars = [None] * len(s.split(" ")) if latin else list(written.replace("/", ""))
            return tuple((same.get(x, x), c) for x, c in zip(s.split(" "), chars, strict=False))

        @functools.lru_cache(200_000)
        def odd(written: str, latin: bool) -> bool:
            return latin or any(c in slip for c in written)

        for pdf in batches:
            rows = []
            for block, loc, kind, aw, al, as_, an, bw, bl, bs, bn in pdf[["block", "a_loc", "a_kind", "a_written", "a_latin", "a_s", "a_n", "b_written", "b_latin", "b_s", "b_n"]].itertuples(index=False, name=None):
                a_odd, b_odd = odd(aw, al), odd(bw, bl)
                firm = block[0] == "N"
                # an established name stays what it is, unless it stands once beside a frequent one at the same number
                if (not a_odd and (b_odd or not (firm and 3 * an <= bn))) or (a_odd and b_odd and (bl > al or (bl == al and (bn, bw) < (an, aw)))):
                    continue
                cost = assignment_cost(tokens(aw, al, as_), tokens(bw, bl, bs), slip, firm)
                if cost <= (MOST_COST if block[0] != "R" else TOKEN_COST / 2):
                    rows.append((block, loc, kind, aw, al, bw, cost, b_odd, bn))
            yield pd.DataFrame(rows, columns=[*keys, "b_written", "cost", "odd", "n"])

    chosen = near.mapInPandas(run, schema).groupBy(*keys).agg(F.min_by(F.struct("b_written", "cost"), F.struct("odd", "cost", -F.col("n"), "b_written")).alias("m"))
    return chosen.select("block", F.col("a_loc").alias("loc"), F.col("a_kind").alias("kind"), F.col("a_written").alias("written"), F.col("a_latin").alias("latin"), F.col("m.b_written").alias("means"), F.col("m.cost").alias("cost"))


def _meaning(parsed: DataFrame, found: DataFrame, block: Column, kind: Column, written: Column, into: str) -> DataFrame:
    """parsed with ``into``: struct of what a written name means and the cost, null where it means itself."""
    f = found.select(*[F.col(c).alias(f"_tw_{c}") for c in ("block", "loc", "kind", "written", "latin")], F.struct("cost", "means").alias(into))
    on = (block == F.col("_tw_block")) & (written == F.col("_tw_written")) & (F.col("latin") == F.col("_tw_latin")) & F.col("district").eqNullSafe(F.col("_tw_loc")) & kind.eqNullSafe(F.col("_tw_kind"))
    return parsed.join(f, on, "left").drop(*[f"_tw_{c}" for c in ("block", "loc", "kind", "written", "latin")])


def place_keys(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """parsed with what its names mean (road_tok, estate_tok), what other records say of parts left out (zh_kind, at_road,
    at_number), and place: the key under which records are compared."""
    zh_kind = F.when(~F.col("latin"), F.col("estate_kind"))
    none = F.lit(None).cast("string")
    building, at = _estate_blocks()
    crossing = F.col("kind") == "crossing"
    p = _meaning(parsed, found, F.when(~crossing, _road_block()), none, F.col("road"), "_tw_road")
    p = _meaning(p, found, building, zh_kind, F.col("estate"), "_tw_e1")
    p = _meaning(p, found, at, zh_kind, F.col("estate"), "_tw_e2")
    p = _meaning(p, found, F.when(crossing, F.concat_ws("|", F.lit("X"), "road_kind", "road2_kind")), none, F.concat_ws("/", "road", "road2"), "_tw_x")
    p = p.withColumn("road_tok", F.when(F.col("number").isNotNull(), F.concat_ws("|", F.coalesce("_tw_road.means", "road"), "road_kind")))
    p = p.withColumn("estate_tok", F.coalesce(F.array_min(F.filter(F.array("_tw_e1", "_tw_e2"), lambda x: x.isNotNull()))["means"], F.col("estate")))
    both_roads = F.split(F.coalesce("_tw_x.means", F.concat_ws("/", "road", "road2")), "/")
    ends = F.array_sort(F.array(F.concat_ws("|", both_roads[0], "road_kind"), F.concat_ws("|", F.get(both_roads, F.lit(1)), "road2_kind")))
    p = p.withColumn("_tw_ends", ends).drop("_tw_road", "_tw_e1", "_tw_e2", "_tw_x")
    both = p.filter((F.col("kind") == "building") & F.col("estate_tok").isNotNull() & F.col("road_tok").isNotNull() & F.col("number").isNotNull())
    links = both.groupBy("estate_tok", zh_kind.alias("zh_kind"), "road_tok", "number").agg(F.count("*").alias("n"))
    by_road = links.groupBy(F.col("road_tok").alias("_tw_r"), F.col("number").alias("_tw_n")).agg(
        F.max_by("estate_tok", F.struct("n", "estate_tok")).alias("_tw_estate"), F.max_by("zh_kind", F.struct(F.when(F.col("zh_kind").isNotNull(), F.col("n")).alias("n"), "zh_kind")).alias("_tw_kind")
    )
    p = p.join(by_road, (F.col("road_tok") == F.col("_tw_r")) & (F.col("number") == F.col("_tw_n")) & (F.col("kind") == "building"), "left").drop("_tw_r", "_tw_n")
    # the other way: an estate of one name and kind that all links put at one house number
    by_estate = links.filter("zh_kind is not null").groupBy(F.col("estate_tok").alias("_tw_e"), F.col("zh_kind").alias("_tw_k")).agg(
        F.count_distinct("road_tok", "number").alias("_tw_places"), F.max_by("road_tok", F.struct("n", "road_tok", "number")).alias("_tw_road"), F.max_by("number", F.struct("n", "road_tok", "number")).alias("_tw_number")
    )
    alone = (F.col("kind") == "building") & F.col("road_tok").isNull()
    p = p.withColumn("zh_kind", F.coalesce(zh_kind, F.col("_tw_kind"))).join(by_estate.filter("_tw_places = 1"), (F.col("estate_tok") == F.col("_tw_e")) & (F.col("zh_kind") == F.col("_tw_k")) & alone, "left")
    p = p.withColumn("at_road", F.coalesce("road_tok", "_tw_road")).withColumn("at_number", F.coalesce("number", "_tw_number")).drop("_tw_kind", "_tw_e", "_tw_k", "_tw_places", "_tw_road", "_tw_number")
    owner = F.coalesce("estate_tok", "_tw_estate")
    place = (
        F.when(crossing, F.concat_ws("|", F.lit("X"), F.col("_tw_ends")[0], F.col("_tw_ends")[1]))
        .when(F.col("kind") == "house", F.concat_ws("|", F.lit("H"), "road_tok", F.col("number").cast("string")))
        .when(owner.isNotNull(), F.concat_ws("|", F.lit("E"), owner, F.col("building").cast("string")))
        .otherwise(F.concat_ws("|", F.lit("R"), "road_tok", F.col("number").cast("string"), F.col("building").cast("string")))
    )
    return p.withColumn("place", place).drop("_tw_estate", "_tw_ends")


_VETO = ("district", "town", "phase", "at_number", "zh_kind", "at_road")


def members(records: DataFrame, districts: dict[str, str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rec_key, place and the components that veto (``_VETO``) of every record (rec_key, location) that names a place.

    keep: stores rows once, as they are used by several steps.
    """
    reading = readings(records.sparkSession)
    parsed = keep(parse_records(records.dropDuplicates(["rec_key"]), districts, reading))
    named = keep(names(parsed))
    sure = F.col("block").rlike("^[NX]")  # blocks in which established names ask as well, and confusions show
    near = keep(candidates(named.filter(sure)))
    same = confusions(near)
    slip = slips(name_characters(parsed), lambda c: same.get(reading.get(c, c), reading.get(c, c)))
    odd = F.col("latin") | (F.col("written").rlike("[" + re.escape("".join(sorted(slip))) + "]") if slip else F.lit(False))
    near = near.unionByName(candidates(named.filter(~sure), odd))
    placed = place_keys(parsed, keep(assigned(near, slip, same)))
    return placed.withColumn("at_road", F.when(F.col("kind") != "crossing", F.col("at_road"))).select("rec_key", "place", *_VETO)


def same_place_pairs(placed: DataFrame) -> DataFrame:
    """key_a, key_b of the records of one place, after the vetoes, which are looked at once a pair of classes."""
    classes = placed.select("place", *_VETO).distinct()
    a, b = (classes.select("place", *[F.col(c).alias(f"{s}_{c}") for c in _VETO]) for s in "ab")
    veto = F.lit(False)
    for c in _VETO:
        veto = veto | F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    allowed = a.join(b, "place").filter(~veto)

    def of(side: str) -> DataFrame:
        return placed.select("place", *[F.col(c).alias(f"{side}_{c}") for c in _VETO], F.col("rec_key").alias(f"key_{side}"))

    def on(side: str, x: DataFrame, y: DataFrame) -> Column:
        same = x["place"] == y["place"]
        for c in _VETO:
            same = same & x[f"{side}_{c}"].eqNullSafe(y[f"{side}_{c}"])
        return same

    one = of("a")
    left = allowed.join(one, on("a", allowed, one)).select(allowed["place"], *[allowed[f"b_{c}"] for c in _VETO], "key_a")
    two = of("b")
    return left.join(two, on("b", left, two)).filter("key_a < key_b").select("key_a", "key_b")


def match_addresses(records: DataFrame, districts: dict[str, str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key_a, key_b of records (rec_key, location) at the same place."""
    return same_place_pairs(keep(members(records, districts, keep)))
