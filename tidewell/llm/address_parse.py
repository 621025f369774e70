"""Reading one postal address, in Chinese or in romanised form, into components.

``parse_location`` never raises; what it cannot read stays ``None``.  Components: district,
town, road, number, estate, phase, building, unit, room, and for crossings the second road.
Names keep their written characters; ``spell`` gives the romanised form used as a token.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# What estates, roads and the parts of an address are called.
ESTATE_KINDS = (
    "花园", "广场", "名邸", "雅居", "新村", "佳园", "小区", "华庭", "豪庭", "公寓", "家园", "公馆", "里", "府", "城", "苑",
)
ESTATE_KINDS_EN = (
    "Park", "Yard", "Estate", "Court", "Village", "Garden", "Town", "Mansion", "Manor", "Residence", "Square",
    "Place", "Homes", "Plaza", "Apartments", "Terrace",
)
ROAD_KINDS_EN = {"Road": "路", "Street": "街", "Lane": "巷", "Avenue": "大道"}
SIDES_EN = {"East": "东", "West": "西", "South": "南", "North": "北"}
ADMIN_NAMES = ("东岭省", "澜川市")

_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_NUM = r"(?:\d+|[零〇一二三四五六七八九十百千两]+)"


def number_of(s: str | None) -> int | None:
    """Value of Arabic or Chinese digits; None where there is no number."""
    if not s:
        return None
    if s.isdigit():
        return int(s)
    total, cur = 0, 0
    if all(c in _DIGIT for c in s):
        return int("".join(str(_DIGIT[c]) for c in s))
    for c in s:
        if c in _DIGIT:
            cur = _DIGIT[c]
        elif c in "十百千":
            total += (cur or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            cur = 0
        else:
            return None
    return total + cur


@dataclass
class Location:
    district: str | None = None
    town: str | None = None
    road: str | None = None  # stem, "|", side and kind
    number: int | None = None
    estate: str | None = None  # stem, "|", kind
    phase: int | None = None
    building: int | None = None
    unit: int | None = None
    room: int | None = None
    road2: str | None = None
    latin: bool = False

    @property
    def kind(self) -> str | None:
        if self.road and self.road2:
            return "crossing"
        if self.building is not None and (self.estate or (self.road and self.number is not None)):
            return "building"
        if self.road and self.number is not None and self.building is None and not self.estate:
            return "house"
        return None


_EN = re.compile(
    r"^\s*(?:Rm\s*(?P<room>\d+)\s*,\s*)?(?:Unit\s*(?P<unit>\d+)\s*,\s*)?(?:Bldg\s*(?P<bldg>\d+)\s*,\s*)?"
    r"(?:(?P<est>[A-Za-z]+)\s+(?P<ekind>" + "|".join(ESTATE_KINDS_EN) + r")(?:\s+Phase\s*(?P<phase>\d+))?\s*,\s*)?"
    r"(?:(?P<no>\d+)\s+(?P<road>[A-Za-z]+)(?:\s+(?P<side>East|West|South|North))?\s+(?P<rkind>Road|Street|Lane|Avenue))?"
    r"\s*(?:,\s*(?P<dist>[A-Za-z]+)\s+(?:District|County))?\s*$",
    re.I,
)
_HAN = "一-鿿"
_ROAD = rf"(?:[东西南北]?(?:路|街(?![道办])|巷)|大道)"
_ESTATE = "(?:" + "|".join(ESTATE_KINDS) + ")"
_TOWN = re.compile(rf"([{_HAN}]{{2,3}}?)(街道|街办|镇区|镇|乡)")
_ROAD_AT = re.compile(rf"([{_HAN}]{{2,3}}?)({_ROAD})")
_ESTATE_AT = re.compile(rf"([{_HAN}]{{2,4}}?)({_ESTATE})(?:([一二三四五六七八九十]|\d)期)?")
_BLDG = re.compile(rf"({_NUM})\s*(?:号楼|#楼|栋楼?|幢楼?|座|号幢)")
_DASH = re.compile(r"(?<![\d-])(\d{1,3})-(\d{1,2})-(\d{2,4})(?![\d-])")
_NO_AFTER = re.compile(rf"\s*[(（]?({_NUM})\s*(号|#)?(?!\s*(?:楼|栋|幢|座|单|室|期|#楼|-))")
_NO_BEFORE = re.compile(rf"({_NUM})\s*(?:号|#)\s*$")
_UNIT = re.compile(rf"({_NUM})\s*单元?")
_ROOM = re.compile(r"(\d{3,4})\s*室?\s*$|单元?\s*(\d{3,4})|(\d{3,4})室")
_CONNECT = re.compile(r"^\s*(?:和|与|跟|及|、|/|&|交叉)\s*")
_SEP = re.compile(r"[，,、;；()（）\s]+")


def _admin(s: str, districts: dict[str, str], admin: tuple[str, ...]) -> tuple[str, str | None]:
    """Strips province and city, then the district; returns the rest and the district."""
    for full in admin:
        for name in (full, full[:-1]):
            if s.startswith(name):
                s = s[len(name) :].lstrip()
                break
    for bare, full in districts.items():
        if s.startswith(full):
            return s[len(full) :].lstrip(), full
        if s.startswith(bare) and not re.match(_ROAD, s[len(bare) :]):  # a road may be called like a district
            return s[len(bare) :].lstrip(), full
    return s, None


def parse_location(text: str | None, districts: dict[str, str], admin: tuple[str, ...] = ADMIN_NAMES) -> Location:
    """districts: bare name to full name, e.g. 砚湾 to 砚湾区."""
    loc = Location()
    if not text or not text.strip():
        return loc
    s = unicodedata.normalize("NFKC", text).replace("號", "号").strip()
    if m := _EN.match(s):
        if m["road"] or m["est"]:
            loc.latin = True
            loc.road = m["road"] and m["road"].lower() + "|" + (SIDES_EN.get((m["side"] or "").title(), "")) + ROAD_KINDS_EN[m["rkind"].title()]
            loc.number = number_of(m["no"])
            loc.estate = m["est"] and m["est"].lower()
            loc.phase = number_of(m["phase"])
            loc.building, loc.unit, loc.room = number_of(m["bldg"]), number_of(m["unit"]), number_of(m["room"])
            if m["dist"]:
                loc.district = m["dist"].lower()  # romanised; the caller knows the readings
            return loc
    # building, unit and room first: they carry their own marks
    if m := _DASH.search(s):
        loc.building, loc.unit, loc.room = (int(x) for x in m.groups())
        s = s[: m.start()] + " " + s[m.end() :]
    elif m := _BLDG.search(s):
        loc.building = number_of(m[1])
        tail = s[m.end() :]
        if u := _UNIT.search(tail):
            loc.unit = number_of(u[1])
        if r := _ROOM.search(tail.split("(")[0]):
            loc.room = number_of(r[1] or r[2] or r[3])
        tail = re.sub(rf"^\s*(?:{_NUM}\s*单元?)?\s*(?:\d{{3,4}}\s*室?)?", " ", tail)
        s = s[: m.start()] + " " + tail
    roads: list[tuple[str, int | None]] = []
    for part in _SEP.split(s):
        rest, d = _admin(part, districts, admin)
        if d:
            loc.district = loc.district or d
        before = None
        while rest:
            if lead := re.match(rf"^({_NUM})(?:号|#)(?=[{_HAN}])", rest):  # the number stands before the road
                before, rest = number_of(lead[1]), rest[lead.end() :]
                continue
            if roads and (c := _CONNECT.match(rest)) and (then := _ROAD_AT.match(rest, c.end())):
                # 和 may also begin a name: then what follows it is no name and a side, as in 和锦北路
                begins = c[0].strip() in ("和", "与") and then[1][-1] in "东西南北" and _ROAD_AT.match(rest)
                if not begins:
                    rest = rest[c.end() :]
            m = _TOWN.match(rest)
            r, e = _ROAD_AT.match(rest), _ESTATE_AT.match(rest)
            if m and (not r or m.end() <= r.end()) and (not e or m.end() <= e.end()):
                loc.town = loc.town or m[1]
                rest = rest[m.end() :]
                continue
            if r and (not e or r.end() <= e.end()):
                rest = rest[r.end() :]
                no = before
                if n := _NO_AFTER.match(rest):
                    no = number_of(n[1])
                    rest = rest[n.end() :]
                roads.append((r[1] + "|" + r[2], no))
                before = None
                continue
            if e:
                if loc.estate is None:
                    loc.estate, loc.phase = e[1] + "|" + e[2], number_of(e[3])
                rest = rest[e.end() :]
                continue
            if p := re.match(r"^([一二三四五六七八九十]|\d)期", rest):
                loc.phase = loc.phase or number_of(p[1])
                rest = rest[p.end() :]
                continue
            if n := re.match(rf"^({_NUM})\s*(?:号|#)?$", rest):
                if roads and roads[-1][1] is None:
                    roads[-1] = (roads[-1][0], number_of(n[1]))
                break
            rest = rest[1:]
    if roads:
        loc.road, loc.number = roads[0]
        if len(roads) > 1 and loc.building is None and loc.number is None:
            loc.road2 = roads[1][0]
        elif loc.number is None:
            for r, n in roads[1:]:
                if n is not None:
                    loc.road, loc.number = r, n
                    break
    return loc

