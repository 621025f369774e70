"""Generated personal data, things that only look like it, and sentences that carry them, for fitting.

Nothing here is read when texts are searched.  ``sentences`` puts generated pieces into carrier sentences,
those into sentences of real texts, and gives the spans; carriers are split into two sets, so that what is
held out has wordings the fitting never saw.
"""

from __future__ import annotations

import random
import re

# Carriers.  {n} name, {p} phone, {m} mail, {i} identity number, {a} address; {N} {P} {M} {I} {A} look like one.
CARRIERS = (
    "我叫{n}，电话{p}。", "联系人：{n}，手机{p}", "本人{n}，身份证{i}。", "收件人{n}，地址{a}，电话{p}。", "请找{n}核实。", "业主{n}反映楼道漏水。",
    "{n}表示愿意配合。", "昨天{n}来过一次。", "和{n}一起去看过。", "{n}的号码是{p}，请回电。", "姓名{n}，证件号码{i}。", "住户{n}、{n}都签了字。",
    "我住在{a}，麻烦处理。", "地址是{a}。", "{a}夜里太吵。", "家住{a}的居民反映。", "位于{a}的路灯坏了。", "关于{a}的问题，请答复。", "寄到{a}就行。", "投诉地点：{a}；",
    "请发到{m}。", "邮箱{m}，电话{p}。", "材料寄到{m}即可", "回复请写{m}，谢谢。", "手机号：{p}", "您可以打{p}找我", "联系电话 {p} ，随时可以。", "我的电话{p}您记一下", "回电{p}",
    "身份证号{i}，请登记。", "证件{i}已上传。", "证号 {i}", "户主{n}，地址{a}", "登记的是{n}，住{a}。", "老人{n}需要照顾。", "{n}（女）来电。", "找{n}，{p}。",
    "{N}来电反映。", "{N}那边也一样。", "听{N}说过。", "旁边的{N}关门了。", "在{N}门口。", "{N}附近都这样。",
    "工单号为{P}，请查。", "受理编号{P}。", "取件码{P}", "订单{P}未送达。", "涉及金额{P}元", "批次{P}已发。", "编号：{P}，", "尾号{P}的车。", "流水{P}",
    "受理编号{I}。", "单号{I}一直没有回音。", "订单{I}已取消。", "编号{I}，请核对。", "流水号 {I}", "批次{I}",
    # the same words without a name
    "我叫了三次都没人应。", "联系人待定。", "本人已经知道。", "收件人不在家。", "业主大会开过了。", "业主都说不行。", "住户反映很多。", "老人孩子出门不便。", "老人走得慢。", "户主不在。", "户主变更要多久？", "市民都在问。", "市民中心几点开门？",
    "姓名写错了怎么改？", "和邻居一起去过。", "昨天来过两次。", "请找物业核实。", "负责人没有出面。", "登记的是去年的事。", "都签了字才算。", "表示愿意配合的不多。", "需要照顾的人很多。", "来电很久没人接。", "说了也没用，昨天和今天一样。", "家属到场后再说。",
    "家属{n}到场签字。", "市民{n}表示感谢。", "负责人{n}没有出面", "我是{n}，想问一下。", "{n}和{n}都在现场。", "和{n}说好的。", "老人{n}走得慢，", "{n}说了三次。", "业主{n}和{n}都反对", "登记人{n}，", "当事人{n}不在。", "我爱人{n}来办过。", "住户{n}住在三楼。", "户主{n}，手机{p}", "申请人写的是{n}。", "{n}提供了照片", "问一下{n}的情况。",
    "{n}要求回电。", "{n}说明了经过。", "{n}反映过多次，", "{n}已经签字。", "{n}负责联系各家", "{n}的情况属实。", "{n}问什么时候修。", "居民说了多次。", "工作人员说他不清楚。", "要求回电。", "反映过多次。", "找{n}说明情况", "由{n}和{n}负责。", "业主{n}、{n}到场。", "有人说明天修。", "问什么时候修好。",
    "在{A}。", "{A}一直堵车。", "位置在{A}附近", "{A}没有人管。", "从{A}往东走。",
    "请看{M}。", "用{M}登录。", "信号{M}，太弱。", "型号{M}", "见{M}一节。",
)
# Family names followed by what makes them no full name, and words that begin like one.
_BEHIND = ("女士", "先生", "阿姨", "师傅", "老师", "大爷", "记面馆", "氏牙科", "家桥", "家超市", "记饭店", "经理")
_FAMILY = "赵钱孙李周吴郑王冯陈蒋沈韩杨朱秦许何吕施张孔曹严魏陶姜谢邹章苏潘葛范彭鲁韦马苗方任袁柳唐费薛雷贺倪汤罗郝安常于傅齐康伍余顾孟黄尹姚邵汪祁毛宋庞熊纪舒项祝董梁杜阮蓝闵季贾路江童颜郭梅盛林钟徐邱骆高夏蔡田樊胡凌霍水尤窦岑"
_DOUBLE = ("欧阳", "上官", "司马", "诸葛", "尉迟", "慕容", "东方", "皇甫", "公孙", "令狐", "南宫")
_FIRST, _LAST = ("Anna", "Pierre", "Marta", "Jonas", "Lucía", "Omar", "Elena", "Tom"), ("Keller", "Dubois", "Silva", "Weber", "García", "Novak", "Rossi", "Brown")
_USERS, _HOSTS = ("lee", "sun.hao", "q_river", "office", "amber.tan", "zhouyi", "hotline", "j-park"), ("mail.example", "post.example.org", "box.test", "corp-net.example", "inbox.example.com")
_KINDS = ("花园", "小区", "公寓", "家园", "广场", "苑", "里", "府", "城", "新村", "佳园")
_DIGITS = "零一二三四五六七八九"
SENTENCES = 100  # of each carrier


def any_char(rng: random.Random) -> str:
    """A character of the common block, whatever it means."""
    while True:
        c = chr(rng.randrange(0x4E00, 0x9A00))
        if c not in "路街巷道号楼栋幢座单元室区县市镇乡省里府城苑园期一二三四五六七八九十百零":
            return c


def _spread(rng: random.Random, text: str) -> str:
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text) if rng.random() < 0.1 else text


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def name(rng: random.Random, known: list[str]) -> str:
    given = lambda: rng.choice(known) if known and rng.random() < 0.85 else any_char(rng)
    r = rng.random()
    if r < 0.08:
        return f"{rng.choice(_FIRST)} {rng.choice(_LAST)}"
    if r < 0.16:
        return "".join(given() for _ in range(2)) + "·" + "".join(given() for _ in range(rng.randrange(2, 4)))
    out = [rng.choice(_DOUBLE) if rng.random() < 0.12 else rng.choice(_FAMILY), given()] + ([given()] if rng.random() < 0.7 else [])
    return (" " if rng.random() < 0.05 else "").join(out)


def phone(rng: random.Random) -> str:
    d = "1" + rng.choice("3456789") + _digits(rng, 9)
    r = rng.random()
    if r < 0.15:
        return "".join("幺" if c == "1" else _DIGITS[int(c)] for c in d)
    if r < 0.3:
        return rng.choice(("0{} {}", "0{}-{}", "0{}{}")).format(_digits(rng, 3).replace("0", "6"), rng.choice("23456789") + _digits(rng, 6))
    mark = rng.choice(("", "", "-", " "))
    return _spread(rng, rng.choice(("", "", "", "+86 ", "+86-", "0086")) + mark.join((d[:3], d[3:7], d[7:])))


def identity(rng: random.Random) -> str:
    area, year, month, day = _digits(rng, 6).replace("0", "9"), rng.randrange(1930, 2012), rng.randrange(1, 13), rng.randrange(1, 29)
    if rng.random() < 0.1:
        return f"{area}{year % 100:02d}{month:02d}{day:02d}{_digits(rng, 3)}"
    mark = rng.choice(("", "", "", " ", "-"))
    return _spread(rng, f"{area}{mark}{year}{month:02d}{day:02d}{mark}{_digits(rng, 3)}{rng.choice('0123456789X')}")


def mail(rng: random.Random) -> str:
    user, host = rng.choice(_USERS) + rng.choice(("", _digits(rng, 3))), rng.choice(_HOSTS)
    r = rng.random()
    if r < 0.15:
        return user + "艾特" + host.replace(".", "点")
    out = user + rng.choice(("@", "@", "@", "@", "(at)", " [at] ", " at ", "＠")) + host
    return out.upper() if rng.random() < 0.1 else out


def _number(rng: random.Random, n: int) -> str:
    if rng.random() < 0.3 and n < 1000:
        h, t, o = n // 100, n // 10 % 10, n % 10
        return (_DIGITS[h] + "百" if h else "") + (_DIGITS[t] + "十" if t else "零" if h and o else "") + (_DIGITS[o] if o else "") or "十"
    return _spread(rng, str(n))


def _stem(rng: random.Random, n: int) -> str:
    """A place name; every third begins like a person's."""
    return (rng.choice(_FAMILY) if rng.random() < 0.33 else any_char(rng)) + "".join(any_char(rng) for _ in range(n - 1))


def address(rng: random.Random) -> str:
    stem = lambda n: _stem(rng, n)
    road = stem(rng.choice((1, 2, 2, 2, 3))) + rng.choice(("路", "街", "巷", "大道", "东路", "南街", "西路", "中路")) + _number(rng, rng.randrange(1, 500)) + rng.choice(("号", "号", "#", "號"))
    building = _number(rng, rng.randrange(1, 40)) + rng.choice(("号楼", "栋", "幢", "座", "#楼")) + rng.choice(("", "", f"{rng.randrange(1, 6)}单元{rng.randrange(1, 30)}0{rng.randrange(1, 5)}室"))
    estate = stem(rng.choice((2, 3, 3, 4))) + rng.choice(_KINDS) + building
    town = rng.choice(("", "", stem(2) + rng.choice(("街道", "镇"))))
    return rng.choice((town + road, town + road + building, town + road + estate, estate, f"{estate}（{road}）", town + estate))


def _no_name(rng: random.Random) -> str:
    return rng.choice(_FAMILY) + rng.choice(_BEHIND)


def _no_phone(rng: random.Random) -> str:
    d = _digits(rng, rng.choice((4, 5, 6, 7, 8, 10, 12, 13, 14, 11)))
    return ("20" + d if rng.random() < 0.5 else "9" + d) if rng.random() < 0.8 else "".join(_DIGITS[int(c)] for c in d)


def _no_identity(rng: random.Random) -> str:
    if rng.random() < 0.5:
        return _digits(rng, rng.choice((14, 16, 17, 19)))
    return _digits(rng, 6) + rng.choice(("99", "45", "00")) + _digits(rng, 10)


def _no_address(rng: random.Random) -> str:
    stem = lambda: _stem(rng, 2)
    return rng.choice((f"{stem()}路与{stem()}街交叉口", f"{stem()}大道、{stem()}路路口", f"{stem()}路", f"{stem()}小区", f"{stem()}街道", f"{stem()}路和{stem()}巷交口"))


def _no_mail(rng: random.Random) -> str:
    return rng.choice((f"v{rng.randrange(9)}@{rng.randrange(9)}", f"look at {rng.randrange(99)}", f"A{rng.randrange(99)}@x", f"level at {rng.randrange(9)}.{rng.randrange(9)}", "support@"))


_MAKE = {"p": phone, "i": identity, "m": mail, "a": address, "N": _no_name, "P": _no_phone, "I": _no_identity, "A": _no_address, "M": _no_mail}
_TYPE = {"n": "name", "p": "phone", "m": "email", "i": "id_number", "a": "address"}


def fill(carrier: str, rng: random.Random, known: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, size = [], [], 0
    for piece in re.split(r"(\{\w\})", carrier):
        text = piece
        if re.fullmatch(r"\{\w\}", piece):
            k = piece[1]
            text = name(rng, known) if k == "n" else _MAKE[k](rng)
            if k in _TYPE:
                spans.append((size, size + len(text), _TYPE[k]))
        out.append(text)
        size += len(text)
    return "".join(out), spans


def sentences(texts: list[str], rng: random.Random) -> tuple[list, list]:
    """(text, spans) for fitting and held out; each carrier stands between two sentences of a real text, which are unknown.

    Two of three carriers fit, the third is held out, in the order of the list.
    """
    known = [any_char(rng) for _ in range(30)]  # given names recur, as in any population
    sets: tuple[list, list] = ([], [])
    for n, carrier in enumerate(CARRIERS):
        for _ in range(SENTENCES):
            inner, spans = fill(carrier, rng, known)
            around = re.split(r"(?<=[。；！\n])", rng.choice(texts)) if texts else [""]
            at = rng.randrange(len(around) + 1)
            before, after = "".join(around[max(0, at - 1) : at]), "".join(around[at : at + 1])
            k = len(before)
            text = before + inner + after
            sets[n % 3 == 2].append((text, [(a + k, b + k, z) for a, b, z in spans] + [(0, k, ""), (k + len(inner), len(text), "")]))
    return sets
