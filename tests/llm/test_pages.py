"""Furniture: tree matching against brute force, wrappers on made-up hosts, and the parsed blocks as a score."""

import itertools
import random

from tidewell.llm import boilerplate as B
from tidewell.session import materialise


def _best(a, b, weight):
    """Weight of the heaviest order-preserving matching, by trying all of them."""
    top = 0
    for k in range(min(len(a), len(b)) + 1):
        for x in itertools.combinations(range(len(a)), k):
            for y in itertools.combinations(range(len(b)), k):
                w = [weight(a[i], b[j]) for i, j in zip(x, y, strict=True)]
                if all(w):
                    top = max(top, sum(w))
    return top


def test_alignment_is_ordered_and_heaviest():
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(6))] for _ in range(2))
        table = {(x, y): rng.choice((0, 0, 1, 2, 3)) for x in "abcd" for y in "abcd"}
        total, pairs = B._align(len(a), len(b), lambda i, j: table[a[i], b[j]])
        assert total == _best(a, b, lambda x, y: table[x, y]) == sum(table[a[i], b[j]] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(pairs))


def test_trees_of_two_pages():
    one = "登录\n首页 > 公开 > 正文\n关于甲的通知\n第一段在此。\n版权所有 © 2026"
    two = "首页 > 公开 > 正文\n关于乙的通知\n另一段。还有一句。\n版权所有 © 2024\n登录"
    pairs = B.match_trees(B.sections(B.read_lines(one)), B.sections(B.read_lines(two)))
    assert [(x.at, y.at) for x, y in pairs] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert B.match_trees([], B.sections(B.read_lines(two))) == []


def _pages(n, hosts=2):
    """Pages with known furniture; recurring headings and stock sentences stand only inside the body."""
    rng = random.Random(3)
    rows, want = [], {}
    nav = ["登录", "注册", "政策文件", "政务公开", "新闻动态", "English"]
    topics = [a + b for a in "甲乙丙丁戊己庚辛" for b in "金木水火土日月"]
    for k in range(n):
        head = rng.sample(nav, 3) + ["首页 > 政务公开 > 正文"]
        body = [f"关于{rng.choice(topics)}事项的通知"]
        rest = [f"本事项由{rng.choice(topics)}单位负责，{rng.choice(topics)}配合。" for _ in range(5)]
        rest.insert(rng.randrange(1, 5), "办理流程")
        rest.insert(rng.randrange(1, 5), "材料可以拍照上传。")
        lines = [(x, False) for x in head] + [(x, True) for x in body]
        if rng.random() < 0.6:
            lines.append((f"发布时间：2025-01-{rng.randrange(10, 29)}  来源：{rng.choice(topics)}局", False))
        lines += [(x, True) for x in rest]
        if rng.random() < 0.1:
            lines.insert(rng.choice((0, len(lines) - 2, len(lines))), ("附件预览插件未安装，点此下载", False))
        lines += [("扫一扫在手机打开当前页", False), ("相关阅读", False), *((f"{rng.choice(topics)}办理指南发布", False) for _ in range(4)), (f"网站标识码：{k:08d}", False), ("版权所有 © 2026", False)]
        text = [x for x, _ in lines]
        text.insert(rng.randrange(len(text)), "")
        rows.append((str(k), f"https://h{k % hosts}.example/{k}.html", "\n".join(text), None, None, "x"))
        left = [b for x, b in lines]
        want[str(k)] = {i for i, x in enumerate(text) if x and not left.pop(0)}
    return rows, want


def test_wrapper(spark):
    pages, want = _pages(240)
    foot = "登录\r\n政策文件\n相关阅读\n甲金办理指南发布\n乙木办理指南发布\n版权所有 © 2026"
    pages.append(("f", "https://h0.example/f.html", foot, "q", "重复：\n政策文件\n相关阅读\n甲金办理", "x"))
    pages.append(("n", None, None, "e", "", "x"))
    pages.append(("s", "https://h1.example/s", " \n ", None, None, "x"))
    df = spark.createDataFrame(pages, "rec_key string, url string, raw_text string, quote_key string, quote string, plus string")
    counts = B.induce(df, keep=lambda x: materialise(x, "test"))
    out = B.strip_boilerplate(df, *B.wrappers(counts))
    assert out.count() == sum(1 for p in pages for x in (p[2] or "").split("\n") if x.strip()) + 3
    got = {}
    for r in out.filter("not body").collect():
        got.setdefault((r["src"], r["rec_key"]), set()).add(r["line_no"])
    hit = sum(len(v & got.get(("page", k), set())) for k, v in want.items())
    found = sum(len(v) for (_, k), v in got.items() if k in want)
    assert hit >= 0.98 * sum(map(len, want.values())) and hit >= 0.98 * found
    assert got["page", "f"] == {0, 1, 2, 3, 4, 5} and got["quote", "q"] == {1, 2, 3}
    none = df.limit(0)
    assert B.strip_boilerplate(none, *B.wrappers(B.induce(none))).count() == 0


def test_one_host_holds_nearly_all(spark):
    """The sample of a host is bounded, and every page is judged all the same."""
    pages, _ = _pages(90, hosts=1)
    df = spark.createDataFrame(pages, "rec_key string, url string, raw_text string, quote_key string, quote string, plus string")
    assert B.sample_pages(df, most=20).count() == 20
    out = B.strip_boilerplate(df, *B.wrappers(B.induce(df, most=60)))
    assert out.select("rec_key").distinct().count() == 90


def test_blocks_agree(spark, small):
    """The parsed blocks are never read by the operator; here they score it."""
    from tidewell.llm.queries import p2_lines

    judged = {(r["rec_key"], r["line_no"]): r["body"] for r in p2_lines(spark, small).filter("src = 'parsed_documents'").collect()}
    inside = outside = kept = 0
    for p in spark.read.parquet(f"{small}/parsed_documents.parquet").dropDuplicates(["page_id"]).select("page_id", "raw_text", "blocks").collect():
        texts = {x.strip() for b in p["blocks"] or () for x in ((b and b["text"]) or "").split("\n")}
        if not texts:
            continue
        for i, x in enumerate((p["raw_text"] or "").split("\n")):
            if x.strip() and x.strip() in texts:
                inside, kept = inside + 1, kept + judged[str(p["page_id"]), i]
            elif x.strip():
                outside += not judged[str(p["page_id"]), i]
    assert kept >= 0.98 * inside and outside > 0


def test_every_page_of_a_large_host_counts(spark):
    """A host of several blocks, with repeats, has the counts that one pass over all of its pages gives."""
    rows, _ = _pages(500, hosts=1)
    other, _ = _pages(30, hosts=1)
    rows += [(k, "https://small.example/", *r) for k, _, *r in other]
    df = spark.createDataFrame(rows + rows[:90], "rec_key string, url string, raw_text string, quote_key string, quote string, plus string")
    got, want = {}, {}
    for r in B.induce(df, keep=lambda x: materialise(x, "test")).collect():
        got.setdefault(r[0], {})[r[1]] = tuple(r[2:])
    assert got["h0.example"][""][0] == 500 and got["*"][""][0] == 530
    parts = df.filter("rec_key is not null").selectExpr("url like '%small%' as small", "pmod(xxhash64(raw_text), 2) as block", "raw_text").distinct().collect()
    want["h0.example"] = B.host_counts([[r["raw_text"] for r in parts if not r["small"] and r["block"] == k] for k in (0, 1)])
    want["small.example"] = B.host_counts([[r["raw_text"] for r in parts if r["small"]]])
    for host, counts in want.items():
        least = max(B.LEAST_PAGES, B.LEAST_SHARE * counts[0][1])
        assert got[host] == {x: tuple(n) for x, *n in counts if not x or n[0] >= least}
    total = {}
    for x, *n in [*want["h0.example"], *want["small.example"]]:
        total[x] = tuple(a + b for a, b in zip(n, total.get(x, (0,) * 7), strict=True))
    assert got["*"] == {x: n for x, n in total.items() if not x or n[0] >= B.LEAST_PAGES}
