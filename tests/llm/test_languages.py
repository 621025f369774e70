"""Held-out languages."""

from collections import Counter

import duckdb
import numpy as np

from tidewell.llm import languages as G

def test_held_out_accuracy(small):
    rows = duckdb.sql(f"select text, lang from '{small}/documents.parquet' where text is not null and lang in ('zh','en','de','fr','es','pt','ja','ko') order by doc_id").fetchall()
    rows = [(t, lang) for t, lang in rows if len(t) >= 40]
    fit, held = rows[::2], rows[1::2]
    p = G.fit([t[:4000] for t, _ in fit], [G.LANGS.index(lang) for _, lang in fit])
    out = G.detect(p, [t for t, _ in held])
    single = [(G.LANGS[o[0][0]], lang) for o, (_, lang) in zip(out, held, strict=True) if len(o) == 1]
    assert sum(a == b for a, b in single) / len(single) > 0.85  # about a tenth of the labels are wrong


def test_edges_of_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    mixed = "工作人员通过资料复核确认，路灯连续多日不亮。请申请人完成自查。Most cases are closed within eight working days, and you will be told if it takes longer."
    odd = [(-1, None, "zh"), (-2, "", None), (-3, "12345 ... 66%", "en"), (-4, mixed, "zh"), (-5, "Die meisten Fälle werden innerhalb von vierzig Werktagen abgeschlossen und beantwortet.", "und")]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {}
    for r in G.label_documents(df, "doc_id", "text", "lang").filter("doc_id < 0").collect():
        got.setdefault(r["doc_id"], {})[r["seg_no"]] = r["lang_code"]
    joined = "Chaque photo ne doit pas dépasser quarante mégaoctets et doit rester lisible.🇨🇿A maioria dos processos é concluída em quarenta dias úteis.Wer mit der Antwort nicht einverstanden ist, kann eine Überprüfung verlangen."
    texts, labels = G.sample_labelled(docs, "doc_id", "text", "lang")
    assert [G.LANGS[x[0]] for x in G.detect(G.fit(texts, labels), [joined])[0]] == ["fr", "pt", "de"]
    assert got == {-4: {0: "zh" if sum("一" <= c <= "鿿" for c in mixed) * 2 > sum(c.isascii() and c.isalpha() for c in mixed) else "en", 1: "zh", 2: "en"}, -5: {0: "de"}}
    assert G.label_documents(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_samples_are_whole(spark):
    from tidewell.llm import pii

    long = "材料可以拍照上传。" * 900
    df = spark.createDataFrame([(1, long, "zh")], "doc_id long, text string, lang string")
    assert G.sample_labelled(df, "doc_id", "text", "lang") == ([long], [G.LANGS.index("zh")])
    assert pii.sample_texts(df, ["doc_id"], "text") == ([long], [[]])


def test_ranks_and_distance_by_hand():
    """The out-of-place distance against a plain reading of its definition."""
    texts = ["die Katze und die Maus und die Ziege", "el gato y el perro y el pez", "中文的中文和中国", "mixed 中文 words"]
    p = G.fit(texts[:3] * 4, [G.LANGS.index(x) for x in ("de", "es", "zh")] * 4, rounds=1, calibrate=False)
    t = G.read(texts)
    dist, total, _ = G.distances(p, G.occurrences(t), t.sent_doc, len(texts))
    for d in range(3):
        seen = Counter()
        for keys, i in G.grams(t):
            seen.update(keys[t.sent_doc[t.sent[i]] == d].tolist())
        assert total[d] == sum(seen.values())
        for j in range(len(G.LANGS)):
            want = 0
            for k, n in seen.items():
                rank = sum(m > n for m in seen.values())
                at = np.nonzero(p.keys == np.uint64(k))[0]
                r = int(p.ranks[at[0], j]) if len(at) else G.PROFILE
                want += abs(r - rank) if r < G.PROFILE else G.PROFILE
            assert dist[d, j] == want


def test_every_listed_gram_is_found():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 62, 400_000).astype(np.uint64))  # many share a slot
    p = G.Profiles(keys, np.zeros((len(keys), 8), np.int16), [])
    assert (p.look(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(1, 1 << 62, 1000).astype(np.uint64), keys)
    assert (p.look(other) == len(keys)).all()


def test_confidence_is_calibrated(small):
    rows = duckdb.sql(f"select text, lang from '{small}/documents.parquet' where text is not null and lang in ('zh','en','de','fr','es','pt','ja','ko') order by doc_id").fetchall()
    p = G.fit([t for t, _ in rows[::2]], [G.LANGS.index(x) for _, x in rows[::2]])
    conf, right = [], []
    for (_, lang), parts in zip(rows[1::2], G.detect(p, [t for t, _ in rows[1::2]]), strict=True):
        if len(parts) == 1:
            conf.append(parts[0][4])
            right.append(G.LANGS[parts[0][0]] == lang)
    assert all(0 < c < 1 for c in conf)
    assert sum(conf) / len(conf) > sum(right) / len(right) - 0.02  # the labels, not the profiles, are wrong in a tenth
    x, y = G.isotonic(np.array([0.1, 0.2, 0.3, 0.4] * 10), np.array([0.0, 1, 0, 1] * 10))
    assert list(y) == sorted(y) and len(x) == len(y)


def test_stops_between_scripts_and_weak_stretches(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    p = G.fit(*G.sample_labelled(docs, "doc_id", "text", "lang"))
    text = "번호표가 금방 떨어지니 오전에 방문해 주십시오.回复内容：您反映的充电桩长期离线已转公共安全局，预计书面告知。"
    assert [G.LANGS[x[0]] for x in G.detect(p, [text])[0]] == ["ko", "zh"]
    dist = np.full((3, 8), 100.0)
    dist[[0, 2], 4], dist[1, 5], dist[1, 4] = 50, 95, 100  # the middle is hardly nearer to its own
    assert list(G.joined(np.array([4, 5, 4]), dist)) == [4, 4, 4]
    dist[1, 5] = 50
    assert list(G.joined(np.array([4, 5, 4]), dist)) == [4, 5, 4]
