import math
import random
import zlib

import pytest

from sparkvane.llm.langid import BUCKETS, ORDERS, fit, identify, keep_known


def test_held_out_accuracy(spark):
    from sparkvane.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    asked = [(got[r.doc_id].lang_pred, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.held_out for r in got.values()) == len(asked)
    assert sum(a == b for a, b in asked) / len(asked) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark, docs, clashing, odd):
    learn = [(i, "the cat and the dog", "en") for i in range(20, 60)] + [(100 + i, "le chat et le chien", "fr") for i in range(40)] + [(200 + i, "zz zz", None) for i in range(9)]
    model = fit(docs(learn))
    assert model.langs == ["en", "fr"]
    for df in (docs(odd + learn), clashing(odd + learn)):
        got = identify(spark, df, model).collect()
        assert len(got) == len(odd) + len(learn)
        for r in got:
            if r.doc_id in (1, 2, 3):
                assert (r.lang_pred, r.score) == ("und", 0.0)
            elif r.doc_id and 10 < r.doc_id < 60:
                assert r.lang_pred == "en"
            elif r.doc_id and r.doc_id >= 100 and r.doc_id < 140:
                assert r.lang_pred == "fr"
    lone = identify(spark, docs([(1, "123 ... !"), (2, "é"), (3, "e")]), model).collect()
    assert [r.lang_pred == "und" for r in lone] == [True, False, False]
    assert identify(spark, docs([]), model).count() == 0
    blank = fit(docs([(1, None, "en")]))
    assert {r.lang_pred for r in identify(spark, docs(odd), blank).collect()} == {"und"}


def test_prediction_ignores_the_batch(spark, docs):
    learn = [(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "le chat et le chien", "fr") for i in range(40)]
    model = fit(docs(learn))
    rows = [(i, f"the dog and chien {i} et le" + " chat" * (i % 7)) for i in range(50)]
    together = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(spark, docs(rows), model).collect()}
    for row in rows[::9]:
        r = identify(spark, docs([row]), model).first()
        assert (r.lang_pred, round(r.score, 9)) == together[row[0]]


def brute(learn, texts):
    """(language, posterior) of each text, by plain sums over each n-gram."""

    def grams(text):
        chars = [ord(c) for c in f" {text.lower()} "]
        for n in ORDERS:
            for i in range(len(chars) - n + 1):
                code = 0
                for k in range(n):
                    code = (code * 0x9E3779B97F4A7C15 + chars[i + k] + k + 1) % 2**64
                yield (code ^ code >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - 15

    langs = sorted({k for _, k in learn})
    counts = {k: {} for k in langs}
    for text, lang in learn:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0.5) + 1
    total = {k: sum(counts[k].values()) + 0.5 * (BUCKETS - len(counts[k])) for k in langs}
    out = []
    for text in texts:
        found = list(grams(text))
        like = {k: sum(math.log(counts[k].get(g, 0.5) / total[k]) for g in found) for k in langs}
        logs = {k: like[k] + math.log(sum(x == k for _, x in learn) / len(learn)) for k in langs}
        best = max(langs, key=lambda k: logs[k])
        out.append((best, 1 / sum(math.exp(logs[k] - logs[best]) for k in langs)))
    return out


SAID = {"en": "the cat and the dog were here when it rained on the old house by the river".split(), "fr": "le chat et le chien dormaient dans la maison quand il pleuvait sur les toits".split(), "de": "die katze und der hund lagen im haus als es über den alten dächern regnete".split()}


def said(seed, n, lengths=(1, 12)):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "fr", "de"])
        rows.append((i, " ".join(r.choice(SAID[lang]) for _ in range(r.randint(*lengths))), lang))
    return rows


def test_scores_against_brute_force(spark, docs):
    rows = said(1, 300)
    model = fit(docs(rows))
    learn = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    asked = [(1000 + i, t) for i, t in enumerate([*(t for _, t, _ in said(2, 60)), "le dog", "é", "x", "und the", "Ω", "THE OLD HOUSE"])]
    want = brute(learn, [t for _, t in asked])
    for r, (lang, score) in zip(sorted(identify(spark, docs(asked), model).collect()), want, strict=True):
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3, abs=1e-6)


def test_junk_and_unknown_languages_go(spark, docs, odd):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    junk = ["Съешь же ещё этих мягких французских булок да выпей чаю", "日本語のテキストはここにあります", letters(200), " ".join(letters(r.randint(3, 8)) for _ in range(40)), "12 34 !!", None, "", "#$% 77 @"]
    good = [t for _, t, _ in said(5, 40, (4, 30))] + ["the old house 1234567890123456 by the river token=\"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\"", "THE OLD HOUSE!! BY THE RIVER!!"]
    table = docs([(i, t) for i, t in enumerate(good)] + [(500 + i, t) for i, t in enumerate(junk)] + [(None, good[0]), (3, good[3])])
    model = fit(docs(said(6, 1500, (20, 60))))
    kept = sorted(repr((x.doc_id, x.text)) for x in keep_known(spark, table, model).collect())
    assert kept == sorted(map(repr, [*enumerate(good), (None, good[0]), (3, good[3])]))
    assert keep_known(spark, docs([]), model).count() == 0 and keep_known(spark, table, fit(docs([]))).count() == 0
