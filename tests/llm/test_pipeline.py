import random

import numpy as np
import public_tokenizers
from test_jaccard import brute as components
from test_pii import SECRETS
from test_substrings import brute as passages
from tokenizers import Tokenizer

import corpus_pipeline
from sparkvane.llm import pii


def corpus():
    r = random.Random(8)
    en, fr = "the cat sat on a mat with some other old things that were there before we came".split(), "le chat est sur la table avec des choses anciennes que nous avons vues hier soir".split()
    rows = []
    for i in range(60):
        words = [r.choice(en if i % 2 else fr) + r.choice(["", "", "a", "io", "en"]) for _ in range(r.choice([30, 80, 200]))]
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
    common = " ".join(r.choice(en) + str(k) for k in range(55))
    rows += [(100 + i, f"{rows[i][1]} {common} the end of {i}", "en") for i in range(8)]
    rows += [(200 + i, rows[i][1] + " and more", rows[i][2]) for i in range(0, 40, 4)] + [(300 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 5)]
    rows += [(400 + i, f"{rows[20 + i][1][:150]} {SECRETS} write to u{i}@mail.example.com", "en") for i in range(6)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", "fr"), (503, "the cat sat on the mat", None)]
    return rows


def test_each_stage(spark, docs, clashing, tmp_path):
    rows, docs_ = corpus(), clashing(corpus())
    now = dict((i, t) for i, t, _ in rows)
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs_, None).write.parquet(str(tmp_path / str(k)))
        before, docs_ = now, spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            break
        assert docs_.columns == list(corpus_pipeline.COLUMNS)
        now = {r.doc_id: r.text for r in docs_.collect()}
        assert len(now) == docs_.count()
        if name == "language":
            assert set(before) - set(now) == {500, 501, 502} and all(before[i] == now[i] for i in now)
        elif name == "near_copies":
            groups = [eval(c) for c in components(list(before.items()), 5, 80)]
            assert now == {i: before[i] for i, _, c in groups if c == i} and len(now) < len(before) - 15
        elif name == "passages":
            want = {i: (m, kept) for i, _, m, kept in passages(list(before.items()))}
            assert now == {i: want[i][1] if want[i][0] else before[i] for i in before}
            assert sum(m > 50 for m, _ in want.values()) >= 7
        elif name == "personal_data":
            base = {i: pii.base_spans(t) for i, t in before.items()}
            for i in before:
                for s, _, e in base[i]:
                    assert before[i][s:e] not in now[i]
                if not base[i] and "password" not in before[i] and "AKIA" not in before[i]:
                    assert now[i] == before[i]
            assert all(r.n_chars == len(r.text) for r in docs_.collect())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in now.items()}
    got = docs_.collect()
    assert sum(p.length for p in got) == sum(map(len, want.values()))
    assert all(np.frombuffer(p.token_ids, "<u4").tolist() == want[p.doc_id][p.start : p.start + p.length] for p in got)


def test_empty_table(spark, docs, tmp_path):
    docs_ = docs([])
    for _, function in corpus_pipeline.STAGES:
        docs_ = function(spark, docs_, None)
        assert docs_.count() == 0


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 100
