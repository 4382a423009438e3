import hashlib
import random
import re

import pytest

from sparkvane.llm.substrings import dedup_substrings, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(doc_id, words, removed, kept) of each row."""
    place = lambda i: -(2**63) if i is None else i
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (place(i), k)), (place(i), k))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (place(i), k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def digest(rows):
    return sorted(repr((i, n, m, hashlib.sha256(k.encode()).hexdigest())) for i, n, m, k in rows)


def got(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in df.collect())


def corpus(seed, n=70):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(8)] + ["é", "日本"]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([19, 20, 21, 35, 60]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            words += r.choice(passages) if kind < 0.4 else [r.choice(vocabulary)] * r.choice([1, 25, 45]) if kind < 0.5 else r.choice(vocabulary[:2]).split() + [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        rows.append((r.choice([i, i, i, n - i]), "".join(w + r.choice([" ", "  ", "\n", "\t "]) for w in words)))
    return rows


@pytest.mark.parametrize("seed,per_shard,per_task", [(1, 20_000, 4000), (2, 50, 3), (3, 10, 1)])
def test_against_brute_force(docs, seed, per_shard, per_task):
    rows = corpus(seed)
    assert got(dedup_substrings(docs(rows), per_shard=per_shard, per_task=per_task)) == digest(brute(rows))


def test_odd_rows(docs, clashing, odd):
    p = " ".join(f"p{i}" for i in range(30))
    rows = odd + [(20 + i, f"x{i} {p}") for i in range(40)] + [(None, p), (None, p), (80, "same " * 50), (81, "same " * 50), (81, "same " * 50), (82, "short " * 19), (83, p.replace(" ", "\n")), (5, p), (5, p + " tail")]
    assert got(dedup_substrings(clashing(rows))) == digest(brute(rows))
    assert got(dedup_substrings(clashing(rows), per_task=2, per_shard=5)) == digest(brute(rows))
    assert dedup_substrings(docs([])).count() == 0
    assert got(dedup_substrings(docs([(1, None), (2, "")]))) == digest(brute([(1, None), (2, "")]))


def test_other_windows(docs):
    rows = corpus(5, 30)
    assert got(dedup_substrings(docs(rows), window=6, phrase=3)) == digest(brute(rows, 6))


def test_texts(docs):
    rows = corpus(4, 30)
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in dedup_substrings(docs(rows), texts=True).collect()) == sorted(map(repr, brute(rows)))
    want = sorted(repr((i, k if m else t)) for (i, _, m, k), (_, t) in zip(brute(rows), rows, strict=True))
    whole = {t for _, t in rows}
    assert sorted(repr((r.doc_id, r.text if r.text in whole else " ".join(WORD.findall(r.text)))) for r in without_repeats(docs(rows)).collect()) == want


def test_cut_texts_keep_their_lines(docs):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"head\n  {p}\n\ttail  end "), (2, f" a\n\n{p}\n b\n  c\n"), (3, f"x\n  {p} \n"), (4, f" {p}\n"), (5, None), (6, ""), (7, f"{p}\nlast"), (8, "é \u2003 z")]
    found = {r.doc_id: r.text for r in without_repeats(docs(rows)).collect()}
    assert found == {**dict(rows), 2: " a\n\nb\n  c\n", 3: "x \n", 4: " \n", 7: "last"}


def test_long_documents_and_stops(docs):
    """Blocks, chunks, and letters whose polynomial hashes modulo 2^64 are equal."""
    r = random.Random(9)
    a = "ab"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    words = [r.choice(["u", "v", "w", "x"]) for _ in range(45_000)]
    pair = [(a[:n], a[:n].translate(str.maketrans("ab", "ba"))) for n in (1024, 2048, 4096)]
    rows = [(1, " ".join(words)), (2, " ".join(words[990:1040] + ["cut"] + words[19_970:20_050] + ["cut"] + words[44_000:])), (3, " ".join(words[500:43_000]))]
    rows += [(10 + k, " ".join([side[k % 2], *(f"w{i}" for i in range(19))])) for k, side in enumerate(x for x in pair for _ in (0, 1))]
    assert got(dedup_substrings(docs(rows))) == digest(brute(rows))


def test_query_equals_its_sql(spark):
    import duckdb

    from sparkvane.llm.queries import ORACLE_SQL, QUERIES

    rows = QUERIES["op3_substrings"](spark, "/root/testdata/sf0.001").collect()
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, rows)) == sorted(c.sql(ORACLE_SQL["op3_substrings"]).fetchall())
    assert sum(r.n_removed for r in rows) > 100
