import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvane.llm.common import Stage
from sparkvane.llm.components import connected_components
from sparkvane.llm.jaccard import _open, _settled, compare, exact_shingles, jaccard_components, keep_first, scheme, shingles, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(rows, n=4, percent=85):
    held = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(held[i] & held[k])
            if rows[i][0] is not None and rows[k][0] is not None and both and 100 * both >= percent * len(held[i] | held[k]):
                root[top(i)] = top(k)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(repr((d, len(held[i]), None if d is None else least[top(i)])) for i, (d, _) in enumerate(rows))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 260), st.integers(0, 10**9), st.sampled_from([60, 80, 85, 95]))
def test_linked_sets_share_a_signature(size, seed, percent):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
    s = scheme(percent)
    drop = int(r.integers(0, s.differ(size, s.largest(size)) + 1))
    gone = int(r.integers(0, drop + 1))
    b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**64, drop - gone, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if not both or 100 * both < percent * (len(a) + len(b) - both):
        return
    if np.array_equal(a, b):
        return
    doc, code = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
    n = np.array([len(a), len(b)])
    keys = [set(), set()]
    for lower in (False, True):
        for d, k in zip(*signatures(doc, code, n, percent, lower), strict=True):
            keys[d].add(int(k))
    assert keys[0] & keys[1]


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(r.choice(vocabulary) for _ in range(25))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            words = (r.choice(rows)[1] or "a").split()
            for _ in range(r.randint(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 7, 12, 30, 80, 200])))
            text = f"{common} {text}" if kind < 0.7 else text
        rows.append((i * 3 + 1, text))
    return rows


def got(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(jaccard_components(docs(rows))) == brute(rows)


def test_families_of_copies(docs):
    """Many copies of one text, each with edits, some shared: most pairs aren't linked, chains are."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows, shared = [], [(r.randrange(120), f"s{i}") for i in range(6)]
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            at, w = r.choice(shared) if r.random() < 0.5 else (r.randrange(120), f"e{r.randrange(10**6)}")
            words[at] = w
        rows.append((i, " ".join(words)))
    assert got(jaccard_components(docs(rows), broadcast_rows=0)) == brute(rows)
    assert got(jaccard_components(docs(rows[:30]), percent=90, cell_sets=6)) == brute(rows[:30], percent=90)


def test_open_nodes_meet_all_that_they_may_be_linked_with(spark):
    """Clusters of several times `cell_sets` sets whose hub is linked with few of them: cells are bounded and miss no link."""
    words = {}
    for seed in range(8):  # a hub, copies of it, a chain away from it, and strangers that are copies of one another
        r, base = random.Random(seed), [f"b{seed}_{i}" for i in range(40)]
        words[seed * 100] = base
        for i in range(1, 12):
            words[seed * 100 + i] = [f"y{seed}_{i}" if k == i else w for k, w in enumerate(base)]
        for i in range(12, 30):
            base = list(base)
            base[r.randrange(10, 40)] = f"x{seed}_{i}"
            words[seed * 100 + i] = base
        for i in range(30, 40):
            words[seed * 100 + i] = [f"z{seed}_{k}" for k in range(40 - i % 3)]
    texts = spark.createDataFrame([(k, " ".join(w)) for k, w in words.items()], "node long, text string")
    sizes = spark.createDataFrame([(k, len(set(w))) for k, w in words.items()], "node long, n int")
    apart = lambda a, b: len(set(words[a]) ^ set(words[b]))
    linked = lambda a, b: 100 * len(set(words[a]) & set(words[b])) >= 90 * len(set(words[a]) | set(words[b]))
    stars = spark.createDataFrame([(k, k // 100 * 100, linked(k, k // 100 * 100), apart(k, k // 100 * 100)) for k in words if k % 100], "node long, hub long, linked boolean, apart long")
    stage = Stage(spark, "t")
    roots = stage.put(connected_components(stars.where("linked").selectExpr("node a", "hub b"), stage))
    cells = _open(stars, roots, sizes, 90, 8, 10**6, stage, 100)
    held = {}
    for r in cells.collect():
        held.setdefault(r.cell, []).append((r.node, r.asked))
    met = {frozenset((a, b)) for c in held.values() for a, ask in c for b, _ in c if ask and a != b}
    root = {r.node: r.root for r in roots.collect()}
    must = {frozenset((a, b)) for a in words for b in words if a != b and linked(a, b) and root.get(a, a) != root.get(b, b)}
    assert len(must) > 50 and must <= met and max(map(len, held.values())) <= 32
    assert not any(c[0][0] // 100 != x // 100 for c in held.values() for x, _ in c)
    far = {frozenset((a, b)) for a in words for b in words if a // 100 == b // 100 and a % 100 >= 30 and 0 < b % 100 < 12}
    assert not far & met  # strangers aren't asked against the hub's own
    links = _settled(cells, texts, 1, 90, 100).union(roots.selectExpr("node a", "root b"))
    root = {r.node: r.root for r in connected_components(links, stage).collect()}
    assert sorted(repr((k, len(set(w)), root.get(k, k))) for k, w in words.items()) == brute([(k, " ".join(w)) for k, w in words.items()], 1, 90)


def test_odd_rows(docs, clashing, odd):
    rows = odd + [(20 + i, "one and the same text here again") for i in range(30)] + [(60, "One AND the same text  here\tagain"), (61, "short"), (62, "Short"), (63, "É a b c d"), (64, "é a b c d"), (None, "one and the same text here again")]
    assert got(jaccard_components(clashing(rows))) == brute(rows)
    assert jaccard_components(docs([])).count() == 0
    assert got(jaccard_components(docs([(1, None), (2, "")]))) == brute([(1, None), (2, "")])


def test_linked_counts_exactly():
    a = pa.array([" ".join(f"a{i}" for i in range(103)), "x", "", "p q r s t"])
    b = pa.array([" ".join(f"a{i}" for i in range(88)), "x", "", "p q r s u"])
    assert compare(a, b, 4, 85)[0].tolist() == [True, True, False, False] and compare(a, b, 4, 86)[0].tolist() == [False, True, False, False]
    assert shingles(a, 4)[3].tolist() == [100, 1, 0, 2]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 95)], "a long, b long")
    found = {r.node: r.root for r in connected_components(links, Stage(spark, "t")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
    assert connected_components(links.limit(0), Stage(spark, "t")).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from sparkvane.llm.queries import ORACLE_SQL, QUERIES

    rows = QUERIES["op10_jaccard"](spark, "/root/testdata/sf0.001").collect()
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, rows)) == sorted(c.sql(ORACLE_SQL["op10_jaccard"]).fetchall())


def test_letters_that_cancel(docs):
    """Words of two letters whose polynomial hashes modulo 2^64 are equal aren't the same word."""
    rows = []
    for n in (1024, 2048, 4096):
        a = "ab"
        while len(a) < n:
            a += a.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows) + 1, a), (len(rows) + 2, a.translate(str.maketrans("ab", "ba"))), (len(rows) + 3, f"{a} x y z w")]
    rows.append((100, rows[0][1]))
    assert sorted(repr(tuple(r)) for r in jaccard_components(docs(rows)).collect()) == brute(rows)
    ok, _ = compare(pa.array([rows[0][1]]), pa.array([rows[1][1]]), 4, 85)
    assert ok.tolist() == [False]


@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "long-word"]), max_size=9), min_size=1, max_size=6), st.integers(1, 9))
def test_numbered_shingles(texts, n):
    array = pa.array([" ".join(t) for t in texts])
    doc, number, code, size = exact_shingles(array, n)
    want = [sets(" ".join(t), n) for t in texts]
    assert size.tolist() == [len(x) for x in want]
    held = [set(number[doc == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for k in range(i):
            assert len(held[i] & held[k]) == len(want[i] & want[k])
    same, other, _, _ = shingles(array, n)
    assert same.tolist() == doc.tolist() and sorted(other.tolist()) == sorted(code.tolist())


def test_keep_first_keeps_one_row_of_each_group(docs):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(3, a), (3, a), (3, a + " more"), (4, a + " tail"), (4, "another text that is no copy at all"), (5, None), (5, None), (None, a), (6, ""), (7, "one two"), (7, "one two"), (8, "one two")]
    kept = sorted(repr((r.doc_id, r.text)) for r in keep_first(docs(rows), 5, 80).collect())
    group = [t for t in (a, a + " more") if repr((3, t)) in kept]
    assert len(group) == 1
    assert kept == sorted(map(repr, [(3, group[0]), rows[4], (5, None), (5, None), (None, a), (6, ""), (7, "one two")]))
    assert keep_first(docs([]), 5, 80).count() == 0
