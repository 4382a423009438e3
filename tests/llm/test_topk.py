import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparkvane.llm.topk import arranged, exact_top_k, products, search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(queries, rows, k):
    ok = lambda v: v[0] is not None and v[1] and all(x is not None and math.isfinite(x) for x in v[1])
    whole = lambda v: [math.floor(1024 * x) for x in v[1]]
    out = []
    for q in {(q[0], tuple(q[1])) for q in queries if ok(q)}:
        a = whole(q)
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, whole(r), strict=True)))), r[0]) for r in rows if ok(r) and r[0] != q[0] and len(r[1]) == len(a))
        out += [(q[0], i + 1, r, -s) for i, (s, r) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("cell_bytes", [16 << 20, 3000])
def test_against_brute_force(spark, cell_bytes):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 1).astype("f4")]) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 700)] + [(700, None), (701, [None] + [0.1] * 7), (702, [math.nan] * 8), (703, [math.inf] * 8), (704, []), (705, [1.0, 2.0]), (710, [3.0, -1.0]), (None, [9.0] * 8), (3, rows[3][1])]
    rows += [(800, [3.0e38] + [0.0] * 7)] if cell_bytes < 10_000 else []
    queries = [x for x in rows if x[0] is not None and x[0] % 10 == 0]
    make = lambda v: spark.createDataFrame([(*x, 1) for x in v], SCHEMA)
    got = sorted(tuple(x) for x in exact_top_k(make(queries), make(rows), 10, cell_bytes).collect())
    assert got == brute(queries, rows, 10)


def test_few_candidates_and_none(spark):
    make = lambda v: spark.createDataFrame([(*x, 1) for x in v], SCHEMA)
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert [tuple(x) for x in exact_top_k(make(rows[:1]), make(rows)).orderBy("rank").collect()] == [(0, 1, 1, 524288), (0, 2, 2, -1048576)]
    assert exact_top_k(make(rows[:1]), make(rows[:1])).count() == 0
    assert exact_top_k(make([]), make(rows)).count() == 0 == exact_top_k(make(rows), make([])).count()


def test_products_beyond_53_bits():
    assert products(np.array([[2.0**40]]), np.array([[2.0**20 + 1]])).tolist() == [[2**60 + 2**40]]
    assert products(np.array([[2.0**60]]), np.array([[-(2.0**60)]])).tolist() == [[-(2**63) + 1]]


def test_components_of_any_size(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e305, -1e305]), (1, [1.7e308, 1.0]), (2, [1e-300, 0.25]), (3, [2.0**41, 3.0]), (4, [2.0**41 + 1024, 3.0]), (5, [-1e12, 0.5]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, schema)
    for cell_bytes in (16 << 20, 20):
        assert sorted(map(tuple, exact_top_k(df, df, 3, cell_bytes).collect())) == brute_whole(rows, 3)


def brute_whole(rows, k):
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    out = []
    for q in whole:
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(whole[q], whole[c], strict=True)))), c) for c in whole if c != q)
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=400))
def test_arranged_is_an_order(values):
    x = np.array([[v, (v * 7) % 5] for v in values], float)
    assert sorted(arranged(x).tolist()) == list(range(len(x)))


def test_pruning_skips_most_blocks_of_vectors_that_are_alike():
    """Families of similar vectors in any order of ids: fewer than half of the pairs are scored, and the result is whole."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 32))
    x = np.floor(1024 * np.concatenate([c + 0.03 * r.normal(size=(64, 32)) for c in centres]))
    order = r.permutation(len(x))
    x, ids = x[order], np.arange(len(x))
    q, names = x[::100], ids[::100]
    tally = [0, 0]
    who, found, score = search(q, names, np.full(len(q), -(2**63)), x, ids, 10, tally)
    assert tally[0] < tally[1] / 2
    plain = (q @ x.T).astype(np.int64)
    for i in range(len(q)):
        want = sorted((-s, c) for c, s in enumerate(plain[i].tolist()) if c != names[i])[:10]
        assert [(-s, c) for c, s in zip(found[who == i].tolist(), score[who == i].tolist(), strict=True)] == want
    again = [0, 0]
    floor = np.array([score[who == i].min() for i in range(len(q))])
    kept = search(q, names, floor, x, ids, 10, again)
    assert again[0] <= tally[0] and all((a == b).all() for a, b in zip(kept, (who, found, score), strict=True))
