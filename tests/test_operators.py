import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.limits import NotFound, bounded, collection_name, search_arguments
from sparkvane.operators import catalogs, evaluate, quantise, routing, search, validate
from sparkvane.operators.filters import Equals, Exists, Filter, Range
from sparkvane.schema import DELETE, UPSERT
from sparkvane.sources.live import live_view, next_lsn


@pytest.fixture
def grid(spark):
    return lambda n, m: spark.createDataFrame([(i, 1, [float(i), float(i % m)]) for i in range(1, n + 1)], "id long, generation long, vector array<float>")


def test_nearest_of_a_grid(grid):
    hits = search.top_k(grid(100, 7), [41.1, 6.0], 2, "l2", 3, 64).orderBy("rank").collect()
    assert len(hits) == 3 and hits[0].id == 41 and hits[0].distance < 0.02
    assert "TakeOrderedAndProject" in search.top_k(grid(100, 7), [1.0, 1.0], 2, "l2")._jdf.queryExecution().toString()


@pytest.mark.parametrize("query,metric,k", [([1.0], "l2", 3), ([0.0, 0.0], "cosine", 3), ([float("nan"), 1.0], "l2", 3), ([1.0, 1.0], "l2", 0), ([1.0, 1.0], "x", 3)])
def test_bad_queries(grid, query, metric, k):
    with pytest.raises(ValueError):
        search.top_k(grid(5, 2), query, 2, metric, k)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_batch_equals_single(spark, metric):
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6).astype("f4")]) for i in range(1, 201)] + [(300 + i, [1.0] * 6) for i in range(5)], "id long, vector array<float>")
    queries = rows.where("id % 40 = 0 or id = 301").select(F.col("id").alias("qid"), "vector")
    got = {}
    for x in search.batch_top_k(queries, rows, metric, 7, cells=3, block_queries=2).collect():
        got.setdefault(x.qid, []).append((x.rank, x.id))
    for q in queries.collect():
        one = [(x.rank, x.id) for x in search.top_k(rows, q.vector, 6, metric, 7).collect()]
        assert sorted(got[q.qid]) == sorted(one)
    assert search.batch_top_k(queries.limit(0), rows, metric).count() == 0


def test_shards_with_the_same_ids_merge(spark):
    rows = spark.createDataFrame([(s, i, [4.0 * (i - 1)] * 2) for s in range(3) for i in (1, 2, 3)], "shard int, id long, vector array<float>")
    assert [h.id for h in search.scatter_gather(rows, [0.1, 0.1], 2, "l2", 3, 1).collect()] == [1]


def test_text_search(spark):
    texts = [(1001, "apple silicon SIMD vector kernels"), (1002, "hierarchical navigable small world graph"), (1003, "distributed shard coordinator heartbeat")]
    rows = validate.with_defaults(spark.createDataFrame([(i, d, None, t, None, None) for i, (d, t) in enumerate(texts)], "ord int, id long, generation long, text string, vector array<float>, payload string"), 32, 0)
    assert search.text_top_k(spark, rows, "apple silicon vector SIMD", 32, "cosine", 2).orderBy("rank").first().id == 1001
    with pytest.raises(ValueError):
        search.text_top_k(spark, rows, "...", 32, "cosine")


def test_multi_get_keeps_order_and_repeats(grid):
    rows = grid(5, 2)
    assert [(r.pos, r.id) for r in search.multi_get(rows.sparkSession, rows, [4, 9, 1, 4]).collect()] == [(0, 4), (2, 1), (3, 4)]


def test_filters(spark):
    data = ['{"k":1,"s":"1","f":2.5,"b":true}', '{"k":2,"n":3e10}', '{"s":"x","k":"1"}', "{}", '{"f":7}']
    rows = spark.createDataFrame(list(enumerate(data)), "i int, j string").select("i", F.parse_json("j").alias("p"))
    ids = lambda f: sorted(r.i for r in rows.where(f.column(F.col("p"))).collect())
    assert ids(Equals("k", 1)) == [0] and ids(Equals("k", "1")) == [2] and ids(Equals("b", True)) == [0] and ids(Equals("f", 2.5)) == [0]
    assert ids(Range("f", gt=2.5)) == [4] and ids(Range("f", gte=2.5, lt=7)) == [0] and ids(Range("k", gte=0)) == [0, 1] and ids(Range("k")) == [0, 1]
    assert ids(Exists("s")) == [0, 2] and ids(Filter()) == [0, 1, 2, 3, 4]
    assert ids(Filter(must=(Exists("k"),), should=(Equals("s", "x"), Filter(must=(Range("k", lte=1),))), must_not=(Exists("b"),))) == [2]
    with pytest.raises(ValueError):
        Exists("").column(F.col("p"))


def test_record_rules(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 0, [1.0, 2.0]), (1, 1, [1.0]), (1, 1, [1.0, float("inf")]), (1, 1, [0.0, 0.0]), (1, 1, None), (None, 1, [1.0, 2.0]), (1, 1, [None, 1.0])], "id long, generation long, vector array<float>")
    assert [r[0] for r in rows.select(validate.record_error(2, "cosine")).collect()] == [None, "id", "generation", "dimension", "finite", "zero", "dimension", "id", "finite"]
    assert rows.where(validate.record_error(2, "l2").isNull()).count() == 2
    p = spark.createDataFrame([('{"a":1}',), ('{"":1}',), ('{"a":[1]}',), ('{"a":null}',), (None,)], "p string")
    assert [r[0] for r in p.select(validate.payload_error(F.col("p"))).collect()] == [None, "key", "value", "value", None]


def test_arguments():
    assert search_arguments() == {"top_k": 10, "ef_search": 96, "rerank_candidates": 100, "timeout_millis": 2000}
    assert search_arguments(100)["ef_search"] == 100
    for bad in ({"top_k": 0}, {"top_k": 101}, {"top_k": 10, "ef_search": 9}, {"top_k": True}, {"timeout_millis": 30_001}):
        with pytest.raises(ValueError):
            search_arguments(**bad)
    assert bounded("dimensions") == 128 and collection_name("a_1") == "a_1"
    for bad in ("", "a b", "x" * 129, "é", "a\n"):
        with pytest.raises(ValueError):
            collection_name(bad)


def fold(entries):
    state = {}
    for lsn, op, i, g in entries:
        if op == UPSERT:
            state[i] = (lsn, g)
        elif i in state and state[i][1] <= g:
            del state[i]
    return state


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 1, 2]), st.integers(1, 6), st.integers(1, 4)), max_size=40))
def test_live_view_is_the_fold(spark_session, steps):
    entries = [(n + 1, *s) for n, s in enumerate(steps)]
    df = spark_session.createDataFrame(entries, "lsn long, op int, id long, generation long")
    assert {r.id: (r.lsn, r.generation) for r in live_view(df).collect()} == fold(entries)
    assert next_lsn(df) == len(entries) + 1


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def test_deletes_of_other_generations(spark):
    rows = [(1, UPSERT, 1, 5), (2, DELETE, 1, 4), (3, UPSERT, 2, 1), (4, DELETE, 2, 9), (5, UPSERT, 2, 1)]
    df = spark.createDataFrame(rows, "lsn long, op int, id long, generation long")
    assert {r.id for r in live_view(df).collect()} == {1, 2}


def test_quantisation(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [0.8, 0.2, 0.4])], "id long, vector array<float>")
    model = quantise.train(rows)
    codes = rows.crossJoin(model).select("id", quantise.encode(F.col("vector"), F.col("low"), F.col("scale")).alias("code"))
    assert {r.id: r.code for r in codes.collect()} == {1: [0, 0, 0], 2: [255, 255, 255], 3: [204, 51, 102]}
    q = F.array(*[F.lit(x).cast("float") for x in (0.79, 0.21, 0.39)])
    near = codes.crossJoin(model).select("id", quantise.approximate_distance(q, F.col("code"), F.col("low"), F.col("scale"), "l2").alias("d"))
    d = {r.id: r.d for r in near.collect()}
    assert d[3] < d[1] and quantise.two_stage(rows, codes, model, q, "l2", 1, 3).first().id == 3
    rough = codes.crossJoin(model).select("id", quantise.approximate_distance(q, F.col("code"), F.col("low"), F.col("scale"), "cosine").alias("d"))
    assert {r.id: r.d == float("inf") for r in rough.collect()} == {1: True, 2: False, 3: False}
    flat = quantise.train(spark.createDataFrame([(1, [2.0])], "id long, vector array<float>")).first()
    assert flat.low == [2.0] and flat.scale == [1.0]


def test_two_stage_on_a_grid(grid):
    rows = grid(64, 5)
    model = quantise.train(rows)
    codes = rows.crossJoin(model).select("id", quantise.encode(F.col("vector"), F.col("low"), F.col("scale")).alias("code"))
    q = F.array(F.lit(23.05).cast("float"), F.lit(3.0).cast("float"))
    assert quantise.two_stage(rows, codes, model, q, "l2", 1, 10).first().id == 23


def fnv64(text):
    h = 14695981039346656037
    for c in text.encode():
        h = ((h ^ c) * 1099511628211) % 2**64
    return h


def test_routes_and_migration(spark):
    d = routing.Directory(spark, 12, 2)
    for n in "abc":
        d.add_node(f"node-{n}", f"{n}:1", 64)
    d.place()
    ring = sorted((fnv64(f"node-{n}#{i}"), f"node-{n}") for n in "abc" for i in range(64))
    for s in range(12):
        h, found = fnv64(f"logical-shard/{s}"), []
        for _, n in [t for t in ring if t[0] >= h] + ring:
            if n not in found:
                found.append(n)
        assert d.placed[s] == found[:2]
    before = d.route("tenant-17")
    assert before["shard"] == fnv64("tenant-17") % 12 == 4 and before["replicas"] == ["node-b", "node-a"]
    move = d.begin_migration(4, "node-c")
    assert d.route("tenant-17")["replicas"] == before["replicas"]
    with pytest.raises(ValueError):
        d.cutover(move.id)
    d.mark_caught_up(move.id)
    d.cutover(move.id)
    assert d.route("tenant-17")["replicas"] == ["node-b", "node-c"] and d.epoch > before["epoch"]
    with pytest.raises(NotFound):
        d.cutover(move.id)
    with pytest.raises(ValueError):
        d.begin_migration(4, "node-c")
    d.set_state("node-a", "down")
    with pytest.raises(ValueError):
        d.begin_migration(4, "node-a")


def test_heartbeats(spark):
    beats = spark.createDataFrame([("node-a", 2, 100), ("node-a", 1, 200), ("", 1, 100), ("node-b", 0, 100), ("node-c", 1, 50), ("node-c", 3, 60), ("node-c", 3, 70)], "node_id string, incarnation long, s long").withColumn("seen_at", F.timestamp_seconds("s"))
    got = {r.node_id: (r.incarnation, r.last_seen.timestamp()) for r in routing.heartbeats(beats).collect()}
    assert got == {"node-a": (2, 100.0), "node-c": (3, 70.0)}
    ok = spark.range(1).select(routing.healthy(F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(160)), 60), routing.healthy(F.timestamp_seconds(F.lit(99)), F.timestamp_seconds(F.lit(160)), 60)).first()
    assert tuple(ok) == (True, False)


def test_catalog_aggregates(spark):
    shards = spark.createDataFrame([("b", 2, "l2", 3, 24), ("a", 4, "dot", 1, 16), ("b", 2, "l2", 2, 16)], "name string, dimensions int, metric string, live_vectors long, resident_bytes long")
    assert [tuple(r) for r in catalogs.list_collections(shards).collect()] == [("a", 4, "dot", 1, 16), ("b", 2, "l2", 5, 40)]
    with pytest.raises(Exception, match="differ"):
        catalogs.list_collections(shards.union(spark.createDataFrame([("a", 5, "dot", 1, 1)], shards.schema))).collect()
    acks = spark.createDataFrame([(3, 2, []), (7, 1, ["x"])], "committed_index long, applied long, errors array<string>")
    assert tuple(catalogs.merge_acks(acks).first()) == (7, 3, ["x"])
    assert tuple(catalogs.health(spark.createDataFrame([("active",), ("down",)], "state string"), 4).first()) == (2, 1, 4)


def test_percentiles_and_gate(spark):
    ops = spark.createDataFrame([("s", float(i)) for i in range(1, 101)] + [("e", None)], "t string, v double")
    got = {r.t: r for r in evaluate.latency_summary(ops, ["t"], "v").collect()}
    assert (got["s"].p50, got["s"].p95, got["s"].p99, got["s"].max_millis) == (50, 95, 99, 100) and got["e"].p99 == 0
    assert evaluate.sample_size(50, 3000) == 50 and evaluate.sample_size(500, 3000) == 100 and evaluate.sample_size(500, 300) == 300
    assert all(evaluate.gate({"recall": 1, "vectors_per_second": 2000, "p99_millis": 8, "errors": 0}).values())


def test_payload_values_are_told_by_type(spark):
    rows = ['{"a":"see: [1]"}', '{"a":"x: null"}', '{"a":": {"}', '{"a":null}', '{"a":{"b":1}}', '{"a":[1]}', '[1]', "7", "no json", '{"":1}', '{}', '{"a":1,"b":true,"c":2.5,"d":"x"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(validate.payload_error(df.p)).collect()]
    assert got == [None, None, None, "value", "value", "value", "object", "object", "object", "key", None, None]


def test_batch_search_in_small_cells_with_ties(spark):
    import numpy as np

    from sparkvane.operators.search import batch_top_k

    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = df.where("id % 10 = 0").selectExpr("id qid", "vector")
    for metric in ("l2", "dot"):
        for cell_bytes in (64 << 20, 500):
            got = sorted((x.qid, x.rank, x.id) for x in batch_top_k(asked, df, metric, 7, cell_bytes=cell_bytes).collect())
            far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b)) if metric == "l2" else -sum(p * q for p, q in zip(a, b))  # noqa: E731, B023
            want = [(q, k + 1, i) for q, v in rows if q % 10 == 0 for k, (_, i) in enumerate(sorted((far(v, w), i) for i, w in rows)[:7])]
            assert got == sorted(want)


def test_stress_measures_each_search(spark, tmp_path):
    from sparkvane.operators.evaluate import gate, stress
    from sparkvane.plans.engine import Engine

    got = stress(Engine(spark, str(tmp_path / "e")), 16, vectors=100, queries=20, timed=6, concurrency=2)
    assert got["timed"] == 6 and got["errors"] == 0 and 0 < got["p50_millis"] <= got["p95_millis"] <= got["p99_millis"] and got["recall"] == 1.0
    assert gate(got)["p99"] == (got["p99_millis"] <= 8.0)


def test_batch_search_in_one_large_cell_is_bounded_in_memory(spark):
    """131,072 rows in a cell: pairs are scored in tiles, not 256 queries against all rows at once (over 1 GB a worker)."""
    import threading
    import time

    import psutil

    peak, stop = [0], threading.Event()

    def watch():
        while not stop.is_set():
            for c in psutil.Process().children(recursive=True):
                try:
                    peak[0] = max(peak[0], c.memory_info().rss if "python" in c.name() else 0)
                except psutil.Error:
                    pass
            time.sleep(0.02)

    rows = spark.range(131_072).select("id", F.array(*[F.randn(k) for k in range(8)]).alias("vector"))
    threading.Thread(target=watch, daemon=True).start()
    try:
        assert search.batch_top_k(rows.where("id < 300").withColumnRenamed("id", "qid"), rows, "l2", 10, cells=1).where("rank = 1 and qid = id").count() == 300
    finally:
        stop.set()
    assert 0 < peak[0] < 700 << 20


@pytest.mark.parametrize("tile", [(4096, 256), (16, 5)])
def test_nearest_rows_of_odd_tables(monkeypatch, tile):
    """Copies, near copies, whole numbers, a small spread far from zero, values that aren't numbers: as by brute force."""
    monkeypatch.setattr(search, "TILE_ROWS", tile[0]), monkeypatch.setattr(search, "TILE_QUERIES", tile[1])
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16)).astype("f4").astype(float)
    x[50:150], x[200:250] = x[50], x[200] * (1 + 1e-9)
    whole = r.integers(1, 4, (300, 3)).astype(float)
    holes = x.copy()
    holes[3, 1], holes[9, 2], holes[280] = np.nan, np.inf, np.nan
    for metric in ("cosine", "l2", "dot"):
        for body in (x, whole, x * 1e-3 + 1000, x[:4], *([holes, holes[:11]] if metric != "cosine" else [])):
            for digits in (6, 12):
                asked = body[::7]
                with np.errstate(all="ignore"):
                    got = search._nearest_rows(asked, body, metric, 5, digits)
                    far = [np.round(search._exact(np.repeat(q[None], len(body), 0), body, metric), digits) for q in asked]
                want = [(i, j, d[j]) for i, d in enumerate(far) for j in np.argsort(d, kind="stable")[:5]]
                assert np.array_equal(np.column_stack(got[:3]), np.array(want), equal_nan=True)


def test_grid_sends_few_copies():
    for queries, records, width in ((615_000, 615_000, 64), (200, 3_000_000, 128), (30, 300, 4), (0, 5, 3), (5, 0, 0), (1, 1, 65_536)):
        blocks, cells = search._grid(queries, records, width, 10, 200, 65_536, 64 << 20)
        assert blocks >= 1 and cells >= 1 and records * width * 8 <= cells * (64 << 20) and queries * width * 8 <= blocks * (64 << 20)
        assert blocks * cells >= min(200, queries * records)
    blocks, cells = search._grid(615_000, 615_000, 64, 10, 200, 65_536, 64 << 20)
    assert blocks + cells < 60  # 200 cells took 200 copies of each query before


def test_distances_are_rounded_once(spark):
    """0.24999999 ties with 0.25 at six digits, but isn't it: a later rounding must see the distance itself."""
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [0.49999999])], "qid long, vector array<double>")
    got = {r.id: r.distance for r in search.batch_top_k(asked, rows, "l2", 2, digits=6).collect()}
    assert got[1] == 0.49999999**2 and round(got[1], 1) == 0.2
