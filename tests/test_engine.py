import json

import pytest
from pyspark.sql import functions as F

from sparkvane.limits import Conflict, NotFound, StaleGeneration
from sparkvane.operators import evaluate
from sparkvane.operators.filters import Equals, Filter
from sparkvane.plans.engine import Engine, bootstrap
from sparkvane.sources import frames, uploads
from sparkvane.streaming.ingest import REQUEST, generation_gate, heartbeat_state, ingest

BATCH = "ord int, id long, generation long, vector array<float>, payload string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def rows(spark):
    return lambda *r: spark.createDataFrame([(i, *x, *([None] * (4 - len(x)))) for i, x in enumerate(r)], BATCH)


def test_records_live_across_restart(spark, engine, rows, tmp_path):
    engine.create("c", 3, "cosine")
    c = engine.collection("c")
    c.upsert(rows((1, 1, [1.0, 0.0, 0.0]), (2, 1, [0.0, 1.0, 0.0])))
    assert c.search([0.9, 0.1, 0.0], k=1).first().id == 1
    c.upsert(rows((1, 2, [0.0, 0.0, 1.0])))
    assert c.search([0.0, 0.0, 1.0], k=1).first().generation == 2
    with pytest.raises(StaleGeneration):
        c.upsert(rows((1, 2, [0.0, 0.0, 1.0])))
    with pytest.raises(StaleGeneration):
        c.delete(2, 7)
    c.delete(2, 1)
    assert c.delete_many([(2, 1), (1, 1)]) == ["missing", "stale"]
    again = Engine(spark, str(tmp_path / "db")).collection("c")
    assert again.size() == 1 and again.get(2) is None and again.get(1).generation == 2
    again.compact()
    assert again.size() == 1 and again.log().count() == 1
    again.upsert(rows((2, 1, [0.0, 1.0, 0.0])))
    assert again.size() == 2


def test_a_bad_batch_leaves_no_trace(engine, rows):
    engine.create("c", 2, "cosine")
    c = engine.collection("c")
    for bad in (rows((1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0])), rows((1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])), rows((1, 1, [1.0])), rows((0, 1, [1.0, 1.0]))):
        with pytest.raises(ValueError):
            c.upsert(bad)
    assert c.size() == 0 and c.log().count() == 0
    assert c.upsert(rows((1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])))["applied"] == 2 and c.get(1).generation == 2
    assert c.upsert(rows((1, 1, [1.0, 0.0])).limit(0))["applied"] == 0


def test_repeated_keys_and_catalog(engine, rows):
    engine.create("c", 2, "l2")
    c = engine.collection("c")
    first = c.upsert(rows((7, 1, [1.0, 1.0])), "request-1")
    assert c.upsert(rows((8, 1, [5.0, 5.0])), "request-1") == first and first["applied"] == 1 and c.size() == 1
    assert c.search([1.1, 1.1], k=5).first().id == 7
    with pytest.raises(ValueError):
        c.upsert(rows((9, 1, [1.0, 1.0])), "")
    with pytest.raises(Conflict):
        engine.create("c", 2)
    for bad in ({"name": "a b"}, {"name": "d", "dimensions": 0}, {"name": "d", "metric": "x"}, {"name": "d", "hnsw_m": 1}):
        with pytest.raises(ValueError):
            engine.create(**bad)
    engine.create("a", 4, "dot")
    assert [(r.name, r.live_vectors, r.resident_bytes) for r in engine.list().collect()] == [("a", 0, 0), ("c", 1, 8)]
    engine.drop("c")
    with pytest.raises(NotFound):
        engine.collection("c")
    assert [r.name for r in engine.catalog().collect()] == ["a"] and not engine.state["acks"]
    engine.drop("a")
    bootstrap(engine)
    assert [tuple(r) for r in engine.catalog().collect()] == [("documents", 128, "cosine", 32, 200)]


def test_a_second_writer_fails(spark, engine, tmp_path):
    other = Engine(spark, str(tmp_path / "db"))
    engine.create("one", 2)
    with pytest.raises(Conflict):
        other.create("two", 2)
    for n in range(5):
        engine.create(f"c{n}", 2)
    assert len(engine.store.versions("catalog")) == 3 and Engine(spark, str(tmp_path / "db")).catalog().count() == 6


def test_filtered_and_text_search(spark, engine):
    engine.create("t", 32, "cosine")
    c = engine.collection("t")
    data = [(1001, "apple silicon SIMD vector kernels", {"kind": "hardware"}), (1002, "hierarchical navigable small world graph", {"kind": "index"}), (1003, "distributed shard coordinator heartbeat", {"kind": "cluster"})]
    up = spark.createDataFrame([(i, d, None, t, None, json.dumps(p)) for i, (d, t, p) in enumerate(data)], "ord int, id long, generation long, text string, vector array<double>, payload string")
    assert [r.sequence for r in c.upload(up, 0).collect()] == [1, 1, 1]
    hit = c.search(text="apple silicon vector SIMD", k=2).orderBy("rank").first()
    assert hit.id == 1001 and json.loads(hit.payload) == {"kind": "hardware", "text": data[0][1]}
    assert [r.id for r in c.search(text="apple", k=5, where=Filter(must=(Equals("kind", "index"),))).collect()] == [1002]
    with pytest.raises(ValueError):
        c.search()


def test_routed_crud(engine, rows):
    engine.create("r", 2, "l2")
    c = engine.collection("r")
    assert c.upsert(rows((11, 1, [0.0, 0.0]), (22, 1, [4.0, 4.0]), (33, 1, [8.0, 8.0])))["applied"] == 3
    assert c.search([3.9, 4.1], k=1).first().id == 22
    assert c.delete_many([(22, 1)]) == ["deleted"] and c.describe().first().live_vectors == 2
    assert [r.id for r in c.multi_get([33, 22, 11, 33]).collect()] == [33, 11, 33]


def test_stress_run(engine):
    got = evaluate.stress(engine, 32, vectors=64, queries=20, top_k=10)
    assert got["errors"] == 0 and got["recall"] >= 0.95 and got["self_hit"] >= 0.98
    assert engine.catalog().count() == 0
    with pytest.raises(ValueError):
        evaluate.stress(engine, vectors=20_001)


def test_frames_round_trip_and_torn_tail(spark, tmp_path):
    raw = frames.encode_entry(1, 1, 11, 1, [1.0, 2.0], {"tenant": "blue", "priority": 7, "f": 0.5, "ok": True}) + frames.encode_entry(2, 2, 11, 1)
    (tmp_path / "a.log").write_bytes(raw + b"VDB")
    got = frames.read_frames(spark, str(tmp_path / "a.log")).orderBy("lsn").collect()
    assert [(r.lsn, r.op, r.id) for r in got] == [(1, 1, 11), (2, 2, 11)]
    assert got[0].vector == [1.0, 2.0] and json.loads(got[0].payload) == {"tenant": "blue", "priority": 7, "f": 0.5, "ok": True}
    for bad in (b"X" + raw[1:], raw[:20] + b"\xff" + raw[21:]):
        with pytest.raises(ValueError):
            list(frames.frames(bad))
    assert len(list(frames.frames(raw[:-1]))) == 1
    with pytest.raises(ValueError):
        frames.decode_entry(next(frames.frames(raw)) + b"x")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"id": 1, "text": "one", "payload": {"category": "docs"}}, {"vector": [1, 2.5]}]}')
    got = uploads.read_json(spark, str(tmp_path / "a.json")).orderBy("ord").collect()
    assert [(r.ord, r.id, r.text, r.vector) for r in got] == [(0, 1, "one", None), (1, None, None, [1.0, 2.5])] and json.loads(got[0].payload) == {"category": "docs"}
    (tmp_path / "a.csv").write_text('id, text ,vector,kind,note\r\n1,"a ""b"", c",,x,"two\nlines"\r\n\r\n2,,1;2 3,y,\r\n3,,"[4, 5]",z,n\r\n')
    got = uploads.read_csv(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r.id, r.text, r.vector) for r in got] == [(1, 'a "b", c', None), (2, None, [1.0, 2.0, 3.0]), (3, None, [4.0, 5.0])]
    assert json.loads(got[0].payload) == {"kind": "x", "note": "two\nlines"} and json.loads(got[1].payload) == {"kind": "y", "note": ""}
    (tmp_path / "b.csv").write_text("id,text\n,x\n")
    with pytest.raises(Exception, match="positive"):
        uploads.read_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(ValueError):
        uploads.read_json(spark, str(tmp_path / "c.json"))


def test_stream_acknowledges_each_request(spark, engine, tmp_path):
    engine.create("s", 2, "l2")
    rows = [("s", "a", 1, 0, 99, 1, [2.0, 3.0], None), ("s", "b", 2, 0, 1, 1, [1.0], None), ("nope", "c", 3, 0, 1, 1, [1.0, 1.0], None), ("s", "d", 4, 0, 99, 1, [2.0, 3.0], None), ("s", "e", 5, 0, 5, 1, [9.0, 9.0], None)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, REQUEST).write.parquet(source)
    acks: list = []
    ingest(spark.readStream.schema(REQUEST).parquet(source), engine, str(tmp_path / "cp"), acks).awaitTermination()
    assert [(a["idempotency_key"], a["applied"], len(a["errors"])) for a in acks] == [("a", 1, 0), ("b", 0, 1), ("c", 0, 1), ("d", 0, 1), ("e", 1, 0)]
    assert engine.collection("s").search([2.1, 3.1], k=1).first().id == 99


def test_requests_of_a_batch_are_one_commit_and_as_if_in_turn(spark, engine):
    """Held against one upsert after the other, with stale, bad, repeated and empty keys."""
    engine.create("many", 2, "l2")
    engine.create("single", 2, "l2")
    data = {"a": [(1, 1), (2, 1)], "b": [(1, 1), (3, 1)], "c": [(3, 2)], "d": [(4, 1), (4, 1)], "e": [(4, 1), (4, 2)], "f": [(0, 1)], "g": [(9, 3)], "": [(8, 1)]}
    flat = [(k, 10 * n, i, id_, g, [1.0, float(g)], None) for n, (k, rs) in enumerate(data.items()) for i, (id_, g) in enumerate(rs)]
    requests = spark.createDataFrame(flat, "idempotency_key string, sequence long, ord int, id long, generation long, vector array<float>, payload string")
    for name in ("many", "single"):
        engine.collection(name).upsert(requests.where("idempotency_key = 'g'").withColumn("generation", F.lit(5).cast("long")), "before")
    start, version = engine.state["committed"], engine.state["version"]
    many = engine.collection("many")
    acks = many.upsert_many(requests)
    assert engine.state["version"] == version + 1 and len(many.meta["batches"]) == 2
    want, single = [], engine.collection("single")
    for key in data:
        try:
            want.append((key, single.upsert(requests.where(F.col("idempotency_key") == key), key)["applied"]))
        except ValueError:
            want.append((key, 0))
    assert [(a["idempotency_key"], a["applied"]) for a in acks] == want == [("a", 2), ("b", 0), ("c", 1), ("d", 0), ("e", 2), ("f", 0), ("g", 0), ("", 0)]
    assert [a["committed_index"] - start for a in acks] == [1, 1, 2, 2, 3, 3, 3, 3]
    state = lambda c: sorted((r.id, r.generation) for r in c.live().collect())
    assert state(many) == state(single) == [(1, 1), (2, 1), (3, 2), (4, 2), (9, 5)]
    again = many.upsert_many(requests)
    assert [a for a in again if a["applied"]] == [a for a in acks if a["applied"]] and state(many) == state(single)


def _states(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_stateful_gate_and_heartbeats(spark, tmp_path):
    _states(spark)
    spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 2), (2, 3, 1)], "id long, ord long, generation long").coalesce(1).write.parquet(str(tmp_path / "g"))
    q = generation_gate(spark.readStream.schema("id long, ord long, generation long").parquet(str(tmp_path / "g"))).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, r.ord, r.previous, r.accepted) for r in spark.table("gate").orderBy("ord").collect()] == [(1, 0, 0, True), (1, 1, 1, True), (1, 2, 3, False), (2, 3, 0, True)]
    beats = spark.createDataFrame([("node-a", 2, 100), ("node-a", 1, 200), ("node-b", 1, 50)], "node_id string, incarnation long, s long").select("node_id", "incarnation", F.timestamp_seconds("s").alias("seen_at"))
    beats.coalesce(1).write.parquet(str(tmp_path / "b"))
    q = heartbeat_state(spark.readStream.schema("node_id string, incarnation long, seen_at timestamp").parquet(str(tmp_path / "b"))).writeStream.outputMode("update").format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.node_id, r.incarnation, r.last_seen.timestamp()) for r in spark.table("beats").collect()} == {("node-a", 2, 100.0), ("node-b", 1, 50.0)}


def _records(spark, *ids, generation=1):
    return spark.createDataFrame([(i, id_, generation, [1.0, float(id_)], None) for i, id_ in enumerate(ids)], "ord int, id long, generation long, vector array<float>, payload string")


def test_two_writers_lose_nothing(spark, tmp_path):
    """A writer with an old state applies and acknowledges nothing; its second try succeeds."""
    one = Engine(spark, str(tmp_path / "e"))
    one.create("c", 2, "l2")
    two = Engine(spark, str(tmp_path / "e"))
    assert one.collection("c").upsert(_records(spark, 1), "a")["applied"] == 1
    with pytest.raises(Conflict):
        two.collection("c").upsert(_records(spark, 2), "b")
    assert "c:b" not in Engine(spark, str(tmp_path / "e")).state["acks"]
    ack = two.collection("c").upsert(_records(spark, 2), "b")
    assert ack["applied"] == 1 and ack["committed_index"] == 2
    for i in range(5):  # versions in between are dropped; an old writer fails all the same
        two.collection("c").upsert(_records(spark, 10 + i))
    with pytest.raises(Conflict):
        one.collection("c").upsert(_records(spark, 3), "z")
    assert one.collection("c").upsert(_records(spark, 3), "z")["applied"] == 1
    with pytest.raises(Conflict):
        two.collection("c").delete(1, 1)
    fresh = Engine(spark, str(tmp_path / "e")).collection("c")
    assert sorted(r.id for r in fresh.live().collect()) == [1, 2, 3, 10, 11, 12, 13, 14]


def test_batches_are_evaluated_once(spark, tmp_path):
    """What is checked is what is logged, also where a source gives other rows each time."""
    from pyspark.sql import functions as F

    engine = Engine(spark, str(tmp_path / "e"))
    engine.create("c", 2, "l2")
    seen = spark.range(50).select(F.col("id").cast("int").alias("ord"), (F.floor(F.rand() * 10**12) + 1).cast("long").alias("id"), F.lit(1).cast("long").alias("generation"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"))
    assert engine.collection("c").upsert(seen)["applied"] == 50 and engine.collection("c").size() == 50


def test_many_deletes_are_one_batch(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create("c", 2, "l2")
    own = engine.collection("c")
    own.upsert(_records(spark, 1, 2, 3, 4))
    assert own.delete_many([(1, 1), (1, 1), (2, 9), (7, 1), (3, 1)]) == ["deleted", "missing", "stale", "missing", "deleted"]
    assert len(own.meta["batches"]) == 2 and engine.state["committed"] == 3 and sorted(r.id for r in own.live().collect()) == [2, 4]
    assert not own.delete_everywhere([(1, 1)]) and own.delete_everywhere([(9, 1), (2, 1)])
    assert own.delete_many([]) == []


def test_compaction_keeps_the_version_before(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create("c", 2, "l2")
    own = engine.collection("c")
    own.upsert(_records(spark, 1, 2, 3))
    own.upsert(_records(spark, 2, generation=2))
    before = own.live()
    own.compact()
    assert before.count() == 3 and own.size() == 3 and own.get(2).generation == 2
    own.compact()
    assert own.size() == 3 and len(own.meta["batches"]) == 1


def test_search_of_one_shard(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create("c", 2, "l2")
    own = engine.collection("c")
    own.upsert(_records(spark, *range(1, 30)))
    shard = {r.id: r.shard for r in own.live().collect()}
    for s in range(3):
        assert [r.id for r in own.search_shard(s, [1.0, 0.0], 4).orderBy("rank").collect()] == sorted(i for i in shard if shard[i] == s)[:4]
    with pytest.raises(ValueError):
        own.search_shard(3, [1.0, 0.0])


def test_uploaded_payloads_keep_their_types(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create("c", 8, "cosine")
    own = engine.collection("c")
    rows = [(0, 1, None, "first text", None, '{"priority":7,"ok":true,"r":2.5,"s":"7","text":"other"}'), (1, 2, None, "second", None, None), (2, 3, None, " ", [1.0] * 8, None)]
    own.upload(spark.createDataFrame(rows, "ord int, id long, generation long, text string, vector array<float>, payload string"), 0)
    held = {r.id: json.loads(r.payload) for r in own.live().collect()}
    assert held == {1: {"priority": 7, "ok": True, "r": 2.5, "s": "7", "text": "first text"}, 2: {"text": "second"}, 3: {"text": " "}}
    found = lambda *must: [r.id for r in own.search(vector=[1.0] * 8, where=Filter(must=must)).collect()]
    assert found(Equals("priority", 7)) == [1] and found(Equals("s", "7")) == [1] and found(Equals("priority", "7")) == []
