"""Registered queries over the engine's whole surface: uploads, catalogs, deletes, shards, placements, streams, limits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import shown
from ..limits import BOUNDS, bounded, collection_name, search_arguments
from ..operators import evaluate, ivf, quantise, routing
from ..operators.filters import Equals, Filter
from ..sources import uploads
from .engine import Collection, Engine
from .queries import _KEY_SHARD, _REC, _RING, _SQ, _knn_sql, _nodes, _sql_distance, asked, log, query, records, shared_folder, table


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _batch(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("id") - 1).cast("int").alias("ord"), "id", "generation", "vector", F.to_json(F.struct("label")).alias("payload"))


def _loaded(spark: SparkSession, sf_dir: str, name: str, metric: str = "l2") -> Collection:
    """A collection of all records, in an engine of its own."""
    engine = Engine(spark, _root(spark, name))
    engine.create("vectors", 64, metric)
    engine.collection("vectors").upsert(_batch(records(spark, sf_dir)), "load")
    return engine.collection("vectors")


@query("json_upload", """
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS ord, CASE WHEN item_id % 3 <> 0 THEN item_id + 1 END AS id, text, CAST(item_id % 5 AS BIGINT) AS rank FROM benchmark""")
def json_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as one JSON upload (which is small by design), a third of them without an id."""
    path = _root(spark, "json")
    b = table(spark, sf_dir, "benchmark")
    one = F.struct("item_id", F.when(F.col("item_id") % 3 != 0, F.col("item_id") + 1).alias("id"), "text", F.struct((F.col("item_id") % 5).alias("rank")).alias("payload"))
    b.select(one.alias("r")).agg(F.to_json(F.struct(F.sort_array(F.collect_list("r")).alias("records")))).write.text(path)
    return uploads.read_json(spark, path).select("ord", "id", "text", F.get_json_object("payload", "$.rank").cast("long").alias("rank"))


@query("csv_upload", """
SELECT item_id + 1 AS id, trim(text) AS text, CASE WHEN item_id % 2 = 0 THEN [CAST(item_id AS DOUBLE), 0.5e0] END AS vector, 'a "b", ' || item_id AS note FROM benchmark""")
def csv_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as one CSV upload with quoted quotes; vectors as numbers between semicolons and as JSON."""
    path, b = _root(spark, "csv"), table(spark, sf_dir, "benchmark")
    item = F.col("item_id").cast("string")
    vector = F.when(F.col("item_id") % 4 == 0, F.concat(item, F.lit("; 0.5"))).when(F.col("item_id") % 2 == 0, F.concat(F.lit("["), item, F.lit(", 0.5]")))
    rows = b.select((F.col("item_id") + 1).alias("id"), "text", vector.alias("vector"), F.concat(F.lit('a "b", '), item).alias("note"))
    rows.coalesce(1).write.csv(path, header=True, quote='"', escape='"')
    return uploads.read_csv(spark, path).select("id", "text", "vector", F.get_json_object("payload", "$.note").alias("note"))


@query("reopened_catalog", """
SELECT 'part_' || (vec_id % 4) AS name, CAST(64 AS INTEGER) AS dimensions, CASE vec_id % 4 WHEN 0 THEN 'cosine' WHEN 1 THEN 'l2' ELSE 'dot' END AS metric, count(*) AS live_vectors, count(*) * 256 AS resident_bytes, CAST(3 AS INTEGER) AS keys_kept
FROM embeddings WHERE vec_id % 4 <> 3 GROUP BY 1, 2, 3""")
def reopened_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four collections of all records, one compacted, one dropped with its keys; what a second engine on the same folder finds."""
    engine, rows = Engine(spark, _root(spark, "reopened")), records(spark, sf_dir)
    for i, metric in enumerate(("cosine", "l2", "dot", "cosine")):
        engine.create(f"part_{i}", 64, metric)
        engine.collection(f"part_{i}").upsert(_batch(rows.where(F.pmod(F.col("id") - 1, F.lit(4)) == i)), "load")
    engine.collection("part_1").compact()
    engine.drop("part_3")
    again = Engine(spark, engine.store.root)
    return again.list().withColumn("keys_kept", F.lit(len(again.state["acks"])))


@query("multi_delete", """
WITH p(pos, id, g) AS (VALUES (0, 5, 1), (1, 6, 2), (2, 900000000, 1), (3, 5, 1), (4, 7, 1))
SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN id > (SELECT count(*) FROM embeddings) OR pos = 3 THEN 'missing' WHEN g <> 1 THEN 'stale' ELSE 'deleted' END AS status,
 true AS any_deleted, (SELECT count(*) - 2 FROM embeddings) AS live_left FROM p""")
def multi_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that are told one by one: gone, stale, missing, repeated; whether any hit; how many records are left."""
    own = _loaded(spark, sf_dir, "deletes")
    told = own.delete_many([(5, 1), (6, 2), (900_000_000, 1), (5, 1), (7, 1)])
    return spark.createDataFrame([(i, s, "deleted" in told, own.size()) for i, s in enumerate(told)], "pos int, status string, any_deleted boolean, live_left long")


@query("shard_search", f"""
WITH {_REC}, s AS (SELECT id, vector, CAST({_KEY_SHARD.format(k='id')} % 3 AS INTEGER) AS shard FROM rec), d AS (SELECT s.id, {_sql_distance('l2', 'q.vector', 's.vector')} AS distance FROM s, rec q WHERE q.id = 9 AND s.shard = 2)
SELECT CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) + 0 AS distance FROM d ORDER BY d.distance, id LIMIT 10""")
def shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten records of shard 2 nearest to record 9; the other shards' files aren't read."""
    own = _loaded(spark, sf_dir, "shards")
    return own.search_shard(2, list(own.get(9).vector), 10).select("rank", "id", shown(F.col("distance")).alias("distance"))


@query("filtered_search", f"""
WITH {_REC}, d AS (SELECT r.id, {_sql_distance('cosine', 'q.vector', 'r.vector')} AS distance FROM rec r, rec q WHERE q.id = 4 AND r.label = 3)
SELECT CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) + 0 AS distance FROM d ORDER BY d.distance, id LIMIT 5""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's own search, among records whose payload passes."""
    own = _loaded(spark, sf_dir, "filtered", "cosine")
    return own.search(list(own.get(4).vector), k=5, where=Filter(must=(Equals("label", 3),))).select("rank", "id", shown(F.col("distance")).alias("distance"))


@query("sealed_codes", f"WITH {_SQ} SELECT id, CAST(sum(code * (pos + 1)) AS BIGINT) AS weighted FROM c GROUP BY id")
def sealed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a sealed snapshot, read back from its folder."""
    codes = quantise.seal(records(spark, sf_dir), _root(spark, "sealed"))[1]
    weighted = F.aggregate(F.transform("code", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return codes.select("id", weighted.alias("weighted"))


@query("ivf_all_cells", _knn_sql("l2"))
def ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index asked in every cell gives the exact result."""
    rows = records(spark, sf_dir).select("id", "vector")
    model = ivf.train(rows, cells=8)
    near = ivf.search(asked(spark, sf_dir), ivf.assign(rows, model), model, "l2", 10, nprobe=8)
    return near.select("qid", "rank", "id", shown(F.col("distance")).alias("distance"))


@query("migrated_placements", f"""
WITH {_RING}, f AS (SELECT min(nd.id) AS id FROM nd, rp WHERE rp.shard = 0 AND NOT list_contains(rp.r, nd.id)),
m AS (SELECT shard, CASE WHEN shard = 0 THEN [r[1], f.id] ELSE r END AS n FROM rp, f)
SELECT shard, n[1] AS leader, array_to_string(n, ',') AS replicas, (SELECT count(*) + count(*) FILTER (WHERE n_nationkey % 4 = 0) + 5 FROM nation) AS epoch FROM m""")
def migrated_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes join, some drain, shards are placed, one shard moves, and a node drains without new placements; the epoch counts all of it."""
    known = _nodes(spark, sf_dir).orderBy("id").collect()  # nodes are few
    directory = routing.Directory(spark, 12, 2)
    for n in known:
        directory.add_node(n.id, n.endpoint, n.virtual_nodes)
    for n in known:
        if n.state != "active":
            directory.set_state(n.id, n.state)
    directory.place()
    free = min(n.id for n in known if n.state == "active" and n.id not in directory.placed[0])
    move = directory.begin_migration(0, free)
    directory.mark_caught_up(move.id)
    directory.cutover(move.id)
    directory.set_state(free, "draining")
    return directory.placement_table().select("shard", "leader", F.concat_ws(",", "replicas").alias("replicas"), F.lit(directory.epoch).cast("long").alias("epoch"))


@query("stream_gate", """
WITH r AS (SELECT event_id + 1 AS ord, user_id + 1 AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS generation FROM events),
p AS (SELECT *, coalesce(max(generation) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous FROM r)
SELECT id, ord, generation, previous, generation > previous AS accepted FROM p""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the gate that keeps each id's generation in RocksDB state."""
    from ..streaming.ingest import generation_gate

    path, key = _root(spark, "gate"), "spark.sql.streaming.stateStore.providerClass"
    log(spark, sf_dir).select("id", F.col("lsn").alias("ord"), "generation").write.parquet(f"{path}/rows")
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        gated = generation_gate(spark.readStream.schema("id long, ord long, generation long").parquet(f"{path}/rows"))
        gated.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(f"{path}/out")


_LIMITS = ", ".join(f"('{n}', {base}, {low}, {high})" for n, base, low, high in (
    ("dimensions", 128, 1, 65536), ("hnsw_m", 32, 2, 128), ("ef_construction", 200, 4, 2000), ("top_k", 10, 1, 100), ("rerank_candidates", 100, 1, 5000),
    ("timeout_millis", 2000, 1, 30000), ("vectors", 1000, 1, 20000), ("queries", 200, 1, 5000), ("concurrency", 8, 1, 64)))


@query("argument_limits", f"""
WITH b(name, base, low, high) AS (VALUES {_LIMITS})
SELECT name, CAST(base AS INTEGER) AS by_default, CAST(low AS INTEGER) AS least, CAST(high AS INTEGER) AS most, true AS rejects_outside FROM b""")
def argument_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bounded argument takes, found by trying values at and around its bounds."""

    def taken(name: str, value: object = None) -> int | None:
        try:
            return bounded(name, value)
        except ValueError:
            return None

    rows = []
    for name, (_, low, high) in BOUNDS.items():
        tried = [x for x in (low - 1, low, high, high + 1) if taken(name, x) is not None]
        rows.append((name, taken(name), min(tried), max(tried), all(taken(name, x) is None for x in (low - 1, high + 1, True, 1.5, "7"))))
    return spark.createDataFrame(rows, "name string, by_default int, least int, most int, rejects_outside boolean")


@query("search_limits", """
WITH k(k) AS (VALUES (1), (10), (96), (97), (100)) SELECT CAST(k AS INTEGER) AS top_k, CAST(greatest(96, k) AS INTEGER) AS ef_search, CAST(greatest(100, k) AS INTEGER) AS rerank_candidates, CAST(2000 AS INTEGER) AS timeout_millis, true AS smaller_rejected FROM k""")
def search_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of a search's arguments that follow top_k; a smaller one is rejected."""

    def rejected(**given: int) -> bool:
        try:
            search_arguments(**given)
        except ValueError:
            return True
        return False

    rows = []
    for k in (1, 10, 96, 97, 100):
        got = search_arguments(k)
        rows.append((k, got["ef_search"], got["rerank_candidates"], got["timeout_millis"], rejected(top_k=k, ef_search=k - 1) and rejected(top_k=k, rerank_candidates=k - 1)))
    return spark.createDataFrame(rows, "top_k int, ef_search int, rerank_candidates int, timeout_millis int, smaller_rejected boolean")


@query("collection_names", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9_-]{1,128}') AS plain, true AS joined FROM part")
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part names could be a collection's, as they stand and with blanks replaced."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    def fits(name: str) -> bool:
        try:
            return bool(collection_name(name))
        except ValueError:
            return False

    def judged(batches):
        for b in batches:
            b["plain"] = [fits(n) for n in b["p_name"]]
            b["joined"] = [fits(n.replace(" ", "_")) for n in b["p_name"]]
            yield b[["p_partkey", "plain", "joined"]]

    return names.mapInPandas(judged, "p_partkey long, plain boolean, joined boolean")


@query("run_rules", """
WITH q(asked, n) AS (SELECT * FROM (VALUES (50, 100), (200, 100), (2000, 2000), (5000, 2001), (80, 20000)))
SELECT CAST(asked AS INTEGER) AS asked, CAST(n AS INTEGER) AS n, CAST(least(asked, n, CASE WHEN n <= 2000 THEN n ELSE 100 END) AS INTEGER) AS sample, n >= 2000 AS ingest, asked <= 80 AS p99, asked <> 200 AS errors, n > 100 AS recall FROM q""")
def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample sizes and gates of stress runs with given figures."""
    rows = []
    for asked_, n in ((50, 100), (200, 100), (2000, 2000), (5000, 2001), (80, 20000)):
        told = evaluate.gate({"recall": 0.95 if n > 100 else 0.9499, "vectors_per_second": float(n), "p99_millis": asked_ / 10, "errors": int(asked_ == 200)})
        rows.append((asked_, n, evaluate.sample_size(asked_, n), told["ingest"], told["p99"], told["errors"], told["recall"]))
    return spark.createDataFrame(rows, "asked int, n int, sample int, ingest boolean, p99 boolean, errors boolean, recall boolean")


@query("job_seeds", """
SELECT o_orderkey, CAST(list_reduce(list_concat([CAST(2166136261 AS UBIGINT)], list_transform(string_split('job-' || o_orderkey, ''), lambda c: CAST(unicode(c) AS UBIGINT))),
 lambda a, c: (xor(a, c) * CAST(16777619 AS UBIGINT)) % CAST(4294967296 AS UBIGINT)) AS BIGINT) AS seed FROM orders""")
def job_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds that jobs named by order keys would have."""

    def seeds(batches):
        for b in batches:
            b["seed"] = [evaluate.seed_of(f"job-{k}") for k in b["o_orderkey"]]
            yield b

    return table(spark, sf_dir, "orders").select("o_orderkey").mapInPandas(seeds, "o_orderkey long, seed long")
