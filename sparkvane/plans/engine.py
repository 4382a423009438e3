"""An engine of named collections over append-only Parquet logs.

Each accepted batch is a folder of its own, written first and then published by naming
it in the next version of the catalog. Readers see published batches only, so a failed job leaves
nothing behind that counts. A change is made to a copy of the state, which becomes the engine's own when it
is published. A writer whose state is old fails to publish, reads the newest state and can try again.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import route_shard
from ..limits import Conflict, NotFound, StaleGeneration, bounded, collection_name
from ..operators.filters import Filter
from ..operators.search import batch_top_k, multi_get, text_top_k, top_k
from ..operators.validate import batch_errors, chunked, record_error, row_numbers, with_defaults
from ..schema import CATALOG, DELETE, LOG, METRIC_CODES, UPSERT
from ..sources.live import live_view


class Store:
    """Small files on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def versions(self, name: str) -> list[str]:
        """The published versions of a name, oldest first."""
        if not self.fs.exists(self.path("")):
            return []
        found = [str(f.getPath().getName()) for f in self.fs.listStatus(self.path(""))]
        return sorted(f for f in found if re.fullmatch(rf"{name}-[0-9]{{12}}\.json", f))

    def publish(self, name: str, version: int, text: str, keep: int = 3) -> None:
        """Makes a text the newest version of a name: written beside, then moved to a place that must be free."""
        beside, to = f"{name}.{uuid.uuid4().hex}", f"{name}-{version:012d}.json"
        out = self.fs.create(self.path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        # old versions are dropped, so that a free place may still be an old one
        if self.versions(name)[-1:] >= [to] or not self.fs.rename(self.path(beside), self.path(to)):
            self.drop(beside)
            raise Conflict(f"another writer has published version {version} of {name}")
        if self.versions(name)[-1] != to:
            raise Conflict(f"another writer has published beyond version {version} of {name}")
        for old in self.versions(name)[:-keep]:
            self.drop(old)

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Engine:
    """Collections by name: create, list, describe, drop, and data through `collection(name)`."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 3) -> None:
        self.spark, self.store, self.shards = spark, Store(spark, root), shards
        self.refresh()

    def refresh(self) -> None:
        """Reads the newest published state."""
        known = self.store.versions("catalog")
        self.state = json.loads(self.store.read(known[-1])) if known else {"version": 0, "collections": {}, "acks": {}, "committed": 0}

    def _commit(self, change: Callable[[dict], object]) -> None:
        """Changes a copy of the state and publishes it; if another writer was first, theirs becomes the state and Conflict is raised."""
        state = copy.deepcopy(self.state)
        change(state)
        state["version"] += 1
        try:
            self.store.publish("catalog", state["version"], json.dumps(state, sort_keys=True))
        except Conflict:
            self.refresh()
            raise
        self.state = state

    def create(self, name: str, dimensions: int | None = None, metric: str = "cosine", hnsw_m: int | None = None, ef_construction: int | None = None) -> None:
        if collection_name(name) in self.state["collections"]:
            raise Conflict(f"collection {name} exists")
        if metric not in METRIC_CODES:
            raise ValueError(f"unknown metric {metric!r}")
        made = {"dimensions": bounded("dimensions", dimensions), "metric": metric, "hnsw_m": bounded("hnsw_m", hnsw_m), "ef_construction": bounded("ef_construction", ef_construction), "batches": [], "retired": [], "lsn": 0}
        self._commit(lambda state: state["collections"].update({name: made}))

    def drop(self, name: str) -> None:
        if name not in self.state["collections"]:
            raise NotFound(name)

        def change(state: dict) -> None:
            del state["collections"][name]
            state["acks"] = {k: v for k, v in state["acks"].items() if not k.startswith(f"{name}:")}

        self._commit(change)
        self.store.drop(f"logs/{name}")

    def catalog(self) -> DataFrame:
        rows = [(n, c["dimensions"], c["metric"], c["hnsw_m"], c["ef_construction"]) for n, c in sorted(self.state["collections"].items())]
        return self.spark.createDataFrame(rows, CATALOG)

    def collection(self, name: str) -> Collection:
        if name not in self.state["collections"]:
            raise NotFound(name)
        return Collection(self, name)

    def list(self) -> DataFrame:
        """name, dimensions, metric, live_vectors, resident_bytes of all collections, by name."""
        parts = [self.collection(n).describe() for n in sorted(self.state["collections"])]
        if not parts:
            return self.spark.createDataFrame([], "name string, dimensions int, metric string, live_vectors long, resident_bytes long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("name")


class Collection:
    """Data of one collection. All reads are queries over its published log."""

    def __init__(self, engine: Engine, name: str) -> None:
        self.engine, self.spark, self.name = engine, engine.spark, name
        self.dimensions, self.metric = self.meta["dimensions"], self.meta["metric"]

    @property
    def meta(self) -> dict:
        """What the newest state that the engine knows says of the collection."""
        if self.name not in self.engine.state["collections"]:
            raise NotFound(self.name)
        return self.engine.state["collections"][self.name]

    def log(self) -> DataFrame:
        paths = [f"{self.engine.store.root}/logs/{self.name}/{b}" for b in self.meta["batches"]]
        if not paths:
            return self.spark.createDataFrame([], LOG).withColumn("shard", F.lit(0))
        return self.spark.read.option("basePath", f"{self.engine.store.root}/logs/{self.name}").schema(f"{LOG}, shard int").parquet(*paths).select("lsn", "op", "id", "generation", "vector", "payload", "shard")

    def live(self) -> DataFrame:
        return live_view(self.log()).select("id", "generation", "vector", "payload", "shard", "lsn")

    def _append(self, rows: DataFrame, op: int, change: Callable[[dict, int], object]) -> int:
        """Logs rows (ord, id, generation, vector, payload) with successive numbers and publishes them together with a change; returns how many."""
        n = rows.count()
        if not n:
            return 0
        store, first = self.engine.store, self.meta["lsn"]
        numbered = row_numbers(rows, F.floor(F.col("ord") / 250_000), ["ord"], "nth").select((F.col("nth") + first).alias("lsn"), F.lit(op).alias("op"), "id", "generation", "vector", "payload", route_shard(F.col("id"), self.engine.shards).alias("shard"))
        batch = f"batch={first}-{uuid.uuid4().hex[:8]}"
        # a shard's rows are written by a task for each 250,000 of the batch
        numbered.repartition("shard", F.floor(F.col("lsn") / 250_000)).write.partitionBy("shard").parquet(f"{store.root}/logs/{self.name}/{batch}")

        def publish(state: dict) -> None:
            own = state["collections"][self.name]
            own["batches"].append(batch)
            own["lsn"] += n
            change(state, n)

        try:
            self.engine._commit(publish)
        except Conflict:
            store.drop(f"logs/{self.name}/{batch}")
            raise
        return n

    def upsert(self, batch: DataFrame, key: str | None = None) -> dict[str, object]:
        """Applies a whole batch (ord, id, generation, vector, payload) or, if one record is bad, none of it.

        With an idempotency key, a repeat returns the first acknowledgement and applies nothing. The batch is
        written aside once, so that what is checked is what is logged. When another writer was first, nothing is
        applied or acknowledged, Conflict is raised, and the same call may be made again.
        """
        if key is not None and not key:
            raise ValueError("an idempotency key can't be empty")
        known = self.engine.state["acks"].get(f"{self.name}:{key}") if key is not None else None
        if known:
            return known
        aside = f"staged/{uuid.uuid4().hex}"
        try:
            batch.select("ord", "id", "generation", "vector", "payload").write.parquet(f"{self.engine.store.root}/{aside}")
            rows = self.spark.read.parquet(f"{self.engine.store.root}/{aside}")
            errors = batch_errors(rows, self.live().select("id", "generation"), self.dimensions, self.metric).orderBy("ord").take(5)
            if errors:
                told = "; ".join(f"record {e.ord} (id {e.id}): {e.error}" for e in errors)
                raise StaleGeneration(told) if all(e.error == "stale" for e in errors) else ValueError(told)
            ack = {"committed_index": self.engine.state["committed"] + 1, "applied": 0, "errors": []}

            def change(state: dict, n: int) -> None:
                state["committed"] += 1
                ack["applied"] = n
                if key is not None:
                    state["acks"][f"{self.name}:{key}"] = ack

            if not self._append(rows, UPSERT, change):
                ack["committed_index"] -= 1
                if key is not None:
                    self.engine._commit(lambda state: state["acks"].update({f"{self.name}:{key}": ack}))
            return ack
        finally:
            self.engine.store.drop(aside)

    def upsert_many(self, requests: DataFrame) -> list[dict[str, object]]:
        """Applies requests (idempotency_key, sequence, ord, id, generation, vector, payload), each whole or not at all, in one commit.

        The result is that of `upsert` for one key after the other in order of sequence (ties by key): a list of
        idempotency_key, sequence, committed_index, applied, errors. All records are validated together. Of requests that
        are stale only by one another the first is left out, as later ones may have failed because of it; each such
        round is a job over the staged rows. Only a row for each request comes to the driver.
        """
        aside, root = f"staged/{uuid.uuid4().hex}", self.engine.store.root
        fields = ["ord", "id", "generation", "vector", "payload"]
        try:
            requests.select("idempotency_key", "sequence", *fields).write.parquet(f"{root}/{aside}/rows")
            rows = self.spark.read.parquet(f"{root}/{aside}/rows")
            asked = rows.groupBy("idempotency_key").agg(F.min("sequence").alias("sequence"), F.count("*").alias("n")).orderBy("sequence", "idempotency_key").collect()
            known = {k.idempotency_key: self.engine.state["acks"].get(f"{self.name}:{k.idempotency_key}") for k in asked}
            wrong = {k.idempotency_key: "an idempotency key can't be empty" for k in asked if not k.idempotency_key}
            fresh = [k for k in asked if not known[k.idempotency_key] and k.idempotency_key not in wrong]
            turns = self.spark.createDataFrame([(k.idempotency_key, i) for i, k in enumerate(fresh)], "idempotency_key string, turn int")
            of = dict(enumerate(fresh))
            numbered = row_numbers(rows.join(turns, "idempotency_key"), F.col("turn"), ["ord"], "nth").withColumn("ord", F.col("nth") - 1)
            numbered.select("turn", *fields).write.parquet(f"{root}/{aside}/turns")
            todo, out = self.spark.read.parquet(f"{root}/{aside}/turns"), []
            stored = self.live().select("id", "generation")
            # what fails whatever the other requests do: a bad record, or one not newer than what is stored
            old = F.when(F.col("generation") <= F.col("stored_generation"), "stale")
            judged = todo.join(stored.withColumnRenamed("generation", "stored_generation"), "id", "left").withColumn("error", F.coalesce(record_error(self.dimensions, self.metric), old))
            for t in judged.where("error is not null").groupBy("turn").agg(F.min_by(F.struct("id", "error"), "ord").alias("e")).collect():  # a row for each request at most
                wrong[of[t.turn].idempotency_key] = f"record (id {t.e.id}): {t.e.error}"
                out.append(t.turn)
            while True:
                kept = todo.where(~F.col("turn").isin(out)) if out else todo
                stale = batch_errors(kept, stored, self.dimensions, self.metric).orderBy("ord").first()
                if stale is None:
                    break
                turn = kept.where(F.col("ord") == stale.ord).first().turn
                wrong[of[turn].idempotency_key] = f"record (id {stale.id}): {stale.error}"
                out.append(turn)
            base, made, acks = self.engine.state["committed"], 0, []
            for k in asked:
                key = k.idempotency_key
                if key in wrong:
                    ack = {"committed_index": base + made, "applied": 0, "errors": [wrong[key]]}
                elif known[key]:
                    ack = known[key]
                else:
                    made += 1
                    ack = {"committed_index": base + made, "applied": k.n, "errors": []}
                acks.append({"idempotency_key": key, "sequence": k.sequence, **ack})
            new = {f"{self.name}:{a['idempotency_key']}": {x: a[x] for x in ("committed_index", "applied", "errors")} for a in acks if a["idempotency_key"] not in wrong and not known[a["idempotency_key"]]}

            def change(state: dict, _: int) -> None:
                state["committed"] += made
                state["acks"].update(new)

            if made:
                self._append(kept.select(*fields), UPSERT, change)
            return acks
        finally:
            self.engine.store.drop(aside)

    def upload(self, uploads: DataFrame, now_millis: int) -> DataFrame:
        """Fills in defaults and upserts all records as one batch; returns ord, id, sequence."""
        records = with_defaults(uploads, self.dimensions, now_millis)
        self.upsert(records)
        return chunked(records).select("ord", "id", "sequence")

    def delete(self, id_: int, generation: int) -> None:
        """Removes a record; the generation must be the stored one."""
        status = self.delete_many([(id_, generation)])[0]
        if status == "missing":
            raise NotFound(id_)
        if status == "stale":
            raise StaleGeneration(f"record {id_} has another generation than {generation}")

    def delete_many(self, pairs: list[tuple[int, int]]) -> list[str]:
        """A status for each (id, generation): one that fails doesn't undo or stop the others. They are one batch."""
        wanted = self.spark.createDataFrame([(i,) for i, _ in pairs], "id long").distinct()
        stored = {r.id: r.generation for r in self.live().join(F.broadcast(wanted), "id", "left_semi").select("id", "generation").collect()}  # as many as pairs at most
        out, gone = [], []
        for id_, generation in pairs:
            out.append("missing" if id_ not in stored else "stale" if stored[id_] != generation else "deleted")
            if out[-1] == "deleted":
                gone.append((len(gone), id_, stored.pop(id_), None, None))
        rows = self.spark.createDataFrame(gone, "ord int, id long, generation long, vector array<float>, payload string")
        self._append(rows, DELETE, lambda state, n: state.update(committed=state["committed"] + n))
        return out

    def delete_everywhere(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether any of the shards that were asked had something to delete."""
        return any(s == "deleted" for s in self.delete_many(pairs))

    def get(self, id_: int):
        """The record of an id or None; only its shard's files are read."""
        shard = self.spark.range(1).select(route_shard(F.lit(id_), self.engine.shards)).first()[0]
        return live_view(self.log().where((F.col("shard") == shard) & (F.col("id") == id_))).first()

    def search_shard(self, shard: int, vector: list[float], k: int | None = None) -> DataFrame:
        """The k nearest live records of one shard, whose files alone are read."""
        if not 0 <= shard < self.engine.shards:
            raise ValueError(f"there are shards 0 to {self.engine.shards - 1}")
        return top_k(live_view(self.log().where(F.col("shard") == shard)).select("id", "generation", "vector", "payload"), vector, self.dimensions, self.metric, k)

    def multi_get(self, ids: list[int]) -> DataFrame:
        return multi_get(self.spark, self.live(), ids)

    def search(self, vector: list[float] | None = None, text: str | None = None, k: int | None = None, where: Filter | None = None) -> DataFrame:
        """The k nearest live records by vector or by text, among those whose payload passes the filter."""
        records = self.live().select("id", "generation", "vector", "payload")
        if where is not None:
            records = records.where(where.column(F.parse_json("payload")))
        if (vector is None) == (text is None):
            raise ValueError("a search takes either a vector or a text")
        if text is not None:
            return text_top_k(self.spark, records, text, self.dimensions, self.metric, k)
        return top_k(records, vector, self.dimensions, self.metric, k)

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return batch_top_k(queries, self.live().select("id", "vector"), self.metric, k)

    def size(self) -> int:
        return self.live().count()

    def describe(self) -> DataFrame:
        return self.live().agg(F.count("*").alias("live_vectors")).select(
            F.lit(self.name).alias("name"), F.lit(self.dimensions).alias("dimensions"), F.lit(self.metric).alias("metric"), "live_vectors", (F.col("live_vectors") * self.dimensions * 4).alias("resident_bytes")
        )

    def compact(self) -> None:
        """Replaces all batches by one of the live records, with the numbers that they have.

        The old ones stay until the next time, for readers of the version before.
        """
        batch, root = f"batch=live-{uuid.uuid4().hex[:8]}", f"{self.engine.store.root}/logs/{self.name}"
        rows = self.live().withColumn("op", F.lit(UPSERT)).select("lsn", "op", "id", "generation", "vector", "payload", "shard")
        rows.repartition("shard", F.floor(F.col("lsn") / 250_000)).write.partitionBy("shard").parquet(f"{root}/{batch}")
        retired = self.meta.get("retired", [])

        def change(state: dict) -> None:
            own = state["collections"][self.name]
            own["retired"], own["batches"] = own["batches"], [batch]

        try:
            self.engine._commit(change)
        except Conflict:
            self.engine.store.drop(f"logs/{self.name}/{batch}")
            raise
        for b in retired:
            self.engine.store.drop(f"logs/{self.name}/{b}")


def bootstrap(engine: Engine) -> None:
    """A collection `documents` (128 dimensions, cosine) where there is none."""
    if not engine.state["collections"]:
        engine.create("documents", 128, "cosine")
