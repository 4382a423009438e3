"""Streams of upsert requests, generation gates and node heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..limits import Conflict, NotFound
from ..plans.engine import Engine

REQUEST = "collection string, idempotency_key string, sequence long, ord int, id long, generation long, vector array<float>, payload string"


def _publish(engine: Engine, name: str, rows: DataFrame, tries: int = 5) -> list[dict[str, object]]:
    """Acknowledgements of one collection's requests; another writer's commit in between makes it start anew."""
    for left in reversed(range(tries)):
        try:
            return engine.collection(name).upsert_many(rows)
        except NotFound as error:
            keys = rows.groupBy("idempotency_key").agg(F.min("sequence").alias("sequence")).orderBy("sequence").collect()  # a row for each request
            return [{"idempotency_key": k.idempotency_key, "sequence": k.sequence, "committed_index": engine.state["committed"], "applied": 0, "errors": [str(error)]} for k in keys]
        except Conflict:
            if not left:
                raise
    return []


def ingest(requests: DataFrame, engine: Engine, checkpoint: str, acks: list[dict[str, object]] | None = None, once: bool = True) -> StreamingQuery:
    """Upserts a stream of request rows; a request is the rows of one (collection, key), applied whole or not at all.

    A request that fails is told in its acknowledgement and the stream goes on. A micro-batch that is run again after
    a failure finds its keys acknowledged and applies nothing twice. Requests are taken in order of sequence, those of
    a micro-batch and collection are published together.
    """
    done = acks if acks is not None else []

    def apply(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            names = [r.collection for r in held.select("collection").distinct().collect()]  # collections, not requests
            told: list[dict[str, object]] = []
            for name in names:
                rows = held.where(F.col("collection").eqNullSafe(name)).drop("collection")
                told += [{"collection": name, **ack} for ack in _publish(engine, name, rows)]
            done.extend(sorted(told, key=lambda ack: ack["sequence"]))
        finally:
            held.unpersist()

    writer = requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class _Gate(StatefulProcessor):
    """Keeps each id's generation; tells which rows come with a newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.newest.get()[0] if self.newest.exists() else 0
        for part in rows:
            part = part.sort_values("ord")
            previous, accepted = [], []
            for g in part["generation"]:
                previous.append(stored)
                accepted.append(bool(g > stored))
                stored = max(stored, int(g))
            yield pd.DataFrame({"id": part["id"], "ord": part["ord"], "generation": part["generation"], "previous": previous, "accepted": accepted})
        self.newest.update((stored,))

    def close(self) -> None:
        pass


def generation_gate(rows: DataFrame) -> DataFrame:
    """id, ord, generation, previous, accepted for a stream of rows; needs the RocksDB state store."""
    return rows.groupBy("id").transformWithStateInPandas(_Gate(), "id long, ord long, generation long, previous long, accepted boolean", "append", "none")


class _Seen(StatefulProcessor):
    """Keeps each node's incarnation and when it was last seen; lower incarnations are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "incarnation long, last_seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        incarnation, seen = self.state.get() if self.state.exists() else (0, None)
        for part in rows:
            for row in part.sort_values(["seen_at", "incarnation"]).itertuples():
                if row.incarnation >= max(incarnation, 1):
                    incarnation, seen = int(row.incarnation), row.seen_at
        if seen is not None:
            self.state.update((incarnation, seen))
            yield pd.DataFrame({"node_id": [key[0]], "incarnation": [incarnation], "last_seen": [seen]})

    def close(self) -> None:
        pass


def heartbeat_state(beats: DataFrame) -> DataFrame:
    """node_id, incarnation, last_seen after each micro-batch of beats (node_id, incarnation, seen_at)."""
    return beats.where("node_id <> ''").groupBy("node_id").transformWithStateInPandas(_Seen(), "node_id string, incarnation long, last_seen timestamp", "update", "none")
