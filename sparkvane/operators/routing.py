"""Consistent-hash rings, placements, routes, migrations and node health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv64, route_shard
from ..limits import NotFound

NODE = "id string, endpoint string, virtual_nodes int, state string"


def ring(nodes: DataFrame) -> DataFrame:
    """hi, lo, node: tokens of active nodes, in unsigned order. A taken token moves up to the next free one.

    Nodes are few, so a ring is small; equal hashes, of which only neighbours collide, are
    resolved by adding the rank among equal values in order of node and index.
    """
    tokens = nodes.where("state = 'active'").select("id", F.explode(F.sequence(F.lit(0), F.col("virtual_nodes") - 1)).alias("i"))
    hashed = tokens.select("id", "i", fnv64(F.concat("id", F.lit("#"), F.col("i").cast("string"))).alias("h")).select("id", "i", "h.hi", "h.lo")
    again = F.row_number().over(Window.partitionBy("hi", "lo").orderBy("id", "i")) - 1
    return hashed.select("hi", (F.col("lo") + again).alias("lo"), F.col("id").alias("node"))


def replicas(keys: DataFrame, tokens: DataFrame, factor: int) -> DataFrame:
    """key, replicas: for each key, the first `factor` different nodes from its successor on, around the ring."""
    h = fnv64(F.col("key"))
    walk = keys.select("key", h.alias("h")).crossJoin(F.broadcast(tokens)).withColumn("wrapped", (F.col("hi") < F.col("h.hi")) | ((F.col("hi") == F.col("h.hi")) & (F.col("lo") < F.col("h.lo"))))
    first = walk.groupBy("key", "node").agg(F.min(F.struct("wrapped", "hi", "lo")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    chosen = first.withColumn("r", rank).where(F.col("r") <= factor)
    return chosen.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("replicas"))


def placements(spark: SparkSession, nodes: DataFrame, shards: int, factor: int) -> DataFrame:
    """shard, leader, replicas of every logical shard; too few active nodes is an error."""
    if shards < 1 or factor < 1:
        raise ValueError("shards and replication factor must be positive")
    if nodes.where("state = 'active'").count() < factor:
        raise ValueError("too few active nodes for the replication factor")
    keys = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.concat(F.lit("logical-shard/"), F.col("id").cast("string")).alias("key"))
    return keys.join(replicas(keys.select("key"), ring(nodes), factor), "key").select("shard", F.element_at("replicas", 1).alias("leader"), "replicas")


def routed(df: DataFrame, key: str, shards: int, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """With shard, leader, endpoint: where each row's owner is. Placements and nodes are small by design."""
    located = placed.join(nodes.select(F.col("id").alias("leader"), "endpoint"), "leader")
    return df.withColumn("shard", route_shard(F.col(key), shards)).join(F.broadcast(located.select("shard", "leader", "endpoint")), "shard")


def by_owner(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows with their shard, partitioned by it."""
    return df.withColumn("shard", route_shard(F.col(key), shards)).repartition("shard")


@dataclass
class Migration:
    id: str
    shard: int
    source: str
    destination: str
    phase: str = "copying"


class Directory:
    """Driver-side state of nodes, placements and migrations; each change raises the epoch."""

    def __init__(self, spark: SparkSession, shards: int, factor: int = 1) -> None:
        if shards < 1 or factor < 1:
            raise ValueError("shards and replication factor must be positive")
        self.spark, self.shards, self.factor, self.epoch = spark, shards, factor, 0
        self.nodes: dict[str, tuple[str, int, str]] = {}
        self.placed: dict[int, list[str]] = {}
        self.leaders: dict[int, str] = {}
        self.migrations: dict[str, Migration] = {}
        self.moves = 0

    def add_node(self, id_: str, endpoint: str, virtual_nodes: int = 128) -> None:
        if not id_ or not endpoint or virtual_nodes < 1 or id_ in self.nodes:
            raise ValueError("a node needs a new id, an endpoint and virtual nodes")
        self.nodes[id_] = (endpoint, virtual_nodes, "active")
        self.epoch += 1

    def set_state(self, id_: str, state: str) -> None:
        if id_ not in self.nodes:
            raise NotFound(id_)
        self.nodes[id_] = (*self.nodes[id_][:2], state)
        self.epoch += 1

    def node_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *v) for k, v in sorted(self.nodes.items())], NODE)

    def place(self) -> None:
        if self.placed:
            raise ValueError("placements exist already")
        for row in placements(self.spark, self.node_table(), self.shards, self.factor).collect():  # one row a shard
            self.placed[row.shard], self.leaders[row.shard] = list(row.replicas), row.leader
        self.epoch += 1

    def placement_table(self) -> DataFrame:
        return self.spark.createDataFrame([(s, self.leaders[s], self.placed[s]) for s in sorted(self.placed)], "shard int, leader string, replicas array<string>")

    def route(self, key: str) -> dict[str, object]:
        if not key or not self.placed:
            raise ValueError("a route needs a key and placements")
        shard = self.spark.range(1).select(route_shard(F.lit(key), self.shards)).first()[0]
        return {"epoch": self.epoch, "shard": shard, "leader": self.leaders[shard], "replicas": list(self.placed[shard])}

    def begin_migration(self, shard: int, destination: str) -> Migration:
        if shard not in self.placed:
            raise NotFound(shard)
        if destination not in self.nodes or self.nodes[destination][2] != "active" or destination in self.placed[shard]:
            raise ValueError("the destination must be active and not hold the shard yet")
        self.moves += 1
        move = Migration(f"migration-{self.moves}", shard, self.placed[shard][-1], destination)
        self.migrations[move.id] = move
        self.epoch += 1
        return move

    def _migration(self, id_: str, phase: str) -> Migration:
        if id_ not in self.migrations:
            raise NotFound(id_)
        if self.migrations[id_].phase != phase:
            raise ValueError(f"the migration isn't {phase}")
        return self.migrations[id_]

    def mark_caught_up(self, id_: str) -> None:
        self._migration(id_, "copying").phase = "ready"
        self.epoch += 1

    def cutover(self, id_: str) -> None:
        move = self._migration(id_, "ready")
        held = self.placed[move.shard]
        if move.source not in held:
            raise ValueError("the source holds the shard no more")
        held[held.index(move.source)] = move.destination
        if self.leaders[move.shard] == move.source:
            self.leaders[move.shard] = move.destination
        del self.migrations[id_]
        self.epoch += 1


def heartbeats(beats: DataFrame) -> DataFrame:
    """node_id, incarnation, last_seen of beats (node_id, incarnation, seen_at), by partial aggregates.

    A beat of a lower incarnation than one before doesn't count, so the last that does is the
    latest of the highest incarnation.
    """
    valid = beats.where("node_id <> '' and incarnation > 0")
    return valid.groupBy("node_id").agg(F.max(F.struct("incarnation", "seen_at")).alias("b")).select("node_id", "b.incarnation", F.col("b.seen_at").alias("last_seen"))


def healthy(last_seen: Column, now: Column, timeout_seconds: int) -> Column:
    return last_seen >= now - F.make_dt_interval(secs=F.lit(timeout_seconds))
