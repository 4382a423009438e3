"""Aggregates over collections, shards, acknowledgements, operations and fleets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_collections(shards: DataFrame) -> DataFrame:
    """Collections over all shards (name, dimensions, metric, live_vectors, resident_bytes); shards that disagree are an error."""
    total = shards.groupBy("name").agg(
        F.min("dimensions").alias("dimensions"), F.min("metric").alias("metric"), F.sum("live_vectors").alias("live_vectors"), F.sum("resident_bytes").alias("resident_bytes"),
        (F.min(F.struct("dimensions", "metric")) != F.max(F.struct("dimensions", "metric"))).alias("differ"),
    )
    checked = F.when(F.col("differ"), F.raise_error(F.lit("shards differ in a collection's dimensions or metric")).cast("int")).otherwise(F.col("dimensions"))
    return total.select("name", checked.alias("dimensions"), "metric", "live_vectors", "resident_bytes").orderBy("name")


def describe_collection(shards: DataFrame, name: str) -> DataFrame:
    return list_collections(shards.where(F.col("name") == name))


def merge_acks(acks: DataFrame) -> DataFrame:
    """Acknowledgements (committed_index, applied, errors) of all shards as one."""
    return acks.agg(F.max("committed_index").alias("committed_index"), F.sum("applied").alias("applied"), F.flatten(F.collect_list("errors")).alias("errors"))


def first_acks(requests: DataFrame) -> DataFrame:
    """Of requests (collection, idempotency_key, sequence, …), the first of each key in its collection."""
    body = [c for c in requests.columns if c not in ("collection", "idempotency_key")]
    return requests.where("idempotency_key <> ''").groupBy("collection", "idempotency_key").agg(F.min_by(F.struct(*body), "sequence").alias("r")).select("collection", "idempotency_key", "r.*")


def endpoints(placements: DataFrame, nodes: DataFrame) -> DataFrame:
    return placements.join(nodes, placements["leader"] == nodes["id"]).select("endpoint").distinct().orderBy("endpoint")


def recent(ops: DataFrame, n: int = 200) -> DataFrame:
    """The newest operations (at, seq, …); later ones first."""
    return ops.orderBy(F.desc("at"), F.desc("seq")).limit(n)


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The last jobs (job, …), newest first."""
    return jobs.orderBy(F.desc("job")).limit(n)


def fleet(shards: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return shards.agg(F.countDistinct("name").alias("collections"), total("live_vectors").alias("vectors"), total("resident_bytes").alias("bytes"))


def health(nodes: DataFrame, collections: int) -> DataFrame:
    """One row: node counts by state and the number of collections."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("state") == "active").alias("active")).withColumn("collections", F.lit(collections))
