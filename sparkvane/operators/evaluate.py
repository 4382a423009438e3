"""Evaluation of search: ground truth, recall, self-hits, latencies, stress runs and gates."""

from __future__ import annotations

import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import seeded_vectors
from ..functions.hashing import MASK, OFFSET_32, PRIME_32
from ..limits import bounded
from .search import batch_top_k
from .search import top_k as near


def latency_summary(ops: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, p50, p95, p99 and max of a column. A percentile q is the value at place ceil(n * q); 0 without values."""

    def disc(q: float, name: str) -> Column:
        return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0.0)).alias(name)

    return ops.groupBy(*by).agg(F.count("*").alias("n"), disc(0.5, "p50"), disc(0.95, "p95"), disc(0.99, "p99"), F.coalesce(F.max(value), F.lit(0.0)).alias("max_millis"))


def telemetry(ops: DataFrame) -> DataFrame:
    """Latencies of the successful searches that are still among the kept operations (type, status, latency_millis)."""
    searches = ops.where("type = 'search' and status = 'ok'")
    return latency_summary(searches, [], "latency_millis")


def ground_truth(queries: DataFrame, records: DataFrame, metric: str, k: int) -> DataFrame:
    return batch_top_k(queries, records, metric, k)


def recall_at_k(results: DataFrame, truth: DataFrame, n_queries: int, n_records: int, k: int) -> DataFrame:
    """hits, expected, recall: queries without results count as missed."""
    hits = results.select("qid", "id").distinct().join(truth.select("qid", "id"), ["qid", "id"], "left_semi")
    expected = n_queries * min(k, n_records)
    return hits.agg(F.count("*").alias("hits")).select("hits", F.lit(expected).cast("long").alias("expected"), (F.col("hits") / F.lit(max(expected, 1))).alias("recall"))


def self_hit_rate(results: DataFrame, n_queries: int) -> DataFrame:
    """Share of all queries whose own record (id = qid) is among their results."""
    return results.where("id = qid").agg(F.countDistinct("qid").alias("hits")).select("hits", (F.col("hits") / F.lit(max(n_queries, 1))).alias("rate"))


def sample_size(queries: int, n: int) -> int:
    return min(queries, n, n if n <= 2000 else 100)


def seed_of(job: str) -> int:
    """The seed of a job's vectors: the 32-bit FNV-1a fold over the first UTF-16 unit of each character of its id."""
    seed = OFFSET_32
    for c in job:
        unit = int.from_bytes(c.encode("utf-16-le", "surrogatepass")[:2], "little")
        seed = (seed ^ unit) * PRIME_32 & MASK
    return seed


def gate(metrics: dict[str, float], recall: float = 0.95, ingest: float = 2000.0, p99: float = 8.0) -> dict[str, bool]:
    """What a run must reach: recall, records a second, milliseconds at the 99th percentile, no errors."""
    return {"recall": metrics["recall"] >= recall, "ingest": metrics["vectors_per_second"] >= ingest, "p99": metrics["p99_millis"] <= p99, "errors": metrics["errors"] == 0}


def stress(engine, dimensions: int = 64, metric: str = "cosine", vectors: int | None = None, queries: int | None = None, top_k: int | None = None, seed: int = 1, timed: int = 32, concurrency: int = 8, job: str | None = None) -> dict[str, float]:
    """Loads a collection of its own with clustered vectors, searches stored ones in one job, and drops it.

    Recall compares the search (float distances of the log's records) with the ground truth over the generated ones.
    queries_per_second is that of one job for all queries. Latencies are those of `timed` searches made one by one, each a job
    of its own, by `concurrency` callers at a time; errors are those that failed. A job's id, if given, is the seed.
    """
    seed = seed if job is None else seed_of(job)
    n, asked, k = bounded("vectors", vectors), bounded("queries", queries), bounded("top_k", top_k)
    name = f"stress_{uuid.uuid4().hex}"
    engine.create(name, dimensions, metric)
    try:
        data = seeded_vectors(engine.spark, n, dimensions, seed)
        own = engine.collection(name)
        began = time.perf_counter()
        ack = own.upsert(data.select(F.col("id").cast("int").alias("ord"), "id", "generation", "vector", F.to_json(F.struct("cluster")).alias("payload")))
        loaded = time.perf_counter() - began
        query = data.where(F.col("id") <= min(asked, n)).select(F.col("id").alias("qid"), "vector")
        began = time.perf_counter()
        found = own.search_many(query, k).collect()
        took = time.perf_counter() - began
        result = engine.spark.createDataFrame([(r.qid, r.id) for r in found], "qid long, id long")
        some = sample_size(asked, n)
        truth = ground_truth(query.where(F.col("qid") <= some), data.select("id", "vector"), metric, k)
        recall = recall_at_k(result.where(F.col("qid") <= some), truth, some, n, k).first()
        hit = self_hit_rate(result, min(asked, n)).first()
        records = own.live().select("id", "vector").persist()
        try:
            records.count()
            some_queries = query.where(F.col("qid") <= timed).collect()  # at most `timed` rows

            def one(row) -> float | None:
                start = time.perf_counter()
                try:
                    near(records, row.vector, dimensions, metric, k).collect()
                except Exception:  # noqa: BLE001  a failed search is counted, whatever failed
                    return None
                return 1000 * (time.perf_counter() - start)

            with ThreadPoolExecutor(concurrency) as callers:
                each = list(callers.map(one, some_queries))
        finally:
            records.unpersist()
        fine = sorted(t for t in each if t is not None)
        place = lambda q: fine[math.ceil(len(fine) * q) - 1] if fine else 0.0
        return {"vectors": ack["applied"], "vectors_per_second": ack["applied"] / loaded, "queries_per_second": min(asked, n) / took, "recall": recall.recall, "self_hit": hit.rate, "p50_millis": place(0.5), "p95_millis": place(0.95), "p99_millis": place(0.99), "timed": len(each), "errors": len(each) - len(fine)}
    finally:
        engine.drop(name)
