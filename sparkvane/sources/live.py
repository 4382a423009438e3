"""Replay of a log as a query: the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, UPSERT


def live_view(log: DataFrame) -> DataFrame:
    """lsn and record of every live key of a log (lsn, op, id, generation, …).

    The last upsert of a key stands unless a later delete has its generation or a higher one.
    Upserts are reduced by partial aggregates; deletes meet the one upsert of their key in an inner
    join, so a key with very many deletes can be split, and only the dead keys are taken away.
    """
    body = [c for c in log.columns if c not in ("op", "id")]
    puts = log.where(F.col("op") == UPSERT).groupBy("id").agg(F.max_by(F.struct(*body), "lsn").alias("r")).select("id", "r.*")
    gone = log.where(F.col("op") == DELETE).select("id", F.col("lsn").alias("dead_lsn"), F.col("generation").alias("dead_generation"))
    dead = gone.join(puts.select("id", "lsn", "generation"), "id").where("dead_lsn > lsn and dead_generation >= generation").select("id").distinct()
    return puts.join(dead, "id", "left_anti")


def stored_generations(log: DataFrame) -> DataFrame:
    return live_view(log).select("id", "generation")


def next_lsn(log: DataFrame) -> int:
    return (log.agg(F.max("lsn")).first()[0] or 0) + 1
