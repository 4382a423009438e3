"""Scalar quantisation of vectors to eight bits for each dimension, and search in two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import distance, dot_product, squared_norm

EPSILON = 1.1920928955078125e-07  # of 32-bit floats: a fixed value


def train(records: DataFrame) -> DataFrame:
    """One row: arrays low and scale over dimensions, where a range up to EPSILON has scale 1."""
    sides = records.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    scaled = sides.withColumn("scale", F.when(F.col("high") - F.col("low") > EPSILON, (F.col("high") - F.col("low")) / 255).otherwise(1.0))
    row = scaled.agg(F.sort_array(F.collect_list(F.struct("pos", "low", "scale"))).alias("s"))
    return row.select(F.col("s.low").alias("low"), F.col("s.scale").alias("scale"))


def encode(vector: Column, low: Column, scale: Column) -> Column:
    """Codes 0..255, rounded half away from zero."""
    steps = F.zip_with(F.zip_with(vector, low, lambda x, m: x.cast("double") - m), scale, lambda d, s: d / s)
    return F.transform(steps, lambda t: F.greatest(F.least(F.signum(t) * F.floor(F.abs(t) + 0.5), F.lit(255.0)), F.lit(0.0)).cast("int"))


def decode(code: Column, low: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(code, scale, lambda c, s: c * s), low, lambda d, m: d + m)


def seal(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Model and codes of an immutable snapshot, written below a path and read back."""
    spark = records.sparkSession
    train(records).write.parquet(f"{path}/model")
    model = spark.read.parquet(f"{path}/model")
    records.crossJoin(F.broadcast(model)).select("id", encode(F.col("vector"), F.col("low"), F.col("scale")).alias("code")).write.parquet(f"{path}/codes")
    return model, spark.read.parquet(f"{path}/codes")


def approximate_distance(query: Column, code: Column, low: Column, scale: Column, metric: str) -> Column:
    """Distance to the decoded vector; by cosine, a zero vector is infinitely far."""
    body = decode(code, low, scale)
    if metric != "cosine":
        return distance(query, body, metric)
    norms = squared_norm(query) * squared_norm(body)
    return F.when(norms > 0, 1 - dot_product(query, body) / F.sqrt(norms)).otherwise(F.lit(float("inf")))


def two_stage(records: DataFrame, codes: DataFrame, model: DataFrame, query: Column, metric: str, k: int, ef: int) -> DataFrame:
    """id, distance: the k nearest of the `ef` candidates that are nearest by code, ranked exactly."""
    near = codes.crossJoin(F.broadcast(model)).select("id", approximate_distance(query, F.col("code"), F.col("low"), F.col("scale"), metric).alias("rough")).orderBy("rough", "id").limit(max(k, ef))
    return records.join(F.broadcast(near.select("id")), "id").select("id", distance(F.col("vector"), query, metric).alias("distance")).orderBy("distance", "id").limit(k)
