"""Vectors as little-endian 32-bit floats, and a synthetic source of clustered unit vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_fp32(vector: Column, dimensions: int) -> Column:
    """Bytes of a vector; another length, a null or a non-finite component is an error."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            a = np.array([np.nan if x is None else x for x in v], "<f4")
            if len(a) != dimensions or not np.isfinite(a).all():
                raise ValueError(f"a vector must have {dimensions} finite components")
            return a.tobytes()

        return vectors.map(one)

    return encode(vector)


def decode_fp32(raw: Column, dimensions: int) -> Column:
    """The vector of bytes, whose number must be four for each dimension."""

    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            a = np.frombuffer(b, "<f4") if len(b) == 4 * dimensions else None
            if a is None or not np.isfinite(a).all():
                raise ValueError(f"bytes must hold {dimensions} finite components")
            return a

        return values.map(one)

    return decode(raw)


def seeded_block(dimensions: int, seeds: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Unit vectors of a linear congruential generator, one for each (seed, cluster)."""
    state = (seeds.astype(np.uint64) ^ ((clusters.astype(np.uint64) + 1) * 0x9E3779B1)) & 0xFFFFFFFF
    out = np.empty((len(seeds), dimensions))
    for i in range(dimensions):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[:, i] = np.where(clusters % 16 == i % 16, 0.8, 0.0) + (state / 0xFFFFFFFF - 0.5) * 0.35
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm == 0, 1, norm)[:, None]


def seeded_vectors(spark: SparkSession, n: int, dimensions: int, seed: int, base: int = 0, clusters: int = 16) -> DataFrame:
    """id, generation, vector, cluster: row i has seed + i + 1 and cluster i mod `clusters`."""

    def make(batches):
        for batch in batches:
            i = batch["id"].to_numpy()
            body = seeded_block(dimensions, (seed + i + 1) & 0xFFFFFFFF, i % clusters).astype("f4")
            yield pd.DataFrame({"id": base + i + 1, "generation": np.ones(len(i), "i8"), "vector": list(body), "cluster": (i % clusters).astype("i4")})

    return spark.range(n).mapInPandas(make, "id long, generation long, vector array<float>, cluster int")
