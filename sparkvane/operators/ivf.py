"""An optional inverted-file index: records by nearest centroid; a query visits its nearest cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import batch_top_k


def train(records: DataFrame, cells: int = 64, sample_rows: int = 50_000, seed: int = 7) -> np.ndarray:
    """Centroids, fitted on at most about `sample_rows` records; all records are indexed all the same."""
    n = records.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = records.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    model = KMeans(k=min(cells, max(2, n)), seed=seed, maxIter=10).fit(drawn.select(array_to_vector(F.col("vector")).alias("features")))
    return np.array(model.clusterCenters())


def _nearest(df: DataFrame, key: str, centroids: np.ndarray, n: int) -> DataFrame:
    """key, vector, cell: the n nearest cells of each row."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # cells x dimensions: a bound by parameters

    def run(batches):
        c = shared.value
        for batch in batches:
            v = np.stack([np.asarray(x, float) for x in batch["vector"].to_pylist()]) if batch.num_rows else np.zeros((0, c.shape[1]))
            d = (v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)[None, :]
            best = np.argsort(d, 1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(batch.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows)), batch["vector"].take(pa.array(rows)), pa.array(best.ravel().astype("i4"))], names=[key, "vector", "cell"])

    return df.select(key, "vector").mapInArrow(run, f"{key} long, vector array<float>, cell int")


def assign(records: DataFrame, centroids: np.ndarray) -> DataFrame:
    return _nearest(records, "id", centroids, 1)


def search(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, metric: str, k: int = 10, nprobe: int = 8) -> DataFrame:
    """qid, rank, id, distance over the `nprobe` cells nearest to each query; exact within them."""
    return batch_top_k(_nearest(queries, "qid", centroids, nprobe), assigned, metric, k, by="cell")
