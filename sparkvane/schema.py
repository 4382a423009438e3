"""Row types of records, logs, catalogs and routing tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAYLOAD = T.VariantType()
RECORD = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("generation", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType()),
])
UPSERT, DELETE = 1, 2
LOG = "lsn long, op int, id long, generation long, vector array<float>, payload string"
CATALOG = "name string, dimensions int, metric string, hnsw_m int, ef_construction int"
ACK = "collection string, idempotency_key string, committed_index long, applied long, errors array<string>"
METRIC_CODES = {"cosine": 1, "l2": 2, "dot": 3}
