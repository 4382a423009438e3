"""What the operators share: picking columns, staged tables in the shared folder, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: In staged writes, Arrow batches hold about so many bytes at most. Texts differ in size by orders
#: of magnitude, so a bound on rows alone (10,000 by default) says little about a task's memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def staged_settings(spark: SparkSession) -> Iterator[None]:
    """Bounded Arrow batches, and shuffle files that go when a job is done; the caller's settings come back after."""
    old = {key: spark.conf.get(key, None) for key in (_BATCH, _CLEANUP)}
    number, unit = re.fullmatch(r"(-?[0-9]+)([kmgtpb]*)", (old[_BATCH] or "64m").lower()).groups()
    held = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit[:1], 0)
    try:
        if not 0 < held <= BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name; other columns may clash in any way."""
    at = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(at, names, strict=True)])


def text_key() -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64("text").alias("text_key")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where it is unset and Spark is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkvane-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Stage:
    """Written tables of one run: they cut lineage, and what they replace can be freed."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.top = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        with staged_settings(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            self.held = [h for h in self.held if h[0] is not table]

    def only(self, *tables: DataFrame) -> None:
        """Deletes all staged tables but these, which the result reads."""
        self.drop(*[t for t, _ in self.held if not any(t is k for k in tables)])
