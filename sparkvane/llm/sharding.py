"""Sharding by sampled splitters, in DataFrame operations alone.

Rows are ordered by a key. A size-weighted sample of an overfull range's keys gives its quantile
boundaries, by which its records are parted; this is repeated, range by range, until none
is overfull. The number of the row is the last part of the key, so hot keys are parted too.
Within and over ranges, running sums of sizes then place each row in the shard that holds its
share of the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, pick

#: An overfull range is parted into fewer than so many at a time, by about so many sampled keys for each.
FAN = 1024
SAMPLE_PER_RANGE = 64
#: Range numbers are of base FAN, a digit for each time of parting: 2^60 ranges.
LEVELS = 6


def _splitters(full: DataFrame, level: int) -> DataFrame:
    """part, bounds (ascending keys) at quantiles of a sample of each range's keys, for rows with the range's weight w and pieces.

    A row is drawn with probability in proportion to its weight, by a hash of its key, so a
    repeated run draws the same rows; a row above the step counts once for each step. A row as heavy
    as a piece has a boundary on either side, so that it ends up alone.
    """
    lot = F.pmod(F.xxhash64("at", F.lit(level)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = full.withColumn("times", F.floor(F.col("weight") * F.col("pieces") * SAMPLE_PER_RANGE / F.col("w") + lot)).where("times > 0")
    inside = Window.partitionBy("part")  # at most about twice FAN * SAMPLE_PER_RANGE rows
    upto = F.sum("times").over(inside.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        drawn.withColumn("upto", upto).withColumn("n", F.sum("times").over(inside))
        .withColumn("slot", F.floor(F.col("upto") * F.col("pieces") / F.col("n")))
        .withColumn("before", F.floor((F.col("upto") - F.col("times")) * F.col("pieces") / F.col("n")))
        .where("slot > before and (slot < pieces or times * pieces >= n)")
    )
    after = F.struct(F.col("at.key").alias("key"), F.col("at.tie").alias("tie"), (F.col("at.row") + 1).alias("row"))
    sides = F.when(F.col("times") * F.col("pieces") >= F.col("n"), F.array(F.col("at"), after)).otherwise(F.array(F.col("at")))
    return picked.select("part", F.explode(sides).alias("bound")).groupBy("part").agg(F.array_sort(F.collect_set("bound")).alias("bounds"))


def _below() -> Column:
    """How many of the row's bounds are at or below its key, by binary search."""

    def move(low: Column, step: Column) -> Column:
        to = low + step
        return F.when((to <= F.size("bounds")) & (F.get("bounds", to - 1) <= F.col("at")), to).otherwise(low)

    steps = F.array(*[F.lit(1 << b) for b in range(FAN.bit_length() - 1, -1, -1)])
    return F.when(F.col("bounds").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), move)).cast("long")


def _ranged(keyed: DataFrame, stage: Stage, target: float) -> DataFrame:
    """The rows with part, the number of a range whose weight is at most twice `target`, or that has one row; parts ascend with keys."""
    placed = keyed.withColumn("part", F.lit(0).cast("long"))
    for level in range(LEVELS):
        sums = stage.put(placed.groupBy("part").agg(F.sum("weight").alias("w"), F.count("*").alias("n")))
        over = sums.where((F.col("w") > 2 * target) & (F.col("n") > 1)).select("part", "w", F.least(F.lit(FAN // 2 - 1), F.ceil(F.col("w") / target)).alias("pieces"))
        if over.isEmpty():
            break
        # the number of overfull ranges is at most the table's weight over twice the target; Spark broadcasts them while they are few
        bounds = stage.put(_splitters(placed.join(over, "part"), level))
        placed = stage.put(placed.join(bounds, "part", "left").withColumn("part", F.col("part") * FAN + _below()).drop("bounds"))
    return placed


def _place(keyed: DataFrame, stage: Stage, shards: int, target_rows: int) -> DataFrame:
    """shard and slot for each row of row, key, tie, size, staged; see `shard_documents`."""
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / max(rows, 1)
    weighted = keyed.select("*", F.struct("key", "tie", "row").alias("at"), (F.col("size") + mean).alias("weight"))
    placed = _ranged(weighted, stage, 2 * total / max(4 * shards, 4 * -(-rows // target_rows)))
    sums = stage.put(placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("part").orderBy("at")
    middle = F.col("b0") + F.col("upto") - F.col("size") / 2
    located = stage.put(
        placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, "part")
        .select(*keyed.columns, F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int").alias("shard"), (F.col("n0") + F.col("nth")).alias("place"))
    )
    stage.only(located)
    first = located.groupBy("shard").agg(F.min("place").alias("place0"))
    return located.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("place0")).drop("place", "place0")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("tie"), (F.octet_length(text) + 1).cast("long").alias("size"))


def shard_documents(docs: DataFrame, shards: int = 16, target_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row; shards near equal in bytes.

    size is the UTF-8 bytes of the text plus 1 (null: 1, text_crc32 0). The order is by
    hash of the text, then doc_id, so equal texts are neighbours and a group of them is
    cut only where a shard is full. Every shard's bytes are within one document of its
    share. Null doc_ids sort first; repeated rows each have a place. An empty table
    gives no rows.
    """
    stage = Stage(docs.sparkSession, "sharding")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = stage.put(_keyed(pick(docs, "doc_id", "text"), F.monotonically_increasing_id().alias("row"), F.col("doc_id"), crc.alias("text_crc32")))
    return _place(keyed, stage, shards, target_rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, target_rows: int = 200_000) -> None:
    """Writes every row as Parquet, a folder shard=0, 1, ... for each shard, rows in order of their slots, with slot.

    Rows are numbered in a staged copy, so that nulls, repeated rows and repeated doc_ids each are
    written once. Columns keep their names; those that are called shard or slot, or like an earlier column
    but for case, get a number at the end. An empty table writes no rows.
    """
    stage, names = Stage(docs.sparkSession, "shards"), ["shard", "slot", "row"]
    for name in docs.columns:
        free, k = name, 1
        while free.lower() in (n.lower() for n in names):
            k += 1
            free = f"{name}_{k}"
        names.append(free)
    numbered = stage.put(docs.toDF(*names[3:]).withColumn("row", F.monotonically_increasing_id()))
    at = [names[3:][docs.columns.index(c)] for c in ("doc_id", "text")]
    keyed = stage.put(_keyed(numbered.select(F.col(f"`{at[0]}`").alias("doc_id"), F.col(f"`{at[1]}`").alias("text"), "row"), F.col("row")))
    placed = _place(keyed, Stage(docs.sparkSession, "shards"), shards, target_rows).select("row", "shard", "slot")
    (
        numbered.join(placed, "row").drop("row")
        .repartition("shard", F.floor(F.col("slot") / 100_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
    stage.only()
