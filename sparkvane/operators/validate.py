"""What a record must be before it is logged, and defaults of uploaded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import squared_norm
from ..functions.text import embed_text

TYPES = ("STRING", "BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "INT", "SMALLINT", "TINYINT", "FLOAT")


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def record_error(dimensions: int, metric: str, id_: str = "id", generation: str = "generation", vector: str = "vector") -> Column:
    """The first rule that a record breaks, or null."""
    v = F.col(vector)
    error = (
        F.when(~F.coalesce(F.col(id_) > 0, F.lit(False)), "id")
        .when(~F.coalesce(F.col(generation) > 0, F.lit(False)), "generation")
        .when(~F.coalesce(F.size(v) == dimensions, F.lit(False)), "dimension")
        .when(~finite(v), "finite")
    )
    return error.when(~(squared_norm(v) > 0), "zero") if metric == "cosine" else error


def members(payload: Column) -> Column:
    """A payload's members with their types: a map of variants; null where it isn't the JSON text of an object."""
    value = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>"))


def payload_error(payload: Column) -> Column:
    """Whether a payload (JSON text of an object) has an empty key or a value that isn't a text, a number or a truth value."""
    held = members(payload)
    nested = F.exists(F.map_values(held), lambda v: v.isNull() | F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|VOID)"))
    return F.when(payload.isNull(), F.lit(None).cast("string")).when(held.isNull(), "object").when(F.array_contains(F.map_keys(held), ""), "key").when(nested, "value")


def row_numbers(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """With `name`, each row's number from 1 in the order of (bucket, order), without sorting all rows in one task.

    Rows are numbered inside their buckets and shifted by the sizes of those before; only a row
    for each bucket meets in one place. Null buckets come first.
    """
    held = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(2**62))))
    sizes = held.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return held.withColumn("_in", inside).join(shifts, "_bucket").withColumn(name, F.col("_in") + F.col("_before")).drop("_bucket", "_in", "_before")


def staged_generations(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch (ord, id, generation, …) with `previous`: the generation that each record must exceed.

    It is that of the id's last earlier occurrence in the batch, else the stored one, else null.
    """
    earlier = F.lag("generation").over(Window.partitionBy("id").orderBy("ord"))
    return batch.join(stored.select("id", F.col("generation").alias("stored_generation")), "id", "left").withColumn("previous", F.coalesce(earlier, "stored_generation")).drop("stored_generation")


def batch_errors(batch: DataFrame, stored: DataFrame, dimensions: int, metric: str) -> DataFrame:
    """ord, id, error of every record that keeps the batch from being applied."""
    staged = staged_generations(batch.withColumn("error", record_error(dimensions, metric)), stored)
    stale = F.when(F.col("previous").isNotNull() & (F.col("generation") <= F.col("previous")), "stale")
    return staged.select("ord", "id", F.coalesce("error", stale).alias("error")).where("error is not null")


def with_defaults(uploads: DataFrame, dimensions: int, now_millis: int) -> DataFrame:
    """Records of uploads (ord, id, generation, text, vector, payload): missing parts are filled in.

    The id is now_millis * 1000 + ord, the generation 1, the vector the text's embedding, and a
    non-empty text is the payload's `text`. Other members of the payload keep their types.
    """
    texts = uploads.where("vector is null and text is not null").select("ord", "text")
    embedded = embed_text(texts, "ord", "text", dimensions).withColumnRenamed("vector", "embedded")
    told = members(F.to_json(F.struct("text")))
    given = F.coalesce(members(F.col("payload")), members(F.lit("{}")))
    plain = F.when(F.length("text") > 0, F.to_json(F.map_concat(told, F.map_filter(given, lambda k, _: k != "text")))).otherwise(F.col("payload"))
    return uploads.join(embedded, "ord", "left").select(
        "ord", F.coalesce("id", F.lit(now_millis * 1000) + F.col("ord")).alias("id"), F.coalesce("generation", F.lit(1)).cast("long").alias("generation"),
        F.coalesce(F.col("vector").cast("array<float>"), "embedded").alias("vector"), plain.alias("payload"),
    )


def chunked(uploads: DataFrame, size: int = 256) -> DataFrame:
    """With `sequence`, the number from 1 of the chunk that a record's ord falls into."""
    return uploads.withColumn("sequence", F.floor(F.col("ord") / size) + 1)
