"""Uploaded records from JSON and CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..limits import UPLOAD_RECORDS

RECORD = "id long, generation long, text string, vector array<double>, payload map<string,string>"
RESERVED = ("id", "generation", "text", "vector")


def _numbered(df: DataFrame) -> DataFrame:
    """ord from 0 in the order of the file; an upload has at most 20,000 records, so one task numbers it."""
    n = df.count()
    if not 1 <= n <= UPLOAD_RECORDS:
        raise ValueError(f"an upload has 1 to {UPLOAD_RECORDS} records")
    ordered = df.withColumn("at", F.monotonically_increasing_id())
    return ordered.withColumn("ord", (F.row_number().over(Window.orderBy("at")) - 1).cast("int")).drop("at")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """ord and record of a JSON array, or of an object whose `records` is one; payload as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    body = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.records")).otherwise(F.col("v"))
    one = whole.select(F.explode(F.from_json(body, "array<string>")).alias("r"))
    parsed = one.select(F.from_json("r", "id long, generation long, text string, vector array<double>").alias("x"), F.get_json_object("r", "$.payload").alias("payload"))
    return _numbered(parsed.select("x.*", "payload"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """ord and record of a CSV file with a header: columns that aren't reserved make the payload.

    A vector is a JSON array or numbers between semicolons or spaces. Each row needs a text or a vector, and an id
    column without a value is an error.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    filled = [c for c in rows.columns if c]
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in filled]))
    given = {c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string") for c in RESERVED}
    vector = F.when(given["vector"].startswith("["), F.from_json(given["vector"], "array<double>")).otherwise(F.transform(F.split(given["vector"], r"[;\s]+"), lambda x: x.cast("double")))
    bad_id = F.lit(False) if "id" not in rows.columns else ~F.coalesce(given["id"].rlike(r"^[1-9][0-9]*$"), F.lit(False))
    empty = (F.coalesce(given["text"], F.lit("")) == "") & given["vector"].isNull()
    others = [c for c in filled if c not in RESERVED]
    payload = F.to_json(F.create_map(*[x for c in others for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))])) if others else F.lit(None).cast("string")
    out = rows.select(
        F.when(bad_id, F.raise_error(F.lit("id must be a positive number")).cast("long")).otherwise(given["id"].cast("long")).alias("id"), given["generation"].cast("long").alias("generation"),
        F.when(empty, F.raise_error(F.lit("a row needs a text or a vector")).cast("string")).otherwise(given["text"]).alias("text"), vector.alias("vector"), payload.alias("payload"),
    )
    return _numbered(out)
