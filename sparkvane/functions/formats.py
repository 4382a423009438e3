"""Numbers, sizes and names as shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^[A-Za-z0-9_-]{1,128}$"


def format_number(value: Column) -> Column:
    return F.format_number(value, 0)


UNITS = {"KiB": 1024, "MiB": 1024**2, "GiB": 1024**3}


def format_bytes(value: Column, unit: str | None = None) -> Column:
    """B, KiB, MiB or GiB by size; one digit after the point from KiB on. A given unit holds for all sizes, and its halves go to the even digit."""
    amount = value.cast("double")
    if unit is not None:
        return F.concat(F.format_string("%.1f", F.bround(amount / float(UNITS[unit]), 1)), F.lit(f" {unit}"))
    sized = lambda unit: F.concat(F.format_string("%.1f", amount / float(UNITS[unit])), F.lit(f" {unit}"))
    return F.when(amount < 1024, F.concat(value.cast("long").cast("string"), F.lit(" B"))).when(amount < 1024**2, sized("KiB")).when(amount < 1024**3, sized("MiB")).otherwise(sized("GiB"))


def positive_uint64(text: Column) -> Column:
    """The number of a text of digits from 1 to 2^64 - 1 as decimal(20, 0), else null."""
    number = text.try_cast("decimal(20,0)")
    return F.when(text.rlike(r"^[0-9]{1,20}$") & (number >= 1) & (number <= F.lit("18446744073709551615").cast("decimal(20,0)")), number)


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))
