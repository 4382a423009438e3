"""Argument checks with their defaults and bounds, and the errors of the public API."""

from __future__ import annotations

import re

from .functions.formats import NAME


class NotFound(KeyError):
    """A collection, record or job that doesn't exist."""


class Conflict(ValueError):
    """A name that is taken."""


class StaleGeneration(ValueError):
    """An upsert that isn't newer than what is stored, or a delete of another generation."""


#: (default, least, most) of each bounded argument.
BOUNDS = {
    "dimensions": (128, 1, 65_536), "hnsw_m": (32, 2, 128), "ef_construction": (200, 4, 2_000),
    "top_k": (10, 1, 100), "rerank_candidates": (100, 1, 5_000), "timeout_millis": (2_000, 1, 30_000),
    "vectors": (1_000, 1, 20_000), "queries": (200, 1, 5_000), "concurrency": (8, 1, 64),
}
UPLOAD_RECORDS, UPLOAD_CHUNK = 20_000, 256


def bounded(name: str, value: object = None, least: int | None = None, most: int | None = None, default: int | None = None) -> int:
    """The whole number given, or the default; out of bounds is an error."""
    base, low, high = BOUNDS.get(name, (default, least, most))
    low, high = low if least is None else least, high if most is None else most
    if value is None:
        value = base if default is None else default
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def search_arguments(top_k: int | None = None, ef_search: int | None = None, rerank_candidates: int | None = None, timeout_millis: int | None = None) -> dict[str, int]:
    """ef_search and rerank_candidates are at least top_k; exact search needs neither."""
    k = bounded("top_k", top_k)
    return {
        "top_k": k, "ef_search": bounded("ef_search", ef_search, k, 2_000, max(96, k)),
        "rerank_candidates": bounded("rerank_candidates", rerank_candidates, k, 5_000, max(100, k)), "timeout_millis": bounded("timeout_millis", timeout_millis),
    }


def collection_name(name: str) -> str:
    if not re.match(NAME, name or "") or name.endswith("\n"):
        raise ValueError("a collection's name has 1 to 128 letters, digits, - or _")
    return name
