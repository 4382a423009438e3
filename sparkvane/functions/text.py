"""Deterministic feature-hash embeddings of text: as built-in functions, and as a numpy kernel over Arrow batches."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import MASK, OFFSET_32, PRIME_32, fnv32

MAX_DIMENSIONS = 65_536


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def features(words: Column) -> Column:
    """Words, pairs of neighbours joined by ::, and three-character parts after #."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit("::"), b))).otherwise(F.array().cast("array<string>"))
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    parts = F.flatten(F.transform(long_words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("#"), F.substring(w, i, F.lit(3))))))
    return F.concat(words, pairs, parts)


def embed_slots(df: DataFrame, key: str, text: str, dimensions: int, fold: bool = True) -> DataFrame:
    """key, slot, value: the non-zero components of each text's unit vector.

    `fold` applies compatibility normalisation in an Arrow function; leave it out where texts are
    known not to change by it, and the plan has built-in functions alone. Texts without a word or
    whose features cancel out have no rows. Three-character parts are cut by code points here; `embed_text` cuts
    them by UTF-16 code units, so that words with letters beyond the basic plane have other parts there.
    """
    if not 1 <= dimensions <= MAX_DIMENSIONS:
        raise ValueError(f"dimensions must be between 1 and {MAX_DIMENSIONS}")
    lowered = F.lower(F.col(text))
    words = df.select(F.col(key).alias(key), tokens(nfkc(lowered) if fold else lowered).alias("words"))
    hashed = words.select(key, F.explode(features(F.col("words"))).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("times")).withColumn("h", fnv32(F.col("feature")))
    sign = F.when(F.col("h") >= F.lit(2**31), -F.col("times")).otherwise(F.col("times"))
    weight = hashed.groupBy(key, (F.col("h") % dimensions).cast("int").alias("slot")).agg(F.sum(sign).alias("w")).where("w <> 0")
    norm = weight.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weight.join(norm, key).select(key, "slot", (F.col("w") / F.col("norm")).alias("value"))


PIECE = 1 << 16  # code units, or words, that are hashed at once
FEW = 48  # so few rows are hashed one by one to their ends
BLOCK_UNITS = 1 << 20  # texts are taken together up to about so many code units
_OFFSET, _PRIME = np.uint32(OFFSET_32), np.uint32(PRIME_32)


@functools.cache
def _letters() -> np.ndarray:
    """Which code units of the basic plane are letters or numbers."""
    return np.fromiter((chr(i).isalnum() for i in range(0x10000)), bool, 0x10000)


def _word_units(units: np.ndarray) -> np.ndarray:
    """Which UTF-16 code units belong to words; both surrogates of a letter beyond the basic plane do."""
    inside = _letters()[units]
    high = np.flatnonzero((units[:-1] & 0xFC00) == 0xD800)
    high = high[(units[high + 1] & 0xFC00) == 0xDC00]
    if len(high):
        points = ((units[high].astype("i4") & 0x3FF) << 10) + (units[high + 1] & 0x3FF) + 0x10000
        distinct, place = np.unique(points, return_inverse=True)
        inside[high] = inside[high + 1] = np.array([chr(p).isalnum() for p in distinct.tolist()])[place]
    return inside


def _mix(state: np.ndarray, units: np.ndarray | int) -> np.ndarray:
    return (state ^ units) * _PRIME


def _steps(state: np.ndarray, units: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash states after the `length` units from `start` of each row."""
    key = -length if length.max(initial=0) > 0xFFFF else (0xFFFF - length).astype("u2")  # of two bytes: a radix sort
    order = np.argsort(key, kind="stable")
    state, at, size = state[order], start[order], length[order]
    more, k = np.searchsorted(-size, 0, "left"), 0
    while more > FEW:
        state[:more] = _mix(state[:more], units[at[:more] + k].astype(np.uint32))
        k += 1
        more = np.searchsorted(-size, -k, "left")
    for row in range(more):  # what is left of a few long ones: numpy's calls would cost more than plain arithmetic
        h = int(state[row])
        for low in range(int(at[row]) + k, int(at[row] + size[row]), PIECE):
            for unit in units[low : min(low + PIECE, int(at[row] + size[row]))].tolist():
                h = ((h ^ unit) * PRIME_32) & MASK
        state[row] = h
    out = np.empty_like(state)
    out[order] = state
    return out


def _units(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), "<u2")


def _code_units(word: str) -> str:
    """The word with letters beyond the basic plane as their two surrogates."""
    return word if word.isascii() or max(word) < "\U00010000" else "".join(map(chr, np.frombuffer(word.encode("utf-16-le"), "<u2").tolist()))


def _hash_words(words: list[str]) -> np.ndarray:
    length = np.array([len(_units([w])) for w in words], np.int64)
    return _steps(np.full(len(words), _OFFSET), _units(words), np.cumsum(length) - length, length)


def _add_features(grid: np.ndarray, texts: list[str]) -> None:
    """Adds the signs of all features of folded texts to the rows of `grid`."""
    dimensions = np.uint32(grid.shape[1])
    flat = grid.reshape(-1)
    size = np.array([len(t) if t.isascii() else len(_units([t])) for t in texts], np.int64)
    units = _units([t + "\n" for t in texts])
    end = np.cumsum(size + 1)
    inside = _word_units(units)
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # the last unit isn't a word's: starts and ends alternate
    start, length = edge[::2], edge[1::2] - edge[::2]

    def add(doc: np.ndarray, h: np.ndarray) -> None:
        low, high = int(doc[0]), int(doc[-1]) + 1  # places are in the order of texts
        place = (doc - low) * int(dimensions) + (h % dimensions)
        sign = 1.0 - 2.0 * (h >> np.uint32(31))
        flat[low * int(dimensions) : high * int(dimensions)] += np.bincount(place, sign, (high - low) * int(dimensions))

    last = None  # the state and text of the word before
    for at in range(0, len(start), PIECE):
        first, n = start[at : at + PIECE], length[at : at + PIECE]
        doc = np.searchsorted(end, first, "right")
        state = _steps(np.full(len(first), _OFFSET), units, first, n)
        add(doc, state)
        before = np.concatenate([[_OFFSET if last is None else last[0]], state[:-1]]).astype(np.uint32)
        near = np.flatnonzero(doc == np.concatenate([[-1 if last is None else last[1]], doc[:-1]]))
        last = state[-1], doc[-1]
        if len(near):
            add(doc[near], _steps(_mix(_mix(before[near], np.uint32(ord(":"))), np.uint32(ord(":"))), units, first[near], n[near]))
    hashed = np.uint32(((OFFSET_32 ^ ord("#")) * PRIME_32) & MASK)
    for at in range(0, len(units) - 2, PIECE):
        here, word = units[at : at + PIECE + 2].astype(np.uint32), inside[at : at + PIECE + 2]
        three = np.flatnonzero(word[:-2] & word[1:-1] & word[2:])
        if len(three):
            state = _mix(_mix(_mix(hashed, here[:-2]), here[1:-1]), here[2:])[three]
            add(np.searchsorted(end, three + at, "right"), state)


def embed_block(texts: list[str], dimensions: int, dtype: str = "f4") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and which have one."""
    out = np.zeros((len(texts), dimensions))
    some, held = [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        some.append(t if t.isascii() else unicodedata.normalize("NFKC", t))
        held += len(t)
        if held >= BLOCK_UNITS or i + 1 == len(texts):
            _add_features(out[i + 1 - len(some) : i + 1], some)
            some, held = [], 0
    norm = np.sqrt((out * out).sum(1))
    return (out / np.where(norm == 0, 1, norm)[:, None]).astype(dtype), norm > 0


def embed_text(df: DataFrame, key: str, text: str, dimensions: int, double: bool = False) -> DataFrame:
    """key, vector (array of floats, or doubles) of each text that has one, by numpy over Arrow batches; no shuffle.

    The values are those of embed_slots, but for words with letters beyond the basic plane.
    """
    if not 1 <= dimensions <= MAX_DIMENSIONS:
        raise ValueError(f"dimensions must be between 1 and {MAX_DIMENSIONS}")

    def run(batches):
        for batch in batches:
            rows = max(1, min(500, 4_000_000 // dimensions))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                body, ok = embed_block(part["text"].to_pylist(), dimensions, "f8" if double else "f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(body) + 1, dtype="i4") * dimensions), pa.array(body.ravel()))
                yield pa.RecordBatch.from_arrays([part["key"].filter(pa.array(ok)), vectors.filter(pa.array(ok))], names=[key, "vector"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, vector array<{'double' if double else 'float'}>")
