"""Chroma audio fingerprints and their alignment.

A recording's spectrum is folded to twelve pitch classes a frame. Filters compare sums of
rectangles of this image, read from an integral image; each gives two bits, and sixteen of
them a packed 32-bit integer for each frame. Two recordings align at offsets where integers
are equal or one bit apart: a histogram of offsets shows which have several, and bit errors over the
whole overlap decide between them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, pick
from .kernel import span_places

RATE, FRAME, HOP = 4000, 512, 256
WIDTH = 16
#: Filters by rule: shape i % 6, first pitch class, height and width.
FILTERS = tuple((i % 6, (5 * i) % 12 % (12 - h + 1), h, w) for i, (h, w) in enumerate((h, w) for w in (4, 8, 12, 16) for h in (2, 4, 6, 12)))
STEP = 0.15


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to a sum of one."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.arange(power.shape[1]) * RATE / FRAME
    heard = (hertz >= 100) & (hertz <= 1900)
    pitch = np.rint(12 * np.log2(hertz[heard] / 440.0)).astype(int) % 12
    image = power[:, heard] @ np.eye(12)[pitch]
    return image / np.maximum(image.sum(1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has `WIDTH` frames from it on; none for shorter recordings."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0, x1, y0, y1):
        return whole[at + x1, y1] - whole[at + x0, y1] - whole[at + x1, y0] + whole[at + x0, y0]

    code = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        full, hw, hh = area(0, w, y, y + h), w // 2, h // 2
        if shape == 0:
            part = area(0, w, y, y + hh)
        elif shape == 1:
            part = area(0, hw, y, y + h)
        elif shape == 2:
            part = area(0, hw, y, y + hh) + area(hw, w, y + hh, y + h)
        elif shape == 3:
            part = area(0, w, y + h // 3, y + max(h // 3 + 1, 2 * h // 3))
        elif shape == 4:
            part = area(w // 4, 3 * w // 4, y, y + h)
        else:
            part = area(0, hw, y + hh, y + h) + area(hw, w, y, y + hh)
        value = np.log((1.0 + part) / (1.0 + np.maximum(full - part, 0.0)))
        level = np.searchsorted([-STEP, 0.0, STEP], np.round(value, 9))
        code = (code << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return code


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Different bits, and integers compared, with b's start at a's `offset`."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()), hi - lo


def fingerprints(media: DataFrame) -> DataFrame:
    """rec_id, code (little-endian 32-bit integers) from rec_id, pcm (signed 16-bit samples at `RATE`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(np.frombuffer((v := p.as_py() or b"")[: len(v) // 2 * 2], "<i2").astype(float)).astype("<u4").tobytes() for p in batch["pcm"]]
            yield pa.RecordBatch.from_arrays([batch["rec_id"], pa.array(codes, pa.binary())], names=["rec_id", "code"])

    return pick(media, "rec_id", "pcm").mapInArrow(run, "rec_id long, code binary")


def _runs(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of equal integers begin: the integer, its recording, its place and the run's length."""
    each = [np.frombuffer(c, "<u4") for c in codes]
    size = np.array([len(c) for c in each], np.int64)
    word, owner = np.concatenate([*each, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(each)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    first = np.flatnonzero((at == 0) | np.append(True, word[1:] != word[:-1])[: len(word)])
    return word[first], owner[first], at[first], np.diff(np.append(first, len(word)))


class Lookup:
    """Queries' integers and those one bit away, in order."""

    def __init__(self, names: list[int], codes: list[bytes]) -> None:
        self.names, self.codes = np.array(names, np.int64), [np.frombuffer(c, "<u4") for c in codes]
        word, self.owner, self.at, self.run = _runs(codes)
        near = np.concatenate([word, *(word ^ np.uint32(1 << b) for b in range(32))])
        order = np.argsort(near, kind="stable")
        self.word, self.place = near[order], (order % max(len(word), 1)).astype(np.int32)

    def aligned(self, names: list[int], codes: list[bytes], votes: int, least: int, most_errors: float) -> list[tuple[int, int, int, float]]:
        """(query, class, offset, errors) of linked pairs: the histogram of offsets tells which are verified."""
        word, owner, at, run = _runs(codes)
        low = np.searchsorted(self.word, word)
        count = np.searchsorted(self.word, word, "right") - low
        hit = self.place[span_places(low, count)]
        owner, at, run = (np.repeat(x, count) for x in (owner, at, run))
        other = self.names[self.owner[hit]] != np.array(names, np.int64)[owner]
        hit, owner, at, run = hit[other], owner[other], at[other], run[other]
        key = (self.owner[hit] * len(codes) + owner << 26) + (self.at[hit] - at + (1 << 25))
        bins, where = np.unique(key, return_inverse=True)
        bins = bins[np.bincount(where, np.minimum(self.run[hit], run), len(bins)) >= votes]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for pair, offset in zip((bins >> 26).tolist(), ((bins & (1 << 26) - 1) - (1 << 25)).tolist(), strict=True):
            q, c = divmod(pair, len(codes))
            e, n = bit_errors(self.codes[q], np.frombuffer(codes[c], "<u4"), offset)
            if n >= least and e <= most_errors * 32 * n:
                best[q, c] = min(best.get((q, c), (2.0, 0)), (e / (32 * n), offset))
        return [(int(self.names[q]), names[c], offset, e) for (q, c), (e, offset) in best.items()]


def align(prints: DataFrame, every: int = 20, most_errors: float = 0.1, least: int = 16, votes: int = 2, block_bytes: int = 512 << 10) -> DataFrame:
    """A row for each recording: its class, and for queries (rec_id divisible by `every`) how it aligns with others.

    Recordings with equal fingerprints are one class, named by the smallest rec_id. Blocks of about `block_bytes` of queries
    are broadcast, one after another, and all classes are read against each: a class's integers are looked up among the
    query's and those one bit away. Runs of equal integers are aligned at their starts. Every offset with at least `votes`
    hits is verified: a link
    needs `least` integers of overlap and a share of different bits of at most `most_errors`. With errors spread
    evenly at this share, an integer is hit with chance 0.16, so that 48 of them have two hits in 99 of 100 cases. Of a
    pair's offsets the one with least errors counts (ties: the smallest). n_links counts linked classes, best_id, best_offset and
    best_errors tell the one with least errors (ties: the smaller class); they are null without one, n_links for
    recordings that aren't queries. Null or short recordings have no integers and no links; rows
    with a null rec_id are left out; repeated rows count once; an empty table gives no rows.
    """
    spark, stage = prints.sparkSession, Stage(prints.sparkSession, "chroma")
    own = stage.put(pick(prints, "rec_id", "code").where("rec_id is not null").dropDuplicates())
    classes = stage.put(own.groupBy("code").agg(F.min("rec_id").alias("class_id"), F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked")).where(F.length("code") > 0))
    asked = classes.where("asked = 1").select("class_id", "code")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("code"))).first()[0] or 0) // block_bytes))

    def against(block: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == block).collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(([r.class_id for r in some], [bytes(r.code) for r in some]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(*shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    got = lookup.aligned(part["class_id"].to_pylist(), part["code"].to_pylist(), votes, least, most_errors)
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["query", "class_id", "offset", "errors"])

        return stage.put(classes.select("class_id", "code").mapInArrow(run, "query long, class_id long, offset int, errors double"))

    links = reduce(DataFrame.union, [against(b) for b in range(blocks)])
    told = links.groupBy("query").agg(F.count("*").alias("n_links"), F.min(F.struct("errors", "class_id", "offset")).alias("best")).withColumnRenamed("query", "class_id")
    named = stage.put(classes.select("code", "class_id").join(told, "class_id", "left"))
    stage.only(own, named)
    is_query = F.col("rec_id") % every == 0
    return own.join(named, "code", "left").select(
        "rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), (F.length("code") / 4).cast("long").alias("n_ints"), F.crc32("code").alias("code_crc32"),
        F.when(is_query, F.coalesce("n_links", F.lit(0))).alias("n_links"),
        *(F.when(is_query, F.col(f"best.{a}")).alias(b) for a, b in (("class_id", "best_id"), ("offset", "best_offset"), ("errors", "best_errors"))),
    )


def render(vectors: DataFrame) -> DataFrame:
    """rec_id, pcm: vectors played as tunes, as the tables have no audio of their own.

    Component x gives a note of 256 samples, the 24-tone step of frac(4 * x) above 220 Hz. Null and
    non-finite components are rests; a null vector has no samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(256) / RATE
        notes = np.concatenate([np.zeros((1, 256)), [8000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) for k in range(24)]]).astype("<i2")
        for batch in batches:
            pcm = []
            for v in batch["embedding"]:
                if not v.is_valid:
                    pcm.append(None)
                    continue
                x = np.array([np.nan if c is None else c for c in v.as_py()], float)
                fine = np.isfinite(x)
                step = np.where(fine, np.floor(24 * np.mod(4 * np.where(fine, x, 0), 1)).astype(int) % 24 + 1, 0)
                pcm.append(notes[step].tobytes())
            for at in range(0, len(pcm), 500):
                yield pa.RecordBatch.from_arrays([batch["vec_id"].slice(at, 500), pa.array(pcm[at : at + 500], pa.binary())], names=["rec_id", "pcm"])

    return pick(vectors, "vec_id", "embedding").mapInArrow(run, "rec_id long, pcm binary")
