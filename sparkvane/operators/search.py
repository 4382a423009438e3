"""Exact nearest-neighbour search: one query, batches of queries, scattered shards, text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS, distance
from ..functions.text import embed_text
from ..limits import search_arguments


def check_query(vector: list[float], dimensions: int, metric: str) -> list[float]:
    """The query as floats; a wrong length, a non-finite component or (cosine) a zero vector is an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    v = np.asarray(vector, "f4")
    if v.shape != (dimensions,) or not np.isfinite(v).all():
        raise ValueError(f"a query needs {dimensions} finite components")
    if metric == "cosine" and not float((v.astype(float) ** 2).sum()) > 0:
        raise ValueError("a cosine query must not be a zero vector")
    return [float(x) for x in v]


def top_k(records: DataFrame, query: list[float], dimensions: int, metric: str, k: int | None = None, ef_search: int | None = None) -> DataFrame:
    """rank, id, distance and the records' other columns for the k nearest, ties by id.

    The plan is a projection and TakeOrderedAndProject: each task sends k rows at most.
    """
    k = search_arguments(k, ef_search)["top_k"]
    vector = F.array(*[F.lit(x).cast("float") for x in check_query(query, dimensions, metric)])
    near = records.withColumn("distance", distance(F.col("vector"), vector, metric)).drop("vector").orderBy("distance", "id").limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


TILE_QUERIES, TILE_ROWS = 256, 4_096  # pairs that are scored at once
EXACT_BYTES = 8 << 20  # of vectors whose exact distances are taken at once


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows in doubles; equal rows have equal ones, wherever they lie."""
    if metric == "l2":
        return ((q - x) ** 2).sum(1)
    dots = (q * x).sum(1)
    return -dots if metric == "dot" else 1 - dots / np.sqrt((q * q).sum(1) * (x * x).sum(1))


def _scores(v: np.ndarray, metric: str, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """Factors f and constants c of rows, so that a record is the nearer, the larger f(query) . f(record) - c(record) is; distance = c(query) less that."""
    square = (v * v).sum(1)
    if metric == "cosine":
        if not (square > 0).all():
            raise ValueError("cosine distance needs non-zero vectors")
        return (v / np.sqrt(square)[:, None]).astype("f4"), np.full(len(v), 1.0 if query else 0.0)
    if metric == "dot":
        return v.copy(), np.zeros(len(v))
    return (v.copy(), square) if query else (2 * v, square)


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of rows without k equal rows before them: later copies are in no list of k."""
    words = np.ascontiguousarray(x).view("u8")
    h = np.zeros(len(x), np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    later = np.arange(len(x)) - first[group]
    mixed = np.zeros(len(first), bool)  # one hash, but not one vector: all of these stay
    for at in np.array_split(np.flatnonzero(later > 0), max(1, x.nbytes // EXACT_BYTES)):
        mixed[group[at[(words[order[at]] != words[order[first[group[at]]]]).any(1)]]] = True
    return np.sort(order[(later < k) | mixed[group]])


def _nearest_rows(q: np.ndarray, x: np.ndarray, metric: str, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query place, row place, rounded distance and distance of each query's k nearest rows; ties of rounded ones go to the row that comes first.

    Tiles of pairs are screened by scores with a bound on their error; what may be among the k nearest gets its exact distance.
    Memory is that of both tables and of a tile.
    """
    rows = _first_copies(x, k)
    x = x[rows]
    fx, cx = _scores(x, metric, False)
    longest = np.sqrt(np.einsum("ij,ij->i", fx, fx, dtype=float))
    odd = ~np.isfinite(longest + cx)  # their scores say nothing
    fx[odd], cx[odd], longest[odd] = 0, 0, 0
    unit = float(np.finfo(fx.dtype).eps) * (q.shape[1] + 8)
    pairs = max(1, EXACT_BYTES // (8 * max(1, q.shape[1])))
    out = []
    for top in range(0, len(q), TILE_QUERIES):
        asked = q[top : top + TILE_QUERIES]
        fq, cq = _scores(asked, metric, True)
        size = np.sqrt(np.einsum("ij,ij->i", fq, fq, dtype=float))
        strange = ~np.isfinite(size + cq)
        fq[strange], cq[strange], size[strange] = 0, 0, 0
        best = np.empty((0, 4))  # query, rounded distance, row, distance of what is kept, in this order
        worst = np.full(len(asked), np.inf)  # the k-th distance up to now
        for at in range(0, len(x), TILE_ROWS):
            part, minus = fx[at : at + TILE_ROWS], cx[at : at + TILE_ROWS]
            score = fq @ part.T
            if minus.any():
                score -= minus
            strangers = np.flatnonzero(odd[at : at + TILE_ROWS])
            score[:, strangers] = -np.inf
            slack = unit * (size * longest[at : at + TILE_ROWS].max() + np.abs(minus).max() + np.abs(cq)) + 10.0**-digits
            low = cq - worst - slack
            # scores may have fewer digits than bounds
            above = lambda low: score >= np.nextafter(low.astype(score.dtype), -np.inf, dtype=score.dtype)[:, None]  # noqa: E731, B023
            hit = above(low)
            if len(part) > k and np.count_nonzero(hit) > len(asked):  # k rows of this tile are as near as the k-th best score says
                unknown = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
                if len(unknown):
                    low[unknown] = np.maximum(low[unknown], np.partition(score[unknown], len(part) - k, axis=1)[:, len(part) - k] - 2 * slack[unknown])
                    hit = above(low)
            hit[strange], hit[:, strangers] = True, True
            i, j = np.divmod(np.flatnonzero(hit), len(part))
            del score, hit
            if not len(i):
                continue
            near = np.concatenate([_exact(asked[i[s : s + pairs]], x[at + j[s : s + pairs]], metric) for s in range(0, len(i), pairs)])
            best = np.concatenate([best, np.column_stack([i, np.round(near, digits), at + j, near])])
            best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))]
            count = np.bincount(best[:, 0].astype(int), minlength=len(asked))
            place = np.arange(len(best)) - np.repeat(np.cumsum(count) - count, count)
            worst[best[place == k - 1, 0].astype(int)] = np.nan_to_num(best[place == k - 1, 1], nan=np.inf)
            best = best[place < k]
        out.append(best + np.array([top, 0, 0, 0]))
    found = np.concatenate(out) if out else np.empty((0, 4))
    return found[:, 0].astype(int), rows[found[:, 2].astype(int)], found[:, 1], found[:, 3]


def _grid(queries: int, records: int, width: int, k: int, tasks: int, block_queries: int, cell_bytes: int) -> tuple[int, int]:
    """Blocks of queries and cells of records: at least as many pairs of them as tasks, with the fewest bytes sent.

    A record goes to each block, and a query with its k results to each cell.
    """
    row = 8 * max(1, width)
    few_blocks, few_cells = -(-queries // max(1, min(block_queries, cell_bytes // row))), -(-records * row // cell_bytes)
    blocks = max(1, few_blocks, min(queries, round((tasks * queries * (row + 32 * k) / max(1, records * row)) ** 0.5)))
    cells = max(1, few_cells, min(records, -(-tasks // blocks)))
    return max(blocks, min(queries, -(-tasks // cells))), cells


def batch_top_k(queries: DataFrame, records: DataFrame, metric: str, k: int = 10, cells: int | None = None, block_queries: int = 65_536, by: str | None = None, digits: int = 12, cell_bytes: int = 64 << 20, shape: tuple[int, int] | None = None) -> DataFrame:
    """qid, rank, id, distance: the exact k nearest records of every query (qid, vector), ties by id.

    Blocks of queries meet cells of records, both of bounded size; a cell keeps k rows a
    query, so that what is merged doesn't grow with the records in it. Numpy works on whole Arrow batches.
    With `by`, a column of both tables says which cells meet. The order is that of distances rounded to `digits` places, so
    that equal vectors tie; what is returned isn't rounded. `shape` is the records' number and dimension, where both are known (more will do):
    records that are dear to make are then made once.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = records.sparkSession
    asked_rows = queries.count()
    if cells or by:
        blocks = max(1, -(-asked_rows // block_queries))
    else:
        n, width = shape or records.agg(F.count("*"), F.max(F.size("vector"))).first()
        blocks, cells = _grid(asked_rows, n, width or 0, k, int(spark.conf.get("spark.sql.shuffle.partitions")), block_queries, cell_bytes)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("qid", F.col("vector").alias("v"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), (F.col(by) if by else spread(cells)).alias("cell"))
    there = records.select("id", F.col("vector").alias("v"), (F.col(by) if by else F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")).alias("cell")).withColumn("block", spread(blocks))

    def near(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["qid", "id", "place", "distance"])
        dense = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).astype(float)
        ids, names = x["id"].to_numpy(), q["qid"].to_numpy()
        order = np.argsort(ids, kind="stable")
        which, row, place, distance_ = _nearest_rows(dense(q), dense(x)[order], metric, k, digits)
        return pa.table([pa.array(names[which]), pa.array(ids[order][row]), pa.array(place), pa.array(distance_)], names=["qid", "id", "place", "distance"])

    part = asked.groupBy("cell", "block").cogroup(there.groupBy("cell", "block")).applyInArrow(near, "qid long, id long, place double, distance double")
    order = Window.partitionBy("qid").orderBy("place", "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """rank, id, distance of hits from several shards: the nearest copy of each id, then the k nearest."""
    nearest = hits.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)
    return nearest.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def scatter_gather(records: DataFrame, query: list[float], dimensions: int, metric: str, shards: int, k: int | None = None) -> DataFrame:
    """Top-k of each shard (column `shard`), merged; an id may be in more than one."""
    k = search_arguments(k)["top_k"]
    vector = F.array(*[F.lit(x).cast("float") for x in check_query(query, dimensions, metric)])
    scored = records.where(F.col("shard").between(0, shards - 1)).select("shard", "id", distance(F.col("vector"), vector, metric).alias("distance"))
    order = Window.partitionBy("shard").orderBy("distance", "id")
    return merge_hits(scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "distance"), k)


def text_top_k(spark: SparkSession, records: DataFrame, text: str, dimensions: int, metric: str, k: int | None = None) -> DataFrame:
    """Embeds the text, then searches."""
    rows = embed_text(spark.createDataFrame([(0, text)], "qid long, text string"), "qid", "text", dimensions).collect()
    if not rows:
        raise ValueError("text has no words to search for")
    return top_k(records, rows[0].vector, dimensions, metric, k)


def multi_get(spark: SparkSession, records: DataFrame, ids: list[int]) -> DataFrame:
    """pos and the record of each requested id: request order, repeats repeated, missing ids left out."""
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return asked.join(records, "id").orderBy("pos")
