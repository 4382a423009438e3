"""Exact top-k by inner product with block-at-a-time pruning.

Terms are dimensions. Candidates are kept in document-range blocks, each with its rows
(the forward index) and every term's largest and smallest value. A query orders blocks by
the sum of its terms' maxima, scores them in that order and stops when the next bound is
below its k-th score. Inside a cell rows are parted by their widest term, again and again, so that a
block's rows are alike and its maxima bound something. Queries and candidates meet in a grid of cells of bounded
bytes; one row of cells is searched first, and its k-th scores are what the others start with.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, pick

BLOCK = 64
_LOW = -(2**63)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond 64 bits, the nearest long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a.tolist()], object).reshape(a.shape)
    exact = whole(q).dot(whole(x).T)
    return np.array([[max(_LOW + 1, min(2**63 - 1, int(v))) for v in row] for row in exact], np.int64).reshape(exact.shape)


def arranged(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each block of `BLOCK` is a box of its own: halves along the widest term."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > BLOCK:
            part = x[order[a:b]]
            half = (-(-(b - a) // BLOCK) + 1) // 2 * BLOCK
            order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(part.max(0) - part.min(0))], half - 1)]
            todo += [(a, a + half), (a + half, b)]
    return order


def search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate id, score) of the k best candidates of each query, without its own id and scores below its floor.

    `tally` gets the numbers of pairs that were scored and that there are.
    """
    order = arranged(x)
    x, ids = x[order], ids[order]
    blocks = [(x[a : a + BLOCK], ids[a : a + BLOCK]) for a in range(0, len(x), BLOCK)]
    top = np.stack([b.max(0) for b, _ in blocks])
    low = np.stack([b.min(0) for b, _ in blocks])
    # rounded up, as sums of doubles may be off when they leave 53 bits
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    bound += np.abs(bound) * 1e-9
    turn = np.argsort(-bound, 1, kind="stable")
    best = np.full((len(q), k), _LOW)
    who = np.full((len(q), k), -1)
    filled = np.zeros(len(q), np.int64)
    if tally is not None:
        tally[1] += len(q) * len(x)
    for r in range(len(blocks)):
        block = turn[:, r]
        reach = bound[np.arange(len(q)), block]
        open_ = np.flatnonzero((reach >= floor) & ((filled < k) | (reach >= best[:, -1])))
        if not len(open_):
            break  # later bounds are lower still
        order = open_[np.argsort(block[open_], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            body, names = blocks[block[rows[0]]]
            score = products(q[rows], body)
            if tally is not None:
                tally[0] += score.size
            use = (names[None, :] != q_ids[rows, None]) & (score >= floor[rows, None])
            have = np.arange(k)[None, :] < filled[rows, None]
            score_all = np.concatenate([best[rows], score], 1)
            name_all = np.concatenate([who[rows], np.broadcast_to(names, score.shape)], 1)
            ok = np.concatenate([have, use], 1)
            rank = np.lexsort((name_all, -score_all, ~ok), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(score_all, rank, 1), np.take_along_axis(name_all, rank, 1)
            filled[rows] = np.minimum(k, ok.sum(1))
            best[rows] = np.where(np.arange(k)[None, :] < filled[rows, None], best[rows], _LOW)
    keep = np.arange(k)[None, :] < filled[:, None]
    return np.repeat(np.arange(len(q)), filled), who[keep], best[keep]


#: Components beyond this are scored one by one in whole numbers; below, floor(1024 * x) is exact as a double.
WILD = 2.0**40


def exactly(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `search`, for finite components of any size; scores beyond 64 bits are the nearest long."""
    whole = lambda a: [[int(np.floor(1024 * v)) if abs(v) < 2.0**900 else int(v) * 1024 for v in row] for row in a.tolist()]
    rows, out = whole(x), []
    for i, u in enumerate(whole(q)):
        scored = ((max(_LOW + 1, min(2**63 - 1, sum(a * b for a, b in zip(u, v, strict=True)))), -c) for c, v in zip(ids.tolist(), rows, strict=True) if c != q_ids[i])
        out += [(i, -c, s) for s, c in heapq.nlargest(k, scored)]
    columns = np.array(out, np.int64).reshape(-1, 3).T
    return columns[0], columns[1], columns[2]


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 10, cell_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query by integer inner product.

    Both tables have vec_id and embedding; components are floor(1024 * x). A query's own
    vec_id isn't a candidate; ties go to the smaller vec_id; with fewer candidates all are
    returned. Null vec_ids, null vectors, empty ones and those with null or non-finite components
    take no part; only vectors of the query's length are compared; a score beyond 64 bits is the nearest
    long. Repeated query rows count once; repeated candidate rows each count. Empty tables give no rows.
    A cell holds about `cell_bytes` of queries' and of candidates' components at most.
    """
    stage = Stage(rows.sparkSession, "topk")

    def whole(df: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
        return (
            pick(df, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & (F.size("embedding") > 0))
            .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dims"))
        )

    asked, there = stage.put(whole(queries).dropDuplicates(["vec_id", "v"]).withColumn("query_key", F.xxhash64("v"))), whole(rows)
    weigh = lambda df: max(1, -(-8 * (df.agg(F.sum("dims")).first()[0] or 0) // cell_bytes))
    parts, chunks = weigh(there), weigh(asked)
    left = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)).cast("int"))
    right = there.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and x.num_rows:
            dims = x["dims"].to_numpy()
            for d in np.unique(q["dims"].to_numpy()).tolist():
                a, b = q.filter(pa.array(q["dims"].to_numpy() == d)), x.filter(pa.array(dims == d))
                if not b.num_rows:
                    continue
                body, base = (t["v"].combine_chunks().flatten().to_numpy().reshape(-1, d) for t in (a, b))
                names, keys, ids, floor = (c.to_numpy() for c in (a["vec_id"], a["query_key"], b["vec_id"], a["floor"]))
                wild, far = np.abs(body).max(1) >= WILD, np.abs(base).max(1) >= WILD
                for some, others in ((wild, np.ones(len(far), bool)), (~wild, far)):
                    if some.any() and others.any():
                        who, found, score = exactly(body[some], names[some], base[others], ids[others], k)
                        out.append((names[some][who], keys[some][who], found, score))
                body, base = np.floor(body[~wild] * 1024), np.floor(base[~far] * 1024)
                names, keys, ids, floor = names[~wild], keys[~wild], ids[~far], floor[~wild]
                for at in range(0, len(body) if len(base) else 0, 1024):
                    who, found, score = search(body[at : at + 1024], names[at : at + 1024], floor[at : at + 1024], base, ids, k)
                    out.append((names[at + who], keys[at + who], found, score))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    def searched(asking: DataFrame, some: DataFrame) -> DataFrame:
        """A grid of the chunks of queries and the parts of candidates."""
        here = some.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return asking.groupBy("part", "chunk").cogroup(here.groupBy("part", "chunk")).applyInArrow(cell, "query_id long, query_key long, vec_id long, score long")

    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = searched(left.withColumn("part", F.lit(0)).withColumn("floor", F.lit(_LOW)), right.where("part = 0"))
    if parts > 1:
        found = stage.put(best(found).drop("rank"))
        floors = found.groupBy("query_id", "query_key").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "query_key", F.col("least").alias("floor"))
        left = left.join(floors, ["vec_id", "query_key"], "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW)))
        found = found.union(searched(left.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))), right.where("part > 0")))
    return best(found).select("query_id", "rank", "vec_id", "score")
