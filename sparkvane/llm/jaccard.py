"""Exact n-gram Jaccard join by partitioning the universe of tokens.

A document is the set of its distinct shingles, as 64-bit hashes. Hash ranges cut the
universe into segments, whose number depends on a band of set sizes: two sets over the
threshold differ in at most H shingles, so of m > H segments at least m - H are equal.

* Each set indexes its H + 1 heaviest segments (most shingles, ties by content). That is
  enough: the heaviest of a pair's equal segments is among the H + 1 heaviest of either set.
* Where sets are small, half as many segments with their one-deletion neighbourhoods do,
  as one of m > H / 2 segments differs in one shingle at most. A cost model allocates one of
  both to each band.
* A set is indexed by the scheme of its own band, and by that of the band below if a
  partner may lie there; the smaller set's band decides for a pair.

Equal sets are one node from the start. Groups of nodes that share a signature aren't expanded
into pairs: each node is verified against its group's hub. Where a hub's nodes then lie in
several components, those outside the hub's own are asked against the cluster's others, block by block,
in cells of bounded size, which return only links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Stage, pick, text_key
from .components import connected_components

_U = np.uint64
BAND = 2.0
SPARE = 1.1


class Scheme:
    """What depends on the threshold (in hundredths): bands, segments, the largest differences."""

    def __init__(self, percent: int) -> None:
        self.p = percent
        self.lo, self.hi = [1], [1]

    def grow(self, size: int) -> None:
        while self.hi[-1] < size:
            self.lo.append(self.hi[-1] + 1)
            # a partner is never beyond the next band
            self.hi.append(max(self.lo[-1], int(self.lo[-1] * BAND), self.largest(self.hi[-1])))

    def band(self, size: np.ndarray) -> np.ndarray:
        self.grow(int(size.max(initial=1)))
        return np.searchsorted(np.array(self.hi), size)

    def largest(self, size):
        """The largest partner of a set."""
        return 100 * size // self.p

    def differ(self, a, b):
        """The most shingles that are in one of two sets of these sizes alone."""
        return (100 - self.p) * (a + b) // (100 + self.p)

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> tuple[int, bool]:
        """How many segments a band has, and whether they are indexed with one-deletion neighbourhoods."""
        self.grow(self.hi[-1] + 1 if band >= len(self.hi) else 1)
        size = self.hi[band]
        most = self.differ(size, self.largest(size))
        whole, half = int(np.ceil(SPARE * (most + 1))), most // 2 + 1
        # signatures, and strangers met through a segment; a shingle is taken to be common with chance 0.15
        cost = (most + 1 + 1e4 * 0.15 ** max(1.0, 0.8 * size / whole), size + half + 1e4 * 0.15 ** max(1.0, size / half - 1))
        return (half, True) if cost[1] < cost[0] else (whole, False)


@lru_cache(maxsize=8)
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


def shingles(texts: pa.Array, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (text, hash, hash of the next family) in order, and how many each text has."""
    words = kernel.words_of(texts, kernel.NOT_SPACE, lower=True, family=family)
    doc, few = words.doc(), np.flatnonzero((words.count > 0) & (words.count < n))
    codes = []
    for code in (words.hash, kernel.hash_spans(words.data, words.start, words.end, family + 1)):
        run, whole = kernel.runs(kernel.Words(words.data, words.start, words.end, code, words.first), n)
        short = np.array([_fold(code[words.first[d] : words.first[d + 1]]) for d in few.tolist()], np.uint64)  # shorter texts: the whole sequence as one
        codes.append(np.concatenate([run[whole], short]))
    doc_of = np.concatenate([doc[: len(run)][whole], few])
    at = kernel.unique_sorted(doc_of, codes[0])
    return doc_of[at], codes[0][at], codes[1][at], np.bincount(doc_of[at], minlength=len(texts))


def _fold(codes: np.ndarray) -> int:
    h = _U(len(codes))
    with np.errstate(over="ignore"):
        for c in codes:
            h = kernel.mix(np.array([h * _U(0xD1342543DE82EF95) + c], np.uint64))[0]
    return int(h)


def exact_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `shingles`, but numbered by their words' bytes within these texts: (text, number, hash) in order of numbers, and how many each text has."""
    words = kernel.words_of(texts, kernel.NOT_SPACE, lower=True)
    word = kernel.word_bytes(words).dictionary_encode().indices.to_numpy().astype(np.int64) if len(words.start) else np.zeros(0, np.int64)

    def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    have, number = 1, word
    for bit in bin(n)[3:]:  # twice as long, and one more word, as the binary digits of n say
        number, have = numbered(number[: max(0, len(number) - have)], number[have:]), 2 * have
        if bit == "1":
            number, have = numbered(number[: max(0, len(number) - 1)], word[have:][: max(0, len(number) - 1)]), have + 1
    code, whole = kernel.runs(words, n)
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    found: dict[tuple[int, ...], int] = {}
    base = int(number.max(initial=0)) + 1
    short = np.array([base + found.setdefault(tuple(word[words.first[d] : words.first[d + 1]].tolist()), len(found)) for d in few.tolist()], np.int64)
    folded = np.array([_fold(words.hash[words.first[d] : words.first[d + 1]]) for d in few.tolist()], np.uint64)
    doc = np.concatenate([words.doc()[: len(code)][whole], few])
    number, code = np.concatenate([number[: len(code)][whole], short]), np.concatenate([code[whole], folded])
    at = kernel.unique_sorted(doc, number)
    return doc[at], number[at], code[at], np.bincount(doc[at], minlength=len(texts))


def set_hashes(doc: np.ndarray, codes: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, by either family; 0 for an empty one."""
    out = []
    for code, salt in zip(codes, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
        total = np.zeros(n, np.uint64)
        if len(doc):
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            total[doc[first]] = kernel.mix(np.add.reduceat(kernel.mix(code ^ _U(salt)), first) + _U(salt))
        out.append(total)
    return out[0], out[1]


def signatures(doc: np.ndarray, code: np.ndarray, size: np.ndarray, percent: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) by the scheme of the own band, or (lower) of the band below."""
    s = scheme(percent)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    band = s.band(np.maximum(size, 1)) - lower
    hi = np.array(s.hi)[np.maximum(band, 0)]
    use = (size > 0) & (band >= 0) & (~np.array(lower) | (size <= s.largest(hi)))
    most = s.differ(size, np.where(lower, hi, s.largest(size)))
    rule = [s.segments(b) for b in range(int(band.max(initial=0)) + 1)]
    m = np.array([r[0] for r in rule])[np.maximum(band, 0)]
    near = np.array([r[1] for r in rule])[np.maximum(band, 0)]
    use &= most > 0  # else partners are equal sets
    keep = use[doc]
    doc, code = doc[keep], code[keep]
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    segment = ((code >> _U(32)) * m[doc].astype(np.uint64) >> _U(32)).astype(np.int64)
    value = kernel.mix(code ^ _U(0xA0761D6478BD642F))
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])))
    count = np.diff(np.append(first, len(doc)))
    total = np.add.reduceat(value, first)
    d, j = doc[first], segment[first]
    place = kernel.mix(band[d].astype(np.uint64) * _U(1_000_003) + j.astype(np.uint64) + _U(0x2545F491))
    out_doc, out_key = [], []

    def put(which: np.ndarray, at: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        out_doc.append(which)
        out_key.append(kernel.mix(at ^ kernel.mix(sums + counts.astype(np.uint64) * _U(0x9E3779B97F4A7C15))))

    plain = ~near[d]
    order = np.lexsort((total, place, -count, d))
    order = order[plain[order]]
    begin = np.searchsorted(d[order], np.arange(len(size) + 1))
    rank = np.arange(len(order)) - begin[d[order]]
    top = order[rank <= most[d[order]]]
    put(d[top], place[top], total[top], count[top])
    short = np.flatnonzero(use & ~near & (np.diff(begin) <= most))
    for x in short.tolist():  # too few segments have shingles: empty ones count as the lightest
        have = set(j[order[begin[x] : begin[x + 1]]].tolist())
        empty = np.array([k for k in range(int(m[x])) if k not in have], np.int64)
        where = np.sort(kernel.mix(np.full(len(empty), band[x]).astype(np.uint64) * _U(1_000_003) + empty.astype(np.uint64) + _U(0x2545F491)))
        where = where[: int(most[x]) + 1 - len(have)]
        put(np.full(len(where), x), where, np.zeros(len(where), np.uint64), np.zeros(len(where), np.int64))
    close = ~plain
    if close.any():
        put(d[close], place[close], total[close], count[close])
        of = np.repeat(np.arange(len(first)), count)
        pick_ = close[of]
        put(doc[pick_], place[of[pick_]], total[of[pick_]] - value[pick_], count[of[pick_]] - 1)
        for k in range(int(m[use & near].max(initial=0))):  # an empty segment differs from one shingle by a deletion
            has = np.zeros(len(size), bool)
            has[d[close & (j == k)]] = True
            where = np.flatnonzero(use & near & (m > k) & ~has)
            put(where, kernel.mix(band[where].astype(np.uint64) * _U(1_000_003) + _U(k + 0x2545F491)), np.zeros(len(where), np.uint64), np.zeros(len(where), np.int64))
    return np.concatenate(out_doc).astype(np.int64), np.concatenate(out_key)


def compare(a: pa.Array, b: pa.Array, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts: whether 100 * intersection >= percent * union, counted on the words themselves; and how many shingles are in one alone."""
    k = len(a)
    doc, number, _, size = exact_shingles(pa.concat_arrays([a.cast(pa.large_string()), b.cast(pa.large_string())]), n)
    doc = doc % max(k, 1)
    order = np.lexsort((number, doc))
    doc, number = doc[order], number[order]
    same = (doc[1:] == doc[:-1]) & (number[1:] == number[:-1])
    common = np.bincount(doc[1:][same], minlength=k)
    total = size[:k] + size[k:]
    return (100 * common >= percent * (total - common)) & (common > 0), total - 2 * common


INDEX = "sig long, node long, doc_id long, text_key long, n int, check long"


def index(docs: DataFrame, n: int, percent: int, family: int) -> DataFrame:
    """A row for each document (sig null), and one for each signature of each different set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["sig", "node", "doc_id", "text_key", "n", "check"]
        none = lambda k: pa.nulls(k, pa.int64())
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                doc, code, other, size = shingles(part["text"], n, family)
                node, check = set_hashes(doc, (code, other), len(size))
                yield pa.RecordBatch.from_arrays([none(len(size)), pa.array(node.view(np.int64)), part["doc_id"], part["text_key"], pa.array(size.astype(np.int32)), pa.array(check.view(np.int64))], names=names)
                fresh = np.zeros(len(size), bool)
                for i, (x, ok) in enumerate(zip(node.tolist(), part["doc_id"].is_valid().to_pylist(), strict=True)):
                    if ok and size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[doc]
                for lower in (False, True):
                    d, key = signatures(doc[keep], code[keep], np.where(fresh, size, 0), percent, lower)
                    for at in range(0, len(d), 100_000):
                        k = len(d[at : at + 100_000])
                        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + k].view(np.int64)), pa.array(node[d[at : at + k]].view(np.int64)), none(k), none(k), pa.nulls(k, pa.int32()), none(k)], names=names)

    return pick(docs, "doc_id", "text").withColumn("text_key", text_key()).mapInArrow(run, INDEX)


def _sent(ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """A table of ids alone: broadcast while it has few rows, so that texts needn't be shuffled; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def _texts(docs: DataFrame, nodes: DataFrame, n: int, family: int, broadcast_rows: int) -> DataFrame:
    """node, text of the asked nodes (node, doc_id): the text of that doc_id that gives the node's set."""
    found = pick(docs, "doc_id", "text").join(_sent(nodes, broadcast_rows), "doc_id").select("node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                doc, code, other, size = shingles(part["text"], n, family)
                node, _ = set_hashes(doc, (code, other), len(size))
                yield part.filter(pa.array(node.view(np.int64) == part["node"].to_numpy(zero_copy_only=False)))

    return found.mapInArrow(check, "node long, text string").dropDuplicates(["node"])


def _starred(members: DataFrame, texts: DataFrame, n: int, percent: int, stage: Stage, broadcast_rows: int) -> DataFrame:
    """node, hub, linked, apart (shingles in one of the two alone) for each node that shares a group (sig, node) with that hub.

    A group's hub is its node with most neighbours by signatures: in a family of copies, the one
    that they are copies of.
    """
    sizes = stage.put(members.groupBy("sig").agg(F.count("*").alias("size")))
    ranks = stage.put(members.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("rank")))
    hubs = stage.put(members.join(ranks, "node").groupBy("sig").agg(F.max(F.struct("rank", "node")).alias("top")).select("sig", F.col("top.node").alias("hub")))
    pairs = stage.put(members.join(hubs, "sig").where("node <> hub").select("node", "hub").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "x", 1_000_000):
                ok, apart = compare(part["x"], part["y"], n, percent)
                yield pa.RecordBatch.from_arrays([part["node"], part["hub"], pa.array(ok), pa.array(apart)], names=["node", "hub", "linked", "apart"])

    x, y = texts.withColumnRenamed("text", "x"), texts.select(F.col("node").alias("hub"), F.col("text").alias("y"))
    return stage.put(x.join(_sent(pairs, broadcast_rows), "node").join(y, "hub").select("node", "hub", "x", "y").mapInArrow(run, "node long, hub long, linked boolean, apart long"))


def within(table: pa.Table, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the asked texts of a cell with others of it, but for those that roots and links so far imply.

    Each set's overlaps with all others come from the postings of its shingles.
    """
    text = pa.chunked_array(table["text"]).combine_chunks()
    node, asked, (_, at) = table["node"].to_numpy(), table["asked"].to_numpy(), np.unique(table["root"].to_numpy(), return_inverse=True)
    doc, number, _, size = exact_shingles(text, n)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], doc[order]
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
    times = np.diff(np.append(first, len(number)))
    group = np.empty(len(number), np.int64)
    group[order] = np.repeat(np.arange(len(first)), times)
    begin = np.searchsorted(doc, np.arange(len(size) + 1))
    out = []
    for x in np.flatnonzero(asked).tolist():
        mine = group[begin[x] : begin[x + 1]]
        mine = mine[times[mine] > 1]
        if not len(mine):
            continue
        common = np.bincount(owner[kernel.span_places(first[mine], times[mine])], minlength=len(size))
        for y in np.flatnonzero((common > 0) & (100 * common >= percent * (size + size[x] - common)) & (at != at[x])).tolist():
            if at[x] != at[y]:
                out.append((node[x], node[y]))
                at[at == at[y]] = at[x]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _open(stars: DataFrame, roots: DataFrame, sizes: DataFrame, percent: int, cell_sets: int, cell_shingles: int, stage: Stage, broadcast_rows: int) -> DataFrame:
    """Cells (cell, node, root, asked) of bounded size in which every pair of nodes that may still be linked meets.

    Two linked nodes are in a cluster, a hub with its star. If they lie in different components, one of them isn't in
    the hub's: these open nodes are asked, in blocks against blocks of the cluster. Symmetric differences obey the
    triangle inequality; so an open node that is farther from the hub than the hub's own component reaches, and the most
    by which linked sets of its size differ, can't be linked with this, and is asked against the open ones alone.
    """
    most = F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent))
    hubs = stars.select("hub").distinct().select("hub", F.col("hub").alias("node"), F.lit(0).cast("long").alias("apart"))
    rooted = stage.put(stars.select("hub", "node", "apart").union(hubs).join(roots, "node", "left").join(sizes, "node").select("hub", "node", F.coalesce("root", "node").alias("root"), "apart", "n"))
    of_hub = rooted.where("node = hub").select("hub", F.col("root").alias("own"))
    placed = rooted.join(_sent(of_hub, broadcast_rows), "hub").withColumn("open", F.col("root") != F.col("own"))
    each = placed.groupBy("hub").agg(F.max(F.when(~F.col("open"), F.col("apart"))).alias("reach"), F.max("open").alias("mixed")).where("mixed")
    placed = stage.put(placed.join(_sent(stage.put(each.select("hub", "reach")), broadcast_rows), "hub").withColumn("far", F.col("open") & (F.col("apart") > F.col("reach") + most)))
    blocks = lambda k, total: F.greatest(F.lit(1), F.ceil(F.col(k) * 2 / cell_sets), F.ceil(F.col(total) * 2 / cell_shingles)).cast("int")
    near, far = (F.col("open") & ~F.col("far")), F.col("far")
    counts = placed.groupBy("hub").agg(*(f(F.when(c, v)).alias(a) for a, c, f, v in (
        ("k", F.lit(True), F.count, F.lit(1)), ("total", F.lit(True), F.sum, F.col("n")), ("k_near", near, F.count, F.lit(1)), ("total_near", near, F.sum, F.col("n")), ("k_far", far, F.count, F.lit(1)), ("total_far", far, F.sum, F.col("n")),
    )))
    counts = stage.put(counts.na.fill(0).select("hub", blocks("k", "total").alias("all"), (F.col("k_near") > 0).cast("int").alias("any_near"), blocks("k_near", "total_near").alias("near_blocks"), (F.col("k_far") > 0).cast("int").alias("any_far"), blocks("k_far", "total_far").alias("far_blocks")))
    dealt = placed.join(_sent(counts, broadcast_rows), "hub").withColumn("lot", F.abs(F.xxhash64("node") % 1_000_000_007))
    upto = lambda b: F.sequence(F.lit(0), F.col(b) - 1)
    own = lambda b: F.array((F.col("lot") % F.col(b)).cast("int"))

    def grid(kind: int, rows, asks, ask_blocks: str, other_blocks: str) -> DataFrame:
        """Asked nodes go to each cell of their row of blocks, all nodes to each cell of their column."""
        here = dealt.where(rows)
        both = here.withColumn("at", F.explode(F.concat(
            F.when(asks, F.transform(upto(other_blocks), lambda j: F.struct(own(ask_blocks)[0].alias("i"), j.alias("j"), F.lit(True).alias("asked")))).otherwise(F.array().cast("array<struct<i:int,j:int,asked:boolean>>")),
            F.transform(upto(ask_blocks), lambda i: F.struct(i.alias("i"), own(other_blocks)[0].alias("j"), F.lit(False).alias("asked"))),
        )))
        return both.select(F.xxhash64("hub", F.lit(kind), "at.i", "at.j").alias("cell"), "node", "root", "at.asked")

    cells = grid(0, F.col("any_near") == 1, near, "near_blocks", "all").union(grid(1, (F.col("any_far") == 1) & F.col("far"), far, "far_blocks", "far_blocks"))
    return stage.put(cells.groupBy("cell", "node", "root").agg(F.max("asked").alias("asked")))


def _settled(cells: DataFrame, texts: DataFrame, n: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Links (a, b) between components inside cells."""

    def run(table: pa.Table) -> pa.Table:
        a, b = within(table, n, percent)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return texts.join(_sent(cells, broadcast_rows), "node").select("cell", "node", "root", "asked", "text").groupBy("cell").applyInArrow(run, "a long, b long")


def _with_least(rows: DataFrame, value, name: str) -> DataFrame:
    """Rows (root, …) with the least value of their root's rows; no task gets all rows of a root.

    Rows are dealt by root and a salt of their own; a root sends its result to the salts that it has.
    """
    salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("root", "salt").agg(F.min(value).alias(name))
    least = parts.groupBy("root").agg(F.min(name).alias(name), F.collect_list("salt").alias("salts")).select("root", F.explode("salts").alias("salt"), name)
    return dealt.join(least, ["root", "salt"]).drop("salt")


def _components(docs: DataFrame, n: int, percent: int, broadcast_rows: int, cell_sets: int, cell_shingles: int) -> DataFrame:
    """doc_id, text_key, n, root, component of each row, staged; root is the component's node, null for an empty set or a null doc_id."""
    stage = Stage(docs.sparkSession, "jaccard")
    for family in (0, 2, 4):
        table = stage.put(index(docs, n, percent, family))
        rows = table.where("sig is null and n > 0 and doc_id is not null")
        nodes = stage.put(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1")))
        if nodes.where("c0 <> c1").isEmpty():
            break
        stage.drop(table, nodes)  # two sets share a hash: other hashes then
    else:
        raise RuntimeError("different sets share a hash in every family of hashes")
    sizes, nodes = nodes.select("node", "n"), nodes.select("node", "doc_id")
    signed = table.where("sig is not null").select("sig", "node")
    groups = stage.put(signed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig"))
    members = stage.put(signed.join(groups.hint("shuffle_hash"), "sig").distinct())
    texts = stage.put(_texts(docs, members.select("node").distinct().join(nodes, "node"), n, family, broadcast_rows))
    stars = _starred(members, texts, n, percent, stage, broadcast_rows)
    roots = stage.put(connected_components(stars.where("linked").selectExpr("node a", "hub b"), stage))
    cells = _open(stars, roots, sizes, percent, cell_sets, cell_shingles, stage, broadcast_rows)
    if not cells.isEmpty():
        found = stage.put(_settled(cells, texts, n, percent, broadcast_rows))
        roots = stage.put(connected_components(found.union(roots.selectExpr("node a", "root b")), stage))
    best = _with_least(stage.put(roots.join(nodes, "node")), F.col("doc_id"), "component").drop("doc_id")
    labels = nodes.join(best, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component", "doc_id").alias("component"))
    taking = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    told = table.where("sig is null").join(labels, "node", "left").select("doc_id", "text_key", "n", F.when(taking, F.col("root")).alias("root"), F.when(taking, F.col("component")).otherwise(F.col("doc_id")).alias("component"))
    result = stage.put(told)
    stage.only(result)
    return result


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, broadcast_rows: int = 300_000, cell_sets: int = 256, cell_shingles: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; two rows link at Jaccard >= percent / 100.

    Words are runs of anything but ASCII white space, A-Z lower-cased; the set is of distinct
    runs of n words, the whole sequence where there are fewer. A null or empty text has an
    empty set and links with nothing; its component is itself. Repeated rows, and rows that
    share a doc_id, are documents of their own; a row with a null doc_id takes no part in
    links and its component is null. An empty table gives no rows. Equal sets are told by two
    64-bit hashes of their words' bytes, links are counted on the words themselves.
    """
    return _components(docs, n, percent, broadcast_rows, cell_sets, cell_shingles).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, n: int, percent: int, broadcast_rows: int = 300_000, cell_sets: int = 256, cell_shingles: int = 500_000) -> DataFrame:
    """One document of each group of near copies: the row of smallest doc_id, as it is.

    Where rows share that doc_id, the one of smallest text hash stays, and of repeated rows one. Rows
    with an empty or null text or a null doc_id take no part and stay. An empty table gives no rows.
    """
    told = _components(docs, n, percent, broadcast_rows, cell_sets, cell_shingles).where("root is not null")
    gone = _with_least(told, F.struct("doc_id", "text_key"), "first").where(F.struct("doc_id", "text_key") > F.col("first")).select("doc_id", "text_key").distinct()
    marked = docs.withColumn("text_key", text_key())
    left = marked.join(gone, ["doc_id", "text_key"], "left_anti")
    repeated = told.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(repeated, ["doc_id", "text_key"], "left_anti").select(*docs.columns).union(once)
