"""Substring dedup with repeated-phrase automata.

A window of `window` words is tied to its anchor: of the `phrase`-word phrases inside it,
the leftmost one of least hash. Equal windows have equal anchors at the same place, so only
windows whose anchor phrase recurs can recur. All windows tied to one place of an anchor
stand in a row; what they cover is that place's stretch.

1. Confirm. Anchors of all documents are counted; around those that recur, stretches are
   counted by their hash, with the first place of each. An anchor whose stretches are all
   equal gives one passage, its stretch; for others the windows of each different stretch
   are counted, and those that recur are a passage each.
2. Compile. A passage's words are read at its first place. Passages are dealt to shards by
   that place, so that what was copied from one text lies together; each shard's passages
   are compiled to an Aho-Corasick automaton over word symbols.
3. Stream. Documents go, in blocks of words, to the shards that hold a passage around one of
   their anchors (others can't have any), and the automaton finds every occurrence, word by
   word. All but a passage's first are marked. A shard that many blocks concern is dealt
   over salts, each with the same automaton.

Counts are partial aggregates, so a phrase that stands in very many documents crowds no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Stage, pick, text_key

_U = np.uint64
_ANCHOR = _U(0xC2B2AE3D27D4EB4F)
#: Words of a document that are streamed at a time, and words of it whose passages lie in one shard.
BLOCK, CHUNK = 1000, 20_000


def anchors_of(words: kernel.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one text: its first word and its anchor's first word; and all phrases' hashes."""
    code, _ = kernel.runs(words, phrase)
    wide = window - phrase + 1
    if len(words.hash) < window:
        none = np.zeros(0, np.int64)
        return none, none, code
    last = np.repeat(words.first[1:], words.count)
    start = np.arange(len(words.hash) - window + 1)
    start = start[start + window <= last[: len(start)]]
    # least of `wide` in a row, leftmost, by doubling
    best, at = code, np.arange(len(code))
    span = 1
    while span < wide:
        step = min(span, wide - span)
        left, right = best[: len(best) - step], best[step:]
        at = np.where(right < left, at[step:], at[: len(at) - step])
        best = np.minimum(left, right)
        span += step
    return start, at[start], code


def places(words: kernel.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of an anchor: its stretch's first word, how many words it has, its text and the anchor's hash."""
    start, at, code = anchors_of(words, window, phrase)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])  # windows of one anchor stand in a row
    last = np.append(first[1:], len(start))[: len(first)] - 1
    begin = start[first]
    return begin, start[last] + window - begin, np.searchsorted(words.first, begin, "right") - 1, code[at[first]]


def _listed(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Members of a column of lists of structs: the row of each, and its fields."""
    lists = part[column]
    items = lists.flatten()
    return np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), [items.field(k).to_numpy(zero_copy_only=False) for k in range(items.type.num_fields)]


def _by_document(table: DataFrame, *fields: str) -> DataFrame:
    """place, text_key, found: a document's rows as one list."""
    return table.groupBy("place", "text_key").agg(F.collect_set(F.struct(*fields)).alias("found"))


def _union(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ranges of one owner as one: the order of all ranges, where in it each union opens, and its stop."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    far = (stop.max(initial=0) + 1) * np.cumsum(np.append(False, owner[1:] != owner[:-1])[: len(owner)])  # so that owners' ranges ascend
    reach = np.maximum.accumulate(stop + far)
    opens = np.flatnonzero(np.append(True, (start + far)[1:] > reach[:-1])[: len(start)])
    return order, opens, (reach - far)[np.append(opens[1:], len(start))[: len(opens)] - 1]


MARKS = "place long, text_key long, start int, stop int"


def locate(blocks: pa.Table, runs: pa.Table) -> pa.Table:
    """Where passages stand in blocks, but for each one's first place: ranges of words.

    `runs` has place, start, body and passages (start, size) of what stands first there; `blocks` has
    place, text_key, start and body. Words are compared as bytes: a block's word that no passage has is a stop.
    """
    none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=["place", "text_key", "start", "stop"])
    if not blocks.num_rows or not runs.num_rows:
        return none
    spell = lambda code: (code + 0xE000).astype("<u4").tobytes().decode("utf-32-le")
    text_of = lambda t: kernel.words_of(pa.chunked_array(t["body"]).combine_chunks().cast(pa.large_string()), kernel.NOT_SPACE, family=None)
    source, streamed = text_of(runs), text_of(blocks)
    known = kernel.word_bytes(source).dictionary_encode()
    owner, (begin, size) = _listed(runs.combine_chunks().to_batches()[0], "passages")
    from_place, from_start = runs["place"].to_numpy()[owner], begin
    at = source.first[owner] + begin - runs["start"].to_numpy()[owner]
    text = spell(known.indices.to_numpy() + 1)
    machine = ahocorasick.Automaton()
    origin: list[tuple[int, int, int]] = []
    for p, n, place, start in zip(at.tolist(), size.tolist(), from_place.tolist(), from_start.tolist(), strict=True):
        key = text[p : p + n]
        if (i := machine.get(key, -1)) < 0:
            machine.add_word(key, len(origin))
            origin.append((n, place, start))
        else:
            origin[i] = (n, *min(origin[i][1:], (place, start)))
    machine.make_automaton()
    # one string of all blocks, with a stop after each
    code = np.insert(pc.fill_null(pc.index_in(kernel.word_bytes(streamed), value_set=known.dictionary), -1).to_numpy().astype(np.int64) + 1, streamed.first[1:], 0)
    opens = streamed.first[:-1] + np.arange(blocks.num_rows)
    hits = np.fromiter((x for hit in machine.iter(spell(code)) for x in hit), np.int64).reshape(-1, 2)
    n, place, start = np.array(origin, np.int64)[hits[:, 1]].T
    head = hits[:, 0] - n + 1
    block = np.searchsorted(opens, head, "right") - 1
    word = blocks["start"].to_numpy()[block] + head - opens[block]
    later = (blocks["place"].to_numpy()[block] != place) | (word != start)
    block, word, n = block[later], word[later], n[later]
    order, opens, stop = _union(block, word, word + n)
    block, start = block[order][opens], word[order][opens]
    return pa.table(
        [blocks["place"].combine_chunks().take(pa.array(block)), blocks["text_key"].combine_chunks().take(pa.array(block)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
        names=none.column_names,
    )


def repeated_ranges(docs: DataFrame, stage: Stage, window: int, phrase: int, per_shard: int, per_task: int) -> DataFrame:
    """place, text_key, marks (start, stop): ranges of words covered by windows that have an earlier equal one."""
    longest = 2 * window - phrase

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                _, _, doc, code = places(kernel.words_of(part["text"], kernel.NOT_SPACE), window, phrase)
                order = np.lexsort((code, doc))
                doc, code = doc[order], code[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))[: len(doc)])
                count = np.diff(np.append(first, len(doc)))
                for k in range(0, len(first), 100_000):
                    d, c, m = doc[first[k : k + 100_000]], code[first[k : k + 100_000]], count[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(m), part["place"].take(pa.array(d)), part["text_key"].take(pa.array(d))], names=["anchor", "times", "place", "text_key"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE)
                begin, size, doc, code = places(words, window, phrase)
                row, (known,) = _listed(part, "found")
                known = np.sort(kernel.mix(known.view(np.uint64)) + row.astype(np.uint64) * _ANCHOR)
                ask = kernel.mix(code) + doc.astype(np.uint64) * _ANCHOR
                hit = known[np.minimum(np.searchsorted(known, ask), len(known) - 1)] == ask if len(known) else np.zeros(len(ask), bool)
                begin, size, doc, code = begin[hit], size[hit], doc[hit], code[hit]
                if len(begin):
                    whole = kernel.chain(words.hash, window)
                    body = kernel.mix(whole[begin] * _ANCHOR + whole[begin + size - window] + size.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code.view(np.int64)), pa.array(body.view(np.int64)), part["place"].take(pa.array(doc)), part["text_key"].take(pa.array(doc)), pa.array((begin - words.first[doc]).astype(np.int32)), pa.array(size.astype(np.int16))],
                        names=["anchor", "body", "place", "text_key", "start", "size"],
                    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE)
                whole = kernel.chain(words.hash, window)
                row, (anchor, body, start, size, times) = _listed(part, "found")
                count = size.astype(np.int64) - window + 1
                for k in range(0, len(row), 20_000):
                    r, c = row[k : k + 20_000], count[k : k + 20_000]
                    at = kernel.span_places(words.first[r] + start[k : k + 20_000], c)
                    spread = lambda x: pa.array(np.repeat(x[k : k + 20_000], c))  # noqa: B023, E731
                    of = np.repeat(r, c)
                    yield pa.RecordBatch.from_arrays(
                        [spread(anchor), spread(body), pa.array(whole[at].view(np.int64)), spread(times), part["place"].take(pa.array(of)), part["text_key"].take(pa.array(of)), pa.array((at - words.first[of]).astype(np.int32))],
                        names=["anchor", "body", "content", "times", "place", "text_key", "start"],
                    )

    # anchors that recur, and the documents that have some
    seen = stage.put(docs.mapInArrow(anchors, "anchor long, times long, place long, text_key long"))
    recurring = stage.put(seen.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"))
    found = stage.put(_by_document(seen.join(recurring.hint("shuffle_hash"), "anchor"), "anchor"))
    stage.drop(seen, recurring)
    # their stretches; passages are those of anchors with one stretch, and windows that recur elsewhere
    around = stage.put(docs.join(found, ["place", "text_key"]).mapInArrow(stretches, "anchor long, body long, place long, text_key long, start int, size short"))
    stage.drop(found)
    first = F.min(F.struct("place", "start", "text_key", "size"))
    different = stage.put(around.groupBy("anchor", "body").agg(F.count("*").alias("times"), first.alias("first")).select("anchor", "body", "times", "first.*"))
    alone = different.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = stage.put(different.join(alone, "anchor"))
    stage.drop(different)
    shard = lambda shards: F.pmod(F.xxhash64("place", "text_key", F.floor(F.col("start") / CHUNK)), F.lit(shards))
    single = kinds.where("kinds = 1 and times > 1").select("anchor", "body", "place", "text_key", "start", F.col("size").cast("int").alias("size"))
    mixed = docs.join(_by_document(kinds.where("kinds > 1"), "anchor", "body", "start", "size", "times"), ["place", "text_key"])
    inside = stage.put(mixed.mapInArrow(windows, "anchor long, body long, content long, times long, place long, text_key long, start int"))
    counted = inside.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.min(F.struct("place", "start", "text_key")).alias("first")).where("times > 1")
    several = stage.put(counted.select("anchor", "content", "first.*"))
    passages = single.select("place", "text_key", "start", "size").union(several.select("place", "text_key", "start", F.lit(window).alias("size")))
    shards = max(1, -(-passages.count() // per_shard))
    # which blocks concern which shards
    by_body = single.select("anchor", "body", shard(shards).alias("shard")).union(inside.select("anchor", "body", "content").join(several.select("anchor", "content", shard(shards).alias("shard")), ["anchor", "content"]).select("anchor", "body", "shard"))
    routes = stage.put(around.select("anchor", "body", "place", "text_key", F.floor(F.col("start") / BLOCK).cast("int").alias("block")).join(stage.put(by_body.distinct()), ["anchor", "body"]).select("place", "text_key", "block", "shard").distinct())
    stage.drop(around, inside)
    salts = stage.put(routes.groupBy("shard").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")))

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE, family=None)
                row, (start, size) = _listed(part, "found")
                key = row * (1 << 32) + start // CHUNK  # ranges of one chunk
                order, cut, hi = _union(key, start, start.astype(np.int64) + size)
                row, start, size = row[order], start[order].astype(np.int64), size[order]
                owner, lo = row[cut], start[cut]
                a, b = words.start[words.first[owner] + lo], words.end[words.first[owner] + hi - 1]
                raw = words.data
                for k in range(0, len(cut), 5000):
                    to = slice(k, k + 5000)
                    ends = np.append(cut, len(start))[k + 1 : k + 5001]
                    span = slice(int(cut[k]), int(ends[-1]))
                    items = pa.StructArray.from_arrays([pa.array(start[span].astype(np.int32)), pa.array(size[span].astype(np.int32))], ["start", "size"])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut[to], ends[-1]).astype(np.int32) - np.int32(cut[k])), items)
                    yield pa.RecordBatch.from_arrays(
                        [part["place"].take(pa.array(owner[to])), part["text_key"].take(pa.array(owner[to])), pa.array(lo[to].astype(np.int32)), pa.array([raw[x:y].tobytes() for x, y in zip(a[to].tolist(), b[to].tolist(), strict=True)], pa.binary()), lists],
                        names=["place", "text_key", "start", "body", "passages"],
                    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE, family=None)
                row, (block, to_shard, salt) = _listed(part, "found")
                lo = words.first[row] + block.astype(np.int64) * BLOCK
                hi = np.minimum(lo + BLOCK + longest, words.first[row + 1])
                a, b = words.start[lo], words.end[hi - 1]
                for k in range(0, len(row), 1000):
                    to = slice(k, k + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to_shard[to]), pa.array(salt[to]), part["place"].take(pa.array(row[to])), part["text_key"].take(pa.array(row[to])), pa.array((block[to] * BLOCK).astype(np.int32)), pa.array([words.data[x:y].tobytes() for x, y in zip(a[to].tolist(), b[to].tolist(), strict=True)], pa.binary())],
                        names=["shard", "salt", "place", "text_key", "start", "body"],
                    )

    def scanned(blocks: pa.Table, runs: pa.Table) -> pa.Table:
        try:
            return locate(blocks, runs)
        finally:
            kernel.tidy()

    sources = docs.join(_by_document(passages, "start", "size"), ["place", "text_key"])
    compiled_ = sources.mapInArrow(compiled, "place long, text_key long, start int, body binary, passages array<struct<start:int,size:int>>")
    compiled_ = compiled_.withColumn("shard", shard(shards)).join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = routes.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("place", "text_key", "block"), F.col("salts")).cast("int"))
    streamed = docs.join(_by_document(salted, "block", "shard", "salt"), ["place", "text_key"]).mapInArrow(dealt, "shard long, salt int, place long, text_key long, start int, body binary")
    marks = stage.put(streamed.groupBy("shard", "salt").cogroup(compiled_.groupBy("shard", "salt")).applyInArrow(scanned, MARKS))
    ranges = stage.put(marks.groupBy("place", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("marks")))
    stage.only(ranges)
    return ranges


def removed_words(words: kernel.Words, marks: pa.Array) -> np.ndarray:
    """Which words lie in a marked range."""
    items = marks.flatten()
    owner = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    start, stop = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, words.first[owner] + start, 1)
    np.add.at(change, words.first[owner] + stop, -1)
    return np.cumsum(change[:-1]) > 0


def keep_words(words: kernel.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of all texts, each with a space after it, and where each text's bytes end."""
    kept = ~gone
    start, end = words.start[kept], words.end[kept]
    size = end - start + 1
    upto = np.cumsum(size)
    if len(size):
        index = np.arange(upto[-1]) + np.repeat(start - (upto - size), size)
        data = words.data[np.minimum(index, len(words.data) - 1)]
        data[upto - 1] = 0x20
    else:
        data = np.zeros(0, np.uint8)
    through = np.concatenate([[0], np.cumsum(kept)])[words.first]
    return data, np.concatenate([[0], upto])[through]


def cut_words(words: kernel.Words, gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts without the removed words, and where each text's bytes end.

    A run of removed words goes with the white space after it, at a text's end with that before it; all else stays as it is.
    """
    n = len(gone)
    opens = np.ones(n, bool)  # a text's first word
    opens[:] = False
    opens[words.first[:-1][words.count > 0]] = True
    closes = np.append(opens[1:], True)[:n]
    lead = gone & (opens | ~np.append(False, gone[:-1])[:n])
    tail = gone & (closes | ~np.append(gone[1:], False)[:n])
    lead, tail = np.flatnonzero(lead), np.flatnonzero(tail)
    last = closes[tail]
    begin = np.where(last & ~opens[lead], words.end[np.maximum(lead - 1, 0)], words.start[lead])
    end = np.where(last, words.end[tail], words.start[np.minimum(tail + 1, max(n - 1, 0))] if n else 0)
    change = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    keep = np.cumsum(change[:-1]) == 0
    return words.data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _with_marks(docs: DataFrame, window: int, phrase: int, per_shard: int, per_task: int) -> DataFrame:
    stage = Stage(docs.sparkSession, "substrings")
    placed = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63))))
    # rows that share a doc_id are told apart by their texts; a key is shuffled with every anchor, so only where there are some
    shared = not placed.groupBy("place").count().where("count > 1").isEmpty()
    placed = placed.withColumn("text_key", text_key() if shared else F.lit(0).cast("long"))
    marks = repeated_ranges(placed.select("place", "text_key", F.coalesce("text", F.lit("")).alias("text")), stage, window, phrase, per_shard, per_task)
    return placed.join(marks, ["place", "text_key"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<start:int,stop:int>>"))).drop("place", "text_key")


def dedup_substrings(docs: DataFrame, window: int = 20, phrase: int = 8, per_shard: int = 10_000, per_task: int = 4_000, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, with `texts`) for each row.

    Words are runs of anything but ASCII white space. A word goes if a window of `window`
    words over it also starts earlier: at a smaller doc_id, or earlier in the same one.
    Windows are judged on the input. A null or empty text has no words; null doc_ids come
    before all others, as one document; rows that share a doc_id and start at the same word
    aren't earlier than one another, so repeated rows get equal results. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE, family=None)
                gone = removed_words(words, part["marks"])
                data, ends = keep_words(words, gone)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                raw = data.tobytes()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [part["doc_id"], pa.array(words.count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", kept string" if texts else ""
    return _with_marks(pick(docs, "doc_id", "text"), window, phrase, per_shard, per_task).mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string{more}")


def without_repeats(docs: DataFrame, window: int = 20, phrase: int = 8, per_shard: int = 10_000, per_task: int = 4_000) -> DataFrame:
    """The documents with repeated words cut out of text; lines and spaces elsewhere stay, texts without repeats pass unchanged.

    What goes is as in `dedup_substrings`, on nulls, repeated and empty rows too; a null text stays null, and a text
    of which nothing is left becomes its outer white space. Each row gives a row, an empty table none.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                words = kernel.words_of(part["text"], kernel.NOT_SPACE, family=None)
                data, ends = cut_words(words, removed_words(words, part["marks"]), kernel.text_bytes(part["text"])[1])
                whole = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
                texts = pc.if_else(part["text"].is_valid(), whole, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([texts if f.name == "text" else part[f.name] for f in schema], names=schema.names)

    return _with_marks(docs, window, phrase, per_shard, per_task).mapInArrow(run, schema)
