"""Packing of token sequences: best-fit decreasing over a segment tree.

Overlong documents are first cut into full windows; the rests are placed, longest
first, each into the open window with the least room that still holds it, found by a
segment tree over remaining capacities. Each task packs blocks of bounded size, so
memory doesn't grow with the table and a lost task is simply run again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import pick

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"


class Room:
    """Open windows by remaining capacity: a segment tree of counts over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (room, window) with room >= need."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right sibling has a window
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    """The window of each length (1..capacity), by best-fit decreasing, and how many there are."""
    room, at, windows = Room(capacity), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        left, window = found or (capacity, windows)
        windows += found is None
        at[i] = window
        if left > lengths[i]:
            room.add(left - lengths[i], window)
    return at, windows


def pack(lengths: np.ndarray, capacity: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    A window with more than `slack` ids to pad is cut at powers of two, as sequences of
    such a length need no padding: what it holds becomes sequences of its binary digits.
    """
    pieces, rests, sequence = [], [], 0
    for i, n in enumerate(lengths.tolist()):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((i, start, capacity, sequence, 0))
            sequence += 1
        if n > whole:
            rests.append((i, whole, n - whole))
    at, windows = best_fit([r[2] for r in rests], capacity)
    held: list[list[int]] = [[] for _ in range(windows)]
    for k, window in enumerate(at):
        held[window].append(k)
    for members in held:
        fill = sum(rests[k][2] for k in members)
        sizes = [fill]
        if capacity - fill > slack:
            sizes = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        ends = np.cumsum(sizes).tolist()
        which = used = 0
        for k in members:
            i, start, n = rests[k]
            while n:
                begin = ends[which] - sizes[which]
                now = min(n, ends[which] - used)
                pieces.append((i, start, now, sequence + which, used - begin))
                start, n, used = start + now, n - now, used + now
                which += used == ends[which]
        sequence += len(sizes)
    return pieces


_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x30:0x3A] = _PLAIN[0x41:0x5B] = _PLAIN[0x61:0x7B] = True


class CachedTokenizer:
    """Ids of texts by a lower-casing tokenizer that drops white space and never joins ids across it.

    Texts are split at ASCII white space, and before a comma or full stop that ends a word
    (such a tokenizer parts these too); each distinct word is encoded once. Words are found by
    64-bit hash and compared byte by byte; should two meet in a hash, all of a batch's words are encoded
    without the cache. New ones are encoded together, with a special token between them. The cache
    is emptied when it would hold more than `most` words. A file whose tokenizer can't be split
    so (another normaliser or split) is told at the start; its texts are encoded whole.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.mark = "<|startoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.splits = self.mark_id is not None and self._parts(json.loads(self.tokenizer.to_str()))
        self.clear()

    def _parts(self, plan: dict) -> bool:
        """Whether words' ids don't depend on their neighbours: by the file's rules, and on a sentence."""
        names = json.dumps([plan.get("normalizer"), plan.get("pre_tokenizer")])
        probe = "One, two.  three don't\n4,5. ÉTÉ-x e.g. (a), b!? mid,dle \t12.5."
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        cut = kernel.words_of(pa.array([probe]), kernel.NOT_SPACE, lower=True, family=None, tail=(_STOP, _PLAIN))
        words = [self.tokenizer.encode(cut.data[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(cut.start.tolist(), cut.end.tolist(), strict=True)]
        return "Lowercase" in names and [i for w in words for i in w] == whole

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = self.size = self.begin = self.end = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.spelling = np.zeros(0, np.uint8)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        flat, size = [], []
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            joined = self.mark.join(part)
            if joined.count("<|") == len(part) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([joined + self.mark], add_special_tokens=False)[0].ids, np.uint32)
                stops = np.flatnonzero(ids == self.mark_id)
                flat.append(ids[ids != self.mark_id])
                size.append(np.diff(stops, prepend=-1) - 1)
            else:
                for got in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                    flat.append(np.array(got.ids, np.uint32))
                    size.append(np.array([len(got.ids)]))
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), np.concatenate([*size, np.zeros(0, np.int64)]).astype(np.int64)

    def plain(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As `ids`, each text encoded whole."""
        each = [np.array([*got.ids, end], np.uint32) for got in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(e) for e in each], np.int64)

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and how many each text has."""
        if not self.splits:
            return self.plain(texts, end)
        data, _ = kernel.text_bytes(texts)
        special = b"<|" in data.tobytes()  # special tokens are told by their case
        words = kernel.words_of(texts, kernel.NOT_SPACE, lower=not special, tail=None if special else (_STOP, _PLAIN))
        code, distinct = pd.factorize(words.hash)
        some = np.zeros(len(distinct), np.int64)
        some[code[::-1]] = np.arange(len(code))[::-1]  # a place of each word
        if not kernel.equal_spans(words.data, words.start, words.end, words.data, words.start[some][code], words.end[some][code]).all():
            return self.plain(texts, end)
        if len(self.keys) + len(distinct) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        known, at = place[~new], some[~new]
        if not kernel.equal_spans(words.data, words.start[at], words.end[at], self.spelling, self.begin[known], self.end[known]).all():
            return self.plain(texts, end)
        if new.any():
            at, raw = some[new], words.data.tobytes()
            flat, size = self.encode([raw[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            letters = words.end[at] - words.start[at]
            begin = np.concatenate([self.begin, len(self.spelling) + np.cumsum(letters) - letters])
            self.begin, self.end = begin[order], (begin + np.concatenate([self.end - self.begin, letters]))[order]
            self.spelling = np.concatenate([self.spelling, words.data[kernel.span_places(words.start[at], letters)]])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.keys, self.flat = keys[order], np.concatenate([self.flat, flat])
            place = np.searchsorted(self.keys, distinct)
        n = np.append(self.size[place], 1)
        first = np.append(self.first[place], len(self.flat))  # the last "word" is `end`
        order = np.insert(code, words.first[1:], len(distinct))
        n = n[order]
        upto = np.cumsum(n)
        flat = np.append(self.flat, np.uint32(end))
        ids = flat[kernel.span_places(first[order], n)]
        doc_end = upto[words.first[1:] + np.arange(len(texts))]
        return ids, np.diff(doc_end, prepend=0)


@lru_cache(maxsize=2)
def _coder(path: str) -> CachedTokenizer:
    """One for each Python worker: later tasks find its cache filled."""
    return CachedTokenizer(path)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, slack: int = 64, block_tokens: int = 8_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, token_ids.

    Each document is its ids and `end_id`; each id lies in one piece. token_ids holds
    little-endian unsigned 32-bit ids. A null or empty text is `end_id` alone; rows with
    a null or repeated doc_id are packed like others, a document for each row. A text of any
    length is cut into full windows; an empty table gives no rows. sequence_id is unique, not gapless:
    it starts at the partition's number times 2^40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _coder(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            doc_id = pa.concat_arrays([x[0] for x in held])
            ids, length = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            held.clear()
            begin = np.cumsum(length) - length
            table = np.array(pack(length, capacity, slack), np.int64).reshape(-1, 5)
            raw = ids.astype("<u4").tobytes()
            last = int(table[:, 3].max(initial=-1))
            for at in range(0, len(table), 2000):
                doc, start, size, sequence, offset = table[at : at + 2000].T
                first = (begin[doc] + start) * 4
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(length[doc]), pa.array(base + sequence), pa.array(offset), pa.array([raw[a:b] for a, b in zip(first.tolist(), (first + size * 4).tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids"],
                )
            base += last + 1

        for batch in batches:
            for part in kernel.slices(batch, "text", 4_000_000):
                held.append((part["doc_id"], *coder.ids(part["text"], end_id)))
                if sum(len(x[1]) for x in held) >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return pick(docs, "doc_id", "text").mapInArrow(run, PIECES)
