"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text into pieces has the largest sum of scores. The search holds
scores for as many positions as the longest piece has characters, and backpointers only as far
back as surviving paths differ: whenever they meet in one boundary, ids up to it are
committed. Two characters that no piece has side by side part a text for certain; what
stands between such places recurs all over a corpus, so its ids are kept in a bounded cache.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import pick

_U = np.uint64
SPACE = "▁"
#: Kinds of pieces, and how far an unknown character scores below the least piece: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """Pieces, scores and kinds of a model file whose text rule is identity, but for spaces."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    trie: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, scores, kinds, rule = [], [], [], {3: 1, 4: 1}
        for key, value in _fields(Path(path).read_bytes()):
            if key == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, NORMAL))
            elif key == 3:
                rule |= dict(_fields(value))
        if rule.get(2) or rule[4]:
            raise ValueError("only models that leave characters and white space as they are can be streamed")
        return cls(pieces, scores, kinds, bool(rule[3]))

    def __post_init__(self) -> None:
        used = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        for i in used:
            node = self.trie
            for c in self.pieces[i]:
                node = node.setdefault(c, {})
            node.setdefault("", (self.scores[i], i))
        self.longest = max((len(self.pieces[i]) for i in used), default=1)
        self.unknown_score = min((self.scores[i] for i in used), default=0.0) - UNKNOWN_PENALTY
        self.unknown = self.kinds.index(UNKNOWN)
        byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.bytes = byte if len(byte) == 256 else None
        self.raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        pairs = {(a, b) for i in used for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)}
        self.joined = np.zeros(1 << 22, bool)  # pairs that some piece has, by hash: one too many only costs time
        if pairs:
            a, b = (np.array([ord(p[k]) for p in pairs], np.uint64) for k in (0, 1))
            self.joined[_pair(a, b)] = True

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * _U(0x9E3779B97F4A7C15) + b) * _U(0xBF58476D1CE4E5B9) >> _U(42)).astype(np.int64)


def stream(model: Model, chars: Iterable[str], check: int = 64) -> Iterator[list[int]]:
    """Committed ids, as the characters come. Ties go to the piece that starts first.

    A position is settled once `longest` characters after it are known. Held are the open
    positions' scores and backpointers since the last boundary that all paths share.
    """
    source, longest, unknown = iter(chars), model.longest, model.unknown_score
    text: list[str] = []  # since the boundary
    ended = False
    score: list[float] = [0.0]
    back: list[tuple[int, int] | None] = [None]
    at = reach = 0
    low = float("-inf")

    def path(upto: int) -> list[int]:
        out: list[int] = []
        while upto:
            start, piece = back[upto]
            out += model.spell(text[start])[::-1] if piece < 0 else [piece]
            upto = start
        return out[::-1]

    while True:
        while not ended and len(text) < at + longest:
            char = next(source, None)
            if char is None:
                ended = True
            else:
                text.append(char)
        if reach == at and at:  # no piece reaches beyond: the one boundary of all paths
            yield path(at)
            del text[:at]
            score, back, at, reach = [0.0], [None], 0, 0
            continue
        if at == len(text):
            return
        if at and at % (check * longest) == 0:
            ends = {k for k in range(at, len(back)) if back[k] is not None}
            while len(ends) > 1:  # the farthest steps back, until all paths have met
                far = max(ends)
                ends = (ends - {far}) | {back[far][0] if back[far] else 0}
            shared = ends.pop() if ends else 0
            if shared:
                yield path(shared)
                base = score[shared]
                del text[:shared], score[:shared]
                score = [s - base for s in score]
                back = [None, *[None if b is None else (b[0] - shared, b[1]) for b in back[shared + 1 :]]]
                at, reach = at - shared, reach - shared
        here, node, end, single = score[at], model.trie, at, False
        while end < len(text):
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            if "" in node:
                value, piece = node[""]
                single |= end == at + 1
                while len(score) <= end:
                    score.append(low)
                    back.append(None)
                if here + value > score[end]:
                    score[end], back[end] = here + value, (at, piece)
                reach = max(reach, end)
        if not single:
            while len(score) <= at + 1:
                score.append(low)
                back.append(None)
            if here + unknown > score[at + 1]:
                score[at + 1], back[at + 1] = here + unknown, (at, -1)
            reach = max(reach, at + 1)
        at += 1


class Coder:
    """Encodes and decodes batches of texts with a cache of at most `most` parts."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = self.size = self.begin = self.end = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.spelling = np.zeros(0, np.uint8)

    def plain(self, joined: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, without the cache."""
        each = [[i for part in stream(self.model, joined[a:b]) for i in part] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        prefix = SPACE if self.model.dummy_prefix else ""
        whole = [(prefix + t.replace(" ", SPACE)) if t else "" for t in texts]
        length = np.array([len(t) for t in whole], np.int64)
        joined = "".join(whole)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.model.joined[_pair(points[:-1], points[1:])]
        begins[(np.cumsum(length) - length)[length > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))[: len(start)]
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint8)
        code, distinct = pd.factorize(kernel.hash_spans(data, 4 * start, 4 * end))
        some = np.zeros(len(distinct), np.int64)
        some[code[::-1]] = np.arange(len(code))[::-1]  # a place of each part
        cuts = np.concatenate([[0], np.cumsum(length)])
        if not kernel.equal_spans(data, 4 * start, 4 * end, data, 4 * start[some][code], 4 * end[some][code]).all():
            return self.plain(joined, cuts)
        if len(self.keys) + len(distinct) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        known, at = place[~new], some[~new]
        if not kernel.equal_spans(data, 4 * start[at], 4 * end[at], self.spelling, self.begin[known], self.end[known]).all():
            return self.plain(joined, cuts)
        if new.any():
            at = some[new]
            found = [[i for part in stream(self.model, joined[a:b]) for i in part] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            size = np.array([len(f) for f in found], np.int64)
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            letters = 4 * (end[at] - start[at])
            begin = np.concatenate([self.begin, len(self.spelling) + np.cumsum(letters) - letters])
            self.begin, self.end = begin[order], (begin + np.concatenate([self.end - self.begin, letters]))[order]
            self.spelling = np.concatenate([self.spelling, data[kernel.span_places(4 * start[at], letters)]])
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.keys, self.flat = keys[order], np.concatenate([self.flat, np.array([i for f in found for i in f], np.uint32)])
            place = np.searchsorted(self.keys, distinct)
        n = self.size[place][code]
        upto = np.cumsum(n)
        ids = self.flat[kernel.span_places(self.first[place][code], n)]
        through = np.concatenate([[0], upto])[np.searchsorted(start, cuts)]
        return ids, np.diff(through)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.model.raw
        text = b"".join([raw[i] if i < len(raw) else "\ufffd".encode() for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    """One for each Python worker: later tasks find its cache filled."""
    return Coder(Model.load(path))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, token_ids (little-endian unsigned 32-bit), round_trip for each row.

    A null or empty text has no ids. round_trip says whether the ids decode to the text; they
    don't where a text has the piece file's own mark for a space. Repeated rows and null doc_ids
    each give a row; texts of any length are encoded whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path)
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                texts = [t or "" for t in part["text"].to_pylist()]
                ids, n = coder.encode(texts)
                ends = np.cumsum(n)
                each = np.split(ids, ends[:-1])
                same = [coder.decode(i) == t for i, t in zip(each, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), pa.array([i.astype("<u4").tobytes() for i in each], pa.binary()), pa.array(same)], names=["doc_id", "n_ids", "token_ids", "round_trip"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, token_ids binary, round_trip boolean")


def decode_pieces(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for each row of doc_id, token_ids; null ids give a null text, an id beyond the table the replacement character.

    Bytes after the last whole id of four bytes don't count. Repeated rows and null doc_ids each
    give a row; no ids give an empty text; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path)
        for batch in batches:
            texts = [None if (v := i.as_py()) is None else coder.decode(np.frombuffer(v[: len(v) // 4 * 4], "<u4")) for i in batch["token_ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(coded, "doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
