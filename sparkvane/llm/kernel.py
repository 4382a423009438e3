"""Vectorised word kernels over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes of a class; every class used here holds all
bytes from 0x80 on or none of the ASCII separators, so cutting bytes and cutting
code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64

#: Words are runs of anything but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII digits, a-z and everything beyond ASCII.
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


#: Families of word hashes: two words that meet in one family are told apart by another.
_SALTS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of each span's bytes: every lane of eight bytes is mixed with its place before lanes are summed.

    Mixing isn't linear in the bytes, so no pattern of letters cancels as it does in polynomials modulo 2^64.
    """
    size = end - start
    salt = _SALTS[family]
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    code = mix(lanes[start] & _LOW_BYTES[np.minimum(size, 8)] ^ salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] + 7) // 8 - 1
        upto = np.cumsum(more)
        nth = np.arange(1, upto[-1] + 1) - np.repeat(upto - more, more)
        at = np.repeat(start[long], more) + 8 * nth
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        value = mix(mix(lanes[at] & _LOW_BYTES[left] ^ salt) + mix(nth.astype(np.uint64) * salt))
        code[long] += np.add.reduceat(value, upto - more)
    return mix(code + size.astype(np.uint64) * salt)


@dataclass
class Words:
    """Words of some texts: where each starts and ends in `data`, its text and its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, its first word; one more at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each (nulls: empty)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, letters: np.ndarray, lower: bool = False, family: int | None = 0, tail: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of each text. `family` is that of the hashes (None: no hashes). With `tail`, a last byte of its first class after one of its second is a word of its own."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = letters[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    if tail:
        at = np.flatnonzero(ends)
        at = at[tail[0][data[at]] & ~begins[at]]
        at = at[tail[1][data[at - 1]]]
        begins[at] = ends[at - 1] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    codes = np.zeros(0, np.uint64) if family is None else hash_spans(data, start, end, family)
    return Words(data, start, end, codes, first)


def span_places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members of the spans, one span after another."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - size), size)


def chain(code: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` successive codes from each place on, by doubling; each step mixes, so none is linear in the codes."""
    have, out = 1, code
    for bit in bin(length)[3:]:
        out = mix(out[: len(out) - have] * _SALTS[1] + out[have:] + _U(have))
        have *= 2
        if bit == "1":
            out = mix(out[: len(out) - 1] * _SALTS[3] + code[have : have + len(out) - 1] + _U(have))
            have += 1
    return out


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `length` words from each word on, and whether they lie in one text."""
    n = len(words.hash)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - length + 1)
    last = np.repeat(words.first[1:], words.count)  # the end of each word's text
    return chain(words.hash, length), at + length <= last[: n - length + 1]


def equal_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of `data` are those of the span of `other`."""
    size = end - start
    same = size == to - from_
    a, b = (np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), 0, (1,)) for x in (data, other))
    low = _LOW_BYTES[np.minimum(size, 8)]
    same[same] = (a[start[same]] & low[same]) == (b[from_[same]] & low[same])
    long = np.flatnonzero(same & (size > 8))
    if len(long):  # lane by lane
        more = (size[long] + 7) // 8 - 1
        upto = np.cumsum(more)
        step = 8 * (np.arange(1, upto[-1] + 1) - np.repeat(upto - more, more))
        left = _LOW_BYTES[np.minimum(np.repeat(size[long], more) - step, 8)]
        equal = (a[np.repeat(start[long], more) + step] & left) == (b[np.repeat(from_[long], more) + step] & left)
        same[long] = np.logical_and.reduceat(equal, upto - more)
    return same


def word_bytes(words: Words) -> pa.Array:
    """Each word's bytes."""
    size = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[span_places(words.start, size)]))])


def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _trimmer()


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside one another."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to
    tidy()


def unique_sorted(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where distinct (group, code) pairs stand, in their order."""
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (group[1:] != group[:-1]) | (code[1:] != code[:-1])
    return order[keep]
