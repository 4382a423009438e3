import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkvane.llm.packing import CachedTokenizer, Room, best_fit, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_what_a_linear_search_gives(lengths):
    rooms: list[int] = []
    at, n = best_fit(lengths, 50)
    fill = [0] * n
    for i, w in enumerate(at):
        fill[w] += lengths[i]
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(50 - x)
    assert sorted(50 - f for f in fill) == sorted(rooms)


def test_room_takes_the_tightest():
    room = Room(100)
    for w, r in enumerate([7, 30, 30, 99]):
        room.add(r, w)
    assert room.take(8)[0] == 30 and room.take(8)[0] == 30 and room.take(8) == (99, 3) and room.take(8) is None and room.take(7) == (7, 0)


@settings(max_examples=60)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=40))
def test_pieces_cover_each_id_once_without_gaps(lengths):
    pieces = pack(np.array(lengths), 64, 4)
    seen = [np.zeros(n, int) for n in lengths]
    by_sequence = {}
    for doc, start, n, sequence, offset in pieces:
        assert n > 0
        seen[doc][start : start + n] += 1
        by_sequence.setdefault(sequence, []).append((offset, n))
    assert all((s == 1).all() for s in seen)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64 and (64 - at <= 4 or at & (at - 1) == 0)


TEXTS = ["", None, "Hello, it's 2024!\n\tÉcole’s <|endoftext|> a<|startoftext|>b", "á ́b c d\u0085e f\x1cg\x0bh\x0ci", "ΣΑΣ ÀÉ İstanbul ﬁne", "日本語 テキスト 😀👍🏽 'Re 'LL", "x" * 5000, " lead and trail "]


def test_word_cache_gives_the_tokenizers_ids():
    r, plain = random.Random(1), Tokenizer.from_file(PATH)
    texts = TEXTS + ["".join(r.choice("aB'st lé́ \n.9<|>日😀 ") for _ in range(60)) for _ in range(300)]
    coder = CachedTokenizer(PATH, most=50)
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        ids, n = coder.ids(pa.array(part, pa.string()), 2)
        want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in part]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("block", [200, 8_000_000])
def test_documents_against_brute_force(docs, clashing, odd, block):
    rows = odd + [(100 + i, t) for i, t in enumerate(TEXTS)]
    plain = Tokenizer.from_file(PATH)
    want = {}
    for i, t, *_ in rows:
        want.setdefault((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1), []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    for df in (docs(rows), clashing(rows)):
        got = pack_documents(df, PATH, block_tokens=block).collect()
        total = 0
        for p in got:
            ids = np.frombuffer(p.token_ids, "<u4").tolist()
            assert len(ids) == p.length and any(w[p.start : p.start + p.length] == ids for w in want[p.doc_id, p.doc_tokens])
            total += p.length
        assert total == sum(len(w) for ws in want.values() for w in ws)
        fill = {}
        for p in got:
            fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for held in fill.values():
            assert sum(n for _, n in held) == max(o + n for o, n in held) <= 4096
    assert pack_documents(docs([]), PATH).count() == 0


def test_query_reads_all_documents(spark):
    from sparkvane.llm.queries import QUERIES

    got = QUERIES["op1_pack"](spark, "/root/testdata/sf0.001").collect()
    plain = Tokenizer.from_file(PATH)
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sum(p.length for p in got) == sum(map(len, want.values()))
    for p in got:
        part = np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(want[p.doc_id])
    used = {}
    for p in got:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values())
    assert padding < 0.01 * sum(used.values())


def cancelling(n):
    """Two words of letters whose polynomial hashes modulo 2^64 are equal."""
    a = "ab"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n], a[:n].translate(str.maketrans("ab", "ba"))


def test_words_that_differ_have_their_own_ids():
    coder, plain = CachedTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = [t for n in (1024, 2048, 4096) for t in cancelling(n)]
    ids, n = coder.ids(pa.array(texts), 2)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_equal_hashes_are_told_by_bytes(monkeypatch):
    """With a hash that says little, every batch is still right: within it, and against the cache."""
    from sparkvane.llm import kernel

    monkeypatch.setattr(kernel, "hash_spans", lambda data, start, end, family=0: (end - start).astype(np.uint64))
    coder, plain = CachedTokenizer(PATH), Tokenizer.from_file(PATH)
    for texts in (["one three", "a bb ccc"], ["two", "x yy zzz"], ["abc abd", ""], ["a", "b", "abc"]):
        ids, _ = coder.ids(pa.array(texts), 2)
        assert ids.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 2]]


def test_tokenizers_that_cannot_be_split(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert CachedTokenizer(PATH).splits and not CachedTokenizer(path).splits
    rows, plain = [(1, "Hello  world, again."), (2, None), (3, "É x")], Tokenizer.from_file(path)
    got = {}
    for r in sorted(pack_documents(docs(rows), path).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.token_ids, "<u4").tolist()
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
