import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.functions import codec, formats, hashing
from sparkvane.functions.distance import cosine_distance, distance, dot_product, l2_squared, normalised, shown, squared_norm, unit_cosine
from sparkvane.functions.text import embed_slots, embed_text

A, B = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 3.0, 4.0, 5.0, 6.0]


@pytest.fixture
def pair(spark):
    return lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


def test_distances(pair):
    a, b = F.col("a"), F.col("b")
    row = pair(A, B).select(l2_squared(a, b), dot_product(a, b), cosine_distance(a, a), distance(a, b, "dot"), squared_norm(a)).first()
    assert row[0] == 5 and row[1] == 70 and abs(row[2]) < 1e-5 and row[3] == -70 and row[4] == 55
    unit = pair(A, B).select(normalised(a).alias("a"), normalised(b).alias("b")).select(unit_cosine(a, b), squared_norm(a)).first()
    assert abs(unit[0] - (1 - 70 / math.sqrt(55 * 90))) < 1e-6 and abs(unit[1] - 1) < 1e-6


@pytest.mark.parametrize("a,b,metric", [([1.0], [1.0, 2.0], "l2"), ([0.0], [1.0], "cosine")])
def test_bad_pairs_are_errors(pair, a, b, metric):
    with pytest.raises(Exception, match="dimension|non-zero"):
        pair(a, b).select(distance(F.col("a"), F.col("b"), metric)).collect()
    with pytest.raises(ValueError):
        distance(F.col("a"), F.col("b"), "hamming")


def test_shown_has_no_negative_zero(spark):
    value = spark.range(1).select(shown(F.lit(-1e-9)).alias("x")).first().x
    assert value == 0 and math.copysign(1, value) == 1


def fnv(data, offset, prime, bits):
    h = offset
    for c in data:
        h = ((h ^ c) * prime) % 2**bits
    return h


def test_hashes(spark):
    keys = ["", "a", "tenant-17", "logical-shard/3", "18446744073709551615"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.fnv32(F.col("k")).alias("h32"), hashing.fnv64(F.col("k")).alias("h64"), hashing.route_shard(F.col("k"), 7).alias("s"), F.crc32(F.col("k").cast("binary")).alias("c")).collect()
    for r in rows:
        want = fnv(r.k.encode(), 14695981039346656037, 1099511628211, 64)
        assert r.h32 == fnv(r.k.encode(), 2166136261, 16777619, 32) and (r.h64.hi << 32 | r.h64.lo) == want and r.s == want % 7 and r.c == zlib.crc32(r.k.encode())


def embed(text, dimensions):
    text = unicodedata.normalize("NFKC", text.lower())
    words, w = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            w += c
        elif w:
            words, w = [*words, w], ""
    feats = words + [f"{a}::{b}" for a, b in zip(words, words[1:], strict=False)] + [f"#{x[i:i + 3]}" for x in words for i in range(len(x) - 2)]
    out = [0.0] * dimensions
    for f in feats:
        h = fnv([int.from_bytes(f.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(f), 2)], 2166136261, 16777619, 32)
        out[h % dimensions] += -1 if h >> 31 else 1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else None


def test_embedding(spark):
    texts = ["cache conscious vector search", "distributed consensus heartbeat", "Ünïcödé ﬁve ａｂｃ 12x", "a", "x y", "!!!", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.vector for r in embed_text(df, "i", "t", 128).collect()}
    for i, t in enumerate(texts):
        want = embed(t, 128)
        assert (i in got) == (want is not None)
        if want:
            assert np.allclose(got[i], want, atol=1e-6) and abs(sum(x * x for x in got[i]) - 1) < 1e-6
    assert got[0] != got[1]
    with pytest.raises(ValueError):
        embed_slots(df, "i", "t", 0)


def test_fp32_codec(spark):
    df = spark.createDataFrame([([1.5, -2.25],)], "v array<double>")
    raw = df.select(codec.encode_fp32(F.col("v"), 2).alias("r"))
    assert raw.first().r == b"\x00\x00\xc0?\x00\x00\x10\xc0"
    assert raw.select(codec.decode_fp32(F.col("r"), 2).alias("v")).first().v == [1.5, -2.25]
    for v, n in (([1.0], 2), ([float("nan"), 1.0], 2), ([None, 1.0], 2)):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(v,)], "v array<double>").select(codec.encode_fp32(F.col("v"), n)).collect()
    with pytest.raises(Exception, match="finite"):
        raw.select(codec.decode_fp32(F.col("r"), 3)).collect()


def seeded(dimensions, seed, cluster):
    state, out = (seed ^ ((cluster + 1) * 0x9E3779B1)) % 2**32, []
    for i in range(dimensions):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append((0.8 if i % 16 == cluster % 16 else 0) + (state / 0xFFFFFFFF - 0.5) * 0.35)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out]


def test_seeded_vectors(spark):
    one = codec.seeded_block(64, np.array([42]), np.array([3]))[0]
    assert np.allclose(one, seeded(64, 42, 3), atol=1e-12) and abs((one * one).sum() - 1) < 1e-12
    rows = codec.seeded_vectors(spark, 20, 8, 7, base=100).orderBy("id").collect()
    assert rows[17].id == 118 and rows[17].cluster == 1 and np.allclose(rows[17].vector, seeded(8, 25, 1), atol=1e-6)


def test_formats(spark):
    df = spark.createDataFrame([(512,), (2048,), (3 * 1024**2,), (5 * 1024**3,)], "n long")
    assert [r[0] for r in df.select(formats.format_bytes(F.col("n"))).collect()] == ["512 B", "2.0 KiB", "3.0 MiB", "5.0 GiB"]
    assert spark.range(1).select(formats.format_number(F.lit(1234567))).first()[0] == "1,234,567"
    texts = ["1", "0", "-1", "18446744073709551615", "18446744073709551616", "1.0", "", "007", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(formats.positive_uint64(F.col("t"))).collect()]
    assert [None if g is None else int(g) for g in got] == [1, None, None, 2**64 - 1, None, None, None, 7, None]
    names = spark.createDataFrame([("a-B_9",), ("",), ("a b",), ("x" * 129,), (None,)], "t string").select(formats.valid_name(F.col("t"))).collect()
    assert [r[0] for r in names] == [True, False, False, False, False]


def test_hash_counts_code_units(spark):
    """A letter beyond the basic plane is two surrogates, in the column, in the kernel and in plain arithmetic."""
    import numpy as np

    from sparkvane.functions import text as text_
    from sparkvane.functions.hashing import fnv32

    def plain(word):
        h = 2166136261
        for unit in np.frombuffer(word.encode("utf-16-le"), "<u2").tolist():
            h = (h ^ unit) * 16777619 % 2**32
        return h

    words = ["a", "é", "日本", "𝒳y", "😀", "x𐐀z"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv32(rows_col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: plain(w) for w in words}
    assert text_._hash_words(words).tolist() == [plain(w) for w in words]
    assert text_._code_units(chr(0x10400) + "z") == chr(0xD801) + chr(0xDC00) + "z" and text_._code_units("ab") == "ab"


def rows_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_embedding_equals_plain_arithmetic(monkeypatch):
    """Words, pairs and parts of UTF-16 code units, wherever texts are cut into pieces; the parts of letters beyond the basic plane differ."""
    import random
    import re

    from sparkvane.functions import text as text_

    def plain(t, d):
        words = [np.frombuffer(w.encode("utf-16-le"), "<u2").tolist() for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", (t or "").lower()))]
        out = np.zeros(d)
        for f in words + [[*a, 58, 58, *b] for a, b in zip(words, words[1:], strict=False)] + [[35, *w[i : i + 3]] for w in words for i in range(len(w) - 2)]:
            h = fnv(f, 2166136261, 16777619, 32)
            out[h % d] += -1 if h >> 31 else 1
        return out / (math.sqrt(out @ out) or 1)

    r = random.Random(5)
    letters = ["a", "b", "Z", "é", "ﬁ", "日", chr(0x10400), chr(0x1D4B3), chr(0x1F600), "_", " ", " ", ":", "\n", "\0", "İ", "Σ", "٣", "²", "e\u0301", "x" * 70]
    texts = [None, "", "ab", "a" * 500 + " b", chr(0x10400) * 3] + ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(200)]
    want = np.array([plain(t, 64) for t in texts])
    for piece, few, block in ((1 << 16, 48, 1 << 20), (1, 2, 50), (7, 0, 300)):
        monkeypatch.setattr(text_, "PIECE", piece), monkeypatch.setattr(text_, "FEW", few), monkeypatch.setattr(text_, "BLOCK_UNITS", block)
        got, ok = text_.embed_block(texts, 64, "f8")
        assert (got == want).all() and (ok == want.any(1)).all()
