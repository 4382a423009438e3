import zlib

import numpy as np
from pyspark.sql import types as T

from sparkvane.llm.chroma import HOP, WIDTH, align, bit_errors, chroma, fingerprint, fingerprints, render

NOTES = np.random.default_rng(4)


def tune(seed, n=80):
    r = np.random.default_rng(seed)
    t = np.arange(512) / 4000
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in r.integers(0, 24, n)])


def test_pitch_classes_and_lengths():
    t = np.arange(4096) / 4000
    assert chroma(9000 * np.sin(2 * np.pi * 440 * t)).argmax(1).tolist() == [0] * 15
    assert chroma(9000 * np.sin(2 * np.pi * 523.25 * t)).argmax(1).tolist() == [3] * 15
    assert len(fingerprint(np.zeros(100))) == 0 and len(fingerprint(np.zeros(512 + HOP * 20))) == 21 - WIDTH + 1


def test_noise_and_level_change_few_bits():
    a = tune(1)
    plain = fingerprint(a)
    noisy = fingerprint(0.3 * a + NOTES.normal(0, 40, len(a)))
    other = fingerprint(tune(2))
    share = lambda x, y: bit_errors(x, y, 0)[0] / (32 * bit_errors(x, y, 0)[1])
    assert share(plain, noisy) < 0.06 < 0.2 < share(plain, other)
    late = fingerprint(a[HOP * 30 :])
    assert bit_errors(plain, late, 30) == (0, len(late))


def links(codes, every=20, most=0.1, least=16):
    """Every query class against every other class, at all offsets: (class, n_links, (best_id, best_offset)) of each recording."""
    name = {}
    for i in sorted(codes):
        name[i] = next((k for k in sorted(codes) if codes[k].tobytes() == codes[i].tobytes()), i) if len(codes[i]) else i
    out = {}
    for i in codes:
        if i % every:
            out[i] = (name[i], None, None)
            continue
        a, found = codes[name[i]], []
        for k in set(name.values()) - {name[i]}:
            tried = [(e / (32 * n), k, o) for o in range(least - len(codes[k]), len(a) - least + 1) for e, n in [bit_errors(a, codes[k], o)] if n >= least and e <= most * 32 * n]
            found += [min(tried)] if tried else []
        out[i] = (name[i], len(found), min(found)[1:] if found else None)
    return out


def brute(rows):
    return links({i: fingerprint(np.frombuffer((p or b"")[: len(p or b"") // 2 * 2], "<i2").astype(float)) for i, p in rows if i is not None})


def told(df):
    return {r.rec_id: (r.class_id, r.n_links, (r.best_id, r.best_offset) if r.best_id is not None else None) for r in df.collect()}


def test_align_against_brute_force(spark):
    pcm = lambda x: x.astype("<i2").tobytes()
    base = [tune(s) for s in range(12)]
    rows = [(i, pcm(base[i % 12])) for i in range(0, 40)] + [(100 + i, pcm(base[i][HOP * 9 :])) for i in range(12)] + [(200 + 20 * i, pcm(base[i] + NOTES.normal(0, 60, len(base[i])))) for i in range(12)]
    rows += [(500, None), (501, b""), (502, b"abc"), (503, pcm(np.zeros(9000))), (520, pcm(np.zeros(9000))), (540, pcm(np.zeros(12000))), (None, pcm(base[0])), (0, pcm(base[0]))]
    media = spark.createDataFrame([(*r, 1) for r in rows], T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("pcm", T.BinaryType()), T.StructField("code", T.IntegerType())]))
    prints = fingerprints(media)
    want = brute(dict(r for r in rows).items())
    got = align(prints).collect()
    loose = lambda found: {i: (c, n, best if best and i < 503 else best and best[0]) for i, (c, n, best) in found.items()}  # silence fits at many offsets
    assert loose(told(align(prints))) == loose(want)
    assert len(got) == len(want) and sum(bool(w[1]) for w in want.values()) >= 12
    code = {r.rec_id: r.code for r in prints.collect()}
    assert all(r.n_ints * 4 == len(code[r.rec_id]) and r.code_crc32 == zlib.crc32(code[r.rec_id]) for r in got)
    assert told(align(prints, block_bytes=400)) == told(align(prints))
    assert align(prints.limit(0)).count() == 0


def test_crowded_words_count_too(spark):
    """Recordings that share runs of few integers alone: the size of a block changes nothing."""
    r = np.random.default_rng(8)
    shared = [r.integers(0, 2**32, 3, dtype=np.uint32) for _ in range(4)]
    base, rows = r.integers(0, 2**32, 40, dtype=np.uint32), []
    for i in range(0, 60):
        code = base ^ (np.uint32(1) << r.integers(0, 32, 40, dtype=np.uint32))
        for k, s in enumerate(shared):
            code[k * 10 + 2 : k * 10 + 5] = s
        rows.append((i, np.roll(code, 0)[i % 3 :].astype("<u4").tobytes()))
    prints = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "rec_id long, code binary")
    got = [sorted(map(tuple, align(prints, block_bytes=c).collect())) for c in (100, 400, 1 << 20)]
    assert got[0] == got[1] == got[2] and got[0][0][4] == 59


def test_rendered_vectors(spark):
    rows = [(0, [0.1, 0.2] * 32), (1, [0.1, 0.2] * 32), (2, None), (3, [None, float("nan"), 0.5]), (20, [0.3, 0.9, 0.05, 0.61] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.rec_id: r for r in align(fingerprints(render(df))).collect()}
    assert got[1].class_id == 0 and got[0].n_links == 0 and got[2].n_ints == got[3].n_ints == 0 and got[20].class_id == 20


def test_recall_of_noisy_copies_against_all_offsets(spark):
    """Copies whose bits are flipped evenly, up to the share that links, cut at either end; strangers beside them."""
    r = np.random.default_rng(11)
    codes = {i: r.integers(0, 2**32, 48, dtype=np.uint32) for i in range(0, 40)}
    for i in range(240):
        base, share = codes[i % 40], r.uniform(0, 0.11)
        noise = (r.random((48, 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
        codes[1000 + i] = (base ^ noise.astype(np.uint32))[r.integers(0, 20) :][: r.integers(24, 49)]
    want = links(codes, every=5)
    rows = spark.createDataFrame([(i, bytearray(c.astype("<u4").tobytes())) for i, c in codes.items()], "rec_id long, code binary")
    got = told(align(rows, every=5))
    asked = [i for i in codes if i % 5 == 0]
    found, there = sum(got[i][1] for i in asked), sum(want[i][1] for i in asked)
    assert all(got[i][1] <= want[i][1] for i in asked) and there > 150 and found / there >= 0.95
    assert np.mean([got[i][2] == want[i][2] for i in asked]) > 0.95


def test_query_over_its_table(spark):
    from sparkvane.llm.queries import QUERIES

    got = told(QUERIES["op5_chroma"](spark, "/root/testdata/sf0.001"))
    code = {r.rec_id: np.frombuffer(r.code, "<u4") for r in fingerprints(render(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))).collect()}
    assert got == links(code)
