import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvane.llm import kernel
from sparkvane.llm.common import BATCH_BYTES, Stage, pick, shared_dir, staged_settings

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_pick_takes_exact_names(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS A, 3 AS b, 4 AS b, 5 AS `x.y`")
    assert pick(df, "A", "x.y").collect()[0].asDict() == {"A": 2, "x.y": 5}
    with pytest.raises(ValueError):
        pick(df, "c")


def test_settings_hold_for_staged_writes_alone(spark):
    old = spark.conf.get(KEY)
    try:
        for given_, kept in (("1g", str(BATCH_BYTES)), ("4m", "4m"), ("9000000", str(BATCH_BYTES)), ("1000b", "1000b")):
            spark.conf.set(KEY, given_)
            with staged_settings(spark):
                assert spark.conf.get(KEY).rstrip("b") == kept.rstrip("b") and spark.conf.get(CLEANUP) == "true"
            assert spark.conf.get(KEY).rstrip("b") == given_.rstrip("b") and spark.conf.get(CLEANUP) == "false"
            Stage(spark, "t").put(spark.range(5).repartition(2))
            assert spark.conf.get(KEY).rstrip("b") == given_.rstrip("b")
    finally:
        spark.conf.set(KEY, old)


def test_stage_keeps_what_it_is_told(spark):
    stage = Stage(spark, "t")
    a, b = stage.put(spark.range(5)), stage.put(spark.range(3).select(F.col("id").cast("string")))
    stage.only(b)
    assert b.count() == 3 and len(stage.held) == 1 and shared_dir(spark)
    with pytest.raises(Exception):
        a.count()


@given(st.lists(st.one_of(st.none(), st.text("aB é日\t\n ,.", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_and_slices(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], names=["text", "i"])
    parts = list(kernel.slices(batch, "text", limit))
    assert [x for p in parts for x in p["i"].to_pylist()] == list(range(len(texts)))
    for part in parts:
        words = kernel.words_of(part["text"], kernel.NOT_SPACE)
        found = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
        want = [(t or "").replace("\x0b", " ").split() for t in part["text"].to_pylist()]
        assert found == [w for x in want for w in x] and words.count.tolist() == [len(x) for x in want]
        code, whole = kernel.runs(words, 3)
        at = 0
        for x in want:
            for k in range(len(x)):
                if at + k < len(code):
                    assert whole[at + k] == (k + 3 <= len(x))
            at += len(x)


def thue_morse(n, letters="ab"):
    """A word and its complement: their polynomial hashes modulo 2^64 are equal from about 1,024 letters on, whatever the base."""
    out = "ab"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return [out[:n].translate(str.maketrans(x, "".join(letters))) for x in ("ab", "ba")]


@pytest.mark.parametrize("n", [7, 8, 9, 16, 17, 1024, 2048, 4096])
def test_hashes_part_patterns_of_letters(n):
    for letters in ("ab", "eo", "xé"):
        pair = thue_morse(n, letters)
        for family in range(6):
            h = kernel.words_of(pa.array([" ".join(pair), pair[1]]), kernel.NOT_SPACE, family=family).hash
            assert h[0] != h[1] and h[1] == h[2]
    codes = np.array([3, 5], np.uint64)
    a, b = (np.array([codes["ab".index(c)] for c in x]) for x in thue_morse(n))
    assert kernel.chain(a, n)[0] != kernel.chain(b, n)[0]


@given(st.lists(st.text("abé", min_size=1, max_size=20), min_size=1, max_size=20), st.integers(0, 5))
def test_spans_are_compared_by_bytes(found, family):
    words = kernel.words_of(pa.array([" ".join(found)]), kernel.NOT_SPACE, family=family)
    n = len(found)
    x, y = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    same = kernel.equal_spans(words.data, words.start[x], words.end[x], words.data, words.start[y], words.end[y])
    assert same.tolist() == [a == b for a in found for b in found]
    assert (words.hash[x] == words.hash[y]).tolist() == same.tolist()
    assert kernel.word_bytes(words).to_pylist() == [w.encode() for w in found]


def test_hashes_depend_on_words_alone():
    a = kernel.words_of(pa.array(["x yy zzz", "zzz x"]), kernel.NOT_SPACE).hash
    b = kernel.words_of(pa.array(["  q zzz\tyy x"]), kernel.NOT_SPACE).hash
    assert a[0] == b[3] == a[4] and a[1] == b[2] and a[2] == b[1] == a[3] and len(set(b.tolist())) == 4
    up = kernel.words_of(pa.array(["Xy xY"]), kernel.NOT_SPACE, lower=True).hash
    assert up[0] == up[1] and np.unique(kernel.mix(np.arange(1000, dtype=np.uint64))).size == 1000
