import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.engine_queries.QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    place = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(type(v)) if v is None else v) for v in r)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=key)


def test_stream_takes_the_whole_table(spark, duck):
    acks = entry.queries()["stream_upsert"](spark, SF).collect()
    assert sorted((r.idempotency_key, r.applied, r.n_errors) for r in acks) == sorted(duck.sql("SELECT 'k' || vec_id // 1000, count(*), 0 FROM embeddings GROUP BY 1").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("n", [0, 1, 5, 7, 4099, 5001])
def test_fleet_totals_of_any_size(spark, duck, tmp_path, n):
    """The SQL shows all sizes in KiB, halves to the even digit."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array([[1.0]] * n, pa.list_(pa.float32())), "label": pa.array([None if i == 2 else i % 3 for i in range(n)], pa.int32())}), tmp_path / "embeddings.parquet")
    got = entry.queries()["fleet_totals"](spark, str(tmp_path)).select("collections", "vectors", "bytes", "shown").collect()
    assert [tuple(r) for r in got] == duck.sql(entry.oracle_sql()["fleet_totals"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")).fetchall()


def test_knn_text_embeds_each_document_once(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), entry.engine_queries.embed_text

    def counted(df, key, *rest, **named):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        out = plain(df, key, *rest, **named)
        return out.mapInArrow(run, out.schema) if key == "doc_id" else out

    monkeypatch.setattr(entry.engine_queries, "embed_text", counted)
    entry.queries()["knn_text"](spark, SF).collect()
    assert made.value == plain(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", 128).count()
