"""The operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    coded = encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_ids", F.crc32("token_ids").alias("ids_crc32"), "round_trip")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import align, fingerprints, render

    return align(fingerprints(render(read(spark, sf_dir, "embeddings"))))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = read(spark, sf_dir, "documents")
    return identify(spark, docs, fit(docs))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    rows = read(spark, sf_dir, "embeddings")
    return exact_top_k(rows.where("vec_id % 100 = 0"), rows, 10)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, fit

    docs = read(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    placed = shard_documents(read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack, op2_pieces, op3_substrings, op4_licenses, op5_chroma, op6_language, op7_top_k, op8_personal_data, op9_shards, op10_jaccard)
}

ORACLE_SQL: dict[str, str] = {
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op3_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0 FROM g WINDOW o AS (PARTITION BY t ORDER BY doc_id, i)),
x AS (SELECT DISTINCT doc_id, i + k AS z FROM f, (SELECT unnest(range(0, 20)) AS k) WHERE d0 < doc_id OR i0 < i),
l AS (SELECT doc_id, list(z) AS gone FROM x GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, j: NOT list_contains(gone, j)) END AS kept
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM r JOIN l ON l.a = r.other OR l.b = r.other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = n.doc_id
""",
}
