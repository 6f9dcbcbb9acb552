"""Queries on text and vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import search
from convoy.plans import derive as d
from convoy.plans.registry import query


def _slots(table: str, key: str) -> str:
    """(key, bucket, weight) in SQL: the digest's hex digits are summed in chunks of 15."""
    parts = " + ".join(f"CAST('0x' || substr(g, {i}, 15) AS BIGINT) % 3" for i in (1, 16, 31, 46, 61))
    return f"""SELECT {key}, x % 384 AS bucket, CAST(sum(CASE WHEN x < 384 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM (
      SELECT {key}, a + 256 * (((b - a) % 3 + 3) % 3) AS x FROM (
        SELECT {key}, CAST('0x' || substr(g, 63, 2) AS BIGINT) AS a, ({parts}) % 3 AS b FROM (
          SELECT {key}, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS g FROM {table}))) GROUP BY ALL"""


@query("hash_embed", "O-VEC-1",
       sql=f"""WITH w AS ({_slots('documents', 'doc_id')}), n AS (SELECT doc_id, sqrt(sum(weight * weight)::DOUBLE) AS norm FROM w GROUP BY doc_id)
               SELECT doc_id, bucket, round(weight / norm, 12) AS value FROM w JOIN n USING (doc_id) WHERE weight <> 0""")
def hash_embed(spark, sf_dir):
    vectors = search.hashed_vectors(d.spread(d.table(spark, sf_dir, "documents")), "doc_id", "text")
    long = vectors.select("doc_id", F.posexplode("vector").alias("bucket", "value")).filter("value <> 0")
    return long.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 12).alias("value"))


@query("kb_search", "O-VEC-2", "O-TOP-7", "O-JOIN-12",
       sql=f"""WITH dw AS ({_slots('documents', 'doc_id')}), qw AS ({_slots('benchmark', 'item_id')}),
       dn AS (SELECT doc_id, sum(weight * weight) AS n FROM dw GROUP BY doc_id), qn AS (SELECT item_id, sum(weight * weight) AS n FROM qw GROUP BY item_id),
       dots AS (SELECT item_id, doc_id, sum(qw.weight * dw.weight) AS dot FROM qw JOIN dw USING (bucket) GROUP BY ALL),
       ds AS (SELECT qn.item_id AS query_id, dn.doc_id AS item_id, round(1 - coalesce(dot, 0)::DOUBLE / sqrt(qn.n::DOUBLE * dn.n::DOUBLE), 9) AS distance
              FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS place FROM ds) SELECT * FROM r WHERE place <= 5""")
def kb_search(spark, sf_dir):
    corpus = search.hashed_vectors(d.spread(d.table(spark, sf_dir, "documents")), "doc_id", "text", normalise=False)
    wanted = search.hashed_vectors(d.table(spark, sf_dir, "benchmark"), "item_id", "text", normalise=False)
    return search.cosine_neighbours(wanted, corpus, 5, "item_id", "doc_id")


_DENSE_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
   ds AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(1 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS distance
          FROM v a JOIN v b ON a.vec_id <> b.vec_id),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS place FROM ds) SELECT * FROM r WHERE place <= 5"""


@query("knn_dense", "O-VEC-2", sql=_DENSE_SQL)
def knn_dense(spark, sf_dir):
    rows = d.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return search.cosine_neighbours(rows, rows, 5, "vec_id", "vec_id", digits=6, skip_self=True)


@query("knn_blocks", "O-VEC-2", sql=_DENSE_SQL)
def knn_blocks(spark, sf_dir):
    """The same search in many small blocks of queries and corpus rows."""
    rows = d.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return search.cosine_neighbours(rows, rows, 5, "vec_id", "vec_id", digits=6, skip_self=True, query_block=128, corpus_block=256)
