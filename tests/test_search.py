"""Nearest neighbours against plain numpy, in one block of queries and in several."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convoy.functions import text
from convoy.operators import search


def table(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vector array<double>")


@pytest.mark.parametrize("block", [1000, 7])
def test_neighbours(spark, block):
    rng = np.random.default_rng(5)
    corpus = rng.integers(-3, 4, size=(60, 8)).astype(float)
    corpus[10] = corpus[40]
    corpus[20] = 0
    wanted = rng.integers(-3, 4, size=(15, 8)).astype(float)
    found = search.cosine_neighbours(table(spark, wanted), table(spark, corpus).repartition(5), 60, "id", "id", query_block=block, corpus_block=16)
    rows = {(r.query_id, r.place): (r.item_id, r.distance) for r in found.collect()}
    assert len(rows) == 15 * 60
    for q, vector in enumerate(wanted):
        expected = []
        for i, item in enumerate(corpus):
            norm = np.sqrt((vector @ vector) * (item @ item))
            expected.append((round(1 - vector @ item / norm, 9), i) if norm > 0 else (np.inf, i))
        for place, (distance, item) in enumerate(sorted(expected), start=1):
            got_item, got = rows[(q, place)]
            assert got_item == item
            assert got is None if distance == np.inf else got == pytest.approx(distance, abs=1e-9)


def test_no_queries_or_no_corpus(spark):
    some, none = table(spark, np.ones((3, 4))), table(spark, np.ones((0, 4)))
    assert search.cosine_neighbours(none, some, 2, "id", "id").collect() == []
    assert search.cosine_neighbours(some, none, 2, "id", "id").collect() == []


def test_similar_text_is_closer_and_catalogue_upserts(spark):
    entries = spark.createDataFrame(
        [("P0217", "Engine coolant over-temperature condition"), ("P0524", "Engine oil pressure too low"), ("P0700", "Transmission control system")],
        "code string, description string",
    )
    catalogue = search.upsert_catalogue(None, entries, "code", "description")
    numbered = catalogue.withColumn("id", F.when(F.col("code") == "P0524", 2).when(F.col("code") == "P0217", 1).otherwise(3))
    query = search.hashed_vectors(spark.createDataFrame([(9, "low oil pressure")], "q long, text string"), "q", "text")
    best = search.cosine_neighbours(query, numbered, 1, "q", "id").first()
    assert best["item_id"] == 2
    changed = spark.createDataFrame([("P0700", "new text"), ("P9", "added")], "code string, description string")
    after = {r.code: r.description for r in search.upsert_catalogue(catalogue, changed, "code", "description").collect()}
    assert after == {"P0217": "Engine coolant over-temperature condition", "P0524": "Engine oil pressure too low", "P0700": "new text", "P9": "added"}


def test_tiles_are_few_and_large():
    """Rows sent are n x (tiles of the other side): about n ** 1.5 or less, where blocks of 128 and 256 sent n ** 2 / 85."""
    for n in (100_000, 600_000):
        q, c = search._tiles(n, n, 64, 12, 128, 256)
        assert 48 <= q * c and n / q * 64 * 8 <= search.TILE_BYTES and n / c * 64 * 8 <= search.TILE_BYTES
        assert q + c < 24
    assert search._tiles(200, 3_000_000, 384, 12, 2048, 8192)[0] == 1


def test_many_equal_distances(spark):
    """Copies in all blocks, opposite and zero vectors, against all distances sorted; a pair's matrix is in memory in parts."""
    rng = np.random.default_rng(7)
    corpus = np.repeat(rng.integers(-2, 3, size=(150, 6)), 8, axis=0)[rng.permutation(1200)].astype(float) * rng.integers(1, 5, size=(1200, 1))
    corpus[::97] = 0
    ids = rng.permutation(5000)[:1200]
    rows = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, corpus)], "id long, vector array<float>")
    found = search.cosine_neighbours(rows, rows, 9, "id", "id", digits=6, skip_self=True, query_block=50, corpus_block=70).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((np.inf if r.distance is None else r.distance, r.item_id))
    norms = np.sqrt(np.outer((corpus**2).sum(axis=1), (corpus**2).sum(axis=1)))
    with np.errstate(invalid="ignore"):
        distance = np.where(norms > 0, np.round(1 - corpus @ corpus.T / norms, 6) + 0.0, np.inf)
    for q, query in enumerate(ids):
        expected = sorted((d, int(i)) for d, i in zip(distance[q], ids) if i != query)[:9]
        assert got[query] == expected


def test_narrow_keeps_values():
    for values in ([1.0, -3.0], [0.5, 0.1], [float(np.float32(0.1))], [1e300], [40000.0], [float("nan")]):
        matrix = np.array([values])
        assert np.array_equal(search._narrow(matrix).astype(float), matrix, equal_nan=True)


def test_texts_are_hashed_a_few_at_a_time(spark):
    """A whole batch of texts had all its vectors in memory several times."""
    texts = [None if i % 50 == 0 else f"Word{i} word{i % 7} 12-{i % 3}" * (i % 4) for i in range(text.ROWS * 3 + 5)]
    parts = list(text.vectors_of(pa.array(texts), False))
    assert [len(p) for p in parts] == [text.ROWS] * 3 + [5]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    found = {r.id: r.vector for r in search.hashed_vectors(rows, "id", "t", normalise=False).collect()}
    for i, value in enumerate(texts):
        expected = [0.0] * 384
        for token in re.findall("[a-z0-9]+", (value or "").lower()):
            x = int(hashlib.sha256(token.encode()).hexdigest(), 16) % 768
            expected[x % 384] += 1 if x < 384 else -1
        assert found[i] == expected
