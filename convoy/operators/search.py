"""Hashed text vectors and exact nearest neighbours by cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoy.functions.text import hashed_vector

QUERY_BLOCK = 2048
CORPUS_BLOCK = 8192
TILE_BYTES = 2**25  # of the rows of one side that meet in a task
_CELLS = 2**21  # of a matrix product that is in memory
_PACK_ROWS = 2048
_PACKED = "tile int, n int, width int, kind string, ids binary, vectors binary"
_ERROR = 1e-12  # of a cosine


def hashed_vectors(df: DataFrame, key: str, text: str, normalise: bool = True) -> DataFrame:
    """One vector of 384 numbers per text."""
    return df.select(key, hashed_vector(F.col(text), normalise).alias("vector"))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type that holds all its values."""
    with np.errstate(invalid="ignore", over="ignore"):
        for kind in (np.int16, np.float32):
            narrow = matrix.astype(kind)
            if (narrow == matrix).all():
                return narrow
    return matrix


def _packed(rows: DataFrame, tiles: int) -> DataFrame:
    """Rows (id, vector) as rows of many vectors, each within one of the ``tiles`` by the hash of its id."""

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _PACK_ROWS):
                part = batch.slice(start, _PACK_ROWS)
                ids, tile = part["id"].to_numpy(), part["tile"].to_numpy()
                vectors = part["vector"]
                matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
                order = np.argsort(tile, kind="stable")
                out = []
                for at in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
                    small = _narrow(matrix[at])
                    out.append((int(tile[at[0]]), len(at), matrix.shape[1], small.dtype.str, ids[at].tobytes(), small.tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["tile", "n", "width", "kind", "ids", "vectors"])

    return rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).mapInArrow(pack, _PACKED)


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in order of the ids."""
    ids = np.frombuffer(b"".join(frame["ids"]), dtype=np.int64)
    matrix = np.empty((len(ids), int(frame["width"].iloc[0])))
    at = 0
    for n, kind, vectors in zip(frame["n"], frame["kind"], frame["vectors"]):
        matrix[at : at + n] = np.frombuffer(vectors, dtype=kind).reshape(n, -1)
        at += n
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def _directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared lengths, rows of length one, and where there is none."""
    square = (matrix**2).sum(axis=1)
    none = ~(square > 0)
    return square, matrix / np.sqrt(np.where(none, 1, square))[:, None], none


def _nearest(query_ids, queries, corpus_ids, corpus, k: int, digits: int, skip_self: bool, query_block: int, corpus_block: int) -> pd.DataFrame:
    """The k best corpus rows per query: (distance, id) order, zero vectors last with NULL distance.

    ``corpus_ids`` ascend, so a later row must be nearer than the k-th best so far, by one unit of the last digit. Matrix
    products give the rows that can be; only of those the rounded distance is computed.
    """
    unit, keep = 10.0**-digits, k + (1 if skip_self else 0)
    query_square, query_direction, no_query = _directions(queries)
    square, direction, nowhere = _directions(corpus)

    def distances(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        step = max(1, _CELLS // max(1, queries.shape[1]))
        for i in range(0, len(row), step):
            r, c = row[i : i + step], column[i : i + step]
            norms = np.sqrt(query_square[r] * square[c])
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.round(1.0 - np.einsum("ij,ij->i", queries[r], corpus[c]) / norms, digits) + 0.0
            out[i : i + step] = np.where(norms > 0, d, np.inf)
        return out

    found = []
    height = max(1, min(query_block, _CELLS // min(corpus_block, max(1, len(corpus_ids)))))
    for top in range(0, len(query_ids), height):
        part = slice(top, top + height)
        need = np.full(len(query_ids[part]), -np.inf)
        pool, fresh = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)), []
        waiting = 0
        for left in range(0, len(corpus_ids), corpus_block):
            cosine = query_direction[part] @ direction[left : left + corpus_block].T
            cosine[no_query[part]] = -np.inf
            cosine[:, nowhere[left : left + corpus_block]] = -np.inf
            if left == 0 and keep < cosine.shape[1]:
                need = np.partition(cosine, -keep, axis=1)[:, -keep] - unit - _ERROR
            flat = np.flatnonzero(cosine >= need[:, None])
            if len(flat):
                row, column = np.divmod(flat, cosine.shape[1])
                row, column = row + top, column + left
                if skip_self:
                    other = query_ids[row] != corpus_ids[column]
                    row, column = row[other], column[other]
                fresh.append((row, column, distances(row, column)))
                waiting += len(row)
            if fresh and (left == 0 or waiting > 4 * k * len(need)):
                pool, need = _best(pool, fresh, top, len(need), k, unit)
                fresh, waiting = [], 0
        pool, _ = _best(pool, fresh, top, len(need), k, unit)
        found.append(pool)
    row, column, distance = (np.concatenate(c) for c in zip(*found))
    out = pd.DataFrame({"query_id": query_ids[row], "item_id": corpus_ids[column], "distance": distance})
    out["distance"] = out["distance"].astype(object).where(np.isfinite(distance), None)
    return out


def _best(pool: tuple, fresh: list[tuple], top: int, height: int, k: int, unit: float) -> tuple[tuple, np.ndarray]:
    """The k best (row, column, distance) of each row, and the cosine that a later column needs to be among them."""
    row, column, distance = (np.concatenate(c) for c in zip(pool, *fresh))
    order = np.lexsort((column, distance, row))
    row, column, distance = row[order], column[order], distance[order]
    first = np.searchsorted(row, np.arange(top, top + height))
    good = np.arange(len(row)) - first[row - top] < k
    row, column, distance = row[good], column[good], distance[good]
    need, last = np.full(height, -np.inf), np.searchsorted(row, np.arange(top, top + height), side="right") - 1
    full = np.bincount(row - top, minlength=height) == k
    worst = distance[last[full]]
    need[full] = np.where(np.isfinite(worst), 1 - worst + unit / 2 - _ERROR, -2.0)
    return (row, column, distance), need


_FOUND = "query_id bigint, item_id bigint, distance double"


def cosine_neighbours(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str, item_id: str, vector: str = "vector",
    digits: int = 9, skip_self: bool = False, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query by cosine distance, ties to the lowest id.

    One plan at every size: tiles of queries meet tiles of the corpus, as large as ``TILE_BYTES`` lets them be and
    all cores have some. A task goes through a pair of tiles in matrix products of at most ``query_block`` by ``corpus_block``,
    and only the k best of each pair of tiles leave it. Distances are compared after rounding to ``digits``.
    """
    wanted = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    items = corpus.select(F.col(item_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    partial = _paired_tiles(wanted, items, k, digits, skip_self, query_block, corpus_block)
    best = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item_id")
    return partial.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _tiles(n_query: int, n_item: int, width: int, cores: int, query_block: int, corpus_block: int) -> tuple[int, int]:
    """Numbers of tiles on the two sides: the larger tile is halved until all cores have some, but not below a block."""
    most = max(1, TILE_BYTES // (8 * max(1, width)))
    q, c = max(1, -(-n_query // most)), max(1, -(-n_item // most))
    while q * c < 4 * cores:
        if n_item / c >= n_query / q and n_item > c * corpus_block:
            c *= 2
        elif n_query > q * query_block:
            q *= 2
        elif n_item > c * corpus_block:
            c *= 2
        else:
            break
    return q, c


def _paired_tiles(wanted: DataFrame, items: DataFrame, k: int, digits: int, skip_self: bool, query_block: int, corpus_block: int) -> DataFrame:
    one = wanted.select(F.size("vector").alias("width")).first()
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    n_query, n_item = _tiles(wanted.count(), items.count(), one["width"] if one else 1, cores, query_block, corpus_block)
    pairs = n_query * n_item

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = _packed(wanted, n_query).withColumn("other", numbers(n_item)).withColumn("pair", F.col("tile") * n_item + F.col("other"))
    right = _packed(items, n_item).withColumn("other", numbers(n_query)).withColumn("pair", F.col("other") * n_item + F.col("tile"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        return _nearest(*_unpacked(q), *_unpacked(c), k, digits, skip_self, query_block, corpus_block)

    dealt = [side.repartition(pairs, "pair").groupBy("pair") for side in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(search, _FOUND)


def upsert_catalogue(old: DataFrame | None, entries: DataFrame, key: str, text: str) -> DataFrame:
    """Catalogue with vectors: new and changed entries replace stored ones by key, the rest stays."""
    fresh = entries.withColumn("vector", hashed_vector(F.col(text)))
    if old is None:
        return fresh
    return old.join(entries.select(key), key, "left_anti").unionByName(fresh)
