"""Benchmark decontamination: an FM-index per shard of training text, searched for the test phrases.

A phrase is a window of consecutive words of a benchmark item. A task indexes the words of a run of documents (a shard)
and searches all phrases in it at once; the positions found are merged to spans. Words that no phrase has can stand in
no occurrence: each run of them is one separator of the shard, and so is a stretch shorter than the shortest phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import documents
from convoy.llm.fmindex import FmIndex

WINDOW = 13
#: Words of one shard; a longer document is a shard of its own.
SHARD = 1_000_000
#: Words of the benchmark that travel to the tasks at once; a larger benchmark takes several passes of the same scan.
BLOCK = 1_000_000
#: Word bytes as they are, A-Z lower-cased, all other ASCII a space: what is left between spaces is a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Phrases:
    """Windows of a block of items as numbers, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int64)
        for row, p in zip(self.table, owners):
            row[: len(p)] = p
        self.items = [sorted(o for o in group if o is not None) for group in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[str], list[tuple[int, int]]]]:
        """For each text of a shard: its number of words, the items found, the merged spans (first and last word)."""
        number = self.numbers.get
        each = [np.fromiter((number(w, 0) for w in words_of(t)), np.int64) for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        found: dict[int, tuple[set[str], list[tuple[int, int]]]] = {}
        if len(self.lengths) and sizes.sum():
            found = self._occurrences(np.concatenate([a for e in each for a in (e, np.zeros(1, np.int64))]), sizes)
        for k, n in enumerate(sizes.tolist()):
            items, spans = found.get(k, ((), ()))
            yield n, sorted(items), list(spans)

    def _occurrences(self, ids: np.ndarray, sizes: np.ndarray) -> dict:
        starts = np.cumsum(sizes + 1) - sizes - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        first, length = edge[::2], edge[1::2] - edge[::2]
        keep = length >= self.shortest
        first, length = first[keep], length[keep]
        if not len(first):
            return {}
        # stretches of phrase words, each with the 0 that follows it
        inner = np.arange((length + 1).sum()) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
        place = np.repeat(first, length + 1) + inner
        symbols = np.where(inner < np.repeat(length, length + 1), ids[np.minimum(place, len(ids) - 1)], 0)
        index = FmIndex(symbols)
        low, high = index.search(self.table, self.lengths)
        some = np.flatnonzero(high > low)
        n = (high - low)[some]
        if not len(some):
            return {}
        phrase = np.repeat(some, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
        at = place[index.locate(rows)]
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[phrase], -1)
        hit = np.cumsum(cover)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        found: dict = {}
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            found.setdefault(doc, (set(), []))[1].append((a - int(starts[doc]), b - 1 - int(starts[doc])))
        doc_of = np.searchsorted(starts, at, side="right") - 1
        for doc, p in np.unique(np.stack([doc_of, phrase]), axis=1).T.tolist():
            found[doc][0].update(self.items[p])
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, n = [], 0
    for t in texts:
        size = len(t or b"") // 5 + 1  # about its words
        if part and n + size > SHARD:
            yield part
            part, n = [], 0
        part.append(t)
        n += size
    if part:
        yield part


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    block, n = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        block.append((row["i"], row["t"].encode()))
        n += len(words_of(block[-1][1]))
        if n >= BLOCK:
            yield block
            block, n = [], 0
    if block:
        yield block


def _search(keyed: DataFrame, benchmark: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """(key of any type, text) -> key, n_words, n_hit, item_ids, spans; a pass of the scan for each block of items."""
    key = T.StructField("key", keyed.schema["key"].dataType)
    found = [T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)]
    between, last = T.StructType([key, T.StructField("text", T.StringType()), *found]), T.StructType([key, T.StructField("n_hit", T.LongType()), *found])
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    rows, blocks = keyed.select("key", "text"), _blocks(benchmark, item_id, item_text)
    block, k = next(blocks, []), 0
    while block is not None:
        following = next(blocks, None)
        more, shared = following is not None, keyed.sparkSession.sparkContext.broadcast(block)

        def run(batches, items=shared, more=more, k=k):
            phrases = Phrases(items.value, window)
            for batch in batches:
                texts, done = batch.column(1).cast(pa.binary()).to_pylist(), 0
                for part in _shards(texts):
                    was = batch.slice(done, len(part))
                    done += len(part)
                    n, ids, spans = map(list, zip(*phrases.find(part)))
                    if k:
                        ids = [sorted({*a, *b}) for a, b in zip(ids, was.column(3).to_pylist())]
                        spans = [merged(a + [(s["first"], s["last"]) for s in b]) for a, b in zip(spans, was.column(4).to_pylist())]
                    n_hit = pa.array([sum(b - a + 1 for a, b in s) for s in spans], pa.int64())
                    hit = pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], span_type)
                    yield pa.RecordBatch.from_arrays(
                        [was.column(0), was.column(1) if more else n_hit, pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.string())), hit],
                        names=["key", "text" if more else "n_hit", "n_words", "item_ids", "spans"])

        rows = rows.mapInArrow(run, between if more else last)
        block, k = following, k + 1
    return rows


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), item_ids (of items found, sorted as text), spans, per document.

    Items go out in blocks of bounded size, each searched in the same scan, so a benchmark of any size fits. Null texts
    and texts without a word have 0 words and no hits; items without a word have no window; a null item id marks words
    but is not named; repeated items and documents are as they are; an empty benchmark leaves all documents clean; other
    columns play no part.
    """
    keyed = documents(docs, doc_id, text).withColumnRenamed("doc_id", "key")
    return _search(keyed, benchmark, window, item_id, item_text).withColumnRenamed("key", "doc_id")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words stand in occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_items(docs, benchmark, **names).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that are not contaminated."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col(text).alias("text"))
    found = _search(keyed, benchmark, window, item_id, item_text)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("key.*")


#: DuckDB form of :func:`report`.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM d, lengths, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(k)),
found AS (SELECT doc_id, item_id, k, p.n FROM places p JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM found), unnest(range(0, n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
