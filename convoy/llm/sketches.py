"""Fingerprints of texts as invertible Bloom lookup sketches, and what differs between two versions.

A text is its paragraphs: lines, cut further after those spaces where a hash of the eight bytes before says so, about every
eighth. An edit so changes the paragraphs it touches and no others. Each paragraph's 64-bit digest (repeats of one
paragraph are numbered, so all digests of a text differ) goes into one cell of each of three tables; a cell is a count, a
sum of digests and a sum of checks. The difference of two sketches holds only the digests that one of the two has: a
cell with count 1 or -1 whose check fits is such a digest; taking it out lays others open, until all cells are empty.
If some stay, or a digest came out twice, the sketch was too small and both texts are sketched again at twice the size.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import documents

TABLES = 3
#: Cells of one table of a fingerprint; a power of two.
CELLS = 16
#: A sketch of more cells a digest than this that still does not peel holds digests that share all cells.
LARGEST = 64
SEED = 13
#: One space in so many ends a paragraph.
WORDS = 8
_MARGIN = b"\0" * WORDS
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])
_LOW = np.uint64(0xFFFFFFFF)
#: Odd multipliers from one rule, for places, checks, cuts and repeats.
_ODD = [np.uint64(int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "little") | 1) for k in range(TABLES + 2 + WORDS + 1)]
_CHECK, _REPEAT, _CUT = _ODD[TABLES], _ODD[TABLES + 1], _ODD[TABLES + 2 :]
#: Characters sketched at once, and rows of one task of neighbouring documents.
CHUNK = 1_000_000
ROWS = 10_000
#: Most tasks of neighbouring documents; with more rows they get larger, which costs no memory.
MOST_TASKS = 20_000
NO_ID = -(1 << 63)


def paragraphs(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The paragraphs of all texts in order, joined they are the texts, and how many each text has."""
    raws = [t.encode() for t in texts]
    raw = b"".join([x for r in raws for x in (_MARGIN, r)])
    buffer = np.frombuffer(raw, np.uint8)
    stops = np.cumsum(np.fromiter((len(r) + WORDS for r in raws), np.int64, len(raws)))
    begins = np.append(0, stops[:-1]) + WORDS
    spaces = np.flatnonzero(buffer == 32)
    mixed = np.zeros(len(spaces), np.uint64)
    for k in range(WORDS):  # a text begins behind a margin, so nothing before it counts
        mixed += buffer[spaces - k - 1].astype(np.uint64) * _CUT[k]
    cut = spaces[(mixed * _CUT[WORDS]) >> np.uint64(61) == 0] + 1
    full = stops > begins
    ends = np.unique(np.concatenate([cut, np.flatnonzero(buffer == 10) + 1, stops[full]]))
    owner = np.searchsorted(stops, ends)
    counts = np.bincount(owner, minlength=len(texts))[: len(texts)]
    starts = np.append(0, ends[:-1])
    first = np.cumsum(counts) - counts
    starts[first[full]] = begins[full]
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())], counts


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit digest per paragraph, all different within a text, and how many each text has."""
    found, counts = paragraphs(texts)
    keys = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in found), np.uint64, len(found))
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((keys, owner))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.arange(len(keys))
    again = np.empty(len(keys), np.uint64)
    again[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return keys + again * _REPEAT, counts


class Sketches:
    """Sketches of many texts side by side: ``cells`` places in each of three tables per text."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * TABLES * cells, np.int64)
        self.digest = np.zeros(n * TABLES * cells, np.uint64)
        self.check = np.zeros(n * TABLES * cells, np.uint64)
        self._add(keys, owner, np.ones(len(keys), np.int64))

    def _places(self, keys: np.ndarray, owner: np.ndarray, table: int) -> np.ndarray:
        shift = np.uint64(64 - (self.cells.bit_length() - 1))
        place = ((keys * _ODD[table]) >> shift).astype(np.int64) if self.cells > 1 else np.zeros(len(keys), np.int64)
        return (owner * TABLES + table) * self.cells + place

    def _add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        signed = sign.astype(np.uint64)  # -1 is 2 ** 64 - 1
        for table in range(TABLES):
            at = self._places(keys, owner, table)
            np.add.at(self.count, at, sign)
            np.add.at(self.digest, at, keys * signed)
            np.add.at(self.check, at, checks(keys) * signed)

    def texts(self) -> list[str]:
        out = np.empty(len(self.count), _CELL)
        out["count"], out["digest"], out["check"] = self.count, self.digest, self.check & _LOW
        size = TABLES * self.cells * _CELL.itemsize
        raw = out.tobytes()
        return [base64.b64encode(raw[k : k + size]).decode() for k in range(0, len(raw), size)]

    def less(self, other: Sketches) -> Sketches:
        """Changes this one to the difference."""
        self.count -= other.count
        self.digest -= other.digest
        self.check -= other.check
        return self

    def peel(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, text, sign) of all that can be taken out, and which texts came to nothing.

        A sum of several digests may pass for one. Taken out, it lies open with the other sign in its other cells, and could come
        and go without end: a text gives no more than ``most`` digests, and one that gave any twice did not come to nothing.
        """
        keys, owners, signs = [], [], []
        idle, table, taken = 0, 0, np.zeros(self.n, np.int64)
        place = np.arange(len(self.count)) // self.cells
        while idle < TABLES:  # a digest has one cell in a table, so none is found twice at once
            at = np.flatnonzero((np.abs(self.count) == 1) & (place % TABLES == table))
            sign = self.count[at]
            key = self.digest[at] * sign.astype(np.uint64)
            owner = place[at] // TABLES
            fits = ((self.check[at] * sign.astype(np.uint64)) & _LOW == checks(key)) & (self._places(key, owner, table) == at) & (taken[owner] <= most[owner])
            key, owner, sign = key[fits], owner[fits], sign[fits]
            idle = 0 if len(key) else idle + 1
            if len(key):
                self._add(key, owner, -sign)
                keys.append(key)
                owners.append(owner)
                signs.append(sign)
                taken += np.bincount(owner, minlength=self.n)
            table = (table + 1) % TABLES
        rest = ((self.count != 0) | (self.digest != 0)).reshape(self.n, -1).any(axis=1)
        none = np.zeros(0, np.int64)
        key, owner, sign = np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *owners]), np.concatenate([none, *signs])
        own = key + owner.astype(np.uint64) * _CHECK
        rest[owner[np.isin(own, _twice(own))]] = True
        return key, owner, sign, ~rest & (taken <= most)


def _twice(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[1:][keys[1:] == keys[:-1]]


def checks(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) * _CHECK) >> np.uint64(32)


def _some(keys: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, and to which of them they belong."""
    first = np.cumsum(counts) - counts
    n = counts[which]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - n), n)
    return keys[at], np.repeat(np.arange(len(which)), n)


def differences(keys: np.ndarray, counts: np.ndarray, old: np.ndarray, new: np.ndarray, cells: int = CELLS):
    """Of pairs of texts (places in ``counts``) the digests that only one has: (digest, pair, sign: 1 old, -1 new), and
    the cells a table needed per pair."""
    out: list[tuple] = []
    used = np.zeros(len(old), np.int64)
    todo = np.arange(len(old))
    while len(todo):
        a, b = (_some(keys, counts, side[todo]) for side in (old, new))
        most = counts[old[todo]] + counts[new[todo]]
        key, pair, sign, done = Sketches(*a, len(todo), cells).less(Sketches(*b, len(todo), cells)).peel(most)
        stuck = ~done & (TABLES * cells > LARGEST * (most + 1))
        for k in np.flatnonzero(stuck):  # digests with all cells in common: compared as they are
            mine, theirs = a[0][a[1] == k], b[0][b[1] == k]
            for only, s in ((np.setdiff1d(mine, theirs), 1), (np.setdiff1d(theirs, mine), -1)):
                out.append((only, np.full(len(only), todo[k]), np.full(len(only), s)))
        good = done[pair]
        out.append((key[good], todo[pair[good]], sign[good]))
        used[todo] = cells
        todo = todo[~done & ~stuck]
        cells *= 2
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([t, *[o[k] for o in out]]) for k, t in enumerate((none.astype(np.uint64), none, none))) + (used,)


def likeness(keys: np.ndarray, counts: np.ndarray, old: np.ndarray, new: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Common paragraphs by all paragraphs of both, repeats counted; 1 for two texts without any."""
    _, pair, sign, _ = differences(keys, counts, old, new, cells)
    gone = np.bincount(pair[sign > 0], minlength=len(old))
    come = np.bincount(pair[sign < 0], minlength=len(old))
    both = counts[old] + come
    return np.where(both == 0, 1.0, (counts[old] - gone) / np.maximum(both, 1))


def portions(items, size):
    """Lists of items whose sizes add up to about CHUNK; a larger item is a list of its own."""
    part, total = [], 0
    for item in items:
        n = size(item)
        if part and total + n > CHUNK:
            yield part
            part, total = [], 0
        part.append(item)
        total += n
    if part:
        yield part


# fingerprints and versions -----------------------------------------------------------------------------------------

FINGERPRINTS = "doc_id long, n_paragraphs long, fingerprint string"
CHANGES = "doc_id long, only_old array<long>, only_new array<long>, likeness double, cells int"


def fingerprints(docs: DataFrame, cells: int = CELLS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and fingerprint (base64 of the cells) of every row.

    Equal texts have equal fingerprints. Null texts are empty ones: no paragraph, all cells zero. Very long texts are
    sketched whole, into as many cells. Repeated rows and null ids stay; other columns take no part.
    """
    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for part in portions(rows, lambda r: len(r[1] or "")):
                keys, counts = digests([t or "" for _, t in part])
                made = Sketches(keys, np.repeat(np.arange(len(part)), counts), len(part), cells).texts()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in part], pa.int64()), "n_paragraphs": counts, "fingerprint": made})

    rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, FINGERPRINTS)


def changed_paragraphs(old: DataFrame, new: DataFrame, cells: int = CELLS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Two versions of a table -> doc_id, the digests of paragraphs that only the old or only the new text has, likeness,
    and the cells a table that the difference took.

    Rows meet by id; ids in one version only meet an empty text, as do null texts. Rows without id have no other
    version and are left out. An id that repeats meets every row of it in the other version.
    """
    def run(batches):
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(3)])
            for part in portions(rows, lambda r: len(r[1] or "") + len(r[2] or "")):
                n = len(part)
                keys, counts = digests([r[1] or "" for r in part] + [r[2] or "" for r in part])
                first, second = np.arange(n), np.arange(n, 2 * n)
                key, pair, sign, used = differences(keys, counts, first, second, cells)
                order = np.lexsort((key, pair))
                key, pair, sign = key[order].view(np.int64), pair[order], sign[order]
                only = []
                for s in (1, -1):
                    mine = sign == s
                    offsets = np.append(0, np.cumsum(np.bincount(pair[mine], minlength=n)))
                    only.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[mine])))
                both = counts[:n] + np.diff(only[1].offsets.to_numpy())
                like = np.where(both == 0, 1.0, (counts[:n] - np.diff(only[0].offsets.to_numpy())) / np.maximum(both, 1))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *only, pa.array(like), pa.array(used.astype(np.int32))],
                                                 names=["doc_id", "only_old", "only_new", "likeness", "cells"])

    sides = [documents(side, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias(name)).where("doc_id IS NOT NULL")
             for side, name in ((old, "old"), (new, "new"))]
    return sides[0].join(sides[1], "doc_id", "full").select("doc_id", "old", "new").mapInArrow(run, CHANGES)


# each document, its edited text and the next document --------------------------------------------------------------

EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above the key, by halving."""
    if not bounds:
        return F.lit(0)
    values = F.lit(bounds).cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(values, at + step - 1) <= key), at + step).otherwise(at))


def _neighbours(docs: DataFrame, rows_each: int) -> DataFrame:
    """(bucket, tail, doc_id, text) sorted within tasks: ranges of ids, and behind each the first row of the next range.

    The range bounds are ids of the table, so a range begins with all rows of its bound; those are sent twice, and
    the texts of the others once. At most MOST_TASKS bounds reach the driver.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    count, least = rows.agg(F.count("*"), F.min("key")).first()
    n = max(1, min(-(-count // rows_each), MOST_TASKS))
    shares = [k / n for k in range(1, n)]
    bounds = sorted({b for b in rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * n))).first()[0] if b > least}) if shares else []
    n = len(bounds) + 1
    bucket = _bucket(F.col("key"), bounds).cast("int")
    first = (F.col("key") == least) if not bounds else (F.array_contains(F.lit([least, *bounds]).cast("array<long>"), F.col("key")))
    here = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("tail"))
    sent = rows.withColumn("bucket", bucket).select("key", "text", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    placed = sent.select("to.bucket", "to.tail", "key", "text").repartitionById(n, F.col("bucket"))
    return placed.sortWithinPartitions("bucket", "tail", "key", "text")


def _pairs(batches):
    """(key, text, next text) of every row that is not a tail."""
    held = None
    for batch in batches:
        for bucket, tail, key, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if held is not None and not held[1] and held[0] == bucket:
                yield held[2], held[3], text
            held = (bucket, tail, key, text)


def edits(docs: DataFrame, cells: int = CELLS, rows_each: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text, its edited text and the next document, ids ascending and the first after the last.

    In the edited text the last floor(n / 2) code points are replaced by the first as many of the next document, or by
    all of it if it is shorter. Per row: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint, near_edited
    and near_next: the likeness to the edited text and to the next document. Null texts are empty; two empty texts have likeness 1.
    Null ids come first; rows of one id follow their texts, so equal rows are each other's next. A single row is its own next.
    Very long texts are sketched whole; other columns take no part. An empty table gives no row.
    """
    def run(batches):
        for part in portions(_pairs(batches), lambda r: 2 * len(r[1]) + len(r[2])):
            n = len(part)
            texts = [r[1] for r in part]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in part]
            keys, counts = digests(texts + edited + [r[2] for r in part])
            own = np.arange(n)
            some, owner = _some(keys, counts, np.arange(2 * n))
            made = Sketches(some, owner, 2 * n, cells).texts()
            ids = np.fromiter((r[0] for r in part), np.int64, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=ids == NO_ID), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(made[:n]), pa.array(made[n:]), pa.array(likeness(keys, counts, own, own + n, cells)), pa.array(likeness(keys, counts, own, own + 2 * n, cells))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _neighbours(rows, rows_each).mapInArrow(run, EDITS)
