"""Alignment of two tokenizers over the same texts, by lockstep merging.

The tokens of both cover the same bytes, so one flat array of byte ends per tokenizer describes all documents of a block.
Each lane holds a pointer into both; one NumPy step links the tokens that all lanes point at, moves the pointer whose token
ends first (both where they end together: a cut) and drops the lanes that are done. A document is one lane, and more where
it is long: every LANE-th end that both have starts another.

Counts over the corpus need the pairs of all documents. A block sends each different pair once, with the number of its
documents that hold it, and gets each back once with its count; what is shuffled grows with the different pairs
of the blocks, not with the links, and a pair that every document holds is one row per block.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import documents, stored
from convoy.llm.tokens import Encoder, kept_in_process

#: Characters of the documents aligned at once; a longer document is a block of its own.
BLOCK = 3_000_000
#: Tokens of the first tokenizer after which a long document may get another lane.
LANE = 512

ALIGNED = ("block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
           "links binary, times binary, pairs array<long>, holders array<long>")
_ALIGNED = pa.schema([
    ("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """The bytes of all tokens in one array, and the text forms of the ids."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forms = [f"{i}{sign}" for i in range(len(tokens)) for sign in (inner, last)]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


class Pair:
    """Both tokenizers, once per process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder(path_a, 0, plain=True)
        letters = byte_letters()
        known = self.encoder.tok.get_vocab()
        spelled = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = Vocabulary(spelled, ",", "|")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = Vocabulary([self._piece(i) for i in range(self.pieces.get_piece_size())], ",", ";")
        self.forms = self.a.forms + self.b.forms

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]):
        """Per text the ids of both, or none where the text is empty or one of them does not spell it."""
        a = [np.frombuffer(x, self.encoder.kind).astype(np.int64) for x in self.encoder.spaced(texts)]
        b = [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for k, text in enumerate(texts):
            raw = b" " + text.encode()
            same = text and all(v.sizes[x].sum() == len(raw) and v.spelled(x).tobytes() == raw for v, x in ((self.a, a[k]), (self.b, b[k])))
            if not same:
                a[k] = b[k] = none
        return a, b


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
    """First pointers of all lanes and where they stop: one per document, more at common ends of a long one."""
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    full = sizes_a > 0
    more = [np.arange(s + LANE - 1, s + n - 1, LANE) for s, n in zip(first_a[full & (sizes_a > LANE)], sizes_a[full & (sizes_a > LANE)])]
    last_a = np.concatenate(more) if more else np.zeros(0, np.int64)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    common = ends_b[last_b] == ends_a[last_a]
    i = np.sort(np.concatenate([first_a[full], last_a[common] + 1]))
    j = np.sort(np.concatenate([first_b[full], last_b[common] + 1]))
    return i, j, np.append(i[1:], len(ends_a))


def merge(ends_a: np.ndarray, ends_b: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray):
    """Links (i, j) of tokens with common bytes, and cuts (i, j) where both end, from the lanes' first pointers on."""
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        i, j = i + (a <= b), j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (links_a, links_b, cuts_a, cuts_b))


def _groups(pair: Pair, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> np.ndarray:
    """Text forms of all tokens, group by group, those of A before those of B."""
    at_a, at_b = np.arange(len(a)), np.arange(len(b))
    group_a, group_b = np.searchsorted(cuts_a, at_a), np.searchsorted(cuts_b, at_b)
    out = np.empty(len(a) + len(b), np.int64)
    out[at_a + np.append(0, cuts_b + 1)[group_a]] = a * 2 + (cuts_a[np.minimum(group_a, len(cuts_a) - 1)] == at_a)
    out[at_b + cuts_a[group_b] + 1] = len(pair.a.forms) + b * 2 + (cuts_b[group_b] == at_b)
    return out


def _align(pair: Pair, ids: list, texts: list[str], keep: bool) -> pa.RecordBatch:
    """One row per document and one for the block: its different pairs and how many documents hold each."""
    each_a, each_b = pair.encode(texts)
    sizes_a, sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (each_a, each_b))
    a, b = np.concatenate(each_a), np.concatenate(each_b)
    ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
    links_a, links_b, cuts_a, cuts_b = merge(ends_a, ends_b, *lanes(ends_a, ends_b, sizes_a, sizes_b)) if len(a) else (np.zeros(0, np.int64),) * 4
    cuts_a, cuts_b = np.sort(cuts_a), np.sort(cuts_b)
    n = len(texts)
    doc = np.repeat(np.arange(n), sizes_a)
    pairs, which = np.unique(a[links_a] << 32 | b[links_b], return_inverse=True)
    held, times = np.unique(doc[links_a] * max(len(pairs), 1) + which, return_counts=True)
    held_doc, held_pair = np.divmod(held, max(len(pairs), 1))
    bounds = np.searchsorted(held_doc, np.arange(n + 1))
    positions, times = held_pair.astype("<i4"), times.astype("<i4")
    forms = _groups(pair, a, b, cuts_a, cuts_b) if len(a) else np.zeros(0, np.int64)
    first = np.append(0, np.cumsum(sizes_a + sizes_b))
    look = pair.forms.__getitem__
    groups = ["".join(map(look, forms[s:e].tolist()))[:-1] for s, e in itertools.pairwise(first.tolist())]
    block, none = uuid.uuid4().hex, [None]
    spans = list(itertools.pairwise(bounds.tolist()))
    return pa.RecordBatch.from_pydict({
        "block": [block] * (n + 1), "doc_id": ids + none, "n_a": sizes_a.tolist() + none, "n_b": sizes_b.tolist() + none,
        "n_groups": np.bincount(doc[cuts_a], minlength=n).tolist() + none, "n_links": np.bincount(doc[links_a], minlength=n).tolist() + none,
        "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] + none, "groups": (groups if keep else [None] * n) + none,
        "links": [positions[s:e].tobytes() for s, e in spans] + none, "times": [times[s:e].tobytes() for s, e in spans] + none,
        "pairs": [None] * n + [pairs], "holders": [None] * n + [np.bincount(held_pair, minlength=len(pairs))]}, schema=_ALIGNED)


def blocks(ids: list, texts: list):
    """Documents in order, as many as make BLOCK characters."""
    part, chars = 0, 0
    for k, text in enumerate(texts):
        if k > part and chars + len(text) > BLOCK:
            yield ids[part:k], texts[part:k]
            part, chars = k, 0
        chars += len(text)
    if part < len(texts):
        yield ids[part:], texts[part:]


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligns the byte-level tokenizer of ``path_a`` (over space + text) with the pieces of ``path_b`` (over text).

    Per row: doc_id, n_a, n_b (tokens), n_groups (stretches between common ends), n_links (token pairs with common
    bytes), n_best (links whose pair is held by as many documents as any pair of the same A id), count_sum (documents
    that hold the pair, over links), groups_sha256, and the ``groups`` themselves where asked for. Special tokens' strings are text.
    Null and empty texts, and texts that one of the two does not spell byte for byte, have no tokens: zeros, ''. Rows that
    repeat are documents of their own; null ids stay; other columns take no part. Texts are aligned whole: a
    block is as large as its documents, a longer text alone.
    """
    def run(batches):
        pair = kept_in_process(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for some, each in blocks(batch.column(0).to_pylist(), texts):
                yield _align(pair, some, each, groups)

    rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = stored(rows.mapInArrow(run, ALIGNED), "aligned")
    held = aligned.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "holders"))).select("block", F.col("pos"), F.col("col.pairs").alias("pair"), F.col("col.holders").alias("holders"))
    counts = stored(held.groupBy("pair").agg(F.sum("holders").alias("n")), "pair_counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    ranks = counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = held.drop("holders").join(ranks, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("told"))
    told = told.select(F.col("block").alias("of"), F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    return aligned.where("pairs IS NULL").drop("pairs", "holders").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_count, COUNTED)


def _count(rows: pa.Table, told: pa.Table) -> pa.Table:
    """Sums over the links of each document, from what the block was told about its pairs."""
    n = best = np.zeros(1, np.int64)
    if told.num_rows:
        n = told["n"].combine_chunks().values.to_numpy(zero_copy_only=False)
        best = told["best"].combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.int64)
    sums: tuple[list, list] = ([], [])
    for links, times in zip(rows["links"].to_pylist(), rows["times"].to_pylist()):
        at, t = np.frombuffer(links, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        sums[0].append(int(best[at] @ t) if len(at) else 0)
        sums[1].append(int(n[at] @ t) if len(at) else 0)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table({**{c: rows[c] for c in names}, "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()),
                     "groups_sha256": rows["groups_sha256"], "groups": rows["groups"]})
