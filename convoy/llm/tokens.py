"""Token ids in flat binary files.

A shard is three flat little-endian files: ``.bin`` the ids (16 bits when the vocabulary allows, else 32), ``.idx`` one
64-bit offset per document plus the end, counted in ids from the start of the shard, ``.doc`` the 64-bit document ids.
Shards follow ascending document id; a manifest (Parquet) names the shard files of the attempts that succeeded, with
the number of ids before each shard from a prefix sum over one row per shard.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoy.llm.common import documents, scratch

#: Text handed to the tokenizer at once, in characters; a longer document goes alone.
CHUNK = 2_000_000
#: What a null document id is stored as.
NO_ID = -(1 << 63)
MANIFEST = "shard string, first_doc long, n_docs long, n_ids long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Pieces whose ids a process remembers: so many lately used ones, and as many from before.
REMEMBERED = 500_000


class Encoder:
    """Whole texts to ids, as bytes of unsigned integers, through a tokenizer file.

    A byte-level tokenizer without normalizer never joins what stands before a space or line break with that character,
    unless other white space touches it. Such texts are cut there and each different piece is tokenized once; unknown
    pieces go to the tokenizer as one text, and the byte lengths of the ids tell where each piece ends. All other texts
    and tokenizers go through as they are.
    """

    def __init__(self, path: str, end_id: int, plain: bool = False):
        """``plain``: the strings of special tokens are text like any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        made = json.loads(self.tok.to_str())
        before = made.get("pre_tokenizer") or {}
        self.pieces = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not made.get("normalizer")
        self.special = [] if plain else [t["content"] for t in made.get("added_tokens", [])]
        vocabulary = self.tok.get_vocab()
        top = max([end_id, *vocabulary.values()])
        self.kind = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.n_bytes = np.zeros(top + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.end = np.array([end_id], self.kind).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def learn(self, items: list[str]) -> None:
        """Ids of pieces: an item stands for itself with a space before it, or starts with its line break."""
        for k in range(0, len(items), 20_000):
            part = items[k : k + 20_000]
            text = "".join([w if w[:1] == "\n" else " " + w for w in part])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum(np.fromiter((len(w.encode()) + (w[:1] != "\n") for w in part), np.int64, len(part)))
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="left") + 1
            raw, size, last = ids.tobytes(), self.kind.itemsize, 0
            for w, cut in zip(part, cuts.tolist()):
                self.known[w] = raw[last * size : cut * size]
                last = cut

    def meet(self, items: set[str]) -> None:
        """Makes the ids of all these pieces known."""
        known, older, new, ended = self.known, self.older, [], []
        for w in items:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
            elif w[-1] in ".,;:!?" and w[-2:-1].isalnum():  # a letter or digit and a mark after it are never one token
                ended.append(w)
            else:
                new.append(w)
        base = {w[:-1] for w in ended}
        for w in base.difference(items):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        for w in ended:
            known[w] = known[w[:-1]] + self.mark(w[-1])

    def mark(self, sign: str) -> bytes:
        if sign not in self.marks:
            self.marks[sign] = self.whole(sign)
        return self.marks[sign]

    def first(self, item: str) -> bytes:
        """Ids of a piece at the start of a text, without a space before it."""
        if item not in self.firsts:
            if len(self.firsts) >= REMEMBERED:
                self.firsts = {}
            self.firsts[item] = self.whole(item)
        return self.firsts[item]

    def pieces_of(self, texts: list[str]) -> list[list[str] | None]:
        """The pieces of each text, known from now on; None for a text that must go through whole."""
        cut: list[list[str] | None] = []
        for text in texts:
            items = text.replace("\n", " \n").split(" ") if self.pieces else None
            if items is not None:
                plain = text.split()
                single = len(plain) == len(items) and len("".join(plain)) + text.count(" ") + text.count("\n") == len(text)
                if not single or items[0][0] == "\n" or any(s in text for s in self.special):
                    items = None  # other white space, or more than one between words
            cut.append(items)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        return cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = self.pieces_of(texts)
        self.meet({w for items in cut if items for w in items[1:]})
        ids = self.known.__getitem__
        return [
            (self.whole(text) if items is None else self.first(items[0]) + b"".join(map(ids, items[1:]))) + self.end
            for text, items in zip(texts, cut)]

    def spaced(self, texts: list[str]) -> list[bytes]:
        """Ids of each text behind a space, without the end id."""
        cut = self.pieces_of(texts)
        self.meet({w for items in cut if items for w in items})
        ids = self.known.__getitem__
        return [self.whole(" " + text) if items is None else b"".join(map(ids, items)) for text, items in zip(texts, cut)]


def kept_in_process(key: tuple, make):
    """What ``make`` gives, once per process; it stays with the tokenizer library, as functions reach the workers by value."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def encoder(path: str, end_id: int) -> Encoder:
    return kept_in_process((path, end_id), lambda: Encoder(path, end_id))


def chunks(texts: list[str]):
    """The texts in lists of about CHUNK characters; a longer text is a list of its own."""
    part, n = [], 0
    for text in texts:
        if part and n + len(text) > CHUNK:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text)
    if part:
        yield part


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    """Hadoop writes file:/x where others write file:///x."""
    return f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes shards and manifest under ``folder``, which all executors must share.

    Null texts and empty texts give the end id alone; null ids come first and are stored as the smallest 64-bit value;
    rows with equal ids follow the text; other columns are ignored; an empty table gives no shard. A task writes under a
    name of its own, so a task that runs again harms nothing: only the manifest says what counts.
    """
    ordered = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    target = _uri(folder)

    def write(batches):
        tok = encoder(tokenizer_path, end_id)
        kind = tok.kind
        store, base = _opened(target)
        name, ids, lengths = uuid.uuid4().hex, [], []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.bin")
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            for part in chunks(batch.column(1).to_pylist()):
                found = tok(part)
                lengths.append(np.fromiter(map(len, found), dtype="<u8", count=len(found)) // kind.itemsize)
                out.write(b"".join(found))
        if out is None:
            return
        out.close()
        ids, ends = np.concatenate(ids), np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(lengths), dtype="<u8")])
        for suffix, values in ((".idx", ends), (".doc", ids)):
            with store.open_output_stream(f"{base}/{name}{suffix}") as side:
                side.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [name], "first_doc": [int(ids[0])], "n_docs": [len(ids)], "n_ids": [int(ends[-1])], "width": [kind.itemsize]},
                                         schema=pa.schema([("shard", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    shards = ordered.mapInArrow(write, MANIFEST)
    shards.write.parquet(f"{folder}/shards")
    shards = docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/shards")
    # Ranges do not overlap but for rows that tie on the id, and those are in one shard.
    # One window over one row per shard.
    ascending = Window.orderBy("first_doc", "shard")
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    shards.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
                  F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("docs_before"), (F.row_number().over(ascending) - 1).alias("place")).write.parquet(f"{folder}/manifest")


def _array(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file's values, memory-mapped where the store is a mounted folder."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over 32-bit little-endian ids) from the files."""
    target = _uri(folder)
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(batches):
        store, base = _opened(target)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['shard']}"
                ids = _array(store, f"{path}.bin", f"<u{row['width']}")
                ends = _array(store, f"{path}.idx", "<u8").astype(np.int64)
                keys = _array(store, f"{path}.doc", "<i8")
                crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])), dtype=np.int64, count=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == NO_ID), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "width", "base", "place")
    return shards.repartitionById(max(1, manifest.count()), F.col("place")).mapInArrow(read, READ)  # a task per shard


def token_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and reads them back: one row per document."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_shards(docs, folder, tokenizer_path, end_id, doc_id, text)
    return read_shards(docs.sparkSession, folder)
