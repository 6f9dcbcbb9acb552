"""Language identification with bit-sliced Bloom filters.

One table of slots serves all languages: a slot holds a mask with one bit per language, in 64-bit words. An n-gram of a language sets
that bit in its few slots; the intersection of an n-gram's slots is the mask of all languages that (may) have it. A text
counts, per language, the n-grams whose mask has the bit, takes off what the filter's false positives add, and the
language with most wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoy.llm.common import documents, fold_of, stored

#: Code points of an n-gram, slots of the table as a power of two, probes per n-gram.
GRAM, SLOT_BITS, PROBES = 4, 20, 3
#: Training texts per language at most, about, and n-grams per language in the filter at most (the most telling ones).
TRAIN_TEXTS, KEPT = 3_000, 40_000
#: A language has an n-gram if its rate is at least this share of the highest rate among the languages.
RATE = 0.25
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double"
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def points(text: str) -> np.ndarray:
    """Code points in lower case, each run of anything but letters one space, with a space before and behind."""
    folded = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    return np.frombuffer(f" {' '.join(folded.split())} ".encode("utf-32-le"), np.uint32)


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def grams(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit number for each run of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + n]) * np.uint64(_MIX[0])
        out ^= out >> np.uint64(29)
    return out


def features(text: str) -> np.ndarray:
    """The n-grams of a text, and its words of one letter, which a text too short for an n-gram still has."""
    codes = points(text)
    alone = np.flatnonzero((codes[:-2] == 32) & (codes[2:] == 32) & (codes[1:-1] != 32)) if len(codes) > 2 else np.zeros(0, np.int64)
    return np.concatenate([grams(codes), grams(codes, 3)[alone]])


def slots(hashes: np.ndarray, bits: int = SLOT_BITS) -> list[np.ndarray]:
    """The probes of each n-gram: high bits of its hash times odd constants."""
    return [((hashes * np.uint64(_MIX[k % 3] + 2 * k)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(PROBES)]


@dataclass(frozen=True)
class Filter:
    """The table (a row of slots per 64 languages), its languages in the order of their bits, and each language's chance to hold a foreign
    n-gram, and the language with most texts."""

    languages: tuple[str, ...]
    table: np.ndarray
    chance: np.ndarray
    prior: int = 0

    def masks(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """The masks of the ``word``-th 64 languages."""
        out = None
        for s in slots(hashes):
            out = self.table[word][s] if out is None else out & self.table[word][s]
        return out


def build(known: list[tuple[str, np.ndarray]], prior: str | None = None) -> Filter:
    """Filter from the n-gram hashes of each language."""
    languages = tuple(name for name, _ in known)
    table = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    for bit, (_, hashes) in enumerate(known):
        for s in slots(hashes):
            np.bitwise_or.at(table[bit // 64], s, np.uint64(1 << bit % 64))
    filled = np.array([np.count_nonzero(table[b // 64] >> np.uint64(b % 64) & np.uint64(1)) for b in range(len(languages))]) / (1 << SLOT_BITS)
    return Filter(languages, table, filled**PROBES, languages.index(prior) if prior in languages else 0)


def learn(texts: DataFrame, train_texts: int = TRAIN_TEXTS, kept: int = KEPT) -> Filter:
    """Filter from (text, lang) rows: n-gram rates are counted in Spark, and the driver gets ``kept`` n-grams a language.

    Languages come from the rows; about ``train_texts`` texts of each are read, chosen by a hash of the text before anything
    is shuffled: the shares are one number per language. N-grams of one text only count where a language has no others.
    """
    rows = texts.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build([])
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1_000_000, -(-1_000_000 * train_texts // n)))])
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < shares[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found, n = np.unique(features(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = stored(some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.max("texts").alias("most"))
    rates = counts.join(totals, "lang").where("texts > 1 OR most = 1").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    telling = rates.join(best, "gram").where(F.col("rate") >= RATE * F.col("best"))
    top = telling.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")).alias("k")).where(F.col("k") <= kept)
    found: dict[str, list[int]] = {}
    for row in top.select("lang", "gram").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["gram"])
    return build([(name, np.array(found[name], np.int64).view(np.uint64)) for name in sorted(found)], max(sorted(found), key=sizes.get) if found else None)


def decide(texts: list[str | None], model: Filter) -> tuple[list[str], list[float]]:
    """Language and score (its share of the corrected counts) of each whole text."""
    names, scores = [], []
    for text in texts:
        if not model.languages or not text or not any(map(str.isalpha, text)):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        hashes = features(text)
        masks = [model.masks(hashes, word) for word in range(len(model.table))]
        hits = np.array([np.count_nonzero(masks[b // 64] & np.uint64(1 << b % 64)) for b in range(len(model.languages))], float)
        n = len(hashes)
        real = np.maximum(hits - n * model.chance, 0) / (1 - model.chance)  # a language has chance * n n-grams that are not its own
        best = int(np.argmax(real)) if real.any() else model.prior
        names.append(model.languages[best])
        scores.append(float(real[best] / real.sum()) if real.sum() else 1 / len(model.languages))
    return names, scores


def identify(docs: DataFrame, model: Filter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. The filter has a fixed size (2 ** SLOT_BITS slots of 8 bytes per 64 languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                names, scores = decide(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = (fold_of(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out")
    return rows.mapInArrow(run, RESULT).select("doc_id", held, "lang_pred", "score")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows with a language outside the held-out fold (crc32 of the id as text, modulo 4, is 2) and labels all.

    Null texts and texts without a letter are ``und`` with score 0; without any language to learn all are. Texts that have
    nothing in common with any language get the one with most texts; of languages with equal counts the first in name
    order wins. Equal texts get equal answers; very long texts count whole; other columns play no part.
    """
    rows = docs.where(fold_of(F.col(doc_id), FOLDS) != HELD_FOLD).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return identify(docs, learn(rows), doc_id, text)
