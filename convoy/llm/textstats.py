"""Statistics of a whole text as column expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import words

SYMBOLS = r"[#*$%&|<>]"
#: Words of the window that must not come twice.
REPEAT = 8


def _n(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def window_hashes(hashes: Column, width: int) -> Column:
    """A hash for each run of ``width`` word hashes; an empty array when there are fewer."""
    starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def _covered(places: Column, width: int) -> Column:
    """Words under windows of ``width`` that begin at the ascending ``places``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(
        places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])


def _places(ordered: Column) -> Column:
    """Of (hash, place) pairs in order, the places whose hash is not alone, ascending."""
    alone = lambda x, i: ((i == 0) | (F.get(ordered, i - 1)["h"] != x["h"])) & (F.get(ordered, i + 1)["h"].isNull() | (F.get(ordered, i + 1)["h"] != x["h"]))
    return F.sort_array(F.transform(F.filter(ordered, lambda x, i: ~alone(x, i)), lambda x: x["i"]))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (which has no other columns than those its caller named) plus the statistics of its text.

    words, lines (of the text, null as empty), n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words. Windows are compared by 64-bit hashes.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select("*", words(whole).alias("words"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    counted = parts.select("*", F.size("words").cast("long").alias("n_words"), _n(F.length(F.array_join("words", ""))).alias("word_chars"),
                           F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                           F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
    windows = counted.select("*", window_hashes(F.col("word_hashes"), REPEAT).alias("window_hashes"))
    some = F.size(F.array_distinct("window_hashes")) < F.size("window_hashes")
    pairs = windows.select("*", F.when(some, F.sort_array(F.transform("window_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    places = pairs.select("*", F.when(F.col("pairs").isNotNull(), _places(F.col("pairs"))).alias("places"))
    return places.select("*", _n(_covered(F.col("places"), REPEAT)).alias("n_repeat_words")).drop("window_hashes", "pairs", "places")
