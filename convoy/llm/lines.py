"""Line dedup: exact and near repeats of lines, one word apart, by a deletion-neighbourhood join that zooms in.

Two lines are within one word edit if they agree but for one place: a word replaced, or one more. The variants of a line
are the line without a run of its words, as a hash of what is left. First the run is half the line (four keys a line);
entries whose key another line has are split into runs a quarter as long, and so on down to one word. There all lines
of a key are within one edit of each other, so each is held against the earliest only: no pairs are listed. Entries
that nobody shares end at once, which is nearly all of them after the first round. A line of n words and one of n + 1
meet in the frame of n, in which the longer one has one word more in its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import WORD, documents, stored, words

#: Lines of fewer words are compared exactly only: one word is too much of them.
LEAST_WORDS = 5
SPLIT = 4
#: Rows of at most about 40 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _rest(found: Column, frame: Column, at: Column, run: Column) -> list[Column]:
    """What is left and right of the run: the first ``at`` words and the last ``frame - at - run``."""
    behind = (frame - at - run).cast("int")
    return [F.slice(found, F.lit(1), at.cast("int")), F.slice(found, F.size(found) - behind + 1, behind)]


def _key(found: Column, frame: Column, at: Column, run: Column) -> Column:
    return F.xxhash64(frame, at, run, *_rest(found, frame, at, run))


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line of every line with a word."""
    rows = documents(docs, doc_id, text).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD))


def _identified(lines: DataFrame) -> DataFrame:
    """Plus the hashes of the line's words in order, their number, and two hashes of the whole."""
    hashed = lines.select("*", F.transform(words(F.col("line")), lambda w: F.xxhash64(w)).alias("words"))
    return hashed.select("*", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("h2"), F.size("words").alias("n"))


def _checked(narrow: DataFrame) -> DataFrame:
    """A stored table of few short columns: broadcast if it was counted and found small, else left to a shuffle."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def _met(entries: DataFrame) -> DataFrame:
    """The keys that entries (key, h) of more than one line have. Only the two numbers are shuffled, combined per task."""
    seen = entries.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return stored(seen.where("low <> high").select("key"), "met")


def _halves() -> list[tuple[Column, Column, Column]]:
    """(frame, at, run) of the runs that are tried first: both halves, in the line's own frame and in that of one word less."""
    out = []
    for frame in (F.col("n"), F.col("n") - 1):
        half = F.ceil(frame / 2).cast("int")
        out += [(frame, F.lit(0), half), (frame, half, (frame - half).cast("int"))]
    return out


def _first_keys() -> Column:
    """The keys of these runs, null in a frame that is too short."""
    return F.array(*[F.when(frame >= LEAST_WORDS, _key(F.col("words"), frame, at, run)) for frame, at, run in _halves()])


def _try(number: Column) -> Column:
    """The run with this number."""
    out = F.lit(None)
    for k, (frame, at, run) in enumerate(_halves()):
        out = F.when(number == k, F.struct(frame.cast("int").alias("frame"), at.cast("int").alias("at"), run.cast("int").alias("run"))).otherwise(out)
    return out


def near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line_no, h, h2), and those different lines that stand more than once or have an earlier one within
    one edit: (h, h2, first, of).

    ``first`` is the earliest (doc_id, line_no) with the line; ``of`` is the earliest near line, null if there is none. Until a line shares a key with another one, only numbers of it are shuffled; then its words are fetched
    once, from the place where it stands first.
    """
    lines = _identified(line_table(docs, doc_id, text))
    table = stored(lines.select("doc_id", "line_no", "h", "h2", F.when(F.col("n") >= LEAST_WORDS, _first_keys()).alias("tries")), "lines")
    different = stored(table.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies")), "different")
    tries = table.select("h", F.posexplode("tries").alias("number", "key")).where("key IS NOT NULL")
    # as many keys as lines: never a broadcast
    some = tries.join(_met(tries).hint("merge"), "key", "left_semi").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, number)")).alias("numbers"))
    wanted = stored(different.select("h", "h2", "first").join(_checked(stored(some, "some")), "h"), "wanted")
    place = stored(wanted.select(F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("l")), "places")
    here, place = line_table(docs, doc_id, text), _checked(place)
    # stored before the words are cut, which Spark would otherwise make part of the join and evaluate for every line
    texts = stored(here.join(place, here["doc_id"].eqNullSafe(place["d"]) & (here["line_no"] == place["l"]), "left_semi").select("line"), "texts")
    found = stored(_identified(texts).select("h", "h2", "n", "words").join(_checked(wanted), ["h", "h2"]), "found")
    known = found.select("h", "h2", "first", "words")
    entries = stored(found.select("h", "h2", "first", "words", F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("numbers").bitwiseAND(F.when(k == 0, 1).when(k == 1, 2).when(k == 2, 4).otherwise(8)) != 0), _try).alias("es")).select("h", "h2", "first", "words", F.explode("es").alias("e")).select("h", "h2", "first", "words", "e.*"), "entries")
    while not entries.where("run > 1").isEmpty():
        part = F.ceil(F.col("run") / SPLIT).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.col("run") - 1, F.greatest(part, F.lit(1))), lambda k: F.struct(
            (F.col("at") + k).cast("int").alias("at"), F.least(part, F.col("run") - k).cast("int").alias("run")))
        finer = entries.where("run > 0").select("h", "h2", "words", "frame", F.explode(parts).alias("p")).select("h", "h2", "words", "frame", "p.*")
        finer = stored(finer.select("h", "h2", "frame", "at", "run", _key(F.col("words"), F.col("frame"), F.col("at"), F.col("run")).alias("key")), "finer")
        left = stored(finer.join(_met(finer), "key", "left_semi").drop("key").distinct(), "left")
        entries = stored(known.join(_checked(left), ["h", "h2"]).select("h", "h2", "first", "words", "frame", "at", "run"), "entries")
    # one word replaced at a place, or one word more in the gap before or behind it
    extra = F.size("words") - F.col("frame")
    gap = lambda at: F.struct(at.cast("int").alias("at"), F.lit(0).alias("run"))
    final = entries.select("*", extra.alias("extra")).select("h", "h2", "first", "words", "frame", F.explode(F.concat(
        F.when(F.col("extra") == 0, F.array(F.struct("at", F.lit(1).alias("run")))).otherwise(F.expr("cast(array() as array<struct<at: int, run: int>>)")),
        F.array(gap(F.col("at")), gap(F.col("at") + 1)))).alias("p")).select("h", "h2", "first", "words", "frame", "p.*")
    left, right = _rest(F.col("words"), F.col("frame"), F.col("at"), F.col("run"))
    # the key and a second hash of what is left: 128 bits that must agree
    keyed = final.select("h", "h2", "first", F.xxhash64("frame", "at", "run", left, right).alias("key"), F.xxhash64(F.lit(2), right, left, "frame", "at").alias("rest"))
    keyed = stored(keyed, "final")
    earliest = stored(keyed.groupBy("key").agg(F.min(F.struct("first", "rest")).alias("e"), F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key", "e"), "earliest")
    links = keyed.join(earliest, "key").where((F.col("first") != F.col("e.first")) & (F.col("rest") == F.col("e.rest")))
    best = links.select("h", "h2", "first", F.col("e.first").alias("of"))
    repeated = different.where("copies > 1").select("h", "h2", "first", F.lit(None).cast(best.schema["of"].dataType).alias("of"))
    going = best.union(repeated).groupBy("h", "h2").agg(F.min("first").alias("first"), F.min("of").alias("of"))
    return table.select("doc_id", "line_no", "h", "h2"), stored(going, "going")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, repeat (the same words stand earlier), near_of (an earlier line one word edit away, or null) of every line."""
    lines, going = near(docs, doc_id, text)
    found = lines.join(going, ["h", "h2"], "left")
    return found.select("doc_id", "line_no", (F.col("first").isNotNull() & _repeat()).alias("repeat"), F.col("of").alias("near_of"))


def _repeat() -> Column:
    return ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_repeats, n_near, n_kept, removed (the numbers of the lines to remove, from 0).

    A line goes if the same words came earlier (in order of doc_id, null first, then line), or if an earlier line is
    within one word edit and both have at least LEAST_WORDS words; shorter lines are compared exactly only. Lines without
    a word are neither counted nor removed; null and empty texts have none; rows that share an id count as one document;
    very long texts and lines are taken whole; other columns play no part.
    """
    lines, going = near(docs, doc_id, text)
    again = lines.join(going.hint("merge"), ["h", "h2"]).where(_repeat() | F.col("of").isNotNull()).select("doc_id", "line_no", _repeat().alias("repeat"), F.lit(0).cast("long").alias("n"))
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(None).cast("int").alias("line_no"), F.lit(False).alias("repeat"), "n")
    gone = F.col("line_no").isNotNull()
    per = again.union(counted).groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"), F.count_if(F.col("repeat")).alias("n_repeats"), F.count_if(gone & ~F.col("repeat")).alias("n_near"),
        F.sort_array(F.collect_set("line_no")).alias("removed"))
    per = per.withColumn("n_kept", F.col("n_lines") - F.col("n_repeats") - F.col("n_near"))
    ids = documents(docs, doc_id, text).select(F.col("doc_id").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(per, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("id").alias("doc_id"), *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_repeats", "n_near", "n_kept")],
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text without the lines to remove. The id must tell documents apart."""
    gone = report(docs, doc_id, text).select(F.col("doc_id").alias("id"), "removed")
    rows = documents(docs, doc_id, text).join(gone, F.col("doc_id").eqNullSafe(F.col("id")))
    left = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, k: ~F.array_contains("removed", k))
    return rows.select("doc_id", F.array_join(left, "\n").alias("text"))


#: DuckDB form of the query: all one-word deletions of every different line.
SQL = r"""
WITH l AS (
  SELECT doc_id, k AS line_no, regexp_extract_all(string_split(coalesce(text, ''), chr(10))[k + 1], '[^\x20\x09-\x0D]+') AS w
  FROM documents, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS t(k)),
lines AS (SELECT doc_id, line_no, array_to_string(w, ' ') AS line, len(w) AS n, w FROM l WHERE len(w) > 0),
diff AS (SELECT line, any_value(n) AS n, any_value(w) AS w, min((doc_id, line_no)) AS first FROM lines GROUP BY line),
cut AS (SELECT line, n, first, i, md5(array_to_string(list_concat(w[: i - 1], w[i + 1 :]), ' ')) AS rest FROM diff, unnest(range(1, n + 1)) AS t(i) WHERE n >= 5),
sub AS (SELECT n, i, rest, min(first) AS e FROM cut GROUP BY n, i, rest HAVING count(*) > 1),
near AS (
  SELECT line, e FROM cut JOIN sub USING (n, i, rest) WHERE e < first
  UNION ALL SELECT c.line, d.first FROM cut c JOIN diff d ON d.n = c.n - 1 AND d.n >= 5 AND md5(d.line) = c.rest WHERE d.first < c.first
  UNION ALL SELECT d.line, c.first FROM cut c JOIN diff d ON d.n = c.n - 1 AND d.n >= 5 AND md5(d.line) = c.rest WHERE c.first < d.first),
gone AS (SELECT DISTINCT line FROM near),
per AS (
  SELECT lines.doc_id, count(*) AS n_lines, sum(CASE WHEN (lines.doc_id, lines.line_no) <> diff.first THEN 1 ELSE 0 END) AS n_repeats,
    sum(CASE WHEN (lines.doc_id, lines.line_no) = diff.first AND gone.line IS NOT NULL THEN 1 ELSE 0 END) AS n_near,
    string_agg(CASE WHEN (lines.doc_id, lines.line_no) <> diff.first OR gone.line IS NOT NULL THEN CAST(lines.line_no AS VARCHAR) END, ',' ORDER BY lines.line_no) AS gone_no
  FROM lines JOIN diff USING (line) LEFT JOIN gone ON gone.line = lines.line GROUP BY lines.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  CAST(coalesce(n_lines - n_repeats - n_near, 0) AS BIGINT) AS n_kept, coalesce(gone_no, '') AS removed_lines
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN per ON per.doc_id = d.doc_id
"""
