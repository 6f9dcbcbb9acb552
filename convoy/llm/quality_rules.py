"""Quality rules as a short-circuit cascade.

Each rule is a column expression that is true for a text to reject. On a sample every rule's time and the share it
rejects are measured; rules then run in the order of rejections per second, and a text leaves at its first failure. The
order changes the cost, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import documents, stored
from convoy.llm.textstats import with_stats

#: Rows aimed at in the sample that only sets the order of the rules.
SAMPLE = 2_000
#: Seconds below which two rules cost the same.
LEAST_S = 0.01


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules over the columns of :func:`textstats.with_stats`; true rejects."""
    n = F.col("n_words")
    count = lambda keep: F.size(F.filter("words", keep))
    return {
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "letterless": 10 * count(lambda w: ~w.rlike(r"\p{L}")) > 4 * n,
        "capitals": 10 * count(lambda w: w.rlike(r"\p{Lu}{2}") & ~w.rlike(r"\p{Ll}")) > 5 * n,
        "stutter": 10 * count(lambda w, i: w == F.get("words", i - 1)) > 3 * n,
        "exclamations": 10 * F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[!?]{2}")) > 2 * n,
        "ellipses": 10 * F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) > 6 * F.col("n_lines"),
        "bullets": 10 * F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-•*]\s"))) > 9 * F.col("n_lines"),
    }


def ordered(sample: DataFrame, checks: dict[str, Column]) -> list[str]:
    """Rule names by the share of the sample that a rule rejects per second of its time, highest first."""
    seconds, gains = {}, {}
    for name, rejects in checks.items():
        began = time.perf_counter()
        gains[name] = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("int"))).first()[0] or 0.0
        seconds[name] = max(time.perf_counter() - began, LEAST_S)
    return sorted(checks, key=lambda name: (-gains[name] / seconds[name], name))


def cascade(order: list[str], checks: dict[str, Column]) -> Column:
    """The first rule that rejects, or null: a later branch of CASE WHEN is not evaluated once one holds."""
    first = F.when(checks[order[0]], F.lit(order[0]))
    for name in order[1:]:
        first = first.when(checks[name], F.lit(name))
    return first


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", checks: dict[str, Column] | None = None, sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule (the first that
    rejected, in this run's order), per row.

    Null and empty texts have no words and fail the base; a rule that gives null rejects nothing; repeated rows are
    judged alike; other columns play no part; an empty table gives an empty table.
    """
    checks = checks or rules()
    rows = documents(docs, doc_id, text)
    n = rows.count()
    sample = rows if n <= sample_rows else rows.sample(fraction=sample_rows / n, seed=7)
    # stored before the filter, which Spark would otherwise push below the statistics and evaluate anew
    sample = stored(with_stats(sample), "rules-sample").where(~base_failed())
    order = ordered(sample, checks)
    judged = with_stats(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                                     F.when(~base_failed(), cascade(order, checks)).alias("rule"))
    return judged.select("*", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


#: DuckDB form: counts, base and the verdict of the rules.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, k, list_reduce(words[k : k + 7], lambda a, b: a || ' ' || b) AS win FROM w, unnest(range(1, greatest(len(words) - 6, 1))) AS u(k)),
twice AS (SELECT doc_id, win FROM win GROUP BY doc_id, win HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM win JOIN twice USING (doc_id, win), unnest(range(0, 8)) AS u(j) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * len(lines)
    OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 4 * n_words
    OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{Lu}{2}') AND NOT regexp_matches(x, '\p{Ll}'))) > 5 * n_words
    OR 10 * len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) > 3 * n_words
    OR 10 * len(regexp_extract_all(text, '[!?]{2}')) > 2 * n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 6 * len(lines)
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-•*]\s'))) > 9 * len(lines)) AS kept
FROM b
"""
