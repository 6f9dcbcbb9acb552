"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees over the statistics give paths; each path is a conjunction of thresholds (a rule); a logistic model with an L1
penalty keeps few of them. The rules and their weights become one Spark column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import documents, fold_of, stored

#: Labelled rows that training reads at most, about: all of them below that, an even sample by hash above.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002
HELD_FOLDS, HELD_FOLD = 3, 1


def features(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all shares or means, defined for any text (0 for an empty one)."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.length(whole)
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern))
    words = count(r"[^\x20\x09-\x0D]+")
    over = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0)).cast("double")
    return {
        "log_words": F.log1p(words.cast("double")),
        "word_length": over(chars - count(r"[\x20\x09-\x0D]"), words),
        "symbols": over(count(r"[#*$%&|<>@^_~=+\\{}\[\]]"), chars),
        "marks": over(count(r"[.,;:!?]"), words),
        "shouts": over(count(r"[!?]{2}"), words),
        "sentences": over(count(r"[\p{Ll}\d][.!?](\s|$)"), words),
        "capital_words": over(count(r"\p{Lu}{2,}"), words),
        "capital_starts": over(count(r"(?<!\S)\p{Lu}\p{Ll}"), words),
        "digits": over(count(r"\d"), chars),
        "letters": over(count(r"\p{L}"), chars),
        "bars": over(count(r"(?<!\S)[^\p{L}\d\s]+(?!\S)"), words),
        "stutter": over(count(r"(?<!\S)(\S+)(?=\s+\1(?!\S))"), words),
        "short_words": over(count(r"(?<!\S)\p{L}{1,3}(?!\S)"), words),
        "lines": over(count(r"\n"), words),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, is_above, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & ((values[name] > at) if above else (values[name] <= at))
        return out


@dataclass(frozen=True)
class Model:
    """Rules with weights; ``score`` is 1 / (1 + exp(-(bias + weights of the rules that hold)))."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(values), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


_STEP = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)$")


def paths(description: str, names: list[str]) -> set[Rule]:
    """Every path from a root, of any length, in a tree model's ``toDebugString``."""
    found, open_ = set(), []
    for line in description.splitlines():
        step = _STEP.match(line)
        if step:
            depth = len(step[1])
            open_ = [t for t in open_ if t[0] < depth] + [(depth, (names[int(step[3])], step[4] == ">", float(step[5])))]
            found.add(Rule(_shortest([t for _, t in open_])))
    return found


def _shortest(terms: list[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """One threshold per feature and direction, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, at in terms:
        old = tight.get((name, above), at)
        tight[name, above] = max(old, at) if above else min(old, at)
    return tuple(sorted((name, above, at) for (name, above), at in tight.items()))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """Rules and weights from (text, label 0 or 1) rows. With labels of one kind only the score is that share."""
    values = features(F.col(text))
    names = list(values)
    table = stored(labelled.select(F.col(label).cast("double").alias("label"), *[c.alias(n) for n, c in values.items()]).where("label IS NOT NULL"), "statistics")
    n, share = table.agg(F.count("*"), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return Model(30.0 * (2 * share - 1) if n else 0.0, ())
    forest = RandomForestClassifier(labelCol="label", featuresCol="f", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=11, minInstancesPerNode=max(1, n // 1000))
    vectors = VectorAssembler(inputCols=names, outputCol="f").transform(table)
    rules = sorted({r for tree in forest.fit(vectors).trees for r in paths(tree.toDebugString, names)}, key=lambda r: r.terms)
    if not rules:
        return Model(math.log(share / (1 - share)), ())  # no statistic tells the labels apart
    columns = {name: F.col(name) for name in names}
    held = table.select("label", F.array(*[r.column(columns).cast("double") for r in rules]).alias("held"))
    sparse = held.select("label", array_to_vector("held").alias("f"))
    fitted = LogisticRegression(labelCol="label", featuresCol="f", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(sparse)
    kept = tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w)
    return Model(float(fitted.intercept), kept)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, about ``rows`` of them."""
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("label"))
    known = known.where(fold_of(F.col("doc_id"), HELD_FOLDS) != HELD_FOLD)
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return documents(docs, doc_id, text).join(known, "doc_id").select("text", "label")


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts have the statistics of an empty text."""
    rows = documents(docs, doc_id, text)
    values = rows.select("doc_id", *[c.alias(n) for n, c in features(F.col("text")).items()])
    score = model.score({n: F.col(n) for n in values.columns if n != "doc_id"})
    out = values.select("doc_id", (fold_of(F.col("doc_id"), HELD_FOLDS) == HELD_FOLD).alias("held_out"), score.alias("score"))
    return out.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that the model gives at least one half. Order and repeats stay."""
    values = features(F.col("t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))
    table = rows.select("row", *[c.alias(n) for n, c in values.items()])
    judged = table.select("row", model.score({n: F.col(n) for n in values}).alias("score"))
    return judged.select(F.explode(F.when(F.col("score") >= 0.5, F.array("row"))).alias("row")).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Fits on the labels outside the held-out fold (ids whose crc32 as text, modulo 3, is 1) and scores every row.

    No label, an empty table of labels, or labels of one kind give a constant score. Rows whose id is null are not
    learned from, and are not held out; repeated rows score alike; very long texts are scored whole; other columns play no part.
    """
    return scored(docs, fit(training_rows(docs, labels, rows, doc_id, text, quality)), doc_id, text)
