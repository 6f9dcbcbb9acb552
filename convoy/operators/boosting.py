"""Second-order histogram boosting of many yes/no targets at once, as one Spark aggregation per tree level.

Inputs become quantile bins once. A level of the current tree of every target is one pass: tasks sum gradients and
hessians of their rows by (target, node, input, bin) in NumPy, Spark deals the tasks' histograms by (target, node,
input), and the best cut is found where they are added. Only those cuts, at most targets x nodes x inputs
short rows, reach the driver. Margins are a column of the binned rows, brought up to date every ``FOLD`` rounds.

Gradients are whole multiples of 2 ** -24, so that sums do not depend on the order of tasks (up to 2 ** 53 in all).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Training settings.
ROUNDS = 300
DEPTH = 3
STEP = 0.05
MIN_LEAF = 100
L2 = 5.0
PATIENCE = 15
BINS = 255

SCALE = float(2**24)
FOLD = 20
ROWS_PER_TASK = 50_000
_LOSS = -1


@dataclass
class Boosted:
    """Trees of one target in heap order: row r of ``feature`` is -1 where a node has no cut, else right is x > cut."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``; a missing input goes right."""
        total = np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            total += value[_leaves(x, feature, cut)]
        return total


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of a tree in which each row ends."""
    node, row = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(int(np.log2(len(feature) + 1))):
        inner = node < len(feature)
        at = np.where(inner, node, 0)
        f = np.where(inner, feature[at], -1)
        right = ~(x[row, np.maximum(f, 0)] <= cut[at])
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def bin_cuts(rows: DataFrame, width: int, x: str = "x", bins: int = BINS) -> list[np.ndarray]:
    """Per input the distinct quantiles that part it into at most ``bins`` bins; the largest value is no cut."""
    shares = [i / bins for i in range(1, bins)]
    asked = [F.percentile_approx(F.get(F.col(x), F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(width)]
    tops = [F.max(F.get(F.col(x), F.lit(i))).alias(f"m{i}") for i in range(width)]
    found = rows.agg(*asked, *tops).first()  # inputs x bins numbers
    cuts = [np.unique(np.array(found[f"q{i}"] or [], dtype=float)) for i in range(width)]
    return [c[c < found[f"m{i}"]] if len(c) else c for i, c in enumerate(cuts)]


def _binned(rows: DataFrame, cuts: list[np.ndarray], starts: list[float], tasks: int) -> DataFrame:
    """``bins`` (a byte per input), ``y`` (number of the target, -1 for none), ``held`` and the start margins."""

    first = np.array(starts).tobytes()

    def fill(batches):
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), len(cuts))
            codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield batch[["y", "held"]].assign(bins=[c.tobytes() for c in codes], margins=[first] * len(batch))

    return rows.repartition(tasks).mapInPandas(fill, "y int, held boolean, bins binary, margins binary")


def _unpacked(batches: Iterable[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            codes = np.frombuffer(b"".join(batch["bins"]), dtype=np.uint8).reshape(len(batch), width)
            yield batch, codes, np.frombuffer(b"".join(batch["margins"])).reshape(len(batch), -1).copy()


def _tree_values(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a tree gives to each row. ``columns`` holds the bins of an input after each other: whole columns are compared, as
    picking each row's input costs several times that."""
    levels = int(np.log2(len(feature) + 1))
    path = np.zeros(columns.shape[1], dtype=np.uint8 if levels <= 8 else np.int64)
    for level in range(levels):
        right = np.zeros(columns.shape[1], dtype=bool)
        for place in range(2**level):
            node = 2**level - 1 + place
            if feature[node] >= 0:
                right |= (path == place) & (columns[feature[node]] > int(cut[node]))
        path = 2 * path + right
    ends = np.zeros(2**levels, dtype=np.int64)
    for bit in range(levels - 1, -1, -1):
        cuts_on = (ends < len(feature)) & (feature[np.minimum(ends, len(feature) - 1)] >= 0)
        ends = np.where(cuts_on, 2 * ends + 1 + (np.arange(2**levels) >> bit & 1), ends)
    return value[ends][path]


def _advance(codes: np.ndarray, margins: np.ndarray, trees: dict[int, list]) -> np.ndarray:
    """Margins with the trees that came after the stored ones; cuts are bins here."""
    columns = np.ascontiguousarray(codes.T)
    for k, grown in trees.items():
        for feature, cut, value in grown:
            margins[:, k] += _tree_values(columns, feature, cut, value)
    return margins


def _histograms(rows: DataFrame, width: int, level: int, since: dict[int, list], growing: dict[int, tuple]) -> DataFrame:
    """Rows (k, node, f, hist): gradients, hessians and counts by bin, after each other, one row per task and key.

    The root pass has one row more per target, f = -1: the summed loss of the held rows.
    """
    first, nodes, size = 2**level - 1, 2**level, BINS + 1

    def sums(batches):
        total = {k: np.zeros((3, nodes * width * size)) for k in growing}
        loss = dict.fromkeys(growing, 0.0)
        for batch, codes, stored in _unpacked(batches, width):
            margins, y, held = _advance(codes, stored, since), batch["y"].to_numpy(), batch["held"].to_numpy(dtype=bool)
            offset = codes + np.arange(width, dtype=np.int64) * size
            for k, (feature, cut) in growing.items():
                hit, m = y == k, margins[:, k]
                if level == 0:
                    loss[k] += np.rint(np.logaddexp(0, np.where(hit, -m, m))[held] * SCALE).sum()
                node = _leaves(codes, feature, cut) - first
                use = ~held & (node >= 0)
                p = 1 / (1 + np.exp(-m[use]))
                cell = (node[use, None] * (width * size) + offset[use]).ravel()
                for part, weight in enumerate((np.rint((p - hit[use]) * SCALE), np.rint(p * (1 - p) * SCALE), np.ones(len(p)))):
                    total[k][part] += np.bincount(cell, np.repeat(weight, width), nodes * width * size)
        for k, t in total.items():
            t = t.reshape(3, nodes, width, size)
            keys = [(k, first + n, f, t[:, n, f].tobytes()) for n in range(nodes) if t[2, n].any() for f in range(width)]
            if level == 0:
                keys.append((k, 0, _LOSS, np.r_[loss[k], np.zeros(3 * size - 1)].tobytes()))
            yield pd.DataFrame(keys, columns=["k", "node", "f", "hist"])

    return rows.mapInPandas(sums, "k int, node int, f int, hist binary")


def _cuts_found(partial: DataFrame, parts: int, min_leaf: int, l2: float) -> DataFrame:
    """Per (k, node, f) the cut of the largest gain and the sums on its two sides; the first bin wins ties.

    A task adds as it reads and holds one histogram per key, however many tasks sent theirs.
    """
    size = BINS + 1

    def best(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, hist in zip(zip(batch["k"], batch["node"], batch["f"]), batch["hist"]):
                part = np.frombuffer(hist)
                total[key] = total[key] + part if key in total else part
        if not total:
            return
        hist = np.stack(list(total.values())).reshape(len(total), 3, size)
        g, h, n = hist[:, 0] / SCALE, hist[:, 1] / SCALE, hist[:, 2]
        gl, hl, nl = (np.cumsum(a, axis=1) for a in (g, h, n))
        gs, hs, ns = (a[:, -1:] for a in (gl, hl, nl))
        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
        gain = np.where((nl >= min_leaf) & (ns - nl >= min_leaf), gain, 0.0)
        cut, row = gain.argmax(axis=1), np.arange(len(total))
        yield pd.DataFrame(list(total), columns=["k", "node", "f"]).assign(
            gain=gain[row, cut], cut=cut, gl=gl[row, cut], hl=hl[row, cut], g=gs[:, 0], h=hs[:, 0], loss=hist[:, 0, 0],
        )

    schema = "k int, node int, f int, gain double, cut int, gl double, hl double, g double, h double, loss double"
    return partial.repartition(parts, "k", "node", "f").mapInPandas(best, schema)


def fit(
    rows: DataFrame, targets: int, x: str = "x", y: str = "y", held: Column | None = None, rounds: int = ROUNDS, depth: int = DEPTH,
    step: float = STEP, min_leaf: int = MIN_LEAF, l2: float = L2, patience: int = PATIENCE,
) -> list[Boosted | None]:
    """Boosted trees for each target 0 .. ``targets`` - 1 against the rest; None where rows of one side are missing.

    ``x`` is an array of doubles of one length, missing values as NaN or null; ``y`` the number of the row's target,
    any other number or null for none. Rows with ``held`` are not learned from: a target stops when the loss on them
    has not fallen for ``patience`` trees and keeps the trees up to the lowest loss, at least one. Without held rows
    all rounds are kept. Equal gains go to the first input and bin. Needs a checkpoint folder.
    """
    nan = F.transform(F.col(x).cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan"))))
    flag = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    rows = rows.select(nan.alias("x"), F.coalesce(F.col(y).cast("int"), F.lit(-1)).alias("y"), flag.alias("held"))
    counted = rows.groupBy("held", F.when(F.col("y").between(0, targets - 1), F.col("y")).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")
    ).collect()  # two rows per target
    learned = sum(r["n"] for r in counted if not r["held"])
    watched = any(r["held"] for r in counted)
    yes = {k: sum(r["n"] for r in counted if not r["held"] and r["y"] == k) for k in range(targets)}
    active = [k for k in range(targets) if 0 < yes[k] < learned]
    if not active:
        return [None] * targets
    width = max(r["width"] for r in counted)
    starts = [float(np.log(yes[k] / (learned - yes[k]))) if k in active else 0.0 for k in range(targets)]
    missing_last = F.transform("x", lambda v: F.when(~F.isnan(v), v))
    cuts = bin_cuts(rows.filter(~F.col("held")).select(missing_last.alias("x")), width)
    total = sum(r["n"] for r in counted)
    tasks = -(-total // ROWS_PER_TASK)
    stored = _binned(rows, cuts, starts, tasks).checkpoint()

    inner, every = 2**depth - 1, 2 ** (depth + 1) - 1
    trees: dict[int, list] = {k: [] for k in active}
    losses: dict[int, list[float]] = {k: [] for k in active}
    folded = 0
    for done in range(rounds + watched):  # a last pass for the loss of all rounds
        growing = {k: (np.full(inner, -1), np.zeros(inner, dtype=np.int64), np.zeros(every)) for k in active}
        if done - folded == FOLD:
            stored, folded = _folded(stored, width, {k: trees[k][folded:] for k in active}), done
        for level in range(depth if done < rounds else 1):
            since = {k: trees[k][folded:] for k in growing}
            keys = len(growing) * 2**level * width
            partial = _histograms(stored, width, level, since, {k: (t[0], t[1]) for k, t in growing.items()})
            found = _cuts_found(partial, -(-keys // 16) if tasks > 1 else 1, min_leaf, l2).collect()  # targets x nodes x inputs
            if level == 0 and watched:
                for r in found:
                    if r["f"] == _LOSS:
                        losses[r["k"]].append(r["loss"])
                active = [k for k in active if not _settled(losses[k], patience)]
                growing = {k: t for k, t in growing.items() if k in active}
            if not growing or done == rounds:
                break
            _grow([r for r in found if r["f"] != _LOSS and r["k"] in growing], growing, step, l2)
        if not active or done == rounds:
            break
        for k, tree in growing.items():
            trees[k].append(tree)
    return [_kept(trees[k], losses[k], starts[k], cuts) if k in trees else None for k in range(targets)]


def _settled(losses: list[float], patience: int) -> bool:
    after = losses[1:]
    return len(after) > patience and after.index(min(after)) + patience < len(after)


def _grow(found: list, growing: dict[int, tuple], step: float, l2: float) -> None:
    """Sets the best cut of each node and the values of the nodes below it; a root gets a value of its own."""
    best: dict[tuple[int, int], object] = {}
    for r in sorted(found, key=lambda r: (-r["gain"], r["f"])):
        best.setdefault((r["k"], r["node"]), r)
    for (k, node), r in best.items():
        feature, cut, value = growing[k]
        if node == 0:
            value[0] = -step * r["g"] / (r["h"] + l2)
        if r["gain"] > 0:
            feature[node], cut[node] = r["f"], r["cut"]
            value[2 * node + 1] = -step * r["gl"] / (r["hl"] + l2)
            value[2 * node + 2] = -step * (r["g"] - r["gl"]) / (r["h"] - r["hl"] + l2)


def _folded(stored: DataFrame, width: int, since: dict[int, list]) -> DataFrame:
    """The stored rows with up-to-date margins, in the shared folder: lineage does not grow with the rounds."""

    def move(batches):
        for batch, codes, before in _unpacked(batches, width):
            yield batch.assign(margins=[m.tobytes() for m in _advance(codes, before, since)])

    return stored.mapInPandas(move, stored.schema).checkpoint()


def _kept(trees: list, losses: list[float], start: float, cuts: list[np.ndarray]) -> Boosted:
    after = losses[1:]
    trees = trees[: after.index(min(after)) + 1] if after else trees
    real = [[float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(feature, cut)] for feature, cut, _ in trees]
    return Boosted(start, np.array([t[0] for t in trees]), np.array(real), np.array([t[2] for t in trees]))


def margins(x: Column, models: list[Boosted]) -> Column:
    """Array of the log-odds of each model for an array of inputs, one Arrow pass for all models."""

    @F.pandas_udf("array<double>")
    def of(batch: pd.Series) -> pd.Series:
        rows = np.array(batch.tolist(), dtype=float)
        return pd.Series(list(np.stack([m.margin(rows) for m in models], axis=1)))

    return of(x)
