"""Boosting on Spark against a plain version that holds all rows in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.operators import boosting

SCHEMA = "id int, x array<double>, y int, held boolean"


def sample(n=2000, seed=3):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 5)), 1)
    x[:, 3] = draw.integers(0, 4, n)
    x[draw.random(n) < 0.05, 1] = np.nan
    pull = x[:, 0] + (x[:, 3] == 2) + draw.normal(size=n)
    y = np.where(pull > 1.2, 0, np.where(np.nan_to_num(x[:, 1]) * x[:, 2] > 0.8, 1, 7))
    return x, y, np.arange(n) % 7 == 0


def frame(spark, x, y, held, parts=3):
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(held[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(x, hit, held, cuts, rounds, depth, step, min_leaf, l2):
    """(feature, cut, value) per round and the held rows' loss after each; no early stop."""

    def whole(v):
        return np.rint(v * boosting.SCALE) / boosting.SCALE

    margin = np.full(len(x), np.log(hit[~held].sum() / (~hit[~held]).sum()))
    trees, losses = [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = whole(p - hit), whole(p * (1 - p))
        tree, where = {}, {0: np.ones(len(x), dtype=bool)}
        value = {0: -step * g[~held].sum() / (h[~held].sum() + l2)}
        for node in range(2**depth - 1):
            rows = where.get(node)
            if rows is None:
                continue
            known, best = rows & ~held, (0.0, None, None)
            for f, at in enumerate(cuts):
                for c in at:
                    left = known & (x[:, f] <= c)
                    right = known & ~(x[:, f] <= c)
                    if left.sum() < min_leaf or right.sum() < min_leaf:
                        continue
                    gain = sum(s * g[m].sum() ** 2 / (h[m].sum() + l2) for s, m in ((1, left), (1, right), (-1, known)))
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
            if best[1] is None:
                continue
            tree[node] = best[1:]
            left = x[:, best[1]] <= best[2]
            for child, side in ((2 * node + 1, rows & left), (2 * node + 2, rows & ~left)):
                where[child] = side
                value[child] = -step * g[side & ~held].sum() / (h[side & ~held].sum() + l2)
        for node, rows in where.items():
            if node not in tree:
                margin = margin + np.where(rows, value[node], 0.0)
        trees.append(tree)
        losses.append(np.logaddexp(0, np.where(hit, -margin, margin))[held].sum())
    return trees, losses, margin


def test_trees_equal_plain_version(spark):
    x, y, held = sample()
    df = frame(spark, x, y, held)
    settings = {"rounds": 23, "depth": 3, "step": 0.3, "min_leaf": 20, "l2": 5.0}  # 23: margins are folded once
    models = boosting.fit(df, 3, held=F.col("held"), patience=100, **settings)
    cuts = boosting.bin_cuts(df.filter("not held").withColumn("x", F.expr("transform(x, v -> if(isnan(v), null, v))")), 5)
    assert models[2] is None  # no row of this target
    scored = df.select("id", boosting.margins(F.col("x"), models[:2]).alias("m")).orderBy("id").collect()
    for k in (0, 1):
        trees, losses, margin = plain(x, y == k, held, cuts, **settings)
        kept = int(np.argmin(losses)) + 1
        assert len(models[k].feature) == kept
        for tree, feature, cut in zip(trees, models[k].feature, models[k].cut):
            assert {n: (int(f), float(c)) for n, (f, c) in enumerate(zip(feature, cut)) if f >= 0} == tree
        if kept == len(trees):
            assert [r.m[k] for r in scored] == pytest.approx(list(margin))
        else:
            _, _, margin = plain(x, y == k, held, cuts, **(settings | {"rounds": kept}))
            assert [r.m[k] for r in scored] == pytest.approx(list(margin))


def test_patience_stops_at_the_lowest_loss_and_partitions_do_not_matter(spark):
    x, y, held = sample(600, seed=5)
    settings = {"rounds": 60, "step": 0.5, "min_leaf": 5}
    one = boosting.fit(frame(spark, x, y, held, 1), 1, held=F.col("held"), patience=4, **settings)[0]
    many = boosting.fit(frame(spark, x, y, held, 5).orderBy("y"), 1, held=F.col("held"), patience=4, **settings)[0]
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and (one.value == many.value).all()
    cuts = boosting.bin_cuts(frame(spark, x, y, held).filter("not held").withColumn("x", F.expr("transform(x, v -> if(isnan(v), null, v))")), 5)
    _, losses, _ = plain(x, y == 0, held, cuts, len(one.feature) + 4, 3, 0.5, 5, boosting.L2)
    assert len(one.feature) < 60 and int(np.argmin(losses)) + 1 == len(one.feature)


def test_odd_rows(spark):
    rows = [(i, [float(i), None, float("nan")], [0, None, 5][i % 3], None) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    model, other = boosting.fit(df, 2, rounds=3, min_leaf=2)  # no held rows: all rounds
    assert other is None and len(model.feature) == 3 and set(np.unique(model.feature)) <= {-1, 0}
    assert np.isfinite(model.margin(np.array([[np.nan] * 3, [1.0, 2.0, 3.0]]))).all()
    assert boosting.fit(df.limit(0), 2) == [None, None]
    assert boosting.fit(df.withColumn("y", F.lit(0)), 1) == [None]
    flat = boosting.fit(df.withColumn("x", F.lit([1.0, 1.0, 1.0])), 1, rounds=2)[0]
    assert (flat.feature == -1).all()


def test_tree_values_of_whole_columns():
    """Equal to walking each row through the tree, uncut nodes and all depths included, and much cheaper per row."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, size=(5000, 9)).astype(np.uint8)
    for depth in (1, 2, 3, 4):
        for _ in range(20):
            inner = 2**depth - 1
            feature = np.where(rng.random(inner) < 0.3, -1, rng.integers(0, 9, inner))
            cut, value = rng.integers(0, 256, inner), rng.normal(size=2 ** (depth + 1) - 1)
            walked = value[boosting._leaves(codes, feature, cut)]
            assert np.array_equal(boosting._tree_values(np.ascontiguousarray(codes.T), feature, cut, value), walked)
