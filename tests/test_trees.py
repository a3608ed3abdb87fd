"""Quantiles, inversions, trees of absolute deviations and path attributions against loops."""

from itertools import combinations, permutations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from cellwright.operators import models, ranks, selection, trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (200, 4)), 1)
    y = np.round(3 * x[:, 0] - np.abs(x[:, 1]) + x[:, 2] * x[:, 0], 1)
    return spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id bigint, a double, b double, c double, d double, y double").repartition(3), x, y


def test_quantiles_of_all_columns_at_once(spark):
    rng = np.random.default_rng(0)
    own = {"a": rng.normal(size=501) * 10.0 ** rng.integers(-200, 200, 501), "b": rng.choice([-1.5, -0.0, 0.0, 2.0], 501), "c": np.full(501, np.nan)}
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in zip(*own.values(), strict=True)], "a double, b double, c double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = ranks.quantiles(df, ["a", "b", "c"], shares)
    assert got["a"] == pytest.approx(np.quantile(own["a"], shares).tolist(), rel=1e-12) and got["b"] == pytest.approx(np.quantile(own["b"], shares).tolist()) and got["c"] == []
    plain = ranks.quantiles(df, ["a"], shares, interpolate=False)["a"]
    assert plain == np.quantile(own["a"], shares, method="inverted_cdf").tolist()
    assert ranks.quantiles(df.limit(0), ["a"], shares) == {"a": []}


def brute_tau(x, y):
    s, tx, ty = 0, 0, 0
    for i, j in combinations(range(len(x)), 2):
        s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        tx += x[i] == x[j]
        ty += y[i] == y[j]
    n = len(x) * (len(x) - 1) / 2
    return s / np.sqrt((n - tx) * (n - ty))


@pytest.mark.parametrize("strip", [1_000_000, 40, 7])
def test_tau_equals_a_loop_over_pairs(spark, strip):
    """Distinct values, many ties, and one value that holds a third of the rows; in one range and in many."""
    rng = np.random.default_rng(strip)
    x = np.where(rng.random(300) < 0.33, 5.0, np.round(rng.normal(5, 3, 300), 1))
    y = np.where(rng.random(300) < 0.33, -1.0, np.round(x + rng.normal(0, 4, 300), 0))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, None)], "x double, y double").repartition(3)
    got = ranks.kendall(df, "x", "y", strip).first()
    assert got["tau"] == pytest.approx(brute_tau(x, y), abs=1e-12)
    assert ranks.kendall(df.withColumn("x", F.lit(1.0)), "x", "y", strip).first()["tau"] is None


def test_inversions_of_weighted_pairs():
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 9, 80).astype(float), rng.integers(0, 9, 80).astype(float), rng.integers(1, 5, 80)
    want = sum(int(w[i] * w[j]) for i in range(80) for j in range(80) if x[i] < x[j] and y[i] > y[j])
    assert ranks.inversions(x, y, w) == want
    assert ranks.inversions(x, y, w.astype(np.int64) * 2**40) == want * 2**80


def split_loop(x, y):
    """Feature, threshold and gain of the split that lessens the absolute deviation most."""
    dev = lambda v: np.abs(v - np.median(v)).sum() if len(v) else 0.0
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            gain = dev(y) - dev(y[x[:, f] <= t]) - dev(y[x[:, f] > t])
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    return best


def test_splits_of_absolute_trees_equal_a_loop(known):
    df, x, y = known
    grown = trees.absolute_tree(df, NAMES, "y", depth=3, bins=400, target_bins=400)

    def check(at, rows, depth):
        node = grown.nodes[at]
        assert node.value == pytest.approx(np.median(y[rows])) and node.cover == rows.sum()
        gain, f, t = split_loop(x[rows], y[rows])
        if depth == 3 or f is None:
            assert node.feature == -1
            return
        assert (node.feature, node.threshold) == (f, pytest.approx(t))
        check(node.left, rows & (x[:, f] <= t), depth + 1)
        check(node.right, rows & (x[:, f] > t), depth + 1)

    check(0, np.ones(len(y), bool), 0)
    assert grown.importance.sum() == pytest.approx(1) and grown.importance.argmax() == 0
    scored = [r["p"] for r in df.orderBy("id").select(trees.predicted(grown.nodes, NAMES).alias("p")).collect()]
    assert scored == [grown.nodes[k].value for k in trees.reached(grown.nodes, x)]


def test_coarse_bins_and_empty_tables(known, spark):
    df, x, y = known
    assert len(trees.absolute_tree(df, NAMES, "y", depth=2, bins=4, target_bins=8).nodes) == 7
    assert trees.absolute_tree(df.limit(0), NAMES, "y").nodes == [trees.Node(-1, 0.0, -1, -1, 0.0, 0.0)]
    assert trees.absolute_tree(df, NAMES, "y", depth=1, least=150).nodes[0].feature == -1


def shapley_loop(nodes, x):
    """By subsets of features: unknown features follow both branches by cover."""

    def value(at, known):
        node = nodes[at]
        if node.feature < 0:
            return node.value
        if node.feature in known:
            return value(node.left if x[node.feature] <= node.threshold else node.right, known)
        return sum(nodes[c].cover / node.cover * value(c, known) for c in (node.left, node.right))

    out, d = np.zeros(len(x)), len(x)
    for i in range(d):
        others = [k for k in range(d) if k != i]
        for size in range(d):
            for s in combinations(others, size):
                out[i] += factorial(size) * factorial(d - 1 - size) / factorial(d) * (value(0, {*s, i}) - value(0, set(s)))
    return out


@pytest.mark.parametrize("kind", ["tree", "boosted", "absolute"])
def test_attributions_equal_sums_over_subsets(known, kind):
    df, x, y = known
    if kind == "absolute":
        own, score = [(trees.absolute_tree(df, NAMES, "y", depth=4).nodes, 1.0)], None
    else:
        rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)
        model = (DecisionTreeRegressor(labelCol="y", maxDepth=5) if kind == "tree" else GBTRegressor(labelCol="y", maxIter=3, maxDepth=4, lossType="absolute")).fit(rows)
        own = trees.ensemble_nodes(model)
        score = np.array([r["prediction"] for r in model.transform(rows).orderBy("id").collect()])
    tables = [trees.leaf_tables(nodes, weight) for nodes, weight in own]
    got = sum(trees.attributed(leaves, x) for leaves, _ in tables)
    mean = sum(m for _, m in tables)
    raw = sum(w * np.array([n[k].value for k in trees.reached(n, x)]) for n, w in own)
    assert got.sum(1) == pytest.approx(raw - mean)
    if score is not None:
        assert raw == pytest.approx(score)
    for k in range(0, 200, 23):
        assert got[k] == pytest.approx(sum(w * shapley_loop(n, x[k]) for n, w in own))
    found = {r["feature"]: r["importance"] for r in trees.path_importance(df, NAMES, own).collect()}
    assert found == pytest.approx(dict(zip(NAMES, np.abs(got).mean(0), strict=True)))


def test_elimination_drops_what_says_least(known):
    df, _, _ = known
    assert models.recursive_elimination(df, NAMES, "y", keep=1) == ["a"]
    got = {r["feature"]: r["importance"] for r in models.elimination_importance(df, NAMES, "y", "id", keep=2, repeats=2).collect()}
    assert "a" in got and len(got) == 2 and got["a"] == max(got.values()) > 0


def test_permutations_move_one_feature_at_a_time(spark):
    """Two rows a shard's order: every row takes the other's value."""
    df = spark.createDataFrame([(k, float(k), 1.0, float(k)) for k in range(2)], "id int, a double, b double, y double")
    got = {r["feature"]: r["importance"] for r in selection.permutation_importance(df, ["a", "b"], F.col("a") * F.col("b"), "y", "id", repeats=3).collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(0.0)}


def test_information_of_all_features_equals_one_by_one(known):
    df, x, y = known
    some = df.withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b")))
    whole = {r["feature"]: r["mi"] for r in selection.binned_information(some, NAMES, "y", bins=4).collect()}
    for f in NAMES:
        assert selection.binned_information(some, f, "y", bins=4).first()["mi"] == pytest.approx(whole[f])
    a, t = (np.sum(v[:, None] > np.quantile(v, [0.25, 0.5, 0.75]), 1) for v in (x[:, 0], y))
    joint = np.zeros((4, 4))
    np.add.at(joint, (a, t), 1 / len(y))
    p = joint[joint > 0]
    want = (p * np.log(p / np.outer(joint.sum(1), joint.sum(0))[joint > 0])).sum()
    assert whole["a"] == pytest.approx(want)


def test_orders_of_features_average_to_the_attribution():
    """The closed sums are averages over all orders."""
    nodes = [trees.Node(0, 0.5, 1, 2, 0.0, 10.0), trees.Node(-1, 0.0, -1, -1, 4.0, 3.0), trees.Node(1, 0.5, 3, 4, 0.0, 7.0), trees.Node(-1, 0.0, -1, -1, -2.0, 5.0), trees.Node(-1, 0.0, -1, -1, 6.0, 2.0)]
    x = np.array([1.0, 1.0])
    steps = np.zeros(2)
    values = {frozenset(): 0.3 * 4 + 0.5 * -2 + 0.2 * 6, frozenset([0]): 5 / 7 * -2 + 2 / 7 * 6, frozenset([1]): 0.3 * 4 + 0.7 * 6, frozenset([0, 1]): 6.0}
    for order in permutations(range(2)):
        done = frozenset()
        for f in order:
            steps[f] += (values[done | {f}] - values[done]) / 2
            done |= {f}
    leaves, mean = trees.leaf_tables(nodes, 1.0)
    assert trees.attributed(leaves, x[None])[0] == pytest.approx(steps) and mean == pytest.approx(values[frozenset()])


def test_discordant_pairs_with_more_rows_than_ranges(spark, monkeypatch):
    """The number of ranges, and with it the driver's grid, doesn't grow with the rows."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 900, 3000).astype(float), rng.permutation(3000).astype(float)
    asked = []
    plain = ranks.quantiles
    monkeypatch.setattr(ranks, "quantiles", lambda df, columns, shares, **kw: asked.append(len(shares)) or plain(df, columns, shares, **kw))
    counts = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(x, y, strict=True)], "x double, y double, n bigint").repartition(3)
    assert ranks.discordant(counts, 3000, strip=2) == int(sum(((x < x[k]) & (y > y[k])).sum() for k in range(3000)))
    assert asked == [ranks.RANGES - 1]
