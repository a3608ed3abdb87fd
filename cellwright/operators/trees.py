"""Trees on many rows: splits that minimise absolute deviation, and exact attributions along the paths of trees."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.operators.ranks import quantiles


class Node(NamedTuple):
    """An inner node sends rows with x[feature] <= threshold to the left; a leaf has feature -1."""

    feature: int
    threshold: float
    left: int
    right: int
    value: float
    cover: float


class Grown(NamedTuple):
    nodes: list[Node]
    importance: np.ndarray


def matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first n columns, missing as 0."""
    out = np.empty((batch.num_rows, n))
    for k in range(n):
        out[:, k] = batch.column(k).to_numpy(zero_copy_only=False)
    return np.nan_to_num(out)


def reached(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    feature, threshold, left, right = (np.array([getattr(v, c) for v in nodes]) for c in ("feature", "threshold", "left", "right"))
    rows = np.arange(len(x))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        here = at[inner]
        at[inner] = np.where(x[rows[inner], feature[here]] <= threshold[here], left[here], right[here])


def predicted(nodes: list[Node], features: list[str], at: int = 0) -> Column:
    """A tree as an expression of its columns."""
    own = nodes[at]
    if own.feature < 0:
        return F.lit(own.value)
    return F.when(F.coalesce(F.col(features[own.feature]), F.lit(0.0)) <= own.threshold, predicted(nodes, features, own.left)).otherwise(predicted(nodes, features, own.right))


def feature_edges(df: DataFrame, features: list[str], target: str, bins: int, target_bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Values that may be thresholds, and the target's; all distinct values where there are fewer than bins."""
    filled = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*features, target)))
    found = quantiles(filled, features, [k / bins for k in range(1, bins)], interpolate=False)
    own = quantiles(filled, [target], [k / target_bins for k in range(1, target_bins)], interpolate=False)
    return [np.unique(found[c]) for c in features], np.unique(own[target])


def _histograms(nodes: list[Node], open_nodes: list[int], edges: list[np.ndarray], target_edges: np.ndarray, use: list[int]):
    """A partition's counts and sums of the target by open node, feature, bin and the target's bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_t = len(target_edges) + 1
        place = np.full(len(nodes), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        shapes = [(len(open_nodes), len(edges[f]) + 1, n_t) for f in use]
        counts, sums = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for batch in batches:
            x = matrix(batch, len(edges) + 1)
            y = x[:, -1]
            node = place[reached(nodes, x)]
            inside = node >= 0
            if not inside.any():
                continue
            x, y, node = x[inside], y[inside], node[inside]
            t = np.searchsorted(target_edges, y)
            for k, f in enumerate(use):
                cell = np.ravel_multi_index((node, np.searchsorted(edges[f], x[:, f]), t), shapes[k])
                counts[k] += np.bincount(cell, minlength=counts[k].size).reshape(shapes[k])
                sums[k] += np.bincount(cell, y, counts[k].size).reshape(shapes[k])
        for k, f in enumerate(use):
            a, b, c = np.nonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(open_nodes, np.int64)[a]), pa.array(np.full(len(a), f, np.int64)), pa.array(b), pa.array(c), pa.array(counts[k][a, b, c]), pa.array(sums[k][a, b, c])],
                names=["node", "feature", "bin", "t", "n", "s"],
            )

    return run


def deviation(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of absolute differences from the median, and the median, of histograms along the last axis (counts, sums of the target).

    A bin's values count as their mean: exact where a bin holds one value.
    """
    upto = np.cumsum(n, -1)
    total = upto[..., -1:]
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    low = np.argmax(upto >= np.maximum(total / 2, 1e-9), -1)[..., None]
    high = np.argmax(upto > total / 2, -1)[..., None]
    median = (np.take_along_axis(mean, low, -1) + np.take_along_axis(mean, high, -1)) / 2
    return (n * np.abs(mean - median)).sum(-1), np.where(total[..., 0] > 0, median[..., 0], 0.0)


def _best_split(n_bins: list[int], n_t: int, least: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, feature = key
        n, s = np.zeros((n_bins[feature], n_t)), np.zeros((n_bins[feature], n_t))
        n[pdf["bin"], pdf["t"]], s[pdf["bin"], pdf["t"]] = pdf["n"], pdf["s"]
        left_n, left_s = np.cumsum(n, 0), np.cumsum(s, 0)
        whole, value = deviation(left_n[-1], left_s[-1])
        best = (0.0, -1, 0.0, 0.0, 0.0, 0.0)
        if len(n) > 1:
            left, left_value = deviation(left_n[:-1], left_s[:-1])
            right, right_value = deviation(left_n[-1] - left_n[:-1], left_s[-1] - left_s[:-1])
            size = left_n[:-1].sum(1)
            gain = np.where((size >= least) & (left_n[-1].sum() - size >= least), whole - left - right, -1.0)
            k = int(np.argmax(gain))
            best = (float(gain[k]), k, float(left_value[k]), float(right_value[k]), float(size[k]), float(left_n[-1].sum() - size[k]))
        return pd.DataFrame([(node, feature, *best, float(value), float(left_n[-1].sum()))], columns=[c.split()[0] for c in SPLIT.split(", ")])

    return run


SPLIT = "node bigint, feature bigint, gain double, bin bigint, left_value double, right_value double, left_n double, right_n double, value double, n double"


def absolute_tree(df: DataFrame, features: list[str], target: str, depth: int = 5, edges: tuple[list[np.ndarray], np.ndarray] | None = None, use: list[str] | None = None, least: int = 1, bins: int = 32, target_bins: int = 128) -> Grown:
    """A regression tree whose splits lessen the sum of absolute deviations from the median most; leaves hold medians.

    A level is one pass: histograms of the target by node, feature and bin are built in the tasks and merged by a shuffle, and each (node, feature) finds its best
    split from its own, so only a row for each of them comes to the driver.  Ties go to the first feature and the lowest threshold.  ``use``: the features that may split.
    ``importance``: by how much each feature's splits lessen the deviation, as shares.
    """
    edges = edges or feature_edges(df, features, target, bins, target_bins)
    allowed = [features.index(f) for f in (use or features)]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in (*features, target)))
    importance = np.zeros(len(features))
    nodes = [Node(-1, 0.0, -1, -1, 0.0, 0.0)]
    open_nodes = [0]
    sizes = [len(e) + 1 for e in edges[0]]
    for level in range(depth):
        if not open_nodes:
            break
        parts = rows.mapInArrow(_histograms(nodes, open_nodes, edges[0], edges[1], allowed), "node bigint, feature bigint, bin bigint, t bigint, n double, s double")
        merged = parts.groupBy("node", "feature", "bin", "t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = merged.groupBy("node", "feature").applyInPandas(_best_split(sizes, len(edges[1]) + 1, least), SPLIT).collect()
        best: dict[int, tuple] = {}
        for r in sorted(found, key=lambda r: (-r["gain"], r["feature"])):
            best.setdefault(r["node"], r)
        opened = []
        for at, r in sorted(best.items()):
            if level == 0:
                nodes[at] = nodes[at]._replace(value=r["value"], cover=r["n"])
            if r["gain"] <= 1e-9:
                continue
            left = len(nodes)
            nodes.append(Node(-1, 0.0, -1, -1, r["left_value"], r["left_n"]))
            nodes.append(Node(-1, 0.0, -1, -1, r["right_value"], r["right_n"]))
            nodes[at] = nodes[at]._replace(feature=r["feature"], threshold=float(edges[0][r["feature"]][r["bin"]]), left=left, right=left + 1)
            importance[r["feature"]] += r["gain"]
            opened += [left, left + 1]
        open_nodes = opened
    return Grown(nodes, importance / importance.sum() if importance.sum() else importance)


def ensemble_nodes(model) -> list[tuple[list[Node], float]]:
    """Node tables and weights of a fitted Spark ML tree or ensemble of trees."""

    def walk(java, out: list[Node]) -> int:
        at = len(out)
        out.append(Node(-1, 0.0, -1, -1, float(java.prediction()), float(java.impurityStats().count())))
        if java.subtreeDepth():
            split = java.split()
            left = walk(java.leftChild(), out)
            right = walk(java.rightChild(), out)
            out[at] = out[at]._replace(feature=split.featureIndex(), threshold=float(split.threshold()), left=left, right=right)
        return at

    tables = []
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    for tree, weight in zip(trees, weights, strict=True):
        nodes: list[Node] = []
        walk(tree._call_java("rootNode"), nodes)
        tables.append((nodes, float(weight)))
    return tables


class Leaf(NamedTuple):
    """A leaf's path: its features, the bounds (low, high] they must lie in, and for each set of satisfied ones what every feature adds."""

    features: list[int]
    low: np.ndarray
    high: np.ndarray
    added: np.ndarray


def leaf_tables(nodes: list[Node], weight: float) -> tuple[list[Leaf], float]:
    """All leaves' tables, and the tree's mean by cover.

    Given that the features of a set are known, a leaf counts its value times, for each feature on its path, one or zero (known: satisfied or not) or the share of rows that take
    its branches (unknown).  Averaged over all orders in which the features become known, this product's Shapley values are closed sums over a path's own features.
    """
    leaves, mean = [], 0.0
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        own = nodes[at]
        if own.feature >= 0:
            low, high, share = path.get(own.feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((own.left, (low, min(high, own.threshold))), (own.right, (max(low, own.threshold), high))):
                kept = nodes[child].cover / own.cover if own.cover else 0.0
                todo.append((child, {**path, own.feature: (*bounds, share * kept)}))
            continue
        features = sorted(path)
        d = len(features)
        share = np.array([path[f][2] for f in features])
        mean += weight * own.value * float(np.prod(share))
        pattern = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1  # which features are satisfied
        added = np.zeros((1 << d, d))
        for i in range(d):
            # coefficient k: sum over sets of k known others
            known = np.zeros((1 << d, d))
            known[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    known[:, 1:] = known[:, 1:] * share[j] + known[:, :-1] * pattern[:, j : j + 1]
                    known[:, 0] *= share[j]
            odds = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            added[:, i] = weight * own.value * (known @ odds) * (pattern[:, i] - share[i])
        leaves.append(Leaf(features, np.array([path[f][0] for f in features]), np.array([path[f][1] for f in features]), added))
    return leaves, mean


def attributed(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """What each feature adds to each row's prediction; a row's sum is its prediction less the mean."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if leaf.features:
            own = x[:, leaf.features]
            pattern = ((own > leaf.low) & (own <= leaf.high)) @ (1 << np.arange(len(leaf.features)))
            out[:, leaf.features] += leaf.added[pattern]
    return out


def path_importance(df: DataFrame, features: list[str], trees: list[tuple[list[Node], float]]) -> DataFrame:
    """feature, importance: the mean absolute attribution over all rows, missing values as 0; one pass, and a row for each feature and task is shuffled."""
    tables = [leaf for nodes, weight in trees for leaf in leaf_tables(nodes, weight)[0]]
    held = df.sparkSession.sparkContext.broadcast(tables)  # 2**depth leaves of 2**depth rows a tree at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(features)), 0
        for batch in batches:
            x = matrix(batch, len(features))
            total += np.abs(attributed(held.value, x)).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(total), pa.array([n] * len(features), pa.int64())], names=["feature", "total", "n"])

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features))
    sums = rows.mapInArrow(run, "feature string, total double, n bigint").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("feature", F.try_divide("total", "n").alias("importance"))
