"""Model-based selection and baselines with Spark ML, and domain distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.selection import permutation_importance
from cellwright.operators.trees import absolute_tree, ensemble_nodes, feature_edges, path_importance, predicted
from cellwright.sources.files import written_once

#: Rows of a task that fits trees.
TASK_ROWS = 500_000


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.select("*", *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"__{c}") for c in features))
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features").transform(filled)


def tree_importance(df: DataFrame, features: list[str], target: str, rounds: int = 20, seed: int = 0) -> DataFrame:
    """feature, importance: mean absolute path attribution over all rows of boosted trees with absolute loss.

    The columns are written once and dealt into tasks of about ``TASK_ROWS`` rows, so that what a task reads doesn't grow with the table.
    """
    df = written_once(df.select(*dict.fromkeys([*features, target])), "columns")
    df = df.repartition(max(df.rdd.getNumPartitions(), -(-df.count() // TASK_ROWS)))
    model = GBTRegressor(featuresCol="features", labelCol=target, lossType="absolute", stepSize=0.05, maxIter=rounds, maxDepth=4, seed=seed).fit(_assembled(df, features))
    return path_importance(df, features, ensemble_nodes(model))


def recursive_elimination(df: DataFrame, features: list[str], target: str, keep: int, step: float = 0.1, depth: int = 5) -> list[str]:
    """Drop the features with the least importance in a tree of absolute deviations, a tenth of all (one at least) at a time, until ``keep`` are left.

    On equal importances the later feature goes.  The rows' quantiles are taken once; every tree is one pass a level.  The columns are written once: a join behind them would run again in every pass.
    """
    return _left_by_trees(written_once(df.select(*dict.fromkeys([*features, target])), "columns"), features, target, keep, step, depth)


def _left_by_trees(df: DataFrame, features: list[str], target: str, keep: int, step: float = 0.1, depth: int = 5) -> list[str]:
    edges = feature_edges(df, features, target, 32, 128)
    left, at_once = list(features), max(1, int(step * len(features)))
    while len(left) > keep:
        values = dict(zip(features, absolute_tree(df, features, target, depth, edges, left).importance, strict=True))
        order = sorted(left, key=lambda f: (values[f], -left.index(f)))
        gone = set(order[: min(at_once, len(left) - keep)])
        left = [f for f in left if f not in gone]
    return left


def elimination_importance(df: DataFrame, features: list[str], target: str, key: str, keep: int, repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, importance of the features that recursive elimination keeps: permutation importance (mean absolute error) of a tree of them alone."""
    df = written_once(df.select(*dict.fromkeys([key, *features, target])), "columns")
    left = _left_by_trees(df, features, target, keep)
    tree = absolute_tree(df, left, target)
    return permutation_importance(df, left, predicted(tree.nodes, left), target, key, repeats, seed)


def lasso_selection(df: DataFrame, features: list[str], target: str, strength: float = 0.1) -> DataFrame:
    """feature, coefficient (of standardized columns' fit, in the columns' own units) of the features an L1 fit keeps."""
    model = LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=1.0, regParam=strength).fit(_assembled(df, features))
    rows = [(f, float(v)) for f, v in zip(features, model.coefficients.toArray(), strict=True) if v]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def tuned_baseline(train: DataFrame, features: list[str], target: str, key: str, folds: int = 5, strengths: tuple[float, ...] = (0.0, 0.1, 10.0), depths: tuple[int, ...] = (2, 4), rounds: tuple[int, ...] = (5, 20), parallelism: int = 4, seed: int = 0) -> tuple[DataFrame, dict]:
    """A table (model, setting, error, deviation, best) of a line and boosted trees by cross-validation, and the fitted best model of each kind.

    Folds are hashes of the key, so all rows of a cell are in one; a fold that gets no row is left out.  The error is the mean over folds of the mean absolute error, missing features count as 0, and
    settings are fitted side by side.  ``best`` marks the setting with the least error over both models, the first one on ties.
    """
    rows = _assembled(train, features).select("features", F.col(target).cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int").alias("fold"))
    present = sorted(r["fold"] for r in rows.select("fold").distinct().collect())  # folds rows at most
    if len(present) < 2:
        raise ValueError("rows of at least two folds are needed")
    rows = rows.withColumn("fold", F.array_position(F.array(*(F.lit(k) for k in present)), F.col("fold")).cast("int") - 1).cache()
    line, trees = LinearRegression(standardization=True), GBTRegressor(stepSize=0.1, seed=seed)
    grids = {
        "line": (line, ParamGridBuilder().addGrid(line.regParam, list(strengths)).build()),
        "trees": (trees, ParamGridBuilder().addGrid(trees.maxDepth, list(depths)).addGrid(trees.maxIter, list(rounds)).build()),
    }
    found, models = [], {}
    for name, (estimator, grid) in grids.items():
        search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), numFolds=len(present), foldCol="fold", parallelism=parallelism).fit(rows)
        models[name] = search.bestModel
        for setting, error, deviation in zip(grid, search.avgMetrics, search.stdMetrics, strict=True):
            found.append((name, ",".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda x: x[0].name)), float(error), float(deviation)))
    rows.unpersist()
    best = min(range(len(found)), key=lambda k: (found[k][2], k))
    return train.sparkSession.createDataFrame([(*f, k == best) for k, f in enumerate(found)], "model string, setting string, error double, deviation double, best boolean"), models


def life_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """test with pred: a linear fit of the target on the features, missing ones as 0."""
    fill = lambda df: df.select("*", *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"__{c}") for c in features))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features"), LinearRegression(featuresCol="features", labelCol=target, predictionCol="pred", regParam=1e-6)])
    scored = pipeline.fit(fill(train)).transform(fill(test))
    return scored.select(*test.columns, "pred")


def resampled_domain(target: DataFrame, source: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """As many rows of ``target`` as ``source`` has, drawn with replacement: each source row takes the target row at a hashed place."""
    n = target.count()
    if not n:
        return target
    numbered = target.withColumn("__p", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64)).alias("s")).orderBy(key)) - 1).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(64)))
    sizes = numbered.groupBy("__s").agg(F.count("*").alias("c")).orderBy("__s").collect()  # 64 rows
    bounds, total = [], 0
    for row in sizes:
        bounds.append((row["__s"], total, row["c"]))
        total += row["c"]
    offsets = target.sparkSession.createDataFrame(bounds, "__s bigint, __first bigint, __c bigint")
    placed = numbered.join(F.broadcast(offsets), "__s").withColumn("__place", F.col("__p") + F.col("__first")).drop("__p", "__s", "__first", "__c")
    wanted = source.select(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).alias("__place"))
    return wanted.join(placed, "__place").drop("__place")


def mmd(domain: DataFrame, features: int = 64, seed: int = 0, bandwidths: int = 5) -> DataFrame:
    """mmd2 of two domains (domain 0/1, x array<double>): random Fourier features of five Gaussian kernels around the mean pair distance.

    Means by domain and feature are all that is gathered, whatever the number of rows.
    """
    dim = len(domain.select("x").first()["x"])
    spread = domain.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.var_pop("v").alias("s")).agg(F.sum("s")).first()[0] or 1.0
    rng = np.random.default_rng(seed)
    cols = []
    for b in range(bandwidths):
        width = 2 * spread * 2.0 ** (b - bandwidths // 2)
        w = rng.standard_normal((features, dim)) * np.sqrt(2 / width)
        for row, phase in zip(w, rng.uniform(0, 2 * np.pi, features), strict=True):
            dot = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in row)), lambda p, q: p * q), F.lit(float(phase)), lambda p, q: p + q)
            cols.append(F.cos(dot) * float(np.sqrt(2 / features)))
    means = domain.groupBy("domain").agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)))
    a, b = means.filter("domain = 0"), means.filter("domain = 1").select(*(F.col(f"m{k}").alias(f"n{k}") for k in range(len(cols))))
    return a.crossJoin(b).select((sum((F.pow(F.col(f"m{k}") - F.col(f"n{k}"), F.lit(2.0)) for k in range(len(cols))), F.lit(0.0)) / bandwidths).alias("mmd2"))


#: A row goes to so many tiles at most.
GROUPS = 24


def mmd_exact(domain: DataFrame, key: str, bandwidths: int = 5, multiplier: float = 2.0, block: int = 1000) -> DataFrame:
    """mmd2 and bandwidth of two domains (domain 0/1, x array<double>, a unique key): means of a sum of Gaussian kernels within and between them.

    The kernels' widths are powers of ``multiplier`` around the mean squared distance, which comes from sums alone.  Rows are dealt into blocks of about ``block``, or ``GROUPS`` larger ones, by a hash
    of the key, and every pair of blocks is a tile that returns three partial sums: time grows with the square of the rows, what is shuffled with ``GROUPS`` times the rows at most.  A task holds
    the rows of two blocks, and the distances of ``block`` times ``block`` pairs at once.
    """
    rows = domain.filter("x is not null").select("domain", F.col(key).alias("key"), "x")
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if not n.get(0) or not n.get(1):
        return domain.sparkSession.createDataFrame([(None, None)], "mmd2 double, bandwidth double")
    squares = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("s")).first()
    mean = (2 * total * squares["q"] - 2 * squares["s"]) / (total * (total - 1)) or 1.0
    widths = [mean / multiplier ** (bandwidths // 2) * multiplier**k for k in range(bandwidths)]
    blocks = min(GROUPS, max(1, -(-total // block)))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    other = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    placed = other.select(F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), "b", "domain", "x")

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        first = (pdf["b"] == key[0]).to_numpy()
        x, p = np.stack(pdf["x"].to_numpy()), pdf["domain"].to_numpy()
        (x, p), (y, q) = (x[first], p[first]), ((x[first], p[first]) if same else (x[~first], p[~first]))
        out = np.zeros(4)
        for m in range(0, len(x), block):  # no more than block * block distances at once
            for n_ in range(0, len(y), block):
                u, v = x[m : m + block], y[n_ : n_ + block]
                far = np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * u @ v.T, 0)
                kernel = sum(np.exp(-far / w) for w in widths)
                d, e = p[m : m + block], q[n_ : n_ + block]
                out += [kernel[np.ix_(d == f, e == g)].sum() for f in (0, 1) for g in (0, 1)]
        within0, between, back, within1 = out if same else out * 2
        return pd.DataFrame({"within0": [within0], "within1": [within1], "between": [between if same else (between + back) / 2]})

    sums = placed.groupBy("i", "j").applyInPandas(tile, "within0 double, within1 double, between double")
    whole = sums.agg(*(F.sum(c).alias(c) for c in ("within0", "within1", "between")))
    loss = F.col("within0") / float(n[0]) ** 2 + F.col("within1") / float(n[1]) ** 2 - 2 * F.col("between") / (float(n[0]) * float(n[1]))
    return whole.select(loss.alias("mmd2"), F.lit(float(mean)).alias("bandwidth"))


def jittered(points: DataFrame, keys: list[str], order: str, value: str, length: int, holes: int = 10, half: int = 2, sigma: float = 0.02, seed: int = 0) -> DataFrame:
    """Multiplicative noise within ``half`` points of hash-drawn holes, clipped at 3 sigma; other points stay."""
    centres = F.transform(F.sequence(F.lit(1), F.lit(holes)), lambda h: F.pmod(F.xxhash64(F.lit(seed), h, *keys), F.lit(length)))
    inside = F.exists(centres, lambda c: F.abs(F.col(order) - c) <= half)
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), *keys, order), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    noise = F.greatest(F.lit(-3 * sigma), F.least(F.lit(3 * sigma), normal * sigma))
    return points.withColumn(value, F.when(inside, F.col(value) * (1 + noise)).otherwise(F.col(value)))


def low_rank_spectrum(points: DataFrame, keys: list[str], order: str, value: str, length: int, keep: int = 5) -> DataFrame:
    """The series with its ``keep`` frequencies of largest amplitude only: a join with the cosine and sine basis, ranks, and the inverse join.

    ``order`` runs from 0 to length - 1.
    """
    spark = points.sparkSession
    angle = lambda t, f: 2 * 3.141592653589793 * F.col(t) * F.col(f) / length
    basis = spark.range(length // 2 + 1).select(F.col("id").alias("f"))
    spectrum = points.crossJoin(F.broadcast(basis)).groupBy(*keys, "f").agg(F.sum(F.col(value) * F.cos(angle(order, "f"))).alias("re"), F.sum(-F.col(value) * F.sin(angle(order, "f"))).alias("im"))
    ranked = spectrum.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "f"))).filter(F.col("k") <= keep)
    times = spark.range(length).select(F.col("id").alias(order))
    twice = F.when((F.col("f") == 0) | (F.col("f") * 2 == length), 1.0).otherwise(2.0)
    return ranked.crossJoin(F.broadcast(times)).groupBy(*keys, order).agg((F.sum(twice * (F.col("re") * F.cos(angle(order, "f")) - F.col("im") * F.sin(angle(order, "f")))) / length).alias(value))


def mixed_spectrum(points: DataFrame, keys: list[str], order: str, value: str, share: float, mix: bool = True, dominant: int = 3, seed: int = 0, shard_series: int = 100_000) -> DataFrame:
    """keys, order, value: each series with a hashed ``share`` of its frequencies taken from another series (or, without ``mix``, left out).

    The ``dominant`` frequencies of largest amplitude stay.  A series' partner is the next one of the same length in a hashed order (the last one's the first), in shards of about
    ``shard_series`` series, so the only window is over whole series; one that is alone keeps its own frequencies.  A missing value counts as 0.
    """
    listed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("__s"))
    series = listed.select(*keys, F.col("__s.o").alias("__o"), F.col("__s.v").alias("__x"))
    shards = max(1, series.count() // shard_series)
    place = F.xxhash64(F.lit(seed), *keys)
    w = Window.partitionBy(F.size("__x"), F.pmod(F.xxhash64(F.lit(seed + 1), *keys), F.lit(shards))).orderBy(place, *keys)
    paired = series.withColumn("__y", F.coalesce(F.lead("__x").over(w), F.first("__x").over(w)))
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed + 2), k, *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = paired.withColumn("__u", F.transform(F.sequence(F.lit(0), (F.size("__x") / 2).cast("int")), draw))

    def blend(x: pd.Series, y: pd.Series, u: pd.Series) -> pd.Series:
        out = []
        for own, other, dice in zip(x, y, u, strict=True):
            spectrum = np.fft.rfft(own)
            amplitude = np.abs(spectrum)
            rank = np.empty(len(amplitude), int)
            rank[np.argsort(-amplitude, kind="stable")] = np.arange(len(amplitude))
            moved = (dice < share) & (rank >= dominant)
            spectrum[moved] = np.fft.rfft(other)[moved] if mix else 0
            out.append(np.fft.irfft(spectrum, n=len(own)))
        return pd.Series(out)

    blended = drawn.withColumn("__z", F.pandas_udf(blend, "array<double>")("__x", "__y", "__u"))
    return blended.select(*keys, F.explode(F.arrays_zip("__o", "__z")).alias("p")).select(*keys, F.col("p.__o").alias(order), F.col("p.__z").alias(value))
