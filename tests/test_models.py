"""Model-based selection, baselines, domains and augmentation against numpy or known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import models, selection

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def known(spark):
    """y = 3 a - b + noise; c says nothing."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1.0, 2.0, 0.5], (400, 3))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 400) + 7
    return spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id bigint, a double, b double, c double, y double"), x, y


def test_tree_importance_ranks_a_known_model(known):
    got = {r["feature"]: r["importance"] for r in models.tree_importance(known[0], NAMES, "y", rounds=5).collect()}
    assert got["a"] > got["b"] > 5 * got["c"]  # in the target's units: mean absolute attributions


def test_elimination_keeps_what_matters(known):
    assert models.recursive_elimination(known[0], NAMES, "y", keep=2) == ["a", "b"]
    assert models.recursive_elimination(known[0], NAMES, "y", keep=1) == ["a"]


@pytest.mark.parametrize("strength", [0.2, 1.5])
def test_lasso_matches_coordinate_descent(known, strength):
    df, x, y = known
    got = {r["feature"]: r["coefficient"] for r in models.lasso_selection(df, NAMES, "y", strength=strength).collect()}
    x, y, beta = x - x.mean(0), y - y.mean(), np.zeros(3)
    penalty = strength * x.std(0, ddof=1)
    for _ in range(500):
        for j in range(3):
            rest = y - x @ beta + x[:, j] * beta[j]
            rho = (x[:, j] @ rest) / len(y)
            beta[j] = np.sign(rho) * max(abs(rho) - penalty[j], 0) / (x[:, j] @ x[:, j] / len(y))
    assert got == pytest.approx({n: b for n, b in zip(NAMES, beta, strict=True) if b}, rel=1e-2)


def test_life_baseline_is_least_squares(known):
    df, x, y = known
    train, test = df.filter("id < 300"), df.filter("id >= 300")
    got = {r["id"]: r["pred"] for r in models.life_baseline(train, test, NAMES, "y").collect()}
    full = np.column_stack([x, np.ones(len(x))])
    beta = np.linalg.lstsq(full[:300], y[:300], rcond=None)[0]
    assert [got[k] for k in range(300, 400)] == pytest.approx((full[300:] @ beta).tolist(), rel=1e-4, abs=1e-3)


def test_resampled_domain_takes_hashed_places(spark):
    target = spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") * 2).alias("label"))
    source = spark.range(1000, 1500).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"))
    got = sorted(r["vec_id"] for r in models.resampled_domain(target, source, "vec_id").collect())
    shards = {r["vec_id"]: r["s"] for r in target.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("s")).collect()}
    order = sorted(shards, key=lambda k: (shards[k], k))
    places = [r["p"] for r in source.select(F.pmod(F.xxhash64(F.lit(0), "vec_id"), F.lit(300)).alias("p")).collect()]
    assert got == sorted(order[p] for p in places) and len(got) == 500 and len(set(got)) > 150


def test_jitter_changes_points_near_holes_only(spark):
    points = spark.range(40 * 50).select((F.col("id") / 50).cast("int").alias("cell"), (F.col("id") % 50).cast("int").alias("seq"), F.lit(4.0).alias("v"))
    got = models.jittered(points, ["cell"], "seq", "v", 50, holes=2, half=1)
    rows = {(r["cell"], r["seq"]): r["v"] for r in got.collect()}
    holes = {r["cell"]: r["h"] for r in points.select("cell").distinct().select("cell", F.array(*(F.pmod(F.xxhash64(F.lit(0), F.lit(k), "cell"), F.lit(50)) for k in (1, 2))).alias("h")).collect()}
    changed = [abs(v / 4 - 1) for v in rows.values() if v != 4.0]
    for (cell, seq), v in rows.items():
        assert (v != 4.0) <= any(abs(seq - h) <= 1 for h in holes[cell])
    assert 40 * 2 < len(changed) <= 40 * 6 and max(changed) <= 0.06 + 1e-12 and np.std(changed) > 0.005
    assert {(r["cell"], r["seq"]): r["v"] for r in models.jittered(points.repartition(5), ["cell"], "seq", "v", 50, holes=2, half=1).collect()} == rows


def domains(n, m, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, 4)), rng.normal(0.5, 1.5, (m, 4))


def exact_mmd(x, y):
    z = np.concatenate([x, y])
    far = ((z[:, None] - z[None]) ** 2).sum(-1)
    width = far.sum() / (len(z) ** 2 - len(z))
    kernel = sum(np.exp(-far / (width / 4 * 2**k)) for k in range(5))
    n = len(x)
    return kernel[:n, :n].mean() + kernel[n:, n:].mean() - 2 * kernel[:n, n:].mean(), width


@pytest.mark.parametrize("block", [1000, 25])
def test_exact_domain_distance(spark, block):
    x, y = domains(90, 60, 3)
    df = spark.createDataFrame([(k, int(k >= 90), list(map(float, v))) for k, v in enumerate(np.concatenate([x, y]))] + [(999, 1, None)], "id int, domain int, x array<double>").repartition(3)
    got = models.mmd_exact(df, "id", block=block).first()
    assert (got["mmd2"], got["bandwidth"]) == pytest.approx(exact_mmd(x, y))
    assert models.mmd_exact(df.filter("domain = 0"), "id").first()["mmd2"] is None


def test_random_features_come_near_the_exact_distance(spark):
    x, y = domains(300, 300, 4)
    df = spark.createDataFrame([(k, int(k >= 300), list(map(float, v))) for k, v in enumerate(np.concatenate([x, y]))], "id int, domain int, x array<double>")
    # the exact form sums five kernels, the other one takes their mean
    assert models.mmd(df).first()["mmd2"] == pytest.approx(models.mmd_exact(df, "id").first()["mmd2"] / 5, rel=0.3)


def spectrum_rows(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    own = {k: rng.normal(size=n) for k, n in enumerate(lengths)}
    return own, spark.createDataFrame([(k, t, float(v)) for k, x in own.items() for t, v in enumerate(x)], "k int, t int, v double").repartition(3)


def as_series(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["k"], []).append(r["v"])
    return out


def test_mixed_frequencies(spark):
    own, df = spectrum_rows(spark, [30, 30, 30, 31, 31, 8])
    same = as_series(models.mixed_spectrum(df, ["k"], "t", "v", 0.0))
    assert all(same[k] == pytest.approx(own[k]) for k in own)
    swapped = as_series(models.mixed_spectrum(df, ["k"], "t", "v", 1.0, dominant=0))
    assert swapped[3] == pytest.approx(own[4]) and swapped[4] == pytest.approx(own[3]) and swapped[5] == pytest.approx(own[5])
    cycle = {k: next(j for j in range(3) if swapped[k] == pytest.approx(own[j])) for k in range(3)}
    assert all(cycle[k] != k for k in range(3)) and sorted(cycle.values()) == [0, 1, 2]
    part = as_series(models.mixed_spectrum(df, ["k"], "t", "v", 0.5, dominant=3))
    for k in range(3):
        a, b, c = (np.fft.rfft(x) for x in (own[k], own[cycle[k]], part[k]))
        from_other = ~np.isclose(c, a)
        assert np.allclose(c[from_other], b[from_other]) and 0 < from_other.sum() < len(a)
        assert not from_other[np.argsort(-np.abs(a))[:3]].any()


def test_left_out_frequencies(spark):
    own, df = spectrum_rows(spark, [24, 25])
    got = as_series(models.mixed_spectrum(df, ["k"], "t", "v", 1.0, mix=False, dominant=4))
    for k in own:
        a = np.fft.rfft(own[k])
        a[np.argsort(-np.abs(a))[4:]] = 0
        assert got[k] == pytest.approx(np.fft.irfft(a, n=len(own[k])))


def test_tuning_equals_a_loop_over_folds(known):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, x, y = known
    table, best = models.tuned_baseline(df, NAMES, "y", "id", folds=3, strengths=(0.0, 1.0), depths=(2,), rounds=(3,))
    rows = {(r["model"], r["setting"]): r for r in table.collect()}
    folds = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(3)).alias("f")).collect()}
    assembled = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)
    for strength in (0.0, 1.0):
        errors = []
        for f in range(3):
            inside = [k for k, v in folds.items() if v == f]
            model = LinearRegression(labelCol="y", regParam=strength).fit(assembled.filter(~F.col("id").isin(inside)))
            scored = model.transform(assembled.filter(F.col("id").isin(inside)))
            errors.append(scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0])
        got = rows["line", f"regParam={strength}"]
        assert got["error"] == pytest.approx(np.mean(errors), rel=1e-6) and got["deviation"] == pytest.approx(np.std(errors), rel=1e-4)
    assert [r["best"] for r in rows.values()].count(True) == 1 and rows["line", "regParam=0.0"]["best"]
    assert len(rows) == 3 and set(best) == {"line", "trees"}
    with pytest.raises(ValueError, match="two folds"):
        models.tuned_baseline(df.filter("id = 1"), NAMES, "y", "id")


@pytest.mark.parametrize("run", [
    lambda df: selection.binned_information(df, ["a", "b"], "y", bins=4).collect(),
    lambda df: selection.spearman_pairs(df, [("a", "b"), ("a", "y")]).collect(),
    lambda df: models.recursive_elimination(df, ["a", "b"], "y", keep=1, depth=2),
    lambda df: models.elimination_importance(df, ["a", "b"], "y", "id", keep=1, repeats=1).collect(),
    lambda df: models.tree_importance(df, ["a", "b"], "y", rounds=1).collect(),
], ids=["information", "spearman", "elimination", "importance", "trees"])
def test_what_makes_the_rows_runs_once(spark, run):
    """Scans and trees read written columns, so a join behind the rows isn't shuffled anew in each of them."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(k, *map(float, rng.normal(size=3))) for k in range(60)], "id bigint, a double, b double, y double").repartition(3)
    run(rows.mapInArrow(seen, rows.schema))
    assert made.value == 60


def test_vectors_go_to_a_bounded_number_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, domain = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(k, int(d), v.tolist()) for k, (d, v) in enumerate(zip(domain, x, strict=True))], "id bigint, domain int, x array<double>")
    want = models.mmd_exact(df, "id").first()["mmd2"]
    monkeypatch.setattr(models, "GROUPS", 3)
    assert models.mmd_exact(df, "id", block=4).first()["mmd2"] == pytest.approx(want, rel=1e-12)
