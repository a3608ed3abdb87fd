"""Edge rules on hand-made cells, and operators beyond SQL against loops and numpy."""

import math

import numpy as np
import pytest

from cellwright.operators import curves, cycle_features, ingest, models, phases, samples, selection


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def samples_of(spark, rows):
    return spark.createDataFrame([(1, 1, k, float(t), float(i), float(v), 25.0) for k, (t, i, v) in enumerate(rows)], "cell_id int, cycle int, seq int, time_s double, current_a double, voltage_v double, temperature_c double")


def test_missing_phase_gives_zeros_and_nulls(spark):
    tel = samples_of(spark, [(0, 1, 3.0), (10, 1, 3.5)])
    row = rows_of(cycle_features.cycle_features(phases.split_phases(tel)), "cell_id")[0]
    assert row["discharge_capacity"] is None and row["coulombic_efficiency"] is None
    assert row["internal_resistance"] == 0 and row["discharge_energy"] == 0 and row["skew_v"] == 0
    assert row["charge_capacity"] == pytest.approx(10 / 3600)


def test_single_sample_and_discharge_first(spark):
    tel = samples_of(spark, [(0, -1, 3.9), (10, 0, 3.9), (20, 1, 3.0)])
    assert [r["phase"] for r in rows_of(phases.split_phases(tel), "seq")] == ["discharge", None, "charge"]
    assert rows_of(phases.workload_type(tel), "cell_id")[0]["workload_type"] == 1
    assert rows_of(cycle_features.cycle_features(phases.split_phases(tel)), "cell_id")[0]["charge_capacity"] is None


def test_trim_without_crossing_keeps_all(spark):
    tel = phases.split_phases(samples_of(spark, [(0, -1, 3.9), (10, -1, 3.5), (20, -1, 3.2)]))
    assert phases.trim_at_voltage(tel, 3.0).count() == 3
    assert phases.trim_at_voltage(tel, 3.5).count() == 2


def test_stitching_matches_a_loop(spark):
    rng = np.random.default_rng(0)
    jumps, gaps = rng.normal(0, 0.1, 30).tolist(), rng.choice([1.0, 20.0], 30, p=[0.8, 0.2]).tolist()
    segs, t, v = [], 0.0, 4.0
    for k in range(30):
        t += gaps[k]
        segs.append((1, 1, k, t, t + 5, v + jumps[k], v + jumps[k] - 0.02))
        t, v = t + 5, v - 0.02
    expected, shift = [], 0.0
    for k, s in enumerate(segs):
        if k == 0 or s[3] - segs[k - 1][4] >= 10:
            shift = 0.0
        else:
            shift = max(0.0, shift + s[5] - segs[k - 1][6])
        expected.append(shift)
    df = spark.createDataFrame(segs, "cell_id int, cycle int, segment int, begin_s double, end_s double, begin_v double, end_v double")
    assert [r["shift_v"] for r in rows_of(phases.stitched(df), "segment")] == pytest.approx(expected)


def test_time_anomalies_match_a_loop(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([1.0, 5.0, 200.0, -150.0], 200)).tolist()
    kept, last = [], None
    for k, x in enumerate(t):
        if last is None or x - last <= 100:
            kept.append(k)
            last = x
    df = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(t)], "cell_id int, cycle int, seq int, time_s double")
    assert [r["seq"] for r in rows_of(ingest.drop_time_anomalies(df, 100.0), "seq")] == kept


def test_cycle_boundaries_match_a_loop(spark):
    sign = ([1] * 12 + [-1] * 15) * 8
    starts = [k for k in range(len(sign)) if k + 10 <= len(sign) and all(s < 0 for s in sign[k : k + 10]) and (k == 0 or sign[k - 1] > 0)]
    kept = []
    for k in starts:
        if not kept or k - kept[-1] > 40:
            kept.append(k)
    df = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate(sign)], "cell_id int, t int, current_a double")
    assert [r["boundary"] for r in rows_of(ingest.cycle_boundaries(df, suppress=40), "boundary")] == kept[1:]


def test_tests_exclude_cycles_like_a_walk(spark):
    cycles = [(1, k, 100.0 * k) for k in range(1, 12)]
    tests = [150.0, 160.0, 170.0, 900.0]
    left, pending = [], sorted(tests)
    for _, k, start in cycles:
        if pending and pending[0] < start:
            pending.pop(0)
        else:
            left.append(k)
    df = spark.createDataFrame(cycles, "cell_id int, cycle int, start_s double")
    out = ingest.exclude_by_tests(df, spark.createDataFrame([(1, t) for t in tests], "cell_id int, test_s double"))
    assert [r["cycle"] for r in rows_of(out, "cycle")] == left


def test_known_tau(spark):
    t = np.arange(0, 2000, 20.0)
    rows = [(float(x), 0.3 * math.exp(-x / 333) + 0.05, 4.2) for x in t]
    tau = rows_of(cycle_features.current_tau(samples_of(spark, rows), uvp=4.2), "cell_id")[0]["cv_tau"]
    assert tau == pytest.approx(333, rel=2e-3)
    flat = rows_of(cycle_features.current_tau(samples_of(spark, [(x, 0.1, 4.2) for x in t]), uvp=4.2), "cell_id")[0]
    assert flat["cv_tau"] == 0


def curve_of(spark, y, x=None):
    x = range(len(y)) if x is None else x
    return spark.createDataFrame([(1, 1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cell_id int, cycle int, i int, x double, y double")


def test_savgol_keeps_polynomials_and_matches_fits(spark):
    x = np.arange(40.0)
    y = 0.5 * x**2 - 3 * x + 1
    got = [r["smooth"] for r in rows_of(curves.savgol(curve_of(spark, y), 11, 3), "i")]
    assert got == pytest.approx(y.tolist())
    noisy = np.random.default_rng(2).normal(0, 1, 40)
    got = np.array([r["smooth"] for r in rows_of(curves.savgol(curve_of(spark, noisy), 11, 3), "i")])
    fit = lambda a, at: np.polyval(np.polyfit(np.arange(11), noisy[a : a + 11], 3), at)
    expected = [fit(0, k) for k in range(5)] + [fit(k - 5, 5) for k in range(5, 35)] + [fit(29, k - 29) for k in range(35, 40)]
    assert got == pytest.approx(np.array(expected))


def test_peaks_plateaus_and_prominence(spark):
    y = [0, 1, 3, 3, 3, 1, 2, 0, 5, 0, 1, 1]
    got = rows_of(curves.peaks(curve_of(spark, y)), "i")
    assert [(r["i"], r["prominence"]) for r in got] == [(3, 3.0), (6, 1.0), (8, 5.0)]
    widths = rows_of(curves.peak_widths(curves.peaks(curve_of(spark, y)), curve_of(spark, y)), "i")
    assert widths[2]["width"] == pytest.approx(1.0) and widths[0]["left"] == pytest.approx(1.25)


def test_resample_is_exact_on_lines(spark):
    x = np.sort(np.random.default_rng(3).uniform(3, 4, 30))
    df = spark.createDataFrame([(1, 1, k, float(a), float(2 * a + 1)) for k, a in enumerate(x)], "cell_id int, cycle int, seq int, v double, q double")
    got = rows_of(curves.resample(df, step=0.01, least=100), "i")
    assert len(got) == 100 and [r["y"] for r in got] == pytest.approx([2 * r["x"] + 1 for r in got])
    assert got[0]["x"] == pytest.approx(x[0]) and got[-1]["x"] == pytest.approx(x[-1])


def test_short_curves_go(spark):
    df = lambda n: spark.createDataFrame([(1, 1, k, 3.0 + k / 10, 1.0 + k) for k in range(n)], "cell_id int, cycle int, seq int, v double, q double")
    assert curves.prepare(df(14), 0.0).count() == 0 and curves.prepare(df(15), 0.0).count() == 15


def test_collinearity_is_order_free_and_ties(spark):
    corr = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.99), ("a", "c", 0.5)], "a string, b string, r double")
    rank = spark.createDataFrame([("a", 0, 1, 0.5), ("b", 1, 1, 0.5), ("c", 2, 1, 0.5)], "feature string, position int, level int, target_r double")
    assert [r["dropped"] for r in rows_of(selection.collinear_losers(corr, rank, 0.9), "dropped")] == ["b", "c"]


def test_two_stages(spark):
    corr = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.97), ("a", "c", 0.97)], "a string, b string, r double")
    rank = spark.createDataFrame([("a", 0, 1, 0.5, "f"), ("b", 1, 1, 0.5, "f"), ("c", 2, 1, 0.9, "g")], "feature string, position int, level int, target_r double, family string")
    out = [(r["stage"], r["dropped"]) for r in rows_of(selection.two_stage_losers(corr, rank, 0.98, 0.95), "stage")]
    assert out == [(1, "b"), (2, "a")]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(5)], "p double, q double")
    assert selection.pearson_pairs(df, [("p", "q")]).first()["r"] is None


def test_permutation_importance_of_a_known_model(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, float(a), float(b), float(3 * a)) for k, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))], "id int, a double, b double, y double")
    from pyspark.sql import functions as F

    got = {r["feature"]: r["importance"] for r in selection.permutation_importance(df, ["a", "b"], F.col("a") * 3, "y", "id", repeats=2).collect()}
    assert got["b"] == 0 and 2 < got["a"] < 5


def test_density_weights_match_numpy(spark):
    life = np.random.default_rng(5).normal(500, 100, 200)
    df = spark.createDataFrame([(float(x),) for x in life], "life double")
    got = {r["life"]: r["weight"] for r in samples.density_weights(df).collect()}
    assert np.mean(list(got.values())) == pytest.approx(1)
    assert got[float(life.max())] > got[float(np.sort(life)[100])]


def test_scaler_and_point_adjust(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, float(k), 1.0) for k in range(10)], "id int, a double, b double")
    out = [r.asDict() for r in samples.standard_scale(df, ["a", "b"], F.col("id") >= 0).collect()]
    assert np.mean([r["a"] for r in out]) == pytest.approx(0) and np.std([r["a"] for r in out]) == pytest.approx(1) and all(r["b"] == 0 for r in out)
    seg = spark.createDataFrame([(1, k, g, p) for k, (g, p) in enumerate([(1, 0), (1, 1), (0, 0), (1, 0), (1, 0), (1, 1)])], "u int, k int, gt int, pred int")
    assert [r["adjusted"] for r in rows_of(samples.point_adjust(seg, ["u"], "k"), "k")] == [0, 1, 0, 1, 1, 1]


def test_spectrum_of_a_sine(spark):
    n = 32
    y = np.sin(2 * np.pi * 3 * np.arange(n) / n) + 2
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(y)], "c int, t bigint, v double")
    got = rows_of(models.low_rank_spectrum(df, ["c"], "t", "v", n, keep=2), "t")
    assert [r["v"] for r in got] == pytest.approx(y.tolist())


def test_distance_of_equal_domains_is_small(spark):
    x = np.random.default_rng(6).normal(0, 1, (400, 4))
    same = spark.createDataFrame([(k % 2, [float(v) for v in r]) for k, r in enumerate(x)], "domain int, x array<double>")
    apart = spark.createDataFrame([(k % 2, [float(v + 2 * (k % 2)) for v in r]) for k, r in enumerate(x)], "domain int, x array<double>")
    assert models.mmd(same).first()["mmd2"] < 0.1 < models.mmd(apart).first()["mmd2"]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_lags_over_ranges_match_a_window(spark, width):
    rng = np.random.default_rng(11)
    rows = [(g, int(k), float(k) if k % 5 else None) for g in ("a", "b") for k in rng.choice(300, 60, replace=False)] + [("c", 3, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r["g"], r["k"]): r["back"] for r in samples.lagged(df, ["g"], "k", "v", 3, width, "back").collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        assert [got[g, r[1]] for r in own] == [None] * min(3, len(own)) + [r[2] for r in own[:-3]]
