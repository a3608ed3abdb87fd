"""Imputation by names, whole model curves, forecast summaries and labels from capacities against loops."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import cleaning, curves, cycle_features, phases, samples
from cellwright.plans import learning

SNL = ["SNL_NCA_25C_20-80_0.5C_a", "SNL_NCA_25C_20-80_0.5C_b", "SNL_NCA_25C_0-100_0.5C_a", "SNL_NCA_25C_0-100_0.5C_c", "SNL_NCA_25C_0-100_0.5C5_c", "SNL_LFP_25C_20-80_0.5C_a", "SNL_LFP_35C_20-80_1C", "single", "", "SNL_NCA_25C_20-80_0.5C_a_x"]
ISU = ["ISU_G5C1", "ISU_G57C2", "ISU_G58C1", "ISU_G6C1", "ISU_G61C4", "ISU_none", "ISU_G5C1", "", "G90C1", "ISU_G12C1"]


def long_of(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, cycle, f, None if rng.random() < 0.3 or (k, f) == (1, "dvp") else float(rng.integers(0, 90))) for k in range(n) for cycle in range(3) for f in ("temp_mean", "DVP_Q", "dvp", "plain")]
    return rows, spark.createDataFrame(rows, "cell_id bigint, cycle int, feature string, value double").repartition(3)


def means_of(rows):
    out = {}
    for k, _, f, v in rows:
        if v is not None:
            out.setdefault((k, f), []).append(v)
    return {key: np.mean(v) for key, v in out.items()}


def names_of(spark, names):
    return spark.createDataFrame([*enumerate(names), (len(names), None)], "cell_id bigint, name string")


def found(df):
    return {(r["cell_id"], r["feature"]): r["mean"] for r in df.collect()}


def test_siblings_by_the_beginnings_of_names(spark):
    rows, long = long_of(spark, len(SNL))
    m, want = means_of(rows), {}
    for k, name in enumerate(SNL):
        for f in ("temp_mean", "DVP_Q", "dvp", "plain"):
            others = []
            if "temp" in f and (p := re.match(r"(.+)_[a-zA-Z0-9]+$", name)):
                others = [m[j, f] for j, o in enumerate(SNL) if j != k and o.startswith(p[1]) and (j, f) in m]
            elif "dvp" in f.lower() and "NCA" in name and "25C" in name and "20-80" in name and (p := re.match(r"(.+)_[a-zA-Z0-9]+$", name.replace("20-80", "0-100"))):
                others = [m[j, f] for j, o in enumerate(SNL) if j != k and p[1] in o and (j, f) in m]
            if others:
                want[k, f] = np.mean(others)
    got = found(cleaning.named_sibling_means(long, names_of(spark, SNL)))
    assert got == pytest.approx(want) and {f for _, f in want} == {"temp_mean", "DVP_Q", "dvp"}


def test_groups_by_numbers_in_names(spark):
    rows, long = long_of(spark, len(ISU))
    m, want = means_of(rows), {}
    number = [int(x[1]) if (x := re.search(r"G(\d+)", n)) else None for n in ISU]
    for k in range(len(ISU)):
        for f in ("temp_mean", "DVP_Q", "dvp", "plain"):
            if number[k] is None:
                continue
            same = [m[j, f] for j, o in enumerate(ISU) if j != k and f"G{number[k]}" in o and (j, f) in m]
            near = [m[j, f] for j in range(len(ISU)) if j != k and number[j] not in (None, number[k]) and abs(number[j] - number[k]) <= 5 and (j, f) in m]
            if same or near:
                want[k, f] = np.mean(same or near)
    got = found(cleaning.numbered_group_means(long, names_of(spark, ISU)))
    assert got == pytest.approx(want) and (8, "plain") not in want and len(want) > 20


def test_empty_names(spark):
    _, long = long_of(spark, 3)
    none = names_of(spark, []).limit(0)
    assert cleaning.named_sibling_means(long, none).count() == cleaning.numbered_group_means(long, none).count() == 0


def test_worst_cells_of_a_report(spark):
    cycles = spark.createDataFrame([(k, c) for k in range(30) for c in range(1 + k // 2)], "cell_id int, cycle int")
    assert [tuple(r) for r in cleaning.fewest_cycles(cycles, 5).collect()] == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def curve_loop(rows, capacity, early, points, discharge_first):
    out = []
    for cycle in range(1, early + 1):
        own = [r for r in rows if r[1] == cycle]
        v, i, qc, qd = (np.array([r[k] for r in own], float) for k in (3, 4, 5, 6))
        ends = np.flatnonzero(i / capacity <= -0.01 if discharge_first else i / capacity >= 0.01)
        if not len(ends):
            out.append(np.zeros((3, 2 * points)))
            continue
        cut, used = ends[-1], np.abs(i / capacity) > 0.01
        first, second = np.arange(len(v)) < cut, (np.arange(len(v)) >= cut) & used
        parts = [(second, qc), (first, qd)] if discharge_first else [(first, qc), (second, qd)]
        if any(not p.sum() for p, _ in parts):
            out.append(np.zeros((3, 2 * points)))
            continue
        drawn = []
        for p, q in parts:
            n = int(p.sum())
            at = np.linspace(1, n + 1, points)
            drawn.append([np.interp(at, np.arange(1, n + 1), x[p]) for x in (v, i, q)])
        both = np.concatenate(drawn, axis=1)
        out.append(np.stack([both[0] / both[0].max(), both[1] / capacity, both[2] / capacity]))
    return np.array(out)


@pytest.mark.parametrize("discharge_first", [False, True])
def test_model_curves_equal_interpolation(spark, discharge_first):
    rng = np.random.default_rng(6)
    rows = []
    for cell in range(3):
        for cycle in (1, 2, 4, 5, 7):
            n = int(rng.integers(4, 60))
            kind = rng.choice([1.0, 0.005, 0.0, -1.0], n) if cycle != 5 else np.zeros(n)
            rows += [(cell, cycle, k, float(rng.uniform(2, 4)), float(c * rng.uniform(0.5, 1)), float(k), float(n - k)) for k, c in enumerate(kind)]
    df = spark.createDataFrame(rows, "cell_id bigint, cycle int, seq int, voltage_v double, current_a double, charge_capacity_ah double, discharge_capacity_ah double").repartition(3)
    got = curves.curve_arrays(curves.model_curves(df, 1.1, 6, points=12, discharge_first=discharge_first)).collect()
    assert len(got) == 18
    for r in got:
        want = curve_loop([x for x in rows if x[0] == r["cell_id"]], 1.1, 6, 12, discharge_first)[r["cycle"] - 1]
        assert np.allclose([r["v"], r["i"], r["q"]], want, atol=1e-9)
    assert not any(got_r["v"][0] for got_r in got if got_r["cycle"] in (3, 5, 6))


def test_forecast_summary_equals_group_scores(spark):
    rng = np.random.default_rng(7)
    sizes = {"Yearly": 3, "Monthly": 5, "Weekly": 2, "Daily": 4, "Hourly": 1}
    minor, length = ["Weekly", "Daily", "Hourly"], 6
    points, scales, scores = [], [], {}
    for g, n in sizes.items():
        y, pred, naive = (rng.uniform(1, 9, (n, length)) for _ in range(3))
        y[0, 0] = pred[0, 0] = 0.0
        scale = rng.uniform(1, 2, n)
        points += [(g, s, *map(float, t)) for s in range(n) for t in zip(y[s], pred[s], naive[s], strict=True)]
        scales += [(g, s, float(scale[s])) for s in range(n)]
        den = lambda a: np.where(np.abs(y) + np.abs(a) == 0, 1, np.abs(y) + np.abs(a))  # noqa: B023, E731
        scores[g] = [np.mean(200 * np.abs(pred - y) / den(pred)), np.mean(200 * np.abs(naive - y) / den(naive)), np.mean(100 * np.abs(pred - y) / np.where(y == 0, 1, y)), np.mean(np.abs(pred - y).mean(1) / scale), np.mean(np.abs(naive - y).mean(1) / scale)]
    merge = lambda groups: np.average([scores[g] for g in groups], axis=0, weights=[sizes[g] for g in groups])
    want = {g: (np.array(scores[g]) if g else None) for g in ("Yearly", "Monthly")} | {"Others": merge(minor), "Average": merge(list(sizes))}
    got = samples.forecast_summary(spark.createDataFrame(points, "grp string, series int, y double, pred double, naive double"), spark.createDataFrame(scales, "grp string, series int, scale double"), minor, digits=6)
    rows = {r["grp"]: [r["smape"], r["mape"], r["mase"], r["owa"]] for r in got.collect()}
    assert rows.keys() == want.keys()
    for g, (s, s0, p, m, m0) in want.items():
        assert rows[g] == pytest.approx([s, p, m, (m / m0 + s / s0) / 2], abs=2e-6)


def test_capacities_of_named_cells(spark):
    cells = spark.createDataFrame([(1, "RWTH_001", 9.0, 0.2, 0.8), (2, "SNL_18650_NCA_25C_20-80_a", 9.0, 0.2, 0.8), (3, "SNL_18650_NCA_25C_0-100_a", 2.0, 0.0, 1.0), (4, None, 2.0, 0.0, 0.0)], "cell_id int, name string, nominal_capacity_ah double, soc_from double, soc_to double")
    caps = spark.createDataFrame([(c, y, q) for c in (1, 2, 3, 4) for y in (1, 2) for q in (0.1, 1.0 / y, None)], "cell_id int, cycle int, discharge_capacity_ah double")
    got = {(r["cell_id"], r["cycle"]): r["soh"] for r in samples.state_of_health(caps, cells).collect()}
    want = {(c, y): 1.0 / y / n / s for c, n, s in ((1, 1.85, 0.6), (2, 3.2, 0.6), (3, 2.0, 1.0)) for y in (1, 2)}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want) and got[4, 1] is None


def test_stage_times_leave_out_what_is_held_at_the_top(spark):
    rows = [(1, 1, k, 10.0 * k, 3.0 + 0.01 * k if k < 40 else 3.6, 2.0 if k < 20 else 1.0 if k < 40 else 0.3) for k in range(60)]
    df = spark.createDataFrame(rows, "cell_id bigint, cycle int, seq int, time_s double, voltage_v double, current_a double")
    stages = phases.histogram_stages(df, tolerance=0.3, window=5, voltage="voltage_v")
    own = sorted((r["start_s"], r["duration_s"], r["mean_v"], r["std_v"]) for r in stages.collect())
    held = [s for s in own if s[2] > 3.6 - 0.03 and s[3] < 0.015]
    got = cycle_features.stage_times(df, stages).first()
    tccc = sum(s[1] for s in own) - sum(s[1] for s in held)
    assert len(own) == 3 and len(held) == 1 and (got["tccc"], got["tcvc"]) == pytest.approx((tccc, 590.0 - tccc))
    for start, seconds, mean, std in own:
        volts = [r[4] for r in rows if start <= r[3] <= start + seconds]
        assert mean == pytest.approx(np.mean(volts)) and std == pytest.approx(np.std(volts, ddof=1))
    assert cycle_features.stage_times(df.filter(F.col("seq") < 0), stages).count() == 0


def test_conditions_of_the_decay_constant(spark):
    """Cycles of too few rows, too short, too weak, and steady ones have none."""
    decay = lambda n, step, scale: [(k, step * k, 4.2, scale * float(np.exp(-step * k / 50))) for k in range(n)]
    cycles = [decay(40, 5.0, 1.0), decay(10, 5.0, 1.0), decay(40, 0.2, 1.0), decay(40, 5.0, 0.02), [(k, 5.0 * k, 4.2, 1.0) for k in range(40)]]
    df = spark.createDataFrame([(1, c, *r) for c, rows in enumerate(cycles) for r in rows], "cell_id bigint, cycle int, seq int, time_s double, voltage_v double, current_a double")
    got = {r["cycle"]: r["cv_tau"] for r in cycle_features.current_tau(df, uvp=4.2, least_rows=11, over_s=10.0, over_a=0.05, least_std=1e-6).collect()}
    assert got[0] == pytest.approx(50, rel=1e-2) and [got[k] for k in range(1, 5)] == [0.0] * 4


def test_healths_right_at_a_limit_are_as_in_the_sql(spark):
    """Discharged charges that give exactly 0.85 or 0.95, in Spark and in DuckDB."""
    rows = [(k, cycle, round(limit * (160 + 2 * cycle + 10 * k) / 1000, 9), limit) for k in range(5) for cycle in range(1, 31) for limit in (0.85, 0.95)]
    ours = learning.health(spark.createDataFrame(rows, "cell_id bigint, cycle int, qd double, lim double")).collect()
    values = ", ".join(f"({k}, CAST({c} AS INT), CAST({q!r} AS DOUBLE))" for k, c, q, _ in rows)
    theirs = duckdb.sql(f"WITH qd(cell_id, cycle, qd) AS (VALUES {values}), {learning.SOH} SELECT soh FROM soh").fetchall()
    assert sorted((r["cell_id"], r["cycle"], r["soh"]) for r in ours) == sorted((r[0], r[1], t[0]) for r, t in zip(rows, theirs, strict=True))
