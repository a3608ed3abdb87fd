"""Curve features and stages against loops over the same curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.operators import curves, cycle_features, phases
from cellwright.operators.curves import savgol_matrix
from cellwright.plans import curves as plans
from cellwright.plans.registry import QUERIES


@pytest.fixture(scope="module")
def ic(spark, sf):
    out = {}
    for r in plans.ic(spark, sf).orderBy("cell_id", "cycle", "i").collect():
        out.setdefault((r["cell_id"], r["cycle"]), []).append((r["i"], r["x"], r["y"]))
    return {k: tuple(np.array([p[c] for p in v], float) for c in range(3)) for k, v in out.items()}


def loop_peaks(y):
    """place, height, prominence, width by their definitions."""
    found = []
    for p in range(1, len(y) - 1):
        a = b = p
        while a > 0 and y[a - 1] == y[p]:
            a -= 1
        while b < len(y) - 1 and y[b + 1] == y[p]:
            b += 1
        if p != (a + b) // 2 or a == 0 or b == len(y) - 1 or not (y[a - 1] < y[p] > y[b + 1]):
            continue
        sides = []
        for step in (-1, 1):
            k, low = p, y[p]
            while 0 <= k + step < len(y) and y[k + step] <= y[p]:
                k += step
                low = min(low, y[k])
            sides.append(low)
        prominence = y[p] - max(sides)
        level = y[p] - prominence / 2
        left = next((k + (level - y[k]) / (y[k + 1] - y[k]) for k in range(p - 1, -1, -1) if y[k] < level), 0)
        right = next((k - (level - y[k]) / (y[k - 1] - y[k]) for k in range(p + 1, len(y)) if y[k] < level), len(y) - 1)
        found.append((p, y[p], prominence, right - left))
    return found


def loop_main(x, y, low=3.2, high=4.1):
    tops = [(h * w * r, h, x[p], w) for p, h, r, w in loop_peaks(y) if r >= 0.01 and low <= x[p] <= high]
    if tops:
        _, h, at, w = max(tops)
        return h, at, w * (x[-1] - x[0]) / (len(x) - 1)
    inside = [(b, a) for a, b in zip(x, y, strict=True) if low <= a <= high]
    return (*max(inside), None) if inside else (None, None, None)


def loop_area(x, y):
    return sum((y[k] + y[k - 1]) / 2 * (x[k] - x[k - 1]) for k in range(1, len(x)))


def rows_of(spark, sf, name):
    return {(r["cell_id"], r["cycle"]): r for r in QUERIES[name](spark, sf).collect()}


def close(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=2e-6)


def loop_valley(x, y, at):
    if at is None:
        return 0.0, 0.0
    near = [k for k in range(len(x)) if at + 0.05 <= x[k] <= at + 0.5]
    inner = [k for k in near if 0 < k < len(x) - 1]
    for test in (lambda k: y[k] < y[k - 1] and y[k] < y[k + 1], lambda k: y[k] <= y[k - 1] and y[k + 1] > y[k]):
        hit = [k for k in inner if test(k)]
        if hit:
            return y[hit[0]], x[hit[0]]
    return min((y[k], x[k]) for k in near) if near else (0.0, 0.0)


def test_main_peak_area_and_valley(spark, sf, ic):
    got, area, low = rows_of(spark, sf, "cur6_main_peak"), rows_of(spark, sf, "cur7_peak_area"), rows_of(spark, sf, "cur9_valley")
    assert set(got) == set(ic)
    for key, (_, x, y) in ic.items():
        h, at, w = loop_main(x, y)
        assert close(got[key]["icp"], h) and close(got[key]["icp_v"], at) and close(got[key]["fwhm"], w) and got[key]["icp_is_missing"] == (h is None)
        if at is not None:
            near = [k for k in range(len(x)) if abs(x[k] - at) <= 0.05]
            assert close(area[key]["icp_area"], loop_area(x[near], y[near]))
        v, place = loop_valley(x, y, at)
        assert close(low[key]["icv"], v) and close(low[key]["icvl_v"], place)
    assert sum(r["fwhm"] is not None for r in got.values()) > len(got) / 2


def loop_next(x, y, at, unset):
    if at is None:
        return unset, unset
    p = int(np.argmin(abs(x - at)))
    later = [k for k, _, r, _ in loop_peaks(y) if r >= 0.01 and 3.2 <= x[k] <= 4.1 and k > p]
    if later:
        k = p + int(np.argmin(y[p : later[0] + 1]))
        return y[k], x[k]
    slope = np.gradient(y)
    turns = [k for k in range(p + 1, len(y) - 1) if slope[k] < 0 < slope[k + 1]]
    turns = turns or [k for k in range(p + 1, len(y) - 1) if y[k] < min(y[k - 1], y[k + 1])]
    return (y[turns[0]], x[turns[0]]) if turns else (unset, unset)


def test_valley_before_the_next_peak(spark, sf, ic):
    got, peak = rows_of(spark, sf, "cur9_valley_before_next_peak"), rows_of(spark, sf, "cur6_main_peak")
    assert set(got) == set(peak) == set(ic)
    for key, (_, x, y) in ic.items():
        v, place = loop_next(x, y, loop_main(x, y)[1], 0.0)
        assert close(got[key]["icv"], v) and close(got[key]["icvl_v"], place)


def test_charge_side(spark, sf):
    curves = {}
    for r in plans.ic(spark, sf, sign=1, cut=None).orderBy("cell_id", "cycle", "i").collect():
        curves.setdefault((r["cell_id"], r["cycle"]), []).append((r["x"], r["y"]))
    got = rows_of(spark, sf, "cur13_charge_side")
    assert set(got) == set(curves) and curves
    for key, points in curves.items():
        x, y = np.array(points).T
        h, at, w = loop_main(x, y)
        r = got[key]
        assert close(r["chg_icp"], h) and close(r["chg_icp_v"], at) and close(r["chg_fwhm"], w) and r["chg_icp_is_missing"] == (h is None)
        assert close(r["chg_centroid_voltage"], float((x * y).sum() / y.sum()) if y.sum() > 0 else None)
        if at is not None:
            near = [k for k in range(len(x)) if abs(x[k] - at) <= 0.05]
            assert close(r["chg_icp_area"], loop_area(x[near], y[near]))
        v, place = loop_next(x, y, at, None)
        assert close(r["chg_icv_next"], v) and close(r["chg_icvl_v_next"], place)
        inner = [] if at is None else [k for k in range(1, len(x) - 1) if at + 0.05 <= x[k] <= at + 0.5]
        hit = [k for k in inner if y[k] < min(y[k - 1], y[k + 1])] or [k for k in inner if y[k] <= y[k - 1] and y[k + 1] > y[k]]
        assert close(r["chg_icv"], y[hit[0]] if hit else None) and close(r["chg_icvl_v"], x[hit[0]] if hit else None)
    assert any(r["chg_icp"] is not None for r in got.values()) and any(r["chg_icv"] is None for r in got.values())


def test_dv_at_peak_and_valley_and_curve_export(spark, sf, ic):
    got = rows_of(spark, sf, "cur10_dv_at_peak_and_valley")
    n = 0
    for key, (_, x, y) in ic.items():
        h, at, _ = loop_main(x, y)
        some = [k for k in range(len(x)) if y[k] > 0]
        if at is None or not some:
            continue
        v, place = loop_valley(x, y, at)
        nearest = lambda c: 1 / y[min(some, key=lambda k: abs(x[k] - c))]  # noqa: E731, B023
        assert close(got[key]["dvv"], nearest(at)) and close(got[key]["dvp"], nearest(place) if v > 0 else None)
        n += 1
    assert n == len(got)
    out = {}
    for r in QUERIES["cur15_curve_export"](spark, sf).collect():
        out[r["cell_id"], r["cycle"], r["type"], r["i"]] = (r["x"], r["y"])
    want = {(*k, "IC", int(i)): (a, b) for k, (p, x, y) in ic.items() if k[1] <= 100 for i, a, b in zip(p, x, y, strict=True)}
    want |= {(*k[:2], "DV", k[3]): (a, 1 / b) for k, (a, b) in list(want.items()) if b > 0}
    assert set(out) == set(want) and all(out[k] == pytest.approx(want[k], rel=1e-6, abs=2e-6) for k in want)


def test_dv_by_the_rule_of_lfp(spark, sf, ic):
    got, curves = rows_of(spark, sf, "cur10_lfp_dv"), {}
    for r in plans.dv(spark, sf).orderBy("cell_id", "cycle", "i").collect():
        curves.setdefault((r["cell_id"], r["cycle"]), []).append((r["x"], r["y"]))
    assert set(got) == set(ic)
    for key, points in curves.items():
        q, y = np.array(points, float).T
        tops = [(r, h, q[p]) for p, h, r, _ in loop_peaks(y) if r >= 0.005 and 0 < q[p] < 0.7 * q.max()]
        h = loop_main(*ic[key][1:])[0]
        assert (got[key]["dvv"] is None) == (not h) and (not h or got[key]["dvv"] == pytest.approx(1 / h, rel=1e-4, abs=2e-6))
        assert close(got[key]["dvp"], max(tops)[1] if tops else None) and close(got[key]["dvp_q"], max(tops)[2] if tops else None)
    assert sum(r["dvp"] is not None for r in got.values()) > 20


def test_curvature_area(spark, sf, ic):
    got, h = rows_of(spark, sf, "cur8_curvature_area"), savgol_matrix(11, 3, 2)
    for key, (_, x, y) in ic.items():
        at = loop_main(x, y)[1]
        if at is None:
            continue
        n = len(y)
        bent = [h[k] @ y[:11] if k < 5 else h[k - n + 11] @ y[-11:] if k >= n - 5 else h[5] @ y[k - 5 : k + 6] for k in range(n)]
        p = min(range(n), key=lambda k: (abs(x[k] - at), k))
        dip = lambda k: 0 < k < n - 1 and y[k] <= y[k - 1] and y[k] <= y[k + 1]  # noqa: E731, B023
        lo = max((k for k in range(p) if dip(k) or bent[k] * bent[k + 1] < 0), default=p)
        hi = min((k for k in range(p + 1, n) if dip(k) or bent[k] * bent[k - 1] < 0), default=p)
        a, b = x[lo : hi + 1], y[lo : hi + 1]
        base = b[0] + ((b[-1] - b[0]) * (a - a[0]) / (a[-1] - a[0]) if hi > lo else 0)
        assert got[key]["icp_area"] == pytest.approx(abs(loop_area(a, b - base)), abs=5e-6)


def loop_stages(time, current, tolerance):
    n = len(current)
    padded = np.concatenate([np.zeros(7), current, np.zeros(7)])
    smooth = np.array([sorted(padded[k : k + 15])[7] for k in range(n)])
    some = smooth[smooth > 0.1]
    if not len(some):
        return []
    top = max(some.max(), 1.0) * 1.1
    counts = np.zeros(100)
    for v in some:
        counts[min(int(v / top * 100), 99)] += 1
    kept = []
    for p, h, r, _ in sorted(loop_peaks(counts), key=lambda t: (-t[1], -t[0])):
        if all(abs(p - q[0]) >= 5 for q in kept):
            kept.append((p, r))
    centres = sorted((p + 0.5) * top / 100 for p, r in kept if r >= len(some) * 0.01)
    label = [next((c for c in centres if abs(v - c) < tolerance), None) for v in smooth]
    parts = []
    for k in range(n):
        if label[k] is None:
            continue
        if k and label[k - 1] == label[k]:
            parts[-1][1] = k
        else:
            parts.append([k, k, label[k]])
    merged = []
    for a, b, c in parts:
        if merged and time[a] - time[merged[-1][1]] < 120 and (merged[-1][2] == c or (merged[-1][2] < 0.5 and c < 0.5)):
            merged[-1][1] = b
        else:
            merged.append([a, b, c])
    out = []
    for a, b, c in merged:
        if time[b] - time[a] >= 60:
            own = [v for v in current[a : b + 1] if abs(v - c) < 2 * tolerance]
            out.append((time[a], time[b] - time[a], np.mean(own) if own else c))
    return out


def test_histogram_stages(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for cell in range(6):
        levels = [(5.0, 40), (0.0, 4 * cell), (3.0, 30), (1.0, 25), (-2.0, 30)] if cell < 5 else [(-1.0, 50)]
        current = np.concatenate([np.full(k, v) + rng.normal(0, 0.03, k) for v, k in levels])
        time = np.arange(len(current)) * 20.0
        rows += [(cell, 1, k, float(t), float(c)) for k, (t, c) in enumerate(zip(time, current, strict=True))]
        want[cell] = loop_stages(time, current, 0.3)
    tel = spark.createDataFrame(rows, "cell_id bigint, cycle int, seq int, time_s double, current_a double")
    got = {}
    for r in phases.histogram_stages(tel).orderBy("cell_id", "stage").collect():
        got.setdefault(r["cell_id"], []).append((r["start_s"], r["duration_s"], r["current_a"]))
        assert r["stage"] == len(got[r["cell_id"]])
    assert {k for k, v in want.items() if v} == set(got) and len(got[0]) == 3
    for k, v in got.items():
        assert len(v) == len(want[k]) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(v, want[k], strict=True))


def test_smoothed_temperature(spark):
    rng = np.random.default_rng(6)
    t = rng.normal(30, 2, 40)
    tel = spark.createDataFrame([(1, 1, k, float(v)) for k, v in enumerate(t)] + [(1, 2, k, float(k)) for k in range(9)], "cell_id bigint, cycle int, seq int, temperature_c double")
    got = {(r["cycle"], r["seq"]): r["temperature_c"] for r in cycle_features.smoothed_temperature(tel, 11).collect()}
    for k in range(40):
        a = min(max(k - 5, 0), 29)
        assert got[1, k] == pytest.approx(np.polyval(np.polyfit(np.arange(11), t[a : a + 11], 3), k - a), abs=1e-6)
    assert [got[2, k] for k in range(9)] == list(range(9))


def test_files(spark, tmp_path):
    from cellwright.sources import readers

    for cell in ("b1c0", "b1c1"):
        (tmp_path / f"{cell}.csv").write_text("Index;Volt [mV];I\n" + "".join(f"{k};{3000 + k};{0.5 * k}\n" for k in range(4)))
    rows = readers.read_csv(spark, f"{tmp_path}/*.csv", "`Index` int, `Volt [mV]` double, I double", {"Index": "seq", "Volt [mV]": "voltage_v", "I": "current_a"}, {"voltage_v": 0.001}, sep=";")
    assert sorted(map(tuple, rows.collect())) == [(k, pytest.approx(3 + k / 1000), 0.5 * k, cell) for k in range(4) for cell in ("b1c0", "b1c1")]
    out = f"{tmp_path}/features"
    table = rows.select(F.regexp_extract("cell_file", "c(.)", 1).cast("int").alias("cell_id"), "seq", "voltage_v")
    readers.write_features(table, out)
    assert sorted(map(tuple, spark.read.parquet(out).select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    readers.write_reports(f"{tmp_path}/reports", selected=table, drops=table.limit(0))
    assert spark.read.parquet(f"{tmp_path}/reports/selected").count() == 8 and spark.read.parquet(f"{tmp_path}/reports/drops").count() == 0


def test_unfinished_cells(spark, tmp_path):
    from cellwright.sources import readers

    cells = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "cell_id bigint, dvp double")
    path = f"file://{tmp_path}/features"
    assert {r["cell_id"] for r in readers.unfinished(cells, path).collect()} == {1, 2, 3}
    readers.write_features(cells.filter("cell_id < 3"), path)
    assert {r["cell_id"] for r in readers.unfinished(cells, path).collect()} == {3}


def test_tau_is_searched_without_a_row_for_each_grid_point(spark):
    rows = [(k, 1, 30.0 * j, 4.2, 2 * float(np.exp(-30.0 * j / tau)) + 0.1) for k, tau in enumerate((90.0, 700.0)) for j in range(40)]
    got = cycle_features.current_tau(spark.createDataFrame(rows, "cell_id int, cycle int, time_s double, voltage_v double, current_a double"), 4.2).orderBy("cell_id")
    assert [r["cv_tau"] for r in got.collect()] == pytest.approx([90.0, 700.0], rel=1e-3)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_of_points_reads_them_once(spark):
    points = spark.createDataFrame([(1, 1, float(k), float(k * k)) for k in range(9)], "cell_id int, cycle int, v double, q double")
    plan = curves.resample(points, 0.5, 10, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
