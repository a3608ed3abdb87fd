"""dQ/dV and dV/dQ curves as long rows (keys, i, x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, ratio, trapezoid

KEYS = ["cell_id", "cycle"]


def prepare(rows: DataFrame, cut: float | None, least: int = 15, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Rows (v, q): curves of under ``least`` rows go; then q <= cut * max q (no cut: none), and repeats of a voltage and of a charge (the first stays)."""
    k = Window.partitionBy(*keys)
    out = rows.withColumn("__n", F.count("*").over(k)).withColumn("__top", F.max("q").over(k)).filter(F.col("__n") >= least)
    if cut is not None:
        out = out.filter(F.col("q") > cut * F.col("__top"))
    for column in ("v", "q"):
        out = out.withColumn("__k", F.row_number().over(ordered([*keys, column], order))).filter("__k = 1")
    return out.drop("__n", "__top", "__k")


def resample(points: DataFrame, step: float, least: int = 100, most: int = 5000, x: str = "v", y: str = "q", keys: list[str] = KEYS) -> DataFrame:
    """i, x, y on a uniform grid from least to greatest x of clamp(int(range / step), least, most) points; linear between the samples, of which
    one within 1e-9 of the sample before is left out."""
    apart = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).withColumn("__p", F.lag("x").over(ordered(keys, "x", "y"))).filter("__p is null or x - __p >= 1e-9").drop("__p")
    w, whole = ordered(keys, "x"), Window.partitionBy(*keys)
    strips = apart.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).withColumn("lo", F.min("x").over(whole)).withColumn("hi", F.max("x").over(whole))
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.floor((F.col("hi") - F.col("lo")) / step).cast("int")))
    # every strip makes its own grid points: no join of grid and samples by range
    at = strips.dropna(subset=keys).filter("hi > lo and x2 is not null").withColumn("n", size).withColumn("h", (F.col("hi") - F.col("lo")) / (F.col("n") - 1))
    first, last = F.ceil((F.col("x") - F.col("lo")) / F.col("h") - 1e-9).cast("int"), F.ceil((F.col("x2") - F.col("lo")) / F.col("h") - 1e-9).cast("int") - 1
    end = F.when(F.col("x2") == F.col("hi"), F.col("n") - 1).otherwise(last)
    grid = at.withColumn("__a", first).withColumn("__b", end).filter("__a <= __b").withColumn("i", F.explode(F.sequence("__a", "__b")))
    gx = F.col("lo") + F.col("h") * F.col("i")
    return grid.select(*keys, "i", gx.alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * (gx - F.col("x")) / (F.col("x2") - F.col("x"))).alias("y"))


def gradient(curve: DataFrame, y: str = "y", x: str | None = None, name: str = "g", keys: list[str] = KEYS) -> DataFrame:
    """Central differences, one-sided at the ends; with ``x``, the second-order formula for uneven steps."""
    w = ordered(keys, "i")
    before, here, after = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    if x is None:
        inner = (after - before) / 2
        return curve.withColumn(name, F.coalesce(inner, after - here, here - before))
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    inner = ratio(hs * hs * after + (hd * hd - hs * hs) * here - hd * hd * before, hs * hd * (hd + hs))
    return curve.withColumn(name, F.coalesce(inner, ratio(after - here, hd), ratio(here - before, hs)))


def savgol_matrix(window: int, order: int, derivative: int = 0) -> np.ndarray:
    """Row r: coefficients that give the fitted polynomial's value (or derivative) at place r of a window."""
    places = np.arange(window) - window // 2
    powers = places[:, None] ** np.arange(order + 1)
    fit = np.linalg.pinv(powers.astype(float))
    for _ in range(derivative):
        fit = fit[1:] * np.arange(1, len(fit))[:, None]
    return (places[:, None] ** np.arange(len(fit))) @ fit


def savgol(curve: DataFrame, window: int, order: int, y: str = "y", name: str = "smooth", derivative: int = 0, clip: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Savitzky-Golay: the window made odd; at the ends the polynomial of the first or last window.  A curve shorter than the window stays as it is.

    A curve's points come together once, as an array; its windows are summed by place, a missing value making a window's sum missing.
    """
    window = max(3, window | 1)
    half = window // 2
    h = savgol_matrix(window, order, derivative)

    def smooth(v: np.ndarray) -> np.ndarray:
        n = len(v)
        if n < window:
            return v
        out = np.zeros(n)
        for j in range(window):
            out[half : n - half] += v[j : n - window + 1 + j] * h[half, j]
            out[:half] += v[j] * h[:half, j]
            out[n - half :] += v[n - window + j] * h[half + 1 :, j]
        return out

    def run(values: pd.Series) -> pd.Series:
        # NULLs come as NaN, and leave as NULL
        return pd.Series([[None if x != x else x for x in smooth(np.asarray(v, float)).tolist()] for v in values])

    rest = [c for c in curve.columns if c not in (*keys, "i", name)]
    listed = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *rest))).alias("__c"))
    smoothed = listed.withColumn("__s", F.pandas_udf(run, "array<double>")(F.col("__c")[y].cast("array<double>")))
    each = smoothed.select(*keys, F.explode(F.arrays_zip(F.col("__c").alias("c"), F.col("__s").alias("s"))).alias("__p"))
    out = F.col("__p.s")
    columns = [c for c in curve.columns if c != name]
    return each.select(*(F.col(c) if c in keys else F.col(f"__p.c.{c}").alias(c) for c in columns), (F.greatest(out, F.lit(0.0)) if clip else out).alias(name))


def _lowest_since_higher(h: list[float]) -> list[float]:
    """For each place the least value after the nearest higher one before it (or the start), up to the place itself; one pass with a stack."""
    out, stack = [], []
    for value in h:
        low = value
        while stack and stack[-1][0] <= value:
            low = min(low, stack.pop()[1])
        stack.append((value, low))
        out.append(low)
    return out


def local_maxima(i: np.ndarray, y: np.ndarray) -> list[tuple[int, float, float]]:
    """(place, height, prominence) of maxima that are higher than what lies on both sides; a flat top counts at its middle."""
    some = ~np.isnan(y)
    i, y = i[some], y[some]
    if len(y) < 3:
        return []
    begin = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    end = np.append(begin[1:], len(y)) - 1
    h = y[begin].tolist()
    left, right = _lowest_since_higher(h), _lowest_since_higher(h[::-1])[::-1]
    inner = [k for k in range(1, len(h) - 1) if h[k] > h[k - 1] and h[k] > h[k + 1]]
    return [(int(i[begin[k]] + i[end[k]]) // 2, h[k], h[k] - max(left[k], right[k])) for k in inner]


def crossings(i: np.ndarray, y: np.ndarray, place: int, level: float) -> tuple[float, float]:
    """Fractional places left and right of a peak where the curve falls to the level; the curve's ends if it doesn't."""
    below = np.flatnonzero(y < level)
    at = np.searchsorted(i, place)
    cut = np.searchsorted(below, at)
    left, right = float(i[0]), float(i[-1])
    if cut > 0:
        k = below[cut - 1]
        left = i[k] + (level - y[k]) / (y[k + 1] - y[k])
    if cut < len(below):
        k = below[cut]
        right = i[k] - (level - y[k]) / (y[k - 1] - y[k])
    return float(left), float(right)


def _arrays(curve: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """One row for each curve: points, sorted by i."""
    return curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("points"))


def peaks(curve: DataFrame, y: str = "y", height: float | None = None, prominence: float | None = None, keys: list[str] = KEYS) -> DataFrame:
    """keys, i, x, y, prominence of local maxima; a flat top counts at its middle.

    A curve has some thousands of points: they come together once, as an array, and a pass with a stack finds all prominences.
    """

    def found(i: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[{"p": p, "h": h, "prominence": r} for p, h, r in local_maxima(np.asarray(a), np.asarray(b, float))] for a, b in zip(i, values, strict=True)])

    maxima = F.pandas_udf(found, "array<struct<p:int,h:double,prominence:double>>")
    rows = _arrays(curve, y, keys).select(*keys, "points", F.explode(maxima("points.i", "points.y")).alias("m"))
    at = F.get(F.filter("points", lambda p: p["i"] == F.col("m.p")), F.lit(0))
    out = rows.select(*keys, F.col("m.p").alias("i"), at["x"].alias("x"), F.col("m.h").alias("y"), F.col("m.prominence").alias("prominence"))
    for column, least in (("y", height), ("prominence", prominence)):
        if least is not None:
            out = out.filter(F.col(column) >= least)
    return out


def peak_widths(found: DataFrame, curve: DataFrame, y: str = "y", rel: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """left, right (fractional places of the crossings of y - rel * prominence) and width in steps of each peak."""

    def crossed(i: pd.Series, values: pd.Series, peak: pd.Series, level: pd.Series) -> pd.DataFrame:
        both = [[crossings(np.asarray(a), np.asarray(b, float), p, c) for p, c in zip(q, d, strict=True)] for a, b, q, d in zip(i, values, peak, level, strict=True)]
        return pd.DataFrame({"left": [[x[0] for x in one] for one in both], "right": [[x[1] for x in one] for one in both]})

    cut = F.pandas_udf(crossed, "struct<left:array<double>,right:array<double>>")
    listed = found.groupBy(*keys).agg(F.collect_list(F.struct("i", "x", "y", "prominence", (F.col("y") - rel * F.col("prominence")).alias("level"))).alias("tops"))
    joined = _arrays(curve, y, keys).join(listed, keys).select(*keys, "tops", cut("points.i", "points.y", "tops.i", "tops.level").alias("cut"))
    each = joined.select(*keys, F.explode(F.arrays_zip("tops", F.col("cut.left").alias("left"), F.col("cut.right").alias("right"))).alias("t"))
    return each.select(*keys, "t.tops.i", "t.tops.x", "t.tops.y", "t.tops.prominence", "t.left", "t.right", (F.col("t.right") - F.col("t.left")).alias("width"))


def main_peak(curve: DataFrame, widths: DataFrame, low: float, high: float, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """icp, icp_v, fwhm, icp_is_missing: of the peaks in [low, high] the one with the largest height * width * prominence, else the curve's
    greatest value there, else missing."""
    inside = F.col("x").between(low, high)
    best = widths.filter(inside).groupBy(*keys).agg(F.max(F.struct((F.col("y") * F.col("width") * F.col("prominence")).alias("s"), F.col("y").alias("y"), F.col("x").alias("x"), F.col("width").alias("w"))).alias("p"))
    step = curve.groupBy(*keys).agg(F.max(F.when(inside, F.struct(F.col(y).alias("y"), F.col("x").alias("x")))).alias("m"), ratio(F.max("x") - F.min("x"), F.count("*") - 1).alias("h"))
    joined = step.join(best, keys, "left")
    icp = F.coalesce("p.y", "m.y")
    return joined.select(*keys, icp.alias("icp"), F.coalesce("p.x", "m.x").alias("icp_v"), (F.col("p.w") * F.col("h")).alias("fwhm"), icp.isNull().cast("int").alias("icp_is_missing"))


def peak_area(curve: DataFrame, peak: DataFrame, half: float, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """icp_area: trapezoids of the curve within ``half`` of the main peak."""
    near = curve.join(peak.select(*keys, "icp_v"), keys).filter(F.abs(F.col("x") - F.col("icp_v")) <= half)
    return near.withColumn("__s", trapezoid(F.col(y), F.col("x"), ordered(keys, "i"))).groupBy(*keys).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("icp_area"))


def centroid(curve: DataFrame, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    return curve.groupBy(*keys).agg(F.when(F.sum(y) > 0, ratio(F.sum(F.col("x") * F.col(y)), F.sum(y))).alias("centroid_voltage"))


def valley(curve: DataFrame, peak: DataFrame, offset: tuple[float, float] = (0.05, 0.5), least: bool = True, unset: float | None = 0.0, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """icv, icvl_v: in the window above the main peak the first strict local minimum, else the first place where the slope turns upwards, else
    (with ``least``) the least value; else ``unset``."""
    w = ordered(keys, "i")
    marked = curve.withColumn("__p", F.lag(y).over(w)).withColumn("__q", F.lead(y).over(w))
    near = marked.join(peak.select(*keys, "icp_v"), keys, "left").filter(F.col("x").between(F.col("icp_v") + offset[0], F.col("icp_v") + offset[1]))
    here = F.struct(F.col("i"), F.col(y).alias("y"), F.col("x").alias("x"))
    agg = near.groupBy(*keys).agg(F.min(F.when((F.col(y) < F.col("__p")) & (F.col(y) < F.col("__q")), here)).alias("a"), F.min(F.when((F.col(y) <= F.col("__p")) & (F.col("__q") > F.col(y)), here)).alias("b"), F.min(F.struct(F.col(y).alias("y"), F.col("x").alias("x"))).alias("c"))
    rules = ("a", "b", "c") if least else ("a", "b")
    found = (F.coalesce(*(F.col(f"{r}.{c}") for r in rules), F.lit(unset).cast("double")) for c in "yx")
    return peak.select(*keys).join(agg, keys, "left").select(*keys, *(c.alias(name) for c, name in zip(found, ("icv", "icvl_v"), strict=True)))


def valley_before_next_peak(curve: DataFrame, peak: DataFrame, tops: DataFrame, low: float, high: float, unset: float | None = 0.0, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """icv, icvl_v: the least value from the main peak to the next of the peaks in [low, high]; without a next one the first place above the main
    peak where a falling slope turns into a rising one, else the first strict local minimum; else ``unset``."""
    w = ordered(keys, "i")
    own = peak.select(*keys, "icp_v")
    after = tops.join(own, keys).filter((F.col("x") > F.col("icp_v")) & F.col("x").between(low, high)).groupBy(*keys).agg(F.min("x").alias("__next"))
    sloped = gradient(curve, y=y, name="__g", keys=keys)
    marked = sloped.withColumn("__p", F.lag(y).over(w)).withColumn("__q", F.lead(y).over(w)).withColumn("__h", F.lead("__g").over(w))
    near = marked.join(own, keys).filter(F.col("x") >= F.col("icp_v")).join(after, keys, "left")
    here = F.struct(F.col("i"), F.col(y).alias("y"), F.col("x").alias("x"))
    alone = F.col("__next").isNull() & (F.col("x") > F.col("icp_v"))
    agg = near.groupBy(*keys).agg(
        F.min(F.when(F.col("x") <= F.col("__next"), F.struct(F.col(y).alias("y"), F.col("i"), F.col("x").alias("x")))).alias("a"),
        F.min(F.when(alone & (F.col("__g") < 0) & (F.col("__h") > 0), here)).alias("b"),
        F.min(F.when(alone & (F.col(y) < F.col("__p")) & (F.col(y) < F.col("__q")), here)).alias("c"),
    )
    found = (F.coalesce(*(F.col(f"{r}.{c}") for r in "abc"), F.lit(unset).cast("double")) for c in "yx")
    return peak.select(*keys).join(agg, keys, "left").select(*keys, *(c.alias(name) for c, name in zip(found, ("icv", "icvl_v"), strict=True)))


def resample_by_index(rows: DataFrame, columns: list[str], n: int, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """n points at evenly spaced sample numbers from 1 to m + 1 (the last sample beyond m), linear between the samples."""
    w = ordered(keys, order)
    numbered = rows.withColumn("__j", F.row_number().over(w)).withColumn("__m", F.count("*").over(Window.partitionBy(*keys)))
    nexts = numbered.select("*", *(F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"__{c}") for c in columns))
    place = 1 + F.col("k") * F.col("__m") / (n - 1)
    first = F.ceil((F.col("__j") - 1) * (n - 1) / F.col("__m")).cast("int")
    last = F.when(F.col("__j") == F.col("__m"), F.lit(n - 1)).otherwise((F.ceil(F.col("__j") * (n - 1) / F.col("__m")) - 1).cast("int"))
    # a sample between two points has none: a sequence would run backwards
    grid = nexts.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    share = F.least(F.greatest(place - F.col("__j"), F.lit(0.0)), F.lit(1.0))
    return grid.select(*keys, "k", *((F.col(c) + (F.col(f"__{c}") - F.col(c)) * share).alias(c) for c in columns))


def model_curves(rows: DataFrame, capacity: float | str, early: int, points: int = 50, discharge_first: bool = False, cell: str = "cell_id", cycle: str = "cycle", order: str = "seq") -> DataFrame:
    """cell, cycle, k (0 to 2 * points - 1), v, i, q: the first ``early`` cycles of each cell as curves of one length, charge before discharge.

    ``rows``: voltage_v, current_a, charge_capacity_ah, discharge_capacity_ah; ``capacity``: the nominal one, or its column.  A cycle is cut at the last row that charges at C/100 or more (with
    ``discharge_first``: that discharges so); what comes after the cut counts where its current is over C/100 either way.  Both parts are resampled by sample number; voltages are over the highest
    of the cycle's points, currents and capacities over the nominal capacity.  Cycles that are missing, or lack a cut or a part, are zeros.
    """
    keys = [cell, cycle]
    c = F.col(capacity) if isinstance(capacity, str) else F.lit(float(capacity))
    w, whole = ordered(keys, order), Window.partitionBy(*keys)
    rate = F.col("current_a") / c
    own = rows.filter(F.col(cycle).between(1, early)).withColumn("__c", c).withColumn("__j", F.row_number().over(w))
    cut = F.max(F.when((rate <= -0.01) if discharge_first else (rate >= 0.01), F.col("__j"))).over(whole)
    first = F.col("__j") < F.col("__cut")
    placed = own.withColumn("__cut", cut).filter(first | ((F.col("__j") >= F.col("__cut")) & (F.abs(rate) > 0.01)))
    placed = placed.withColumn("__part", F.when(first, int(discharge_first)).otherwise(1 - int(discharge_first)))
    q = F.when(F.col("__part") == 0, F.col("charge_capacity_ah")).otherwise(F.col("discharge_capacity_ah"))
    drawn = resample_by_index(placed.select(*keys, order, "__c", "__part", F.col("voltage_v").alias("v"), F.col("current_a").alias("i"), q.alias("q")), ["v", "i", "q", "__c"], points, [*keys, "__part"], order)
    both = drawn.withColumn("__n", F.count("*").over(whole)).filter(F.col("__n") == 2 * points)
    scaled = both.select(*keys, (F.col("k") + points * F.col("__part")).alias("k"), ratio(F.col("v"), F.max("v").over(whole)).alias("v"), (F.col("i") / F.col("__c")).alias("i"), (F.col("q") / F.col("__c")).alias("q"))
    grid = rows.select(cell).distinct().withColumn(cycle, F.explode(F.sequence(F.lit(1), F.lit(early)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * points - 1))))
    return grid.join(scaled, [cell, cycle, "k"], "left").select(cell, cycle, "k", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("v", "i", "q")))


def curve_arrays(curves: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, v, i, q as arrays in the order of k, a row for each cycle: a model's input."""
    rows = curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v", "i", "q"))).alias("r"))
    return rows.select(*keys, *(F.col(f"r.{c}").alias(c) for c in ("v", "i", "q")))


def curvature_area(curve: DataFrame, peak: DataFrame, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """icp_area between the first change of sign of the second derivative (or local minimum) on each side of the peak, less the sloped baseline;
    a side without one ends at the peak itself."""
    bent = savgol(curve, 11, 3, y=y, name="__d2", derivative=2, keys=keys)
    w = ordered(keys, "i")
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    turn = F.coalesce((F.col(y) <= before) & (F.col(y) <= after), F.lit(False))
    marked = bent.withColumn("__min", turn).withColumn("__left", F.lag("__d2").over(w)).withColumn("__right", F.lead("__d2").over(w))
    top = marked.join(peak.select(*keys, "icp_v"), keys)
    at = F.min(F.struct(F.abs(F.col("x") - F.col("icp_v")).alias("d"), F.col("i").alias("i"))).over(Window.partitionBy(*keys))
    placed = top.withColumn("__p", at["i"])
    crosses = lambda other: F.coalesce(F.col("__d2") * F.col(other) < 0, F.lit(False))
    k = Window.partitionBy(*keys)
    lo = F.max(F.when((F.col("i") < F.col("__p")) & (F.col("__min") | crosses("__right")), F.col("i"))).over(k)
    hi = F.min(F.when((F.col("i") > F.col("__p")) & (F.col("__min") | crosses("__left")), F.col("i"))).over(k)
    inside = placed.withColumn("__lo", F.coalesce(lo, F.col("__p"))).withColumn("__hi", F.coalesce(hi, F.col("__p"))).filter("i between __lo and __hi")
    a, b = F.min(F.struct("i", "x", F.col(y).alias("y"))).over(k), F.max(F.struct("i", "x", F.col(y).alias("y"))).over(k)
    line = a["y"] + F.coalesce(ratio((b["y"] - a["y"]) * (F.col("x") - a["x"]), b["x"] - a["x"]), F.lit(0.0))
    above = inside.withColumn("__c", F.col(y) - line)
    return above.withColumn("__s", trapezoid(F.col("__c"), F.col("x"), w)).groupBy(*keys).agg(F.abs(F.coalesce(F.sum("__s"), F.lit(0.0))).alias("icp_area"))


def dv_at(dv: DataFrame, peak: DataFrame, valley_: DataFrame, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """dvv, dvp: the DV curve at the grid points nearest to the voltages of the IC peak and (if there is one) the IC valley."""
    joined = dv.join(peak.select(*keys, "icp_v"), keys).join(valley_.select(*keys, "icv", "icvl_v"), keys)
    near = lambda v: F.min_by(y, F.struct(F.abs(F.col("x") - F.col(v)), F.col("i")))
    return joined.groupBy(*keys).agg(near("icp_v").alias("dvv"), F.min_by(y, F.when(F.col("icv") > 0, F.struct(F.abs(F.col("x") - F.col("icvl_v")), F.col("i")))).alias("dvp"))


def dv_by_rule_of_lfp(dv: DataFrame, peak: DataFrame, least: float = 0.005, share: float = 0.7, y: str = "y", keys: list[str] = KEYS) -> DataFrame:
    """dvv: one over the IC peak; dvp, dvp_q: the most prominent peak (over ``least``) of the DV curve over the charge x, in the first ``share`` of it; NULL without one."""
    tops = peaks(dv, y=y, prominence=least, keys=keys).join(dv.groupBy(*keys).agg(F.max("x").alias("__q")), keys)
    best = tops.filter((F.col("x") > 0) & (F.col("x") < share * F.col("__q"))).groupBy(*keys).agg(F.max(F.struct("prominence", "y", "x")).alias("p"))
    return peak.select(*keys, "icp").join(best, keys, "left").select(*keys, ratio(F.lit(1.0), F.col("icp")).alias("dvv"), F.col("p.y").alias("dvp"), F.col("p.x").alias("dvp_q"))
