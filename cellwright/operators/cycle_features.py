"""One row of features for each cycle, from phase-tagged samples: conditional aggregates over one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, ratio, trapezoid
from cellwright.operators.curves import savgol

KEYS = ["cell_id", "cycle"]


def _strips(phased: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Trapezoids of |I| dt and V |I| dt between a phase's own rows (gaps are bridged)."""
    w = ordered([*keys, "phase"], order)
    current = F.abs("current_a")
    return phased.withColumn("__q", trapezoid(current, F.col("time_s"), w)).withColumn("__e", trapezoid(current * F.col("voltage_v"), F.col("time_s"), w))


def _in(phase: str, col: Column) -> Column:
    return F.when(F.col("phase") == phase, col)


def cycle_features(phased: DataFrame, keys: list[str] = KEYS, order: str = "seq", uvp: float = 4.1, lvp: float = 3.2, cv_tolerance: float = 0.01) -> DataFrame:
    """Capacity, energy, efficiency, durations, resistance and shape of the discharge.

    Missing phases: capacities and efficiency NULL, energies, durations, resistance, ratio and skewness 0.
    """
    rows = _strips(phased, keys, order)
    t, v, i, o = F.col("time_s"), F.col("voltage_v"), F.col("current_a"), F.col(order)
    cv = (F.col("phase") == "charge") & (v >= uvp - cv_tolerance)
    agg = rows.groupBy(*keys).agg(
        (F.sum(_in("charge", F.col("__q"))) / 3600).alias("qc"), (F.sum(_in("discharge", F.col("__q"))) / 3600).alias("qd"),
        (F.sum(_in("charge", F.col("__e"))) / 3600).alias("ec"), (F.sum(_in("discharge", F.col("__e"))) / 3600).alias("ed"),
        F.min_by(v, F.when(F.col("phase") == "charge", o)).alias("ichv"), F.min_by(v, F.when(F.col("phase") == "discharge", o)).alias("idv"),
        F.min_by(t, F.when(F.col("phase") == "charge", o)).alias("c0"), F.max_by(t, F.when(F.col("phase") == "charge", o)).alias("c1"),
        F.min_by(t, F.when(F.col("phase") == "discharge", o)).alias("d0"), F.max_by(t, F.when(F.col("phase") == "discharge", o)).alias("d1"),
        F.min(F.when(cv, t)).alias("cv0"),
        F.min(_in("discharge", F.when(v <= lvp, t))).alias("low0"),
        F.max_by(v, F.when(F.col("phase") == "rest", o)).alias("v_rest"), F.max_by(v, F.when(F.col("phase") == "charge", o)).alias("v_charge"),
        F.min_by(i, F.when(F.col("phase") == "discharge", o)).alias("i_first"), F.min_by(i, F.when(F.col("phase") == "charge", o)).alias("i_charge"),
        F.max_by(v, F.when(F.col("phase") == "discharge", o)).alias("v_last"),
        F.var_samp(_in("discharge", i)).alias("var_i"), F.var_samp(_in("discharge", v)).alias("var_v"), F.percentile(_in("discharge", v), F.lit(0.5)).alias("median_v"),
        F.stddev_pop(_in("discharge", v)).alias("sd_v"), F.skewness(_in("discharge", v)).alias("skew_v"),
    )
    c = F.col
    efficiency = F.when(c("qc") > 1e-6, ratio(c("qd"), c("qc")))
    total = c("c1") - c("c0")
    tccc = F.when(c("cv0").isNull(), total).otherwise(c("cv0") - c("c0"))
    tcvc = F.when(c("cv0").isNull(), F.lit(0.0)).otherwise(c("c1") - c("cv0"))
    pre = F.coalesce("v_rest", "v_charge")
    resistance = F.when(F.abs("i_first") > 1e-6, ratio(pre - c("idv"), F.abs("i_first")))
    zero = F.lit(0.0)
    return agg.select(
        *keys, c("qc").alias("charge_capacity"), c("qd").alias("discharge_capacity"), F.when(efficiency > 1.0001, 1.0).otherwise(efficiency).alias("coulombic_efficiency"),
        F.coalesce("ec", zero).alias("charge_energy"), F.coalesce("ed", zero).alias("discharge_energy"), F.coalesce(ratio(c("ed"), c("ec")), zero).alias("energy_efficiency"),
        "ichv", F.coalesce(total, zero).alias("uvp_time"), F.coalesce(tccc, zero).alias("tccc"), F.coalesce(tcvc, zero).alias("tcvc"), F.coalesce(F.when(tcvc > 1e-6, ratio(tccc, tcvc)), zero).alias("rcv"),
        "idv", F.coalesce(F.coalesce("low0", "d1") - c("d0"), zero).alias("lvp_time"), F.coalesce(c("d1") - c("d0"), zero).alias("total_discharge_time"),
        "var_i", "var_v", "median_v", F.coalesce(resistance, zero).alias("internal_resistance"),
        F.coalesce(F.when(c("i_charge") > 0.001, ratio(c("ichv") - c("v_last"), c("i_charge"))), zero).alias("alternative_resistance"),
        F.when(c("sd_v") > 1e-6, c("skew_v")).otherwise(zero).alias("skew_v"),
    )


def slopes(phased: DataFrame, phase: str, anchors: list[tuple[float, float]] = [(0.1, 0.3), (0.1, 0.5), (0.1, 0.8)], keys: list[str] = KEYS, order: str = "seq") -> DataFrame:  # noqa: B006
    """Slope of the voltage between two shares of the phase's duration, each at the first sample at or after it; 0 if they are no time apart."""
    w = Window.partitionBy(*keys)
    rows = phased.filter(F.col("phase") == phase)
    begin, end = F.min("time_s").over(w), F.max("time_s").over(w)
    rel = rows.withColumn("__t", F.col("time_s") - begin).withColumn("__d", end - begin)
    shares = sorted({a for pair in anchors for a in pair})
    at = {a: F.min(F.when(F.col("__t") >= a * F.col("__d"), F.struct(F.col(order), F.col("__t").alias("t"), F.col("voltage_v").alias("v")))) for a in shares}
    agg = rel.groupBy(*keys).agg(*(at[a].alias(f"a{k}") for k, a in enumerate(shares)))
    number = {a: f"a{k}" for k, a in enumerate(shares)}

    def slope(x: float, y: float) -> Column:
        dt = F.col(f"{number[y]}.t") - F.col(f"{number[x]}.t")
        return F.when(dt > 1e-6, ratio(F.col(f"{number[y]}.v") - F.col(f"{number[x]}.v"), dt)).otherwise(0.0)

    return agg.select(*keys, *(slope(x, y).alias(f"{phase}_slope_{k}") for k, (x, y) in enumerate(anchors, 1)))


def equal_voltage_times(phased: DataFrame, phase: str, intervals: list[tuple[float, float]], keys: list[str] = KEYS) -> DataFrame:
    """Time between the first crossings of two voltages (upwards in charge, downwards in discharge) if positive, else 0."""
    rows = phased.filter(F.col("phase") == phase)
    v, t = F.col("voltage_v"), F.col("time_s")
    first = lambda bound: F.min(F.when(v >= bound if phase == "charge" else v <= bound, t))
    return rows.groupBy(*keys).agg(*(F.greatest(F.coalesce(first(b) - first(a), F.lit(0.0)), F.lit(0.0)).alias(f"{phase}_time_{k}") for k, (a, b) in enumerate(intervals, 1)))


def smoothed_temperature(rows: DataFrame, window: int = 51, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """rows with temperature_c after a Savitzky-Golay filter of third order; a cycle shorter than the window stays as it is."""
    curve = rows.withColumn("i", F.col(order))
    return savgol(curve, window, 3, y="temperature_c", name="__smooth", keys=keys).withColumn("temperature_c", F.col("__smooth")).drop("__smooth", "i")


def thermal(smooth: DataFrame, uneven: bool = False, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Temperatures, heating rates and load from (smoothed) temperatures; zeros with under 5 rows, rates with over 5 only.

    A rate is the ratio of the central differences of temperature and time, or with ``uneven`` the second-order difference for unequal steps (NULL where a step is 0)."""
    w = ordered(keys, order)
    d = lambda c: F.when(F.lag(c).over(w).isNull(), F.lead(c).over(w) - F.col(c)).when(F.lead(c).over(w).isNull(), F.col(c) - F.lag(c).over(w)).otherwise((F.lead(c).over(w) - F.lag(c).over(w)) / 2)
    dt = d("time_s")
    rate = ratio(d("temperature_c"), F.when(dt == 0, F.lit(1e-6)).otherwise(dt))
    if uneven:
        x, t = F.col("temperature_c"), F.col("time_s")
        back, ahead = t - F.lag(t).over(w), F.lead(t).over(w) - t
        inner = ratio(back * back * F.lead(x).over(w) + (ahead * ahead - back * back) * x - ahead * ahead * F.lag(x).over(w), back * ahead * (back + ahead))
        edge = F.when(back.isNull(), ratio(F.lead(x).over(w) - x, ahead)).otherwise(ratio(x - F.lag(x).over(w), back))
        rate = F.when(back.isNull() | ahead.isNull(), edge).otherwise(inner)
    strip = trapezoid(F.col("temperature_c"), F.col("time_s"), w)
    agg = smooth.withColumn("__rate", rate).withColumn("__strip", strip).groupBy(*keys).agg(
        F.count("temperature_c").alias("n"), F.max("temperature_c").alias("hi"), F.min("temperature_c").alias("lo"), F.avg("temperature_c").alias("mean"),
        F.min_by("temperature_c", order).alias("first"), F.max("__rate").alias("top"), F.avg("__rate").alias("rate"), F.sum("__strip").alias("load"),
    )
    enough = lambda c, least=5: F.when(F.col("n") >= least, c).otherwise(0.0)
    return agg.select(
        *keys, enough(F.col("hi")).alias("max_temperature"), enough(F.col("mean")).alias("mean_temperature"), enough(F.col("lo")).alias("min_temperature"), enough(F.col("hi") - F.col("first")).alias("temperature_rise"),
        enough(F.col("top"), 6).alias("max_heat_rate"), enough(F.col("rate"), 6).alias("mean_heat_rate"), enough(F.col("load")).alias("thermal_load"),
    )


def stage_features(stages: DataFrame, most: int = 3, phase: str = "charge", keys: list[str] = KEYS) -> DataFrame:
    """Current and time of the first stages of a phase; of the charge also the ratio of the first two times and the voltage's step into the
    second stage; absent stages are 0."""
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("stage") == k, F.col(c))), F.lit(0.0))
    each = [at(k, column).alias(f"{phase}_{name}_{k}") for column, name in (("current_a", "current"), ("duration_s", "time")) for k in range(1, most + 1)]
    if phase != "charge":
        return stages.groupBy(*keys).agg(*each)
    agg = stages.groupBy(*keys).agg(*each, at(2, "jump_v").alias("resistance_jump_dv"))
    return agg.withColumn("charge_time_ratio_1_2", F.coalesce(ratio(F.col("charge_time_1"), F.col("charge_time_2")), F.lit(0.0)))


def stage_times(charge: DataFrame, stages: DataFrame, near_v: float = 0.03, steady_v: float = 0.015, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """tccc, tcvc of the cycles with stages (duration_s, mean_v, std_v): seconds in stages that aren't held at the charge's highest voltage, and the rest of the charge.

    A stage is held there where its mean voltage is over the highest less ``near_v`` and its deviation under ``steady_v``; one of a single row has no deviation and isn't.
    """
    whole = charge.groupBy(*keys).agg(F.max("voltage_v").alias("top"), (F.max_by("time_s", order) - F.min_by("time_s", order)).alias("total"))
    held = (F.col("mean_v") > F.col("top") - near_v) & (F.col("std_v") < steady_v)
    summed = stages.join(whole, keys).groupBy(*keys, "total").agg(F.sum(F.when(F.coalesce(held, F.lit(False)), 0.0).otherwise(F.col("duration_s"))).alias("tccc"))
    return summed.select(*keys, "tccc", F.greatest(F.lit(0.0), F.col("total") - F.col("tccc")).alias("tcvc"))


def inferred_rates(tel: DataFrame, capacity: float, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """C-rates: median current of the first half of the charge rows, and median |I| of the discharge, over the capacity; 2 digits."""
    w = Window.partitionBy(*keys)
    rows = tel.filter("current_a > 0").withColumn("__k", F.row_number().over(ordered(keys, order))).withColumn("__n", F.count("*").over(w))
    half = rows.filter("__k <= __n div 2").groupBy(*keys).agg(F.round(F.percentile("current_a", F.lit(0.5)) / capacity, 2).alias("charge_rate"))
    down = tel.filter("current_a < 0").groupBy(*keys).agg(F.round(F.percentile(F.abs("current_a"), F.lit(0.5)) / capacity, 2).alias("discharge_rate"))
    return half.join(down, keys, "left")


def _best_tau(lo: Column, hi: Column) -> Column:
    """(sse, tau, step) of the best fit on a grid of 60 taus, of a cycle's array r of (t, i); NULL where no fit is good."""
    step = (hi - lo) / 59

    def fit(tau: Column) -> Column:
        points = F.transform("r", lambda p: F.struct(p["i"].alias("i"), F.exp(-p["t"] / tau).alias("x")))

        def more(s: Column, p: Column) -> Column:
            n = s["n"] + 1.0
            dx, dy = p["x"] - s["mx"], p["i"] - s["my"]
            mx = s["mx"] + dx / n
            return F.struct(n.alias("n"), mx.alias("mx"), (s["my"] + dy / n).alias("my"), (s["sxx"] + dx * (dx - dx / n)).alias("sxx"), (s["sxy"] + dy * (p["x"] - mx)).alias("sxy"), (s["syy"] + dy * (dy - dy / n)).alias("syy"))

        return F.aggregate(points, F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mx", "my", "sxx", "sxy", "syy"))), more, lambda s: F.struct(tau.alias("tau"), s["sxx"].alias("sxx"), s["sxy"].alias("sxy"), s["syy"].alias("syy")))

    fits = F.transform(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.exp(lo + (hi - lo) * k / 59)), fit)
    good = F.filter(fits, lambda f: (f["syy"] > 1e-12) & (f["sxx"] > 0) & (f["sxy"] >= 0))
    return F.array_min(F.transform(good, lambda f: F.struct((f["syy"] - f["sxy"] * f["sxy"] / f["sxx"]).alias("sse"), f["tau"].alias("tau"), step.alias("step"))))


def current_tau(charge: DataFrame, uvp: float, tolerance: float = 0.05, least_rows: int = 3, keys: list[str] = KEYS, order: str = "seq", rounds: int = 3, over_s: float | None = None, over_a: float | None = None, least_std: float = 0.0) -> DataFrame:
    """cv_tau of I = a exp(-t / tau) + c over the rows at V >= uvp - tolerance, 0 where it can't be fitted.

    It isn't fitted with under ``least_rows`` rows, where these rows last no longer than ``over_s`` seconds, where no current is over ``over_a``, or where the currents' deviation is under ``least_std``.

    For a given tau the fit is linear, so tau is searched on a grid of 60 in [1, 1e4], and twice on finer grids around the best; a >= 0.
    A cycle's rows come together as an array, so they aren't multiplied by the grid.
    """
    w = Window.partitionBy(*keys)
    rows = charge.filter(F.col("voltage_v") >= uvp - tolerance)
    rows = rows.select(*keys, (F.col("time_s") - F.min("time_s").over(w)).alias("t"), F.col("current_a").alias("i"), F.count("*").over(w).alias("n"), (F.max("time_s").over(w) - F.min("time_s").over(w)).alias("s"), F.max("current_a").over(w).alias("top"), F.stddev_pop("current_a").over(w).alias("sd"))
    rows = rows.filter(F.col("n") >= least_rows)
    if over_s is not None:
        rows = rows.filter(F.col("s") > over_s)
    if over_a is not None:
        rows = rows.filter(F.col("top") > over_a)
    rows = rows.filter(F.col("sd") >= least_std)
    own = rows.filter("t is not null and i is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", F.col("i").cast("double").alias("i")))).alias("r"))

    best = own.withColumn("lo", F.lit(0.0)).withColumn("hi", F.log(F.lit(1e4)))
    for _ in range(rounds):
        found = best.select(*keys, "r", _best_tau(F.col("lo"), F.col("hi")).alias("m"))
        # a NULL tau stays NULL in the rounds that follow
        best = found.select(*keys, "r", F.when(F.col("m").isNotNull(), F.greatest(F.lit(0.0), F.log("m.tau") - F.col("m.step"))).alias("lo"), F.least(F.log(F.lit(1e4)), F.log("m.tau") + F.col("m.step")).alias("hi"), F.col("m.tau").alias("tau"))
    every = charge.select(*keys).distinct()
    return every.join(best.select(*keys, "tau"), keys, "left").select(*keys, F.coalesce("tau", F.lit(0.0)).alias("cv_tau"))
