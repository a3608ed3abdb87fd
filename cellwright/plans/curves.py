"""Queries for the dQ/dV curves of the discharge."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, running
from cellwright.operators import curves as cu
from cellwright.operators import ingest as g
from cellwright.operators.names import ZERO_AT_HALF, expansion_metadata
from cellwright.operators.profiles import forced_zeros
from cellwright.plans.cleaning import PROFILED, profiled
from cellwright.plans.cycles import rounded
from cellwright.plans.ingest import CAP
from cellwright.plans.sql import CELLS, TELEMETRY, with_
from cellwright.sources import fixtures as fx
from cellwright.sources.files import written_once

Q: dict = {}
S: dict = {}
KEYS = ["cell_id", "cycle"]
VQ = CAP + ", vq AS (SELECT cell_id, cycle, seq, round(voltage_v, 6) AS v, round(capacity, 6) AS q FROM caps WHERE current_a < 0)"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def vq(spark, d, sign=-1):
    """Voltage and charge of the discharge (sign 1: of the charge), to 6 digits."""
    rows = g.integrate_charge(fx.telemetry(spark, d), sign).filter(F.col("current_a") * sign > 0)
    return rows.select(*KEYS, "seq", F.round(F.col("voltage_v") + 1e-9, 6).alias("v"), F.round(F.col("capacity") + 1e-9, 6).alias("q"))


def ic(spark, d, sign=-1, cut=0.02):
    """Smoothed dQ/dV over the voltage, from a uniform grid of 60 points."""
    grid = cu.resample(cu.prepare(vq(spark, d, sign), cut=cut, least=10), step=0.02, least=60, most=60)
    slope = cu.gradient(cu.gradient(grid, name="dq"), y="x", name="dv")
    curve = slope.select(*KEYS, "i", "x", F.abs(F.try_divide("dq", "dv")).alias("y"))
    return cu.savgol(curve, 11, 3, clip=True).select(*KEYS, "i", "x", F.col("smooth").alias("y"))


PREP = """p1 AS (SELECT *, count(*) OVER k AS n, max(q) OVER k AS top FROM vq WINDOW k AS (PARTITION BY cell_id, cycle)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle, v ORDER BY seq) AS a FROM p1 WHERE n >= 10 AND q > 0.02 * top),
p3 AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle, q ORDER BY seq) AS b FROM p2 WHERE a = 1),
prep AS (SELECT cell_id, cycle, seq, v, q FROM p3 WHERE b = 1)"""


@query("cur12_prepare", with_(TELEMETRY, VQ, PREP) + "SELECT * FROM prep")
def cur12(spark, d):
    return cu.prepare(vq(spark, d), cut=0.02, least=10)


@query("cur1_resample", with_(TELEMETRY, VQ, PREP) + """, s AS (SELECT cell_id, cycle, v AS x, q AS y, lead(v) OVER w AS x2, lead(q) OVER w AS y2, min(v) OVER k AS lo, max(v) OVER k AS hi FROM prep WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY v), k AS (PARTITION BY cell_id, cycle)),
g AS (SELECT cell_id, cycle, i, lo + (hi - lo) / 59 * i AS gx FROM (SELECT DISTINCT cell_id, cycle, lo, hi FROM s), (SELECT unnest(range(60)) AS i) t),
j AS (SELECT g.*, s.*, row_number() OVER (PARTITION BY g.cell_id, g.cycle, i ORDER BY s.x DESC) AS k FROM g JOIN s ON g.cell_id = s.cell_id AND g.cycle = s.cycle AND s.x <= gx + 1e-9 AND s.x2 IS NOT NULL)
SELECT cell_id, cycle, CAST(i AS INT) AS i, round(gx, 6) AS x, round(y + (y2 - y) * (gx - x) / (x2 - x), 5) AS y FROM j WHERE k = 1""")
def cur1(spark, d):
    grid = cu.resample(cu.prepare(vq(spark, d), cut=0.02, least=10), step=0.02, least=60, most=60)
    return rounded(grid, "y").withColumn("y", F.round(F.col("y") + 1e-9, 5))


@query("cur2_gradient", with_(TELEMETRY) + """SELECT cell_id, cycle, seq AS i, round(CASE WHEN lag(seq) OVER w IS NULL THEN lead(voltage_v) OVER w - voltage_v WHEN lead(seq) OVER w IS NULL THEN voltage_v - lag(voltage_v) OVER w ELSE (lead(voltage_v) OVER w - lag(voltage_v) OVER w) / 2 END, 6) AS g
FROM telemetry WHERE current_a < 0 WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)""")
def cur2(spark, d):
    rows = fx.telemetry(spark, d).filter("current_a < 0").select(*KEYS, F.col("seq").alias("i"), F.col("voltage_v").alias("y"))
    return rounded(cu.gradient(rows).select(*KEYS, "i", "g"))


@query("cur3_savgol")
def cur3(spark, d):
    """Tests compare it with polynomials and a fit in numpy."""
    return rounded(ic(spark, d))


@query("cur4_peaks")
def cur4(spark, d):
    return rounded(cu.peaks(ic(spark, d), prominence=0.01))


@query("cur5_peak_widths")
def cur5(spark, d):
    curve = written_once(ic(spark, d), "curves")
    return rounded(cu.peak_widths(cu.peaks(curve, prominence=0.01), curve))


def _main(spark, d):
    """The smoothed curves, which peaks, widths and the greatest values are read from, and their main peaks."""
    curve = written_once(ic(spark, d), "curves")
    return curve, cu.main_peak(curve, cu.peak_widths(cu.peaks(curve, prominence=0.01), curve), 3.2, 4.1)


@query("cur6_main_peak")
def cur6(spark, d):
    return rounded(_main(spark, d)[1])


@query("cur7_peak_area")
def cur7(spark, d):
    curve, peak = _main(spark, d)
    return rounded(cu.peak_area(curve, peak, 0.05))


@query("cur9_valley")
def cur9(spark, d):
    curve, peak = _main(spark, d)
    return rounded(cu.valley(curve, peak))


@query("cur11_centroid", with_(TELEMETRY) + "SELECT cell_id, cycle, round(sum(voltage_v * abs(current_a)) / nullif(sum(abs(current_a)), 0), 6) AS centroid_voltage FROM telemetry WHERE current_a < 0 GROUP BY ALL")
def cur11(spark, d):
    rows = fx.telemetry(spark, d).filter("current_a < 0").select(*KEYS, F.col("voltage_v").alias("x"), F.abs("current_a").alias("y"))
    return rounded(cu.centroid(rows))


@query("cur14_forced_zeros", with_(TELEMETRY, CELLS, PROFILED) + """SELECT t.cell_id, t.cycle, round(CASE WHEN no_width THEN 0 ELSE max(voltage_v) END, 6) AS fwhm, round(CASE WHEN no_dvp THEN 0 ELSE min(voltage_v) END, 6) AS dvp, round(avg(voltage_v), 6) AS icp
FROM telemetry t JOIN cells ON t.cell_id = cells.cell_id JOIN p ON cells.dataset = p.dataset GROUP BY t.cell_id, t.cycle, no_width, no_dvp""")
def cur14(spark, d):
    values = fx.telemetry(spark, d).groupBy(*KEYS).agg(F.max("voltage_v").alias("fwhm"), F.min("voltage_v").alias("dvp"), F.avg("voltage_v").alias("icp"))
    flagged = values.join(profiled(spark, d).select("cell_id", "no_width", "no_dvp"), "cell_id")
    return rounded(forced_zeros(flagged, {"no_width": ["fwhm"], "no_dvp": ["dvp"]}).select(*KEYS, "fwhm", "dvp", "icp"))


@query("cur15_curve_export")
def cur15(spark, d):
    """IC and DV rows of the first cycles (rows only; the parts have tests)."""
    curve = written_once(ic(spark, d).filter("cycle <= 100"), "curves")
    dv = curve.filter("y > 0").select(*KEYS, F.lit("DV").alias("type"), "i", "x", F.try_divide(F.lit(1.0), "y").alias("y"))
    return rounded(curve.select(*KEYS, F.lit("IC").alias("type"), "i", "x", "y").unionByName(dv))


@query("cur16_resample_by_index", with_(TELEMETRY) + """, n AS (SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY cell_id, cycle) AS m, coalesce(lead(voltage_v) OVER w, voltage_v) AS nv FROM telemetry WHERE current_a < 0 WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT n.*, k, 1 + k * m / CAST(24 AS DOUBLE) AS place FROM n, (SELECT unnest(range(25)) AS k) t)
SELECT cell_id, cycle, CAST(k AS INT) AS k, round(voltage_v + (nv - voltage_v) * least(greatest(place - j, 0), 1), 6) AS voltage_v FROM g WHERE j = least(floor(place + 1e-9), m)""")
def cur16(spark, d):
    return rounded(cu.resample_by_index(fx.telemetry(spark, d).filter("current_a < 0"), ["voltage_v"], 25))


@query("cur14_zeros_at_half_range", with_(TELEMETRY) + """SELECT cell_id, cycle, round(CASE WHEN cell_id % 3 = 0 THEN 0 ELSE max(voltage_v) END, 6) AS icp, round(CASE WHEN cell_id % 3 = 0 THEN 0 ELSE min(voltage_v) END, 6) AS dvvl_v, round(avg(voltage_v), 6) AS icp_area FROM telemetry GROUP BY cell_id, cycle""")
def cur14_half(spark, d):
    """Cells whose names say half a range."""
    values = fx.telemetry(spark, d).groupBy(*KEYS).agg(F.max("voltage_v").alias("icp"), F.min("voltage_v").alias("dvvl_v"), F.avg("voltage_v").alias("icp_area"))
    half = values.withColumn("half", expansion_metadata(F.when(F.col("cell_id") % 3 == 0, F.lit("MICH_13R_NMC_25C")).otherwise("MICH_05R_NMC_25C_0-100"))["soc"] == 50)
    return rounded(forced_zeros(half, {"half": [c for c in ZERO_AT_HALF if c in values.columns]}).select(*KEYS, "icp", "dvvl_v", "icp_area"))


#: Telemetry with running capacities of a cycle.
CAPACITIES = """caps AS (SELECT *, sum(CASE WHEN current_a > 0 THEN current_a * dt ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq) / 3600 AS qc, sum(CASE WHEN current_a < 0 THEN -current_a * dt ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq) / 3600 AS qd
  FROM (SELECT *, time_s - lag(time_s, 1, time_s) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS dt FROM telemetry) x)"""


def capacities(spark, d):
    w = ordered(KEYS, "seq")
    tel = fx.telemetry(spark, d).withColumn("__dt", F.coalesce(F.col("time_s") - F.lag("time_s").over(w), F.lit(0.0)))
    up, down = (F.when(sign * F.col("current_a") > 0, sign * F.col("current_a") * F.col("__dt")).otherwise(0.0) for sign in (1, -1))
    return tel.withColumn("__u", up).withColumn("__d", down).withColumn("charge_capacity_ah", running(F.col("__u"), w) / 3600).withColumn("discharge_capacity_ah", running(F.col("__d"), w) / 3600)


def _model_curve_sql(discharge_first: bool) -> str:
    """Curves of 10 + 10 points of the first 12 cycles, capacity 0.4 Ah."""
    cut = "current_a / 0.4 <= -0.01" if discharge_first else "current_a / 0.4 >= 0.01"
    before, after = (1, 0) if discharge_first else (0, 1)
    return f"""SELECT cell_id, cycle, CAST(k AS INT) AS k, round(coalesce(v, 0), 6) AS v, round(coalesce(i, 0), 6) AS i, round(coalesce(q, 0), 6) AS q FROM (WITH a AS (SELECT *, max(CASE WHEN {cut} THEN j END) OVER (PARTITION BY cell_id, cycle) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS j FROM caps WHERE cycle <= 12) x),
b AS (SELECT *, CASE WHEN j < cut THEN {before} ELSE {after} END AS part FROM a WHERE j < cut OR (j >= cut AND abs(current_a / 0.4) > 0.01)),
n AS (SELECT *, CASE WHEN part = 0 THEN qc ELSE qd END AS q, row_number() OVER w AS p, count(*) OVER (PARTITION BY cell_id, cycle, part) AS m FROM b WINDOW w AS (PARTITION BY cell_id, cycle, part ORDER BY seq)),
o AS (SELECT *, coalesce(lead(voltage_v) OVER w, voltage_v) AS nv, coalesce(lead(current_a) OVER w, current_a) AS ni, coalesce(lead(q) OVER w, q) AS nq FROM n WINDOW w AS (PARTITION BY cell_id, cycle, part ORDER BY seq)),
g AS (SELECT o.*, k, least(greatest(1 + k * m / CAST(9 AS DOUBLE) - p, 0), 1) AS f FROM o, (SELECT unnest(range(10)) AS k) t WHERE p = least(floor(1 + k * m / CAST(9 AS DOUBLE) + 1e-9), m)),
r AS (SELECT cell_id, cycle, k + 10 * part AS k, voltage_v + (nv - voltage_v) * f AS v, current_a + (ni - current_a) * f AS i, q + (nq - q) * f AS q, count(*) OVER (PARTITION BY cell_id, cycle) AS n FROM g),
z AS (SELECT cell_id, cycle, k, v / max(v) OVER (PARTITION BY cell_id, cycle) AS v, i / 0.4 AS i, q / 0.4 AS q FROM r WHERE n = 20)
SELECT s.cell_id, s.cycle, s.k, v, i, q FROM (SELECT cell_id, cycle, k FROM (SELECT DISTINCT cell_id FROM telemetry) c, (SELECT unnest(range(1, 13)) AS cycle) y, (SELECT unnest(range(20)) AS k) t) s LEFT JOIN z ON z.cell_id = s.cell_id AND z.cycle = s.cycle AND z.k = s.k) w"""


@query("cur16_model_curves", with_(TELEMETRY, CAPACITIES) + _model_curve_sql(False))
def cur16_model(spark, d):
    return rounded(cu.model_curves(capacities(spark, d), 0.4, 12, points=10))


@query("cur16_model_curves_discharge_first", with_(TELEMETRY, CAPACITIES) + _model_curve_sql(True))
def cur16_discharge_first(spark, d):
    return rounded(cu.model_curves(capacities(spark, d), 0.4, 12, points=10, discharge_first=True))


@query("cur8_curvature_area")
def cur8(spark, d):
    curve, peak = _main(spark, d)
    return rounded(cu.curvature_area(curve, peak))


@query("cur10_dv_at_peak_and_valley")
def cur10(spark, d):
    curve, peak = _main(spark, d)
    dv = curve.filter("y > 0").withColumn("y", F.try_divide(F.lit(1.0), "y"))
    return rounded(cu.dv_at(dv, peak, cu.valley(curve, peak)))


def dv(spark, d):
    """Smoothed dV/dQ over the charge, from a uniform grid of 60 points."""
    grid = cu.resample(cu.prepare(vq(spark, d), cut=0.02, least=10), step=0.001, least=60, most=60, x="q", y="v")
    slope = cu.gradient(cu.gradient(grid, name="dy"), y="x", name="dx")
    return cu.savgol(slope.select(*KEYS, "i", "x", F.abs(F.try_divide("dy", "dx")).alias("y")), 11, 3, clip=True).select(*KEYS, "i", "x", F.col("smooth").alias("y"))


@query("cur10_lfp_dv")
def cur10_lfp(spark, d):
    """The other rule of CUR10: peaks have no SQL; a test compares it with a loop."""
    return rounded(cu.dv_by_rule_of_lfp(dv(spark, d), _main(spark, d)[1]))


@query("cur9_valley_before_next_peak")
def cur9_next(spark, d):
    """The other rule of CUR9."""
    curve, peak = _main(spark, d)
    return rounded(cu.valley_before_next_peak(curve, peak, cu.peaks(curve, prominence=0.01), 3.2, 4.1))


@query("cur13_charge_side")
def cur13(spark, d):
    """The curve features of the charge: no charge is cut off, and a valley that isn't there is NULL."""
    curve = written_once(ic(spark, d, sign=1, cut=None), "curves")
    tops = cu.peaks(curve, prominence=0.01)
    peak = written_once(cu.main_peak(curve, cu.peak_widths(tops, curve), 3.2, 4.1), "peaks")
    parts = [cu.peak_area(curve, peak, 0.05), cu.centroid(curve), cu.valley(curve, peak, least=False, unset=None)]
    next_ = cu.valley_before_next_peak(curve, peak, tops, 3.2, 4.1, unset=None)
    parts.append(next_.select(*KEYS, F.col("icv").alias("icv_next"), F.col("icvl_v").alias("icvl_v_next")))
    out = peak
    for part in parts:
        out = out.join(part, KEYS, "left")
    return rounded(out.select(*KEYS, *(F.col(c).alias(f"chg_{c}") for c in out.columns if c not in KEYS)))
