"""Queries over the telemetry: phases and per-cycle features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, r6
from cellwright.operators import cycle_features as fe
from cellwright.operators import names as nm
from cellwright.operators import phases as ph
from cellwright.plans.sql import TELEMETRY, with_
from cellwright.sources import fixtures as fx

Q: dict = {}
S: dict = {}
KEYS = ["cell_id", "cycle"]

PHASED = """bounds AS (SELECT *, max(CASE WHEN current_a > 0 THEN time_s END) OVER k AS last_c, min(CASE WHEN current_a < 0 THEN time_s END) OVER k AS first_d
  FROM telemetry WINDOW k AS (PARTITION BY cell_id, cycle)),
phased AS (SELECT cell_id, cycle, seq, time_s, current_a, voltage_v, temperature_c, CASE WHEN current_a > 0 THEN 'charge' WHEN current_a < 0 THEN 'discharge'
  WHEN first_d > last_c AND time_s > last_c AND time_s < first_d THEN 'rest' END AS phase FROM bounds)"""


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def rounded(df, *keep: str):
    """Doubles to 6 digits, so that the order of summation doesn't show."""
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


@query("ph1_split_phases", with_(TELEMETRY, PHASED) + "SELECT cell_id, cycle, phase, count(*) AS n, round(sum(time_s), 6) AS t FROM phased GROUP BY ALL")
def ph1(spark, d):
    return rounded(ph.split_phases(fx.telemetry(spark, d)).groupBy(*KEYS, "phase").agg(F.count("*").alias("n"), F.sum("time_s").alias("t")))


@query("ph2_trim_at_voltage", with_(TELEMETRY, PHASED) + """, s AS (SELECT *, min(CASE WHEN phase = 'discharge' AND voltage_v <= 3.5 THEN seq END) OVER (PARTITION BY cell_id, cycle) AS stop FROM phased)
SELECT cell_id, cycle, count(*) AS n, max(seq) AS last_seq FROM s WHERE coalesce(phase, '') <> 'discharge' OR stop IS NULL OR seq <= stop GROUP BY ALL""")
def ph2(spark, d):
    return ph.trim_at_voltage(ph.split_phases(fx.telemetry(spark, d)), 3.5).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("ph3_identify_phases", with_(TELEMETRY) + """, s AS (SELECT *, CASE WHEN abs(current_a) < 0.01 THEN 'Rest' WHEN current_a >= 0.01 THEN 'Charge' ELSE 'Discharge' END AS state FROM telemetry),
m AS (SELECT *, CASE WHEN state <> lag(state) OVER w OR (state <> 'Rest' AND abs(current_a - lag(current_a) OVER w) > 0.05) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS BIGINT) AS segment FROM m)
SELECT cell_id, cycle, segment, state, count(*) AS n_rows, min(time_s) AS begin_s, max(time_s) AS end_s, round(avg(current_a), 6) AS mean_current_a FROM g GROUP BY ALL""")
def ph3(spark, d):
    return rounded(ph.identify_phases(fx.telemetry(spark, d)))


@query("ph4_charge_stages", with_(TELEMETRY) + """, s AS (SELECT *, abs(current_a - lag(current_a) OVER w) AS di, abs(voltage_v - lag(voltage_v) OVER w) AS du FROM telemetry WHERE current_a > 0 WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN di > 0.3 OR (di < 0.02 AND du > 0.12) THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS run FROM s),
a AS (SELECT cell_id, cycle, run, count(*) AS n_rows, max(time_s) - min(time_s) AS duration_s, round(avg(current_a), 6) AS current_a FROM g GROUP BY ALL HAVING count(*) >= 3)
SELECT cell_id, cycle, n_rows, duration_s, current_a, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY run) AS stage FROM a""")
def ph4(spark, d):
    return rounded(_stages(spark, d).drop("jump_v"))


def _stages(spark, d, rows="current_a > 0"):
    return ph.charge_stages(fx.telemetry(spark, d).filter(rows), big=0.3, small=0.02, dv=0.12, least=3)


@query("ph5_histogram_stages")
def ph5(spark, d):
    """Peaks of a histogram and a fold over runs: no SQL; a test compares it with a loop."""
    return rounded(ph.histogram_stages(fx.telemetry(spark, d), tolerance=0.1))


@query("ph6_stable_phase", with_(TELEMETRY) + """, s AS (SELECT *, CASE WHEN abs(current_a) >= 0.6 * max(abs(current_a)) OVER (PARTITION BY cell_id, cycle) THEN 1 ELSE 0 END AS stable FROM telemetry WHERE current_a < 0),
f AS (SELECT *, sum(stable) OVER (PARTITION BY cell_id, cycle ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS full_run FROM s)
SELECT cell_id, cycle, min(CASE WHEN full_run THEN seq END) AS first_stable, CAST(sum(stable) AS BIGINT) AS n_stable FROM f GROUP BY ALL""")
def ph6(spark, d):
    return ph.stable_phase(fx.telemetry(spark, d).filter("current_a < 0"), share=0.6, length=5)


def _stable_sql(phase: str, sign: str, rises: str, gap: int, least: int) -> str:
    """Rows of a phase from the first window of 5 stable rows to a gap."""
    k, w = "PARTITION BY cell_id, cycle", "PARTITION BY cell_id, cycle ORDER BY seq"
    return f"""(WITH r AS (SELECT *, {sign}current_a AS c FROM telemetry WHERE {sign}current_a > 0.001 AND voltage_v > 2.5),
t AS (SELECT *, max(c) OVER ({k}) AS top, count(*) OVER ({k}) AS n FROM r),
m AS (SELECT *, row_number() OVER ({w}) AS i, time_s - lag(time_s) OVER ({w}) AS dt, sum(CASE WHEN c >= 0.6 * top THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS stable,
  voltage_v - lag(voltage_v, 4) OVER ({w}) AS dv, time_s - lag(time_s, 4) OVER ({w}) AS dt4 FROM t WHERE n >= {least} AND top > 0.1),
b AS (SELECT *, min(CASE WHEN stable = 5 AND {rises} THEN i - 4 END) OVER ({k}) AS first_i FROM m),
v AS (SELECT *, max(voltage_v) OVER ({w}) AS high FROM b WHERE i >= first_i),
e AS (SELECT *, min(CASE WHEN (i > first_i AND dt > {gap}) OR ({'high - voltage_v > 0.05' if not sign else 'false'}) THEN i END) OVER ({k}) AS cut FROM v)
SELECT '{phase}' AS phase, cell_id, cycle, seq, time_s, current_a, voltage_v FROM e WHERE cut IS NULL OR i < cut)"""


@query("ph6_stable_rows", with_(TELEMETRY) + _stable_sql("charge", "", "dt4 > 0.001 AND dv / dt4 > 0.00001", 63, 5) + " UNION ALL " + _stable_sql("discharge", "-", "dv <= 0", 63, 10))
def ph6_rows(spark, d):
    """Both phases from their first stable window on."""
    tel = fx.telemetry(spark, d).select(*KEYS, "seq", "time_s", "current_a", "voltage_v")
    charge, discharge = (ph.stable_current_rows(tel, c, share=0.6, length=5, gap_s=63.0).withColumn("phase", F.lit("charge" if c else "discharge")) for c in (True, False))
    return charge.unionByName(discharge)


@query("ph7_streams", with_(TELEMETRY) + """, i AS (SELECT *, current_a < -0.7 AS inside FROM telemetry),
m AS (SELECT *, CASE WHEN inside <> lag(inside) OVER w OR lag(inside) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS block FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY n DESC, block) AS k FROM (SELECT cell_id, cycle, block, count(*) AS n FROM g WHERE inside GROUP BY ALL) x),
r AS (SELECT g.*, n, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY seq) - 1 AS i FROM g JOIN b USING (cell_id, cycle, block) WHERE k = 1),
h AS (SELECT *, min(CASE WHEN voltage_v = top THEN i END) OVER (PARTITION BY cell_id, cycle) AS place FROM (SELECT *, max(voltage_v) OVER (PARTITION BY cell_id, cycle) AS top FROM r) x),
t AS (SELECT cell_id, cycle, seq, time_s, current_a, voltage_v, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY seq) - 1 AS i, min(voltage_v) OVER (PARTITION BY cell_id, cycle) AS low FROM h WHERE place >= n - 1 OR i >= place),
z AS (SELECT *, min(CASE WHEN voltage_v = low THEN i END) OVER (PARTITION BY cell_id, cycle) AS place FROM t),
c AS (SELECT 'discharge' AS phase, cell_id, cycle, seq, time_s, current_a, voltage_v FROM z WHERE place <= 3 OR i <= place UNION ALL SELECT 'charge', cell_id, cycle, seq, time_s, current_a, voltage_v FROM telemetry WHERE voltage_v >= 3.2 AND current_a > 0.01)
SELECT phase, cell_id, cycle, seq, time_s - min(time_s) OVER (PARTITION BY phase, cell_id, cycle) AS time_s, current_a, voltage_v FROM c""")
def ph7_streams(spark, d):
    """The discharge from its highest to its lowest voltage, and the charge."""
    tel = fx.telemetry(spark, d).select(*KEYS, "seq", "time_s", "current_a", "voltage_v")
    discharge = ph.discharge_stream(tel, below=-0.7, after=3).withColumn("phase", F.lit("discharge"))
    return discharge.unionByName(ph.charge_stream(tel, least_v=3.2).withColumn("phase", F.lit("charge")))


@query("ph8_longest_chain", with_(TELEMETRY) + """, r AS (SELECT cell_id, cycle, seq, time_s, voltage_v FROM telemetry WHERE current_a < -0.6),
s AS (SELECT *, sum(CASE WHEN seq - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS segment FROM (SELECT *, lag(seq) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS before FROM r) x),
e AS (SELECT cell_id, cycle, segment, count(*) AS n, min(time_s) AS begin_s, max(time_s) AS end_s, arg_min(voltage_v, seq) AS begin_v, arg_max(voltage_v, seq) AS end_v FROM s GROUP BY ALL),
c AS (SELECT *, sum(CASE WHEN begin_s - gone < 130 THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, cycle ORDER BY segment) AS chain FROM (SELECT *, lag(end_s) OVER (PARTITION BY cell_id, cycle ORDER BY segment) AS gone FROM e) x),
j AS (SELECT *, coalesce(begin_v - lag(end_v) OVER (PARTITION BY cell_id, cycle, chain ORDER BY segment), 0) AS jump FROM c),
u AS (SELECT *, sum(jump) OVER (PARTITION BY cell_id, cycle, chain ORDER BY segment) AS total, sum(n) OVER (PARTITION BY cell_id, cycle, chain) AS rows_in FROM j),
f AS (SELECT *, least(0, min(total) OVER (PARTITION BY cell_id, cycle, chain ORDER BY segment)) AS low FROM u),
k AS (SELECT *, dense_rank() OVER (PARTITION BY cell_id, cycle ORDER BY rows_in DESC, chain) AS place FROM f)
SELECT cell_id, cycle, seq, time_s, round(voltage_v - (total - low), 6) AS voltage_v FROM s JOIN k USING (cell_id, cycle, segment) WHERE place = 1""")
def ph8_rows(spark, d):
    """Discharge rows of over 0.6 A: a missing row splits, two missing ones in a row end a chain."""
    rows = fx.telemetry(spark, d).filter("current_a < -0.6").select(*KEYS, "seq", "time_s", "voltage_v")
    return rounded(ph.longest_chain(rows, gap_s=130.0))


@query("ph7_longest_block", with_(TELEMETRY) + """, i AS (SELECT *, current_a < -0.7 AS inside FROM telemetry),
m AS (SELECT *, CASE WHEN inside <> lag(inside) OVER w OR lag(inside) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS block FROM m),
b AS (SELECT cell_id, cycle, block, count(*) AS n, min(seq) AS first_seq, max(time_s) - min(time_s) AS duration_s FROM g WHERE inside GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY n DESC, block) AS k FROM b)
SELECT cell_id, cycle, n, first_seq, duration_s FROM r WHERE k = 1""")
def ph7(spark, d):
    return ph.longest_block(fx.telemetry(spark, d), below=-0.7).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("time_s").alias("duration_s"))


@query("ph8_chain_stitching")
def ph8(spark, d):
    """Rows only in SQL: the shift is recursive; tests compare it with a loop."""
    seg = ph.identify_phases(fx.telemetry(spark, d), step=0.2).filter("state = 'Discharge'")
    tel = fx.telemetry(spark, d)
    ends = seg.alias("s").join(tel.alias("t"), (F.col("s.cell_id") == F.col("t.cell_id")) & (F.col("s.cycle") == F.col("t.cycle")) & (F.col("t.time_s").isin(F.col("s.begin_s"), F.col("s.end_s"))))
    rows = ends.groupBy("s.cell_id", "s.cycle", "segment", "begin_s", "end_s").agg(F.min_by("voltage_v", "time_s").alias("begin_v"), F.max_by("voltage_v", "time_s").alias("end_v"))
    return rounded(ph.stitched(rows, gap_s=62.0))


@query("ph9_constant_current_slice", with_(TELEMETRY) + """, c AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle, seq) - 1 AS i FROM telemetry WHERE current_a > 0),
m AS (SELECT *, max(voltage_v) OVER k AS top, quantile_cont(current_a, 0.9) OVER k AS target FROM c WINDOW k AS (PARTITION BY cell_id)),
n AS (SELECT *, min(CASE WHEN voltage_v >= top - 0.05 AND current_a < 0.98 * target THEN i END) OVER (PARTITION BY cell_id) AS cut FROM m),
l AS (SELECT *, voltage_v > min(voltage_v) OVER (PARTITION BY cell_id) + 0.02 AS ok FROM n WHERE cut IS NULL OR cut <= 10 OR i < cut),
o AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id) AS n_ok FROM l)
SELECT cell_id, count(*) AS n, max(i) AS last_i FROM o WHERE n_ok <= 10 OR ok GROUP BY ALL""")
def ph9(spark, d):
    rows = fx.telemetry(spark, d).filter("current_a > 0").withColumn("i", F.row_number().over(ordered(["cell_id"], "cycle", "seq")) - 1)
    return ph.constant_current_slice(rows, ["cell_id"], "i").groupBy("cell_id").agg(F.count("*").alias("n"), F.max("i").cast("bigint").alias("last_i"))


@query("ph10_rest_by_index", with_(TELEMETRY) + """, b AS (SELECT *, max(CASE WHEN current_a > 0 THEN seq END) OVER k AS l, min(CASE WHEN current_a < 0 THEN seq END) OVER k AS f FROM telemetry WINDOW k AS (PARTITION BY cell_id, cycle))
SELECT cell_id, cycle, max(CASE WHEN seq > l AND seq < f THEN time_s END) - min(CASE WHEN seq > l AND seq < f THEN time_s END) AS rest_time FROM b GROUP BY ALL""")
def ph10(spark, d):
    return ph.rest_by_index(fx.telemetry(spark, d))


@query("ph11_workload_type", with_(TELEMETRY) + """, b AS (SELECT cell_id, cycle, min(CASE WHEN current_a > 0 AND seq >= cycle % 31 THEN time_s END) AS c, min(CASE WHEN current_a < 0 AND seq >= cycle % 31 THEN time_s END) AS d FROM telemetry GROUP BY ALL)
SELECT cell_id, cycle, CAST(CASE WHEN c IS NULL AND d IS NULL THEN -1 WHEN d IS NULL THEN 2 WHEN c IS NULL THEN 3 WHEN c <= d THEN 0 ELSE 1 END AS INT) AS workload_type FROM b""")
def ph11(spark, d):
    return ph.workload_type(fx.telemetry(spark, d).withColumn("current_a", F.when(F.col("seq") >= F.col("cycle") % 31, F.col("current_a")).otherwise(0.0)))


@query("ph12_cycle_rejection", with_(TELEMETRY) + """, b AS (SELECT cell_id, cycle, max(time_s) AS t FROM telemetry GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS new_cycle FROM b WHERE NOT (t > 1743))
SELECT cell_id, cycle, t, new_cycle FROM k WHERE new_cycle <= 10""")
def ph12(spark, d):
    return ph.renumbered(fx.telemetry(spark, d).groupBy(*KEYS).agg(F.max("time_s").alias("t")), F.col("t") > 1743, limit=10)


FE_SQL = with_(TELEMETRY, PHASED) + """,
s AS (SELECT *, (abs(current_a) + lag(abs(current_a)) OVER w) / 2 * (time_s - lag(time_s) OVER w) AS q,
  (abs(current_a) * voltage_v + lag(abs(current_a) * voltage_v) OVER w) / 2 * (time_s - lag(time_s) OVER w) AS e
  FROM phased WINDOW w AS (PARTITION BY cell_id, cycle, phase ORDER BY seq)),
a AS (SELECT cell_id, cycle,
  sum(q) FILTER (WHERE phase = 'charge') / 3600 AS qc, sum(q) FILTER (WHERE phase = 'discharge') / 3600 AS qd,
  sum(e) FILTER (WHERE phase = 'charge') / 3600 AS ec, sum(e) FILTER (WHERE phase = 'discharge') / 3600 AS ed,
  arg_min(voltage_v, seq) FILTER (WHERE phase = 'charge') AS ichv, arg_min(voltage_v, seq) FILTER (WHERE phase = 'discharge') AS idv,
  min(time_s) FILTER (WHERE phase = 'charge') AS c0, max(time_s) FILTER (WHERE phase = 'charge') AS c1,
  min(time_s) FILTER (WHERE phase = 'discharge') AS d0, max(time_s) FILTER (WHERE phase = 'discharge') AS d1,
  min(time_s) FILTER (WHERE phase = 'charge' AND voltage_v >= CAST(4.1 AS DOUBLE) - CAST(0.01 AS DOUBLE)) AS cv0, min(time_s) FILTER (WHERE phase = 'discharge' AND voltage_v <= 3.2) AS low0,
  arg_max(voltage_v, seq) FILTER (WHERE phase = 'rest') AS v_rest, arg_max(voltage_v, seq) FILTER (WHERE phase = 'charge') AS v_charge,
  arg_min(current_a, seq) FILTER (WHERE phase = 'discharge') AS i_first, arg_min(current_a, seq) FILTER (WHERE phase = 'charge') AS i_charge,
  arg_max(voltage_v, seq) FILTER (WHERE phase = 'discharge') AS v_last,
  var_samp(current_a) FILTER (WHERE phase = 'discharge') AS var_i, var_samp(voltage_v) FILTER (WHERE phase = 'discharge') AS var_v,
  quantile_cont(voltage_v, 0.5) FILTER (WHERE phase = 'discharge') AS median_v, stddev_pop(voltage_v) FILTER (WHERE phase = 'discharge') AS sd_v,
  avg(voltage_v) FILTER (WHERE phase = 'discharge') AS m1, avg(voltage_v * voltage_v) FILTER (WHERE phase = 'discharge') AS m2, avg(voltage_v * voltage_v * voltage_v) FILTER (WHERE phase = 'discharge') AS m3
  FROM s GROUP BY cell_id, cycle)
SELECT cell_id, cycle, round(qc, 6) AS charge_capacity, round(qd, 6) AS discharge_capacity,
  round(CASE WHEN qc > 1e-6 THEN CASE WHEN qd / qc > 1.0001 THEN 1.0 ELSE qd / qc END END, 6) AS coulombic_efficiency,
  round(coalesce(ec, 0), 6) AS charge_energy, round(coalesce(ed, 0), 6) AS discharge_energy, round(coalesce(ed / nullif(ec, 0), 0), 6) AS energy_efficiency,
  round(ichv, 6) AS ichv, coalesce(c1 - c0, 0) AS uvp_time, coalesce(CASE WHEN cv0 IS NULL THEN c1 - c0 ELSE cv0 - c0 END, 0) AS tccc, CASE WHEN cv0 IS NULL THEN CAST(0 AS DOUBLE) ELSE c1 - cv0 END AS tcvc,
  round(coalesce(CASE WHEN c1 - cv0 > 1e-6 THEN (cv0 - c0) / (c1 - cv0) END, 0), 6) AS rcv,
  round(idv, 6) AS idv, coalesce(coalesce(low0, d1) - d0, 0) AS lvp_time, coalesce(d1 - d0, 0) AS total_discharge_time,
  round(var_i, 6) AS var_i, round(var_v, 6) AS var_v, round(median_v, 6) AS median_v,
  round(coalesce(CASE WHEN abs(i_first) > 1e-6 THEN (coalesce(v_rest, v_charge) - idv) / abs(i_first) END, 0), 6) AS internal_resistance,
  round(coalesce(CASE WHEN i_charge > 0.001 THEN (ichv - v_last) / i_charge END, 0), 6) AS alternative_resistance,
  round(CASE WHEN sd_v > 1e-6 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (sd_v * sd_v * sd_v) ELSE 0 END, 6) AS skew_v
FROM a"""


@query("fe_cycle_features", FE_SQL)
def fe_all(spark, d):
    """FE1 to FE11 in one pass."""
    return rounded(fe.cycle_features(ph.split_phases(fx.telemetry(spark, d))))


def slope_sql(phase: str) -> str:
    at = lambda a: f"first(struct_pack(t := time_s - b, v := voltage_v) ORDER BY seq) FILTER (WHERE time_s - b >= CAST({a} AS DOUBLE) * (e - b))"
    return with_(TELEMETRY, PHASED) + f""", r AS (SELECT *, min(time_s) OVER k AS b, max(time_s) OVER k AS e FROM phased WHERE phase = '{phase}' WINDOW k AS (PARTITION BY cell_id, cycle)),
a AS (SELECT cell_id, cycle, {at(0.1)} AS p1, {at(0.3)} AS p3, {at(0.5)} AS p5, {at(0.8)} AS p8 FROM r GROUP BY ALL)
SELECT cell_id, cycle, """ + ", ".join(f"round(CASE WHEN p{x}.t - p1.t > 1e-6 THEN (p{x}.v - p1.v) / (p{x}.t - p1.t) ELSE 0 END, 6) AS {phase}_slope_{k}" for k, x in ((1, 3), (2, 5), (3, 8))) + " FROM a"


@query("fe13_charge_slopes", slope_sql("charge"))
def fe13c(spark, d):
    return rounded(fe.slopes(ph.split_phases(fx.telemetry(spark, d)), "charge"))


@query("fe13_discharge_slopes", slope_sql("discharge"))
def fe13d(spark, d):
    return rounded(fe.slopes(ph.split_phases(fx.telemetry(spark, d)), "discharge"))


@query("fe14_equal_voltage_charge", with_(TELEMETRY) + """SELECT cell_id, cycle, """ + ", ".join(f"greatest(coalesce(min(CASE WHEN voltage_v >= {b} THEN time_s END) - min(CASE WHEN voltage_v >= {a} THEN time_s END), 0), 0) AS charge_time_{k}" for k, (a, b) in enumerate([(3.5, 3.7), (3.7, 3.9), (3.9, 4.1)], 1)) + " FROM telemetry WHERE current_a > 0 GROUP BY ALL")
def fe14c(spark, d):
    return fe.equal_voltage_times(ph.split_phases(fx.telemetry(spark, d)), "charge", [(3.5, 3.7), (3.7, 3.9), (3.9, 4.1)])


@query("fe14_equal_voltage_discharge", with_(TELEMETRY) + """SELECT cell_id, cycle, """ + ", ".join(f"greatest(coalesce(min(CASE WHEN voltage_v <= {b} THEN time_s END) - min(CASE WHEN voltage_v <= {a} THEN time_s END), 0), 0) AS discharge_time_{k}" for k, (a, b) in enumerate([(4.1, 3.9), (3.9, 3.7), (3.7, 3.5)], 1)) + " FROM telemetry WHERE current_a < 0 GROUP BY ALL")
def fe14d(spark, d):
    return fe.equal_voltage_times(ph.split_phases(fx.telemetry(spark, d)), "discharge", [(4.1, 3.9), (3.9, 3.7), (3.7, 3.5)])


@query("fe15_thermal", with_(TELEMETRY) + """, g AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN lead(temperature_c) OVER w - temperature_c WHEN lead(seq) OVER w IS NULL THEN temperature_c - lag(temperature_c) OVER w ELSE (lead(temperature_c) OVER w - lag(temperature_c) OVER w) / 2 END AS dy,
  CASE WHEN lag(seq) OVER w IS NULL THEN lead(time_s) OVER w - time_s WHEN lead(seq) OVER w IS NULL THEN time_s - lag(time_s) OVER w ELSE (lead(time_s) OVER w - lag(time_s) OVER w) / 2 END AS dt,
  (temperature_c + lag(temperature_c) OVER w) / 2 * (time_s - lag(time_s) OVER w) AS strip FROM telemetry WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq))
SELECT cell_id, cycle, """ + ", ".join(f"round(CASE WHEN count(*) >= {n} THEN {x} ELSE 0 END, 6) AS {c}" for n, x, c in ((5, "max(temperature_c)", "max_temperature"), (5, "avg(temperature_c)", "mean_temperature"), (5, "min(temperature_c)", "min_temperature"), (5, "max(temperature_c) - arg_min(temperature_c, seq)", "temperature_rise"), (6, "max(dy / dt)", "max_heat_rate"), (6, "avg(dy / dt)", "mean_heat_rate"), (5, "sum(strip)", "thermal_load"))) + " FROM g GROUP BY ALL")
def fe15(spark, d):
    return rounded(fe.thermal(fx.telemetry(spark, d)))


@query("fe15_smoothed_thermal")
def fe15_smoothed(spark, d):
    """On Savitzky-Golay temperatures: no SQL; a test compares it with numpy."""
    return rounded(fe.thermal(fe.smoothed_temperature(fx.telemetry(spark, d), 29)))


@query("fe15_uneven_thermal", with_(TELEMETRY) + """, d AS (SELECT *, time_s - lag(time_s) OVER w AS a, lead(time_s) OVER w - time_s AS b, lag(temperature_c) OVER w AS p, lead(temperature_c) OVER w AS q FROM telemetry WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq)),
g AS (SELECT *, CASE WHEN a IS NULL THEN (q - temperature_c) / b WHEN b IS NULL THEN (temperature_c - p) / a ELSE (a * a * q + (b * b - a * a) * temperature_c - b * b * p) / (a * b * (a + b)) END AS rate FROM d)
SELECT cell_id, cycle, round(CASE WHEN count(*) >= 6 THEN max(rate) ELSE 0 END, 6) AS max_heat_rate, round(CASE WHEN count(*) >= 6 THEN avg(rate) ELSE 0 END, 6) AS mean_heat_rate FROM g GROUP BY ALL""")
def fe15_uneven(spark, d):
    return rounded(fe.thermal(fx.telemetry(spark, d), uneven=True).select(*KEYS, "max_heat_rate", "mean_heat_rate"))


def _stage_sql(phase: str, most: int) -> str:
    """The SQL of ph4 with the voltage's step into each stage, for either phase, as a table st; then the stages' columns."""
    named = S["ph4_charge_stages"].replace("count(*) AS n_rows", "arg_min(coalesce(du, 0), seq) AS jump_v, count(*) AS n_rows", 1)
    named = named.replace("SELECT cell_id, cycle, n_rows, duration_s, current_a, row_number()", ", st AS (SELECT *, row_number()")
    if phase == "discharge":
        named = named.replace("FROM telemetry WHERE current_a > 0", "FROM telemetry WHERE current_a < 0")
    columns = (f"coalesce(max(CASE WHEN stage = {k} THEN {c} END), 0) AS {phase}_{n}_{k}" for c, n in (("current_a", "current"), ("duration_s", "time")) for k in range(1, most + 1))
    return named + ") SELECT cell_id, cycle, " + ", ".join(columns)


@query("fe16_stage_features", _stage_sql("charge", 3) + """, round(coalesce(max(CASE WHEN stage = 2 THEN jump_v END), 0), 6) AS resistance_jump_dv,
  round(coalesce(coalesce(max(CASE WHEN stage = 1 THEN duration_s END), 0) / nullif(coalesce(max(CASE WHEN stage = 2 THEN duration_s END), 0), 0), 0), 6) AS charge_time_ratio_1_2 FROM st GROUP BY ALL""")
def fe16(spark, d):
    return rounded(fe.stage_features(_stages(spark, d)))


@query("fe16_discharge_stages", _stage_sql("discharge", 4) + " FROM st GROUP BY ALL")
def fe16_discharge(spark, d):
    return rounded(fe.stage_features(_stages(spark, d, "current_a < 0"), most=4, phase="discharge"))


@query("fe16_stage_times")
def fe16_times(spark, d):
    """Times from the stages of PH5, which has no SQL; a test compares them with a loop."""
    charge = fx.telemetry(spark, d).filter("current_a > 0")
    return rounded(fe.stage_times(charge, ph.histogram_stages(charge, tolerance=0.1, voltage="voltage_v")))


@query("fe17_inferred_rates", with_(TELEMETRY) + """, c AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS k, count(*) OVER (PARTITION BY cell_id, cycle) AS n FROM telemetry WHERE current_a > 0),
h AS (SELECT cell_id, cycle, ROUND(quantile_cont(current_a, 0.5) / 1.1, 2) AS charge_rate FROM c WHERE k <= n // 2 GROUP BY ALL),
x AS (SELECT cell_id, cycle, ROUND(quantile_cont(abs(current_a), 0.5) / 1.1, 2) AS discharge_rate FROM telemetry WHERE current_a < 0 GROUP BY ALL)
SELECT h.cell_id, h.cycle, charge_rate, discharge_rate FROM h LEFT JOIN x ON h.cell_id = x.cell_id AND h.cycle = x.cycle""")
def fe17(spark, d):
    return fe.inferred_rates(fx.telemetry(spark, d), 1.1)


@query("fe12_current_tau")
def fe12(spark, d):
    """A non-linear fit: no SQL; tests compare it with curves of known tau."""
    return rounded(fe.current_tau(fx.telemetry(spark, d).filter("current_a > 0"), uvp=4.1, tolerance=0.4))


NAMED = """cells AS (SELECT s_suppkey AS cell_id, CASE s_suppkey % 4 WHEN 0 THEN 'ISU-ILCC_G' || s_suppkey % 70 || 'C' || s_suppkey WHEN 1 THEN 'MICH_EXP_' || lpad(CAST(s_suppkey % 19 AS VARCHAR), 2, '0') || 'R_NMC_' || CASE WHEN s_suppkey % 3 = 0 THEN '-5' ELSE CAST(25 + s_suppkey % 3 AS VARCHAR) END || 'C_' || CASE WHEN s_suppkey % 8 = 1 THEN '50-100' ELSE '0-100' END
  WHEN 2 THEN 'SNL_18650_' || CASE s_suppkey % 3 WHEN 0 THEN 'NCA' WHEN 1 THEN 'LFP' ELSE 'NMC' END || '_25C_' || CASE WHEN s_suppkey % 8 = 2 THEN '20-80' ELSE '0-100' END || '_0.5-' || s_suppkey % 5 || 'C_a' ELSE 'CALB_' || (s_suppkey % 5 * 10 - 10) || '_B' || s_suppkey END AS name FROM supplier)"""


def named_cells(spark, d):
    """Suppliers as cells of four data sets, told by their names."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    isu = F.concat(F.lit("ISU-ILCC_G"), text(k % 70), F.lit("C"), text(k))
    mich = F.concat(F.lit("MICH_EXP_"), F.lpad(text(k % 19), 2, "0"), F.lit("R_NMC_"), F.when(k % 3 == 0, "-5").otherwise(text(25 + k % 3)), F.lit("C_"), F.when(k % 8 == 1, "50-100").otherwise("0-100"))
    snl = F.concat(F.lit("SNL_18650_"), F.when(k % 3 == 0, "NCA").when(k % 3 == 1, "LFP").otherwise("NMC"), F.lit("_25C_"), F.when(k % 8 == 2, "20-80").otherwise("0-100"), F.lit("_0.5-"), text(k % 5), F.lit("C_a"))
    calb = F.concat(F.lit("CALB_"), text(k % 5 * 10 - 10), F.lit("_B"), text(k))
    return fx.table(spark, d, "supplier").select(k.alias("cell_id"), F.when(k % 4 == 0, isu).when(k % 4 == 1, mich).when(k % 4 == 2, snl).otherwise(calb).alias("name"))


RATES = "rates(g, charge_rate, discharge_rate) AS (VALUES " + ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in nm.GROUP_RATES.items()) + ")"


@query("fe17_group_rates", with_(NAMED, RATES) + "SELECT cell_id, charge_rate, discharge_rate FROM cells LEFT JOIN rates ON regexp_extract(name, 'ISU-ILCC_G([0-9]+)', 1) = CAST(g AS VARCHAR)")
def fe17_groups(spark, d):
    return nm.group_rates(named_cells(spark, d)).drop("name")


@query("fe17_protocol_rates", "SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE s_suppkey % 7 / CAST(4 AS DOUBLE) END AS charge_rate, CASE WHEN s_suppkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS discharge_rate FROM supplier")
def fe17_protocols(spark, d):
    """The first of a protocol's entries; some have none, some no rate."""
    k = F.col("s_suppkey")
    entry = lambda rate: F.struct(rate.alias("rate_in_c"), F.lit(0.0).alias("start_soc"))
    none = F.array().cast("array<struct<rate_in_c:double,start_soc:double>>")
    charge = F.when(k % 3 == 0, none).otherwise(F.array(entry(k % 7 / 4), entry(F.lit(9.0))))
    discharge = F.array(entry(F.when(k % 5 != 0, 1.5)))
    return nm.protocol_rates(fx.table(spark, d, "supplier").select(k.alias("cell_id"), charge.alias("charge_protocol"), discharge.alias("discharge_protocol"))).select("cell_id", "charge_rate", "discharge_rate")


@query("ing22_protocol_of_names", with_(NAMED) + """SELECT cell_id, CAST(0.5 AS DOUBLE) AS charge_rate, CAST(cell_id % 5 AS DOUBLE) AS discharge_rate, CASE WHEN cell_id % 8 = 2 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS soc_from, CASE WHEN cell_id % 8 = 2 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS soc_to,
  CASE WHEN contains(name, 'NCA') THEN CAST(2.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS min_v, CASE WHEN contains(name, 'LFP') THEN CAST(3.6 AS DOUBLE) ELSE CAST(4.2 AS DOUBLE) END AS max_v, CASE WHEN contains(name, 'LFP') THEN CAST(30 AS DOUBLE) WHEN contains(name, 'NCA') THEN CAST(6 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END AS max_a
FROM cells WHERE starts_with(name, 'SNL')""")
def ing22_names(spark, d):
    snl = named_cells(spark, d).filter(F.col("name").startswith("SNL"))
    return snl.select("cell_id", nm.protocol_of_name(F.col("name")).alias("p")).select("cell_id", "p.*")


@query("fe18_metadata_of_names", with_(NAMED) + """SELECT cell_id, name, TRY_CAST(split_part(name, '_', 2) AS DOUBLE) AS ambient_temperature, coalesce(TRY_CAST(nullif(regexp_extract(name, 'NMC_([0-9]+)C', 1), '') AS INT), 0) AS temperature,
  CASE WHEN regexp_matches(name, '13R|14C|15H|16R|17C|18H') THEN 50 WHEN contains(name, '0-100') THEN 100 WHEN contains(name, '50-100') THEN 50 ELSE 100 END AS soc, CASE WHEN regexp_matches(name, '01|02|03') THEN 2 ELSE 1 END AS peak_mode FROM cells""")
def fe18_names(spark, d):
    name = F.col("name")
    return named_cells(spark, d).select("cell_id", "name", nm.ambient_temperature(name).alias("ambient_temperature"), nm.expansion_metadata(name).alias("m")).select("cell_id", "name", "ambient_temperature", "m.*")


@query("fe18_metadata", """SELECT s_suppkey AS cell_id, CAST(regexp_extract('CALB_' || (s_suppkey % 3) * 10 || '_B' || s_suppkey, 'CALB_([0-9]+)_', 1) AS INT) AS ambient_temperature,
  (s_suppkey % 3) * 50 AS soc FROM supplier""")
def fe18(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("CALB_"), ((k % 3) * 10).cast("string"), F.lit("_B"), k.cast("string"))
    other = F.concat(F.lit("MICH_"), ((k % 3) * 50).cast("string"), F.lit("soc_"), k.cast("string"))
    return fx.table(spark, d, "supplier").select(k.alias("cell_id"), F.regexp_extract(name, "CALB_([0-9]+)_", 1).cast("int").alias("ambient_temperature"), F.regexp_extract(other, "_([0-9]+)soc", 1).cast("bigint").alias("soc"))


@query("fe19_peak_ratios", with_(TELEMETRY) + "SELECT DISTINCT cell_id, cycle, CAST(0 AS DOUBLE) AS v_diff_peak3_peak1, CAST(0 AS DOUBLE) AS ratio_peak1_peak3 FROM telemetry")
def fe19(spark, d):
    """Always 0: the third peak is never produced."""
    return fx.telemetry(spark, d).select(*KEYS).distinct().select(*KEYS, F.lit(0.0).alias("v_diff_peak3_peak1"), F.lit(0.0).alias("ratio_peak1_peak3"))
