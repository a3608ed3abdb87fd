"""Queries for the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.columns import ordered
from cellwright.operators import ingest as g
from cellwright.plans.cycles import rounded
from cellwright.plans.sql import QD, TELEMETRY, with_
from cellwright.sources import fixtures as fx

Q: dict = {}
S: dict = {}
KEYS = ["cell_id", "cycle"]
CELL_W = "WINDOW w AS (PARTITION BY cell_id ORDER BY cycle)"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def qd(spark, d):
    return fx.discharge_capacity(fx.telemetry(spark, d))


CAP = """caps AS (SELECT *, coalesce(sum(CASE WHEN current_a < 0 THEN abs(current_a) * (time_s - pt) ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq), 0) / 3600 AS capacity
  FROM (SELECT *, lag(time_s) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS pt FROM telemetry) x)"""


@query("ing1_integrate_charge", with_(TELEMETRY, CAP) + "SELECT cell_id, cycle, seq, round(capacity, 6) AS capacity FROM caps")
def ing1(spark, d):
    return rounded(g.integrate_charge(fx.telemetry(spark, d), -1).select(*KEYS, "seq", "capacity"))


@query("ing2_integrate_capped", with_(TELEMETRY) + """, s AS (SELECT cell_id, cycle, list(coalesce(CASE WHEN current_a < 0 THEN abs(current_a) * (time_s - pt) / 3600 END, 0) ORDER BY seq) AS l
  FROM (SELECT *, lag(time_s) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS pt FROM telemetry) x GROUP BY ALL)
SELECT cell_id, cycle, round(list_reduce(l, lambda q, x: CASE WHEN x = 0 THEN q WHEN q + x < 0.1 THEN q + x ELSE 0 END), 6) AS capacity FROM s""")
def ing2(spark, d):
    return rounded(g.integrate_capped(fx.telemetry(spark, d), -1, cap=0.1))


@query("ing3_renumber_on_change", """WITH s AS (SELECT user_id, event_id, length(event_type) AS raw FROM events), c AS (SELECT *, CASE WHEN raw <> lag(raw) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(first_value(raw) OVER w + sum(new) OVER w AS BIGINT) AS cycle FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def ing3(spark, d):
    rows = fx.table(spark, d, "events").select("user_id", "event_id", F.length("event_type").alias("raw"))
    return g.renumber_on_change(rows, "raw", ["user_id"], "event_id").select("user_id", "event_id", F.col("cycle").cast("bigint").alias("cycle"))


@query("ing4_dense_cycles", with_(TELEMETRY) + """, k AS (SELECT cell_id, cycle, seq, dense_rank() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS r FROM telemetry WHERE cycle % 5 <> 2)
SELECT cell_id, r AS cycle, count(*) AS n FROM k WHERE r > 0 GROUP BY ALL""")
def ing4(spark, d):
    return g.dense_cycles(fx.telemetry(spark, d).filter("cycle % 5 <> 2"), drop_first=1).groupBy("cell_id", F.col("cycle").cast("bigint").alias("cycle")).agg(F.count("*").alias("n"))


def _long(spark, d):
    return fx.telemetry(spark, d).withColumn("t", (F.col("cycle") - 1) * 30 + F.col("seq"))


@query("ing5_cycle_boundaries")
def ing5(spark, d):
    """Greedy: no SQL; tests compare it with a loop."""
    return g.cycle_boundaries(_long(spark, d), suppress=20)


@query("ing6_time_anomalies")
def ing6(spark, d):
    """Greedy: no SQL; tests compare it with a loop."""
    jumpy = fx.telemetry(spark, d).withColumn("time_s", F.when(F.col("seq") % 7 == 3, F.col("time_s") + 1000).otherwise(F.col("time_s")))
    return g.drop_time_anomalies(jumpy, most=500.0)


@query("ing7_dedupe_times", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) x WHERE k = 1")
def ing7(spark, d):
    return g.dedupe_times(fx.table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("ing8_isolated_abnormal", with_(TELEMETRY, QD) + """, m AS (SELECT *, quantile_cont(qd, 0.5) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
  quantile_cont(qd, 0.5) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY cell_id) AS n FROM qd)
SELECT cell_id, cycle, round(qd, 6) AS qd FROM m WHERE NOT coalesce(abs(qd - b) > 0.01 AND abs(qd - a) > 0.01 AND i >= 5 AND i < n - 5, false)""")
def ing8(spark, d):
    return rounded(g.isolated_abnormal(qd(spark, d), tolerance=0.01))


@query("ing9_median_filter", with_(TELEMETRY, QD) + """, a AS (SELECT *, list(qd) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM qd),
m AS (SELECT *, abs(qd - list_sort(list_concat(l, list_resize([CAST(0 AS DOUBLE)], 5 - len(l), CAST(0 AS DOUBLE))))[3]) AS dev FROM a),
k AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY cell_id) AS mad FROM m) SELECT cell_id, cycle, round(qd, 6) AS qd FROM k WHERE dev < 3 * mad AND qd > 0.1""")
def ing9(spark, d):
    return rounded(g.median_filter_outliers(qd(spark, d), width=5))


DIST = "least(abs(qd - lag(qd, {s}) OVER w), abs(qd - lead(qd, {s}) OVER w)) AS d{s}"


@query("ing10_shift_outliers", with_(TELEMETRY, QD) + f""", s AS (SELECT *, {DIST.format(s=1)}, {DIST.format(s=2)} FROM qd {CELL_W}),
m AS (SELECT *, quantile_cont(CASE WHEN d1 > 0 THEN d1 END, 0.5) OVER (PARTITION BY cell_id) AS m1, quantile_cont(CASE WHEN d2 > 0 THEN d2 END, 0.5) OVER (PARTITION BY cell_id) AS m2 FROM s)
SELECT cell_id, cycle, coalesce(d1 > 3 * m1, false) OR coalesce(d2 > 3 * m2, false) AS outlier FROM m""")
def ing10(spark, d):
    return g.shift_outliers(qd(spark, d), factor=3.0).select(*KEYS, "outlier")


@query("ing11_hampel", with_(TELEMETRY, QD) + f""", s AS (SELECT *, {DIST.format(s=1)}, {DIST.format(s=2)} FROM qd {CELL_W}),
o AS (SELECT *, abs(d1 - quantile_cont(d1, 0.5) OVER (PARTITION BY cell_id)) AS o1, abs(d2 - quantile_cont(d2, 0.5) OVER (PARTITION BY cell_id)) AS o2 FROM s),
m AS (SELECT *, quantile_cont(o1, 0.5) OVER (PARTITION BY cell_id) AS m1, quantile_cont(o2, 0.5) OVER (PARTITION BY cell_id) AS m2 FROM o)
SELECT cell_id, cycle, coalesce(o1 > 3 * m1, false) OR coalesce(o2 > 3 * m2, false) AS outlier FROM m""")
def ing11(spark, d):
    return g.hampel_outliers(qd(spark, d)).select(*KEYS, "outlier")


@query("ing12_missing_cycles", with_(TELEMETRY) + """, c AS (SELECT DISTINCT cell_id, cycle FROM telemetry WHERE (cell_id + cycle) % 4 <> 0), f AS (SELECT cell_id, unnest(range(1, max(cycle) + 1)) AS cycle FROM c GROUP BY cell_id)
SELECT cell_id, CAST(cycle AS INT) AS cycle FROM f ANTI JOIN c USING (cell_id, cycle)""")
def ing12(spark, d):
    return g.missing_cycles(fx.telemetry(spark, d).filter("(cell_id + cycle) % 4 <> 0").select(*KEYS).distinct())


@query("ing13_as_of_cycles", with_(TELEMETRY) + """, c AS (SELECT DISTINCT cell_id, cycle, (cell_id + cycle) % 3 = 0 AS valid FROM telemetry),
a AS (SELECT cell_id, cycle, coalesce(last_value(CASE WHEN valid THEN cycle END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(CASE WHEN valid THEN cycle END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS source FROM c)
SELECT a.cell_id, a.cycle, count(*) AS n, round(sum(t.current_a), 6) AS current_sum FROM a JOIN telemetry t ON t.cell_id = a.cell_id AND t.cycle = a.source GROUP BY ALL""")
def ing13(spark, d):
    tel = fx.telemetry(spark, d)
    bad = tel.select(*KEYS).distinct().filter("(cell_id + cycle) % 3 <> 0")
    return rounded(g.impute_cycles(tel, bad).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("current_a").alias("current_sum")))


@query("ing14_drop_singletons", with_(TELEMETRY) + "SELECT cell_id, cycle, count(*) AS n FROM telemetry WHERE seq = 0 OR cycle % 2 = 1 GROUP BY ALL HAVING count(*) > 1")
def ing14(spark, d):
    return g.drop_singletons(fx.telemetry(spark, d).filter("seq = 0 or cycle % 2 = 1")).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("ing15_within_capacity", with_(TELEMETRY, QD) + "SELECT t.cell_id, t.cycle, count(*) AS n FROM telemetry t SEMI JOIN (SELECT * FROM qd WHERE qd BETWEEN 0.17 AND 0.19) q ON t.cell_id = q.cell_id AND t.cycle = q.cycle GROUP BY ALL")
def ing15(spark, d):
    tel = fx.telemetry(spark, d)
    return g.within_capacity(tel, fx.discharge_capacity(tel), 0.17, 0.19).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("ing16_exclude_by_tests")
def ing16(spark, d):
    """Greedy: no SQL; tests compare it with a loop."""
    cycles = fx.telemetry(spark, d).groupBy(*KEYS).agg((F.min("time_s") + F.first("cycle") * 2000).alias("start_s"))
    tests = cycles.filter("cycle % 4 = 1").select("cell_id", (F.col("start_s") - 100.0).alias("test_s"))
    return g.exclude_by_tests(cycles, tests)


@query("ing17_by_first_current", with_(TELEMETRY) + ", f AS (SELECT cell_id, cycle FROM telemetry GROUP BY ALL HAVING arg_min(current_a, seq) > 0.6 AND arg_min(current_a, seq) < 0.8) SELECT cell_id, cycle, count(*) AS n FROM telemetry SEMI JOIN f USING (cell_id, cycle) GROUP BY ALL")
def ing17(spark, d):
    return g.by_first_current(fx.telemetry(spark, d), 0.6, 0.8).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("ing18_zero_other_phase", with_(TELEMETRY) + """SELECT cell_id, cycle, seq, CASE WHEN current_a >= 0 THEN CAST(0 AS DOUBLE) ELSE voltage_v END AS qd, CASE WHEN current_a < 0 THEN CAST(0 AS DOUBLE) ELSE voltage_v END AS qc
FROM telemetry WHERE NOT (current_a > -0.001 AND current_a < 0)""")
def ing18(spark, d):
    return g.zero_other_phase(fx.telemetry(spark, d).withColumn("qd", F.col("voltage_v")).withColumn("qc", F.col("voltage_v"))).select(*KEYS, "seq", "qd", "qc")


@query("ing19_merge_continued", with_(TELEMETRY) + """SELECT CASE WHEN cell_id % 10 = 4 THEN cell_id - 1 ELSE cell_id END AS cell_id, count(DISTINCT CASE WHEN cell_id % 10 = 4 THEN cycle + 18 ELSE cycle END) AS n_cycles, CAST(max(CASE WHEN cell_id % 10 = 4 THEN cycle + 18 ELSE cycle END) AS BIGINT) AS last_cycle
FROM telemetry WHERE cell_id % 10 <> 7 GROUP BY 1""")
def ing19(spark, d):
    tel, ids = fx.telemetry(spark, d), fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    mapping = ids.filter("cell_id % 10 = 4").select(F.col("cell_id").alias("from_cell"), (F.col("cell_id") - 1).alias("to_cell"), F.lit(18).alias("offset"))
    return g.merge_continued(tel, mapping, ids.filter("cell_id % 10 = 7")).groupBy("cell_id").agg(F.countDistinct("cycle").alias("n_cycles"), F.max("cycle").cast("bigint").alias("last_cycle"))


@query("ing19_skipped_cycles", with_(TELEMETRY) + """SELECT cell_id, CASE WHEN cell_id % 4 = 1 AND cycle > 3 THEN cycle - 1 ELSE cycle END AS cycle, seq, round(time_s * 60, 6) AS time_s FROM telemetry WHERE NOT (cell_id % 4 = 1 AND cycle = 3)""")
def ing19_skips(spark, d):
    skips = fx.table(spark, d, "supplier").filter("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("cell_id"), F.lit(3).alias("skip"))
    return rounded(g.skipped_cycles(fx.telemetry(spark, d).select(*KEYS, "seq", "time_s"), skips))


@query("ing20_without_partial_end", with_(TELEMETRY) + """, m AS (SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN 7 ELSE max(cycle) - 1 END AS most FROM telemetry GROUP BY cell_id) SELECT t.cell_id, cycle, seq FROM telemetry t JOIN m ON t.cell_id = m.cell_id WHERE cycle <= most""")
def ing20_partial(spark, d):
    whole = fx.table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cell_id"), F.lit(7).alias("n_whole"))
    return g.without_partial_end(fx.telemetry(spark, d).select(*KEYS, "seq"), whole)


@query("ing20_text_units", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey * 7) % 60 AS DOUBLE) END AS seconds FROM orders""")
def ing20(spark, d):
    k = F.col("o_orderkey")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.when(k % 5 == 0, "-").otherwise(F.concat_ws(":", pad(k % 24), pad(k % 60), pad(k * 7 % 60)))
    return fx.table(spark, d, "orders").select("o_orderkey", g.seconds(clock).alias("seconds"))


@query("ing21_elapsed_time", """WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS DOUBLE) * 1e12 ELSE CAST(event_id AS DOUBLE) END AS t FROM events), v AS (SELECT *, CASE WHEN t > 1e11 THEN t / 1e9 ELSE t END AS s FROM e)
SELECT user_id, event_id, round(s - first_value(s) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS elapsed_s FROM v""")
def ing21(spark, d):
    rows = fx.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("user_id") % 2 == 0, F.col("event_id").cast("double") * 1e12).otherwise(F.col("event_id").cast("double")).alias("t"))
    return rounded(g.elapsed(rows, ["user_id"], "t", "event_id").select("user_id", "event_id", "elapsed_s"))


@query("ing22_charge_policy", """SELECT s_suppkey AS cell_id, CAST(s_suppkey % 7 AS DOUBLE) + 0.5 AS rate_1, CAST(s_suppkey % 80 AS DOUBLE) AS percent, CAST(s_suppkey % 4 AS DOUBLE) AS rate_2 FROM supplier""")
def ing22(spark, d):
    k = F.col("s_suppkey")
    text = F.concat((k % 7).cast("string"), F.lit(".5C("), (k % 80).cast("string"), F.lit("%)-"), (k % 4).cast("string"), F.lit("C"))
    return fx.table(spark, d, "supplier").select(k.alias("cell_id"), g.charge_policy(text).alias("p")).select("cell_id", "p.*")


@query("ing23_soc_window", with_(TELEMETRY) + """, a AS (SELECT cell_id, max(temperature_c) / 100 AS c, max(voltage_v) / 10 AS d FROM telemetry WHERE cycle = 1 GROUP BY ALL)
SELECT cell_id, round(1 - least(1.0, c / 0.25), 6) AS soc_start, round(CASE WHEN 1 - d / 0.25 > 1 THEN 1 ELSE 1 - d / 0.25 END, 6) AS soc_end FROM a""")
def ing23(spark, d):
    first = fx.telemetry(spark, d).filter("cycle = 1").select("cell_id", (F.col("temperature_c") / 100).alias("qc"), (F.col("voltage_v") / 10).alias("qd"))
    return rounded(g.soc_window(first, 0.25, ["cell_id"]))


@query("ing24_repair_negative", with_(TELEMETRY) + """, b AS (SELECT *, CASE WHEN current_a < 0 AND seq % 3 = 0 THEN NULL ELSE current_a END AS i, CASE WHEN current_a < 0 AND seq % 3 = 0 THEN NULL ELSE voltage_v END AS v FROM telemetry)
SELECT cell_id, cycle, seq, first_value(i IGNORE NULLS) OVER w AS i, first_value(v IGNORE NULLS) OVER w AS v FROM b WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def ing24(spark, d):
    rows = fx.telemetry(spark, d).select(*KEYS, "seq", F.col("current_a").alias("i"), F.col("voltage_v").alias("v"), F.when((F.col("seq") % 3 == 0), F.col("current_a")).alias("chk"))
    return g.repair_negative(rows, ["chk"], ["i", "v"], KEYS, "seq").select(*KEYS, "seq", "i", "v")
