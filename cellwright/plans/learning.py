"""Queries for selection, scaling, samples, and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellwright.functions.columns import ordered, running
from cellwright.operators import ranks
from cellwright.operators import samples as sm
from cellwright.operators import selection as fs
from cellwright.plans.cycles import rounded
from cellwright.plans.sql import CELLS, FEATURES, LABELS, PREDICTIONS, QD, SPLITS, TELEMETRY, with_
from cellwright.sources import fixtures as fx

Q: dict = {}
S: dict = {}
COLUMNS = ["quantity", "price", "discount", "tax", "twice", "constant"]
WIDE = """wide AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount,
  CAST(l_tax AS DOUBLE) AS tax, CAST(l_extendedprice AS DOUBLE) * 2 + 1 AS twice, CAST(1 AS DOUBLE) AS constant, CAST(o_totalprice AS DOUBLE) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def wide(spark, d):
    item, order = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    c = lambda name: F.col(name).cast("double")
    return item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"), c("l_tax").alias("tax"), (c("l_extendedprice") * 2 + 1).alias("twice"), F.lit(1.0).alias("constant"), c("o_totalprice").alias("target")
    )


#: Names of features with the family and the level that they must get.
NAMES = [
    ("Discharge_Capacity", "Energy", 4), ("Charge_Capacity", "Energy", 4), ("Discharge_Energy", "Energy", 4), ("Charge_Energy", "Energy", 4), ("Coulombic_Efficiency", "Energy", 1), ("Energy_Efficiency", "Energy", 5),
    ("Internal_Resistance(ohm)", "Kinetics", 1), ("CV_Current_Tau", "Kinetics", 1), ("TCCC", "Kinetics", 5), ("RCV(V)", "Kinetics", 1), ("Charge_C_Rate", "Kinetics", 5), ("Rest_Time", "Kinetics", 5), ("UVP_Time", "Kinetics", 2), ("V_rest_end", "Kinetics", 2), ("charge_time_1", "Kinetics", 5),
    ("DTP", "Thermodynamics", 2), ("DTPL_V", "Thermodynamics", 2), ("MAT_Charge", "Thermodynamics", 5), ("T_rise_Discharge", "Thermodynamics", 2), ("T_rise_Charge", "Thermodynamics", 5), ("skew_T_discharge", "Thermodynamics", 3), ("HeatRate", "Thermodynamics", 2), ("Ambient_Temperature", "Thermodynamics", 1),
    ("ICP", "Curve", 1), ("ICPL_V", "Curve", 1), ("ICP_Area", "Curve", 2), ("ICP_FWHM", "Curve", 2), ("DVP_Q", "Curve", 1), ("DVV", "Curve", 1), ("Centroid_Voltage", "Curve", 2), ("ratio_peak1_peak3", "Curve", 5),
    ("skew_V_discharge", "Geometric", 3), ("var_I_charge", "Geometric", 3), ("max_I_charge", "Geometric", 5), ("charge_slope_1", "Geometric", 2), ("TEVI_1", "Geometric", 2), ("median_V_discharge", "Geometric", 3), ("charge_current_1", "Geometric", 5),
    ("workload_type", "Metadata", 5), ("ICP_is_missing", "Metadata", 1), ("DVP_type", "Metadata", 1), ("ICHV", "Metadata", 2), ("IDV", "Metadata", 2), ("soc", "Metadata", 5), ("UVP", "Metadata", 5),
    (" Mean Heat-Rate ", "Thermodynamics", 5), ("Peak Area", "Curve", 5), ("Total / Time", "Kinetics", 5), ("Loop Resistance", "Kinetics", 5), ("Stored Energy", "Energy", 5), ("Area Energy/temp", "Thermodynamics", 5), ("kurtosis_V", "Geometric", 3), ("mean_I", "Geometric", 5), ("Voltage Noise", "Geometric", 5), ("Static Voltage", "Curve", 5), ("dv_dt(V/s)", "Curve", 5), ("Cycle Number", None, 5),
]
NAMED = "names(k, feature, family, level) AS (VALUES " + ", ".join(f"({k}, '{n}', {repr(f) if f else 'NULL'}, {p})" for k, (n, f, p) in enumerate(NAMES)) + f"), named AS (SELECT p_partkey, names.* FROM part JOIN names ON p_partkey % {len(NAMES)} = k)"


def named_parts(spark, d):
    """Every part with a feature's name."""
    names = F.broadcast(spark.createDataFrame([(k, n) for k, (n, _, _) in enumerate(NAMES)], "k int, feature string"))
    return fx.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(NAMES)).cast("int").alias("k")).join(names, "k").select("p_partkey", "feature")


@query("fs1_families", with_(NAMED) + "SELECT p_partkey, feature, family FROM named WHERE family IS NOT NULL")
def fs1(spark, d):
    return fs.families(named_parts(spark, d)).select("p_partkey", "feature", "family")


@query("fs2_priorities", with_(NAMED) + "SELECT p_partkey, feature, level FROM named")
def fs2(spark, d):
    return fs.priorities(named_parts(spark, d)).select("p_partkey", "feature", "level")


def corr_sql(table: str, pairs) -> str:
    return "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS r FROM {table}" for a, b in pairs)


PAIRS = fs.all_pairs(COLUMNS)
TARGETS = [(c, "target") for c in COLUMNS]


@query("fs3_pearson_matrix", with_(WIDE) + corr_sql("wide", PAIRS))
def fs3(spark, d):
    return rounded(fs.pearson_pairs(wide(spark, d), PAIRS))


RANKED = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in ("quantity", "price", "discount", "target")) + " FROM wide)"
RANK_PAIRS = fs.all_pairs(["quantity", "price", "discount", "target"])


@query("fs4_spearman_matrix", with_(WIDE, RANKED) + corr_sql("ranked", RANK_PAIRS))
def fs4(spark, d):
    return rounded(fs.spearman_pairs(wide(spark, d), RANK_PAIRS))


@query("fs5_kendall", with_(WIDE) + """, p AS (SELECT discount AS x, tax AS y, count(*) AS n FROM wide GROUP BY ALL), s AS (SELECT sum(sign(b.y - a.y) * a.n * b.n) AS s FROM p a JOIN p b ON a.x < b.x),
x AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY x)), y AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY y)), a AS (SELECT sum(n) * (sum(n) - 1) / 2 AS t FROM p)
SELECT 'discount' AS a, 'tax' AS b, round(s.s / nullif(sqrt((a.t - x.t) * (a.t - y.t)), 0), 6) AS tau FROM s, x, y, a""")
def fs5(spark, d):
    return rounded(ranks.kendall(wide(spark, d), "discount", "tax"))


@query("fs5_kendall_distinct", """WITH p AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
s AS (SELECT sum(sign(b.y - a.y)) AS s FROM p a JOIN p b ON a.x < b.x),
x AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM p GROUP BY x)), y AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM p GROUP BY y)), a AS (SELECT count(*) * (count(*) - 1) / 2 AS t FROM p)
SELECT 'x' AS a, 'y' AS b, round(s.s / nullif(sqrt((a.t - x.t) * (a.t - y.t)), 0), 6) AS tau FROM s, x, y, a""")
def fs5_distinct(spark, d):
    """Columns of nearly distinct values, in ranges of 4000 rows."""
    orders = fx.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return rounded(ranks.kendall(orders, "x", "y", strip=4000))


def _ranked(spark, d):
    r = fs.pearson_pairs(wide(spark, d), TARGETS).select(F.col("a").alias("feature"), F.col("r").alias("target_r"))
    info = spark.createDataFrame([(c, k, 1 if c in ("price", "discount") else 2) for k, c in enumerate(COLUMNS)], "feature string, position int, level int")
    return info.join(r, "feature")


@query("fs6_collinearity_drop", with_(WIDE, "pairs AS (" + corr_sql("wide", PAIRS) + ")", "tr AS (" + corr_sql("wide", TARGETS) + ")", "info(feature, position, level) AS (VALUES " + ", ".join(f"('{c}', {k}, {1 if c in ('price', 'discount') else 2})" for k, c in enumerate(COLUMNS)) + ")") + """,
o AS (SELECT p.a, p.b, p.r, CASE WHEN ia.level <> ib.level THEN ia.level > ib.level ELSE abs(coalesce(tb.r, 0)) > abs(coalesce(ta.r, 0)) END AS a_loses, ia.position AS pa, ib.position AS pb
  FROM pairs p JOIN info ia ON p.a = ia.feature JOIN info ib ON p.b = ib.feature JOIN tr ta ON ta.a = p.a JOIN tr tb ON tb.a = p.b WHERE abs(p.r) > 0.5),
k AS (SELECT CASE WHEN a_loses THEN a ELSE b END AS dropped, CASE WHEN a_loses THEN b ELSE a END AS kept, r, row_number() OVER (PARTITION BY CASE WHEN a_loses THEN a ELSE b END ORDER BY pa, pb) AS k FROM o)
SELECT dropped, kept, r FROM k WHERE k = 1""")
def fs6(spark, d):
    return rounded(fs.collinear_losers(fs.pearson_pairs(wide(spark, d), PAIRS), _ranked(spark, d), 0.5))


@query("fs9_two_stage_filter")
def fs9(spark, d):
    """FS6 within families and then over all survivors (rows only: FS6 has its SQL)."""
    ranked = _ranked(spark, d).withColumn("family", F.when(F.col("feature").isin("price", "twice"), "money").otherwise("other"))
    return rounded(fs.two_stage_losers(fs.pearson_pairs(wide(spark, d), PAIRS), ranked, 0.98, 0.5))


RELEVANCE = [(c, "price") for c in ("quantity", "discount", "tax", "twice", "constant", "target")]


@query("fs7_target_relevance", with_(WIDE, "tr AS (" + corr_sql("wide", RELEVANCE) + ")") + "SELECT a AS feature, r FROM tr WHERE abs(r) >= 0.1")
def fs7(spark, d):
    return rounded(fs.target_relevance(fs.pearson_pairs(wide(spark, d), RELEVANCE), 0.1))


@query("fs8_binned_information", with_(WIDE) + """, e AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS fx, quantile_cont(target, [0.2, 0.4, 0.6, 0.8]) AS ty FROM wide),
b AS (SELECT len(list_filter(fx, lambda v: v < price)) AS x, len(list_filter(ty, lambda v: v < target)) AS y, count(*) AS c FROM wide, e GROUP BY ALL), p AS (SELECT *, sum(c) OVER (PARTITION BY x) AS px, sum(c) OVER (PARTITION BY y) AS py, sum(c) OVER () AS n FROM b)
SELECT 'price' AS feature, round(sum(c / n * ln(c * n / (px * py))), 6) AS mi FROM p""")
def fs8(spark, d):
    return rounded(fs.binned_information(wide(spark, d), "price", "target", bins=5))


def _information_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, round(sum(c / n * ln(c * n / (px * py))), 6) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY x) AS px, sum(c) OVER (PARTITION BY y) AS py, sum(c) OVER () AS n
  FROM (SELECT len(list_filter(fx, lambda v: v < {feature})) AS x, len(list_filter(ty, lambda v: v < target)) AS y, count(*) AS c
    FROM wide, (SELECT quantile_cont({feature}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS fx, quantile_cont(target, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ty FROM wide) e GROUP BY ALL) b) p"""


@query("fs8_information_of_all", with_(WIDE) + "\nUNION ALL ".join(_information_sql(c) for c in ("quantity", "price", "discount", "tax", "twice", "constant")))
def fs8_all(spark, d):
    """All features at once: their quantiles in the same scans."""
    return rounded(fs.binned_information(wide(spark, d), COLUMNS, "target"))


@query("fs12_permutation_importance")
def fs12(spark, d):
    """Hash-dealt permutations: no SQL; tests check it on a model whose importances are known."""
    return rounded(fs.permutation_importance(wide(spark, d), ["quantity", "discount"], F.col("quantity") * 1000 + F.col("discount"), "price", "id", repeats=2))


IMPORTANCE = """imp AS (SELECT seed, feature, importance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, feature) AS place
  FROM (SELECT o_custkey % 5 AS seed, 'f' || o_orderkey % 12 AS feature, round(avg(o_totalprice), 4) AS importance FROM orders GROUP BY ALL)) WHERE place <= 8)"""


def importance(spark, d):
    """The eight most important of twelve features for each of five seeds."""
    o = fx.table(spark, d, "orders")
    means = o.groupBy((F.col("o_custkey") % 5).alias("seed"), F.concat(F.lit("f"), (F.col("o_orderkey") % 12).cast("string")).alias("feature")).agg(F.round(F.avg("o_totalprice") + 1e-9, 4).alias("importance"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("importance"), "feature"))  # of 12 rows
    return means.withColumn("place", place).filter("place <= 8").drop("place")


@query("fs13_selection_shortcut", with_(WIDE) + "SELECT count(DISTINCT quantity) AS n_targets, count(DISTINCT quantity) < 5 AS keep_all FROM wide")
def fs13(spark, d):
    return fs.target_decides(wide(spark, d), "quantity")


@query("fs13_shortcut_importances", with_(WIDE) + """, n AS (SELECT count(DISTINCT price) AS prices, count(DISTINCT constant) AS constants FROM wide)
SELECT f AS feature, CASE WHEN prices < 5 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS importance, 'k' AS why FROM n, (VALUES ('quantity'), ('discount')) v(f)
UNION ALL SELECT f, CASE WHEN constants < 5 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 'targets' FROM n, (VALUES ('quantity'), ('discount'), ('tax')) v(f)""")
def fs13_importances(spark, d):
    """Two features of two wanted; and three of two with a target of one value."""
    rows = wide(spark, d)
    few = fs.selection_shortcut(rows, ["quantity", "discount"], "price", 2).withColumn("why", F.lit("k"))
    return few.unionByName(fs.selection_shortcut(rows, ["quantity", "discount", "tax"], "constant", 2).withColumn("why", F.lit("targets")))


@query("fs16_varying_means", with_(WIDE) + "SELECT id % 50 AS cell_id, round(avg(quantity), 6) AS quantity, round(avg(price), 6) AS price FROM wide GROUP BY 1")
def fs16_varying(spark, d):
    """The constant column goes."""
    rows = wide(spark, d).withColumn("cell_id", F.col("id") % 50)
    columns = ["quantity", "constant", "price"]
    means = fs.cell_means(rows, columns)
    return rounded(means.select("cell_id", *fs.varying_columns(means, columns)))


@query("fs14_robustness", with_(IMPORTANCE) + """, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, feature) AS rank FROM imp)
SELECT feature, count(*) AS selection_count, round(avg(rank), 6) AS avg_rank, round(avg(importance), 6) AS avg_importance, round(stddev_samp(importance), 6) AS std_importance, round(count(*) / (SELECT count(DISTINCT seed) FROM imp), 6) AS selection_rate FROM r GROUP BY feature""")
def fs14(spark, d):
    return rounded(fs.robustness(importance(spark, d)))


@query("fs16_cell_means", with_(TELEMETRY, FEATURES) + "SELECT cell_id, round(avg(temp_mean), 6) AS temp_mean, round(avg(chg_v), 6) AS chg_v, round(avg(dvp), 6) AS dvp FROM features GROUP BY cell_id")
def fs16(spark, d):
    return rounded(fs.cell_means(fx.cycle_features(spark, d), ["temp_mean", "chg_v", "dvp"]))


SETS = "sets AS (SELECT n_name AS method, list_distinct(list(s_suppkey % 30)) AS features FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"


@query("fs17_agreement", with_(SETS) + """SELECT a.method, b.method AS other, CAST(len(list_intersect(a.features, b.features)) AS INT) AS common, round(len(list_intersect(a.features, b.features)) / len(list_distinct(list_concat(a.features, b.features))), 6) AS jaccard,
  round(len(list_intersect(a.features, b.features)) / least(len(a.features), len(b.features)), 6) AS overlap FROM sets a JOIN sets b ON a.method < b.method""")
def fs17(spark, d):
    rows = fx.table(spark, d, "supplier").join(F.broadcast(fx.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(fs.agreement(rows.groupBy(F.col("n_name").alias("method")).agg(F.collect_set(F.col("s_suppkey") % 30).alias("features"))))


@query("fs18_importance_knee", with_(IMPORTANCE) + """, t AS (SELECT feature, sum(importance) AS importance FROM imp GROUP BY feature), r AS (SELECT *, row_number() OVER w AS k, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS c, sum(importance) OVER () AS t FROM t WINDOW w AS (ORDER BY importance DESC, feature))
SELECT CAST(min(k) AS INT) AS k FROM r WHERE c >= 0.9 * t""")
def fs18(spark, d):
    return fs.importance_knee(importance(spark, d).groupBy("feature").agg(F.sum("importance").alias("importance")), 0.9)


@query("fs20_feature_matrix", """WITH s AS (SELECT DISTINCT 'f' || s_suppkey % 97 AS feature, r_name AS dataset FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT feature, CAST(max(CASE WHEN dataset = 'ASIA' THEN 1 ELSE 0 END) AS INT) AS ASIA, CAST(max(CASE WHEN dataset = 'EUROPE' THEN 1 ELSE 0 END) AS INT) AS EUROPE, CAST(max(CASE WHEN dataset = 'ASIA' THEN 1 ELSE 0 END) + max(CASE WHEN dataset = 'EUROPE' THEN 1 ELSE 0 END) AS INT) AS n_datasets FROM s GROUP BY feature""")
def fs20(spark, d):
    rows = fx.cells(spark, d).select(F.concat(F.lit("f"), (F.col("cell_id") % 97).cast("string")).alias("feature"), "dataset").distinct()
    return fs.feature_matrix(rows, ["ASIA", "EUROPE"])


@query("sm1_standard_scale", with_(WIDE) + """, t AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(constant) AS mc FROM wide WHERE id % 10 < 7) SELECT id, round((quantity - mq) / sq, 6) AS quantity, round(constant - mc, 6) AS constant FROM wide, t""")
def sm1(spark, d):
    return rounded(sm.standard_scale(wide(spark, d).select("id", "quantity", "constant"), ["quantity", "constant"], F.col("id") % 10 < 7))


@query("sm2_label_scale", with_(LABELS, SPLITS) + """, t AS (SELECT avg(life) AS m, stddev_pop(life) AS s FROM life_labels JOIN splits USING (cell_id) WHERE split = 'train') SELECT cell_id, split, round((life - m) / s, 6) AS life FROM life_labels JOIN splits USING (cell_id), t""")
def sm2(spark, d):
    rows = fx.life_labels(spark, d).join(fx.splits(spark, d), "cell_id").withColumn("life", F.col("life").cast("double"))
    return rounded(sm.standard_scale(rows, ["life"], F.col("split") == "train"))


SOH = "soh AS (SELECT cell_id, cycle, qd / (0.16 + cycle * 0.002 + cell_id % 5 * 0.01) AS soh FROM qd)"


def health(q):
    """soh of (cell_id, cycle, qd): over a capacity that is a decimal, as in the SQL; sums of doubles put healths that are right at a limit on either side of it."""
    return q.select("cell_id", "cycle", (F.col("qd") / F.expr("CAST(0.16BD + cycle * 0.002BD + cell_id % 5 * 0.01BD AS DOUBLE)")).alias("soh"))


def _soh(spark, d):
    return health(fx.discharge_capacity(fx.telemetry(spark, d)))


@query("sm3_end_of_life", with_(TELEMETRY, QD, SOH) + """, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k, row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS b FROM soh),
a AS (SELECT cell_id, max(CASE WHEN b = 1 THEN soh END) AS e, min(CASE WHEN soh <= 0.85 THEN k END) AS f, regr_slope(k, soh) FILTER (WHERE b <= 20) AS s, regr_intercept(k, soh) FILTER (WHERE b <= 20) AS c FROM r GROUP BY cell_id)
SELECT cell_id, CAST(CASE WHEN e > 0.85 THEN floor(s * 0.85 + c) ELSE f END AS BIGINT) AS life FROM a WHERE e < 0.95""")
def sm3(spark, d):
    return sm.end_of_life(_soh(spark, d), limit=0.85, near=0.95)


#: Suppliers as cells with names, nominal capacities and ranges of charge.
NAMED_CELLS = """c AS (SELECT s_suppkey AS cell_id, CASE s_suppkey % 3 WHEN 0 THEN 'RWTH_' WHEN 1 THEN 'SNL_18650_NCA_25C_20-80_' ELSE 'CALCE_' END || s_suppkey AS name, 0.3 + s_suppkey % 4 / CAST(10 AS DOUBLE) AS cap, 0.2 * (s_suppkey % 2) AS soc_from FROM supplier)"""
SMALL = "CASE WHEN starts_with(name, 'RWTH') THEN 1.85 WHEN starts_with(name, 'SNL_18650_NCA_25C_20-80') THEN 3.2 ELSE cap END"


@query("sm3_from_capacities", with_(TELEMETRY, NAMED_CELLS) + f""", q AS (SELECT cell_id, cycle, sum(CASE WHEN current_a < 0 THEN abs(current_a) * (time_s - pt) * 8 ELSE 0 END) OVER (PARTITION BY cell_id, cycle ORDER BY seq) / 3600 AS q FROM (SELECT *, lag(time_s, 1, time_s) OVER (PARTITION BY cell_id, cycle ORDER BY seq) AS pt FROM telemetry) x),
h AS (SELECT q.cell_id, cycle, max(q) / ({SMALL}) / (1 - soc_from) AS soh FROM q JOIN c ON q.cell_id = c.cell_id GROUP BY q.cell_id, cycle, name, cap, soc_from),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k, row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS b FROM h),
a AS (SELECT cell_id, max(CASE WHEN b = 1 THEN soh END) AS e, min(CASE WHEN soh <= 0.85 THEN k END) AS f, regr_slope(k, soh) FILTER (WHERE b <= 20) AS s, regr_intercept(k, soh) FILTER (WHERE b <= 20) AS i FROM r GROUP BY cell_id)
SELECT cell_id, CAST(CASE WHEN e > 0.85 THEN floor(s * 0.85 + i) ELSE f END AS BIGINT) AS life FROM a WHERE e < 5""")
def sm3_capacities(spark, d):
    """From the telemetry's running capacities (eight times, so that some cells live)."""
    w = ordered(["cell_id", "cycle"], "seq")
    step = F.when(F.col("current_a") < 0, F.abs("current_a") * (F.col("time_s") - F.lag("time_s").over(w)) * 8).otherwise(0.0)
    samples = fx.telemetry(spark, d).withColumn("__q", F.coalesce(step, F.lit(0.0))).withColumn("discharge_capacity_ah", running(F.col("__q"), w) / 3600)
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, "RWTH_").when(k % 3 == 1, "SNL_18650_NCA_25C_20-80_").otherwise("CALCE_"), k.cast("string"))
    cells = fx.table(spark, d, "supplier").select(k.alias("cell_id"), name.alias("name"), (0.3 + k % 4 / 10).alias("nominal_capacity_ah"), (0.2 * (k % 2)).alias("soc_from"), F.lit(1.0).alias("soc_to"))
    return sm.end_of_life(sm.state_of_health(samples, cells), limit=0.85, near=5.0)


@query("sm4_early_samples", with_(TELEMETRY, FEATURES, LABELS) + """, n AS (SELECT cell_id, count(*) AS n FROM features GROUP BY cell_id HAVING count(*) >= 3) SELECT n.cell_id, CAST(unnest(range(3, least(n, 10) + 1)) AS INT) AS n_cycles, CAST(life AS BIGINT) AS life FROM n JOIN life_labels l ON n.cell_id = l.cell_id""")
def sm4(spark, d):
    return sm.early_samples(fx.cycle_features(spark, d), fx.life_labels(spark, d).withColumn("life", F.col("life").cast("bigint")), 3, 10)


@query("sm4_padded_prefixes", with_(TELEMETRY, FEATURES) + """, l AS (SELECT cell_id, list(coalesce(dvp, 0) ORDER BY cycle) AS l FROM features GROUP BY cell_id), p AS (SELECT cell_id, l, unnest(range(3, least(len(l), 6) + 1)) AS k FROM l WHERE len(l) >= 3)
SELECT cell_id, CAST(k AS INT) AS n_cycles, round(list_sum(l[1:k]), 6) AS total, CAST(6 AS INT) AS width, CAST(k AS DOUBLE) AS mask_sum FROM p""")
def sm4p(spark, d):
    rows = sm.padded_prefixes(fx.cycle_features(spark, d), "dvp", 3, 6)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return rows.select("cell_id", "n_cycles", F.round(total("x") + 1e-9, 6).alias("total"), F.size("x").alias("width"), total("mask").alias("mask_sum"))


@query("sm6_hash_split", with_(CELLS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || cell_id), cell_id) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM cells)
SELECT cell_id, dataset, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def sm6(spark, d):
    return sm.hash_split(fx.cells(spark, d).select("cell_id", "dataset"), seed=7)


@query("sm7_inverse_frequency", with_(CELLS) + ", n AS (SELECT dataset, count(*) AS n FROM cells GROUP BY dataset) SELECT dataset, round(1 / n, 6) AS weight, round(1 / ln(n / (SELECT min(n) FROM n) + 1), 6) AS log_weight FROM n")
def sm7(spark, d):
    return rounded(sm.inverse_frequency(fx.cells(spark, d), "dataset"))


@query("sm8_density_weights")
def sm8(spark, d):
    """A binned kernel sum: rows only; a test compares it with numpy."""
    return rounded(sm.density_weights(fx.life_labels(spark, d).withColumn("life", F.col("life").cast("double"))))


@query("sm13_calendar", """SELECT event_id, round(second(ts) / 59 - 0.5, 6) AS second_of_scale, round(minute(ts) / 59 - 0.5, 6) AS minute_of_scale, round(hour(ts) / 23 - 0.5, 6) AS hour_of_scale, round((isodow(ts) - 1) / 6 - 0.5, 6) AS day_of_week_of_scale,
  round((day(ts) - 1) / 30 - 0.5, 6) AS day_of_month_of_scale, round((dayofyear(ts) - 1) / 365 - 0.5, 6) AS day_of_year_of_scale, round((month(ts) - 1) / 11 - 0.5, 6) AS month_of_scale, round((weekofyear(ts) - 1) / 52 - 0.5, 6) AS week_of_scale FROM events""")
def sm13(spark, d):
    return rounded(fx.table(spark, d, "events").select("event_id", *sm.calendar("ts")))


ERRORS = """round(avg(abs(pred - y)), 6) AS mae, round(avg((pred - y) * (pred - y)), 3) AS mse, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(abs(pred - y) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, round(avg(power((pred - y) / y, 2)), 6) AS mspe,
  round(avg(CASE WHEN abs(pred - y) / (y + 1e-5) <= 0.15 THEN 100 ELSE 0 END), 6) AS acc_15, round(avg(CASE WHEN abs(pred - y) / (y + 1e-5) <= 0.1 THEN 100 ELSE 0 END), 6) AS acc_10"""


def _errors(df):
    return rounded(df, "mse").withColumn("mse", F.round(F.col("mse") + 1e-9, 3))


@query("ev1_errors", with_(PREDICTIONS) + f"SELECT model, {ERRORS} FROM predictions GROUP BY model")
def ev1(spark, d):
    return _errors(fx.predictions(spark, d).groupBy("model").agg(*sm.errors()))


@query("ev2_relative_errors", with_(PREDICTIONS) + """, c AS (SELECT *, y - avg(y) OVER (PARTITION BY model) AS dy, pred - avg(pred) OVER (PARTITION BY model) AS dp FROM predictions)
SELECT model, round(sqrt(sum((y - pred) * (y - pred)) / sum(dy * dy)), 6) AS rse, round(sum(dy * dp) / sqrt(sum(dy * dy * dp * dp)), 6) AS corr FROM c GROUP BY model""")
def ev2(spark, d):
    return rounded(sm.relative_errors(fx.predictions(spark, d), ["model"]))


@query("ev4_seen_unseen", with_(PREDICTIONS) + f"SELECT model, seen, {ERRORS} FROM predictions GROUP BY model, seen")
def ev4(spark, d):
    return _errors(fx.predictions(spark, d).groupBy("model", "seen").agg(*sm.errors()))


@query("ev5_by_cycles", with_(PREDICTIONS) + f"SELECT n_cycles, {ERRORS} FROM predictions GROUP BY n_cycles")
def ev5(spark, d):
    return _errors(fx.predictions(spark, d).groupBy("n_cycles").agg(*sm.errors()))


@query("ev6_weighted_errors", with_(PREDICTIONS) + """SELECT model, round(sum(n_cycles * abs(pred - y)) / sum(n_cycles), 6) AS mae, round(sum(n_cycles * (pred - y) * (pred - y)) / sum(n_cycles), 3) AS mse,
  round(sum(n_cycles * abs(pred - y) / y) / sum(n_cycles), 6) AS mape FROM predictions GROUP BY model""")
def ev6(spark, d):
    return _errors(fx.predictions(spark, d).groupBy("model").agg(*sm.weighted_errors("n_cycles")))


@query("ev6_multi_output", with_(PREDICTIONS) + """SELECT model, round(avg(abs(pred - y)), 6) AS mae_0, round(avg(abs(seen - n_cycles)), 6) AS mae_1, round((avg(abs(pred - y)) + avg(abs(seen - n_cycles))) / 2, 6) AS mae FROM predictions GROUP BY model""")
def ev6_multi(spark, d):
    return rounded(fx.predictions(spark, d).groupBy("model").agg(*sm.multi_output_errors([("y", "pred"), ("n_cycles", "seen")])))


SERIES = "series AS (SELECT o_orderpriority AS g, o_orderkey, CAST(o_totalprice AS DOUBLE) AS y, o_totalprice * (1 + (o_orderkey % 7) / 100.0) AS pred, lag(CAST(o_totalprice AS DOUBLE), 4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS back FROM orders)"


def series(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", F.col("o_totalprice").cast("double").alias("y"))
    return sm.lagged(rows.withColumn("pred", F.col("y") * (1 + F.col("o_orderkey") % 7 / 100)), ["g"], "o_orderkey", "y", 4, width=50_000, name="back")


@query("ev7_smape_mase", with_(SERIES) + "SELECT g, round(avg(coalesce(200 * abs(pred - y) / nullif(abs(pred) + abs(y), 0), 0)), 6) AS smape, round(avg(abs(pred - y)) / nullif(avg(abs(y - back)), 0), 6) AS mase FROM series GROUP BY g")
def ev7(spark, d):
    e = F.abs(F.col("pred") - F.col("y"))
    smape = F.coalesce(F.try_divide(200 * e, F.abs("pred") + F.abs("y")), F.lit(0.0))
    return rounded(series(spark, d).groupBy("g").agg(F.avg(smape).alias("smape"), F.try_divide(F.avg(e), F.avg(F.abs(F.col("y") - F.col("back")))).alias("mase")))


@query("ev8_grouped_summary", with_(SERIES) + """, s AS (SELECT CASE WHEN g IN ('1-URGENT', '2-HIGH') THEN g ELSE 'Others' END AS grp, abs(pred - y) AS e, abs(back - y) AS naive FROM series WHERE back IS NOT NULL)
SELECT coalesce(grp, 'Average') AS grp, count(*) AS n, round(avg(e), 3) AS mae, round(avg(e) / avg(naive), 3) AS owa FROM s GROUP BY ROLLUP (grp)""")
def ev8(spark, d):
    rows = series(spark, d).filter("back is not null").select(F.when(F.col("g").isin("1-URGENT", "2-HIGH"), F.col("g")).otherwise("Others").alias("grp"), F.abs(F.col("pred") - F.col("y")).alias("e"), F.abs(F.col("back") - F.col("y")).alias("naive"))
    agg = rows.rollup("grp").agg(F.count("*").alias("n"), F.avg("e").alias("mae"), (F.avg("e") / F.avg("naive")).alias("owa"))
    return agg.select(F.coalesce("grp", F.lit("Average")).alias("grp"), "n", F.round(F.col("mae") + 1e-9, 3).alias("mae"), F.round(F.col("owa") + 1e-9, 3).alias("owa"))


@query("ev6_multi_output_all", with_(PREDICTIONS) + """, e AS (SELECT model, abs(pred - y) AS e0, abs(seen - n_cycles) AS e1, y, n_cycles FROM predictions)
SELECT model, round(avg(e0), 6) AS mae_0, round(avg(e1), 6) AS mae_1, round((avg(e0) + avg(e1)) / 2, 6) AS mae, round(avg(e0 * e0), 3) AS mse_0, round(avg(e1 * e1), 3) AS mse_1, round((avg(e0 * e0) + avg(e1 * e1)) / 2, 3) AS mse,
  round(avg(e0 / abs(y)), 6) AS mape_0, round(avg(e1 / n_cycles), 6) AS mape_1, round((avg(e0 / abs(y)) + avg(e1 / n_cycles)) / 2, 6) AS mape FROM e GROUP BY model""")
def ev6_all(spark, d):
    out = fx.predictions(spark, d).groupBy("model").agg(*sm.multi_output_errors([("y", "pred"), ("n_cycles", "seen")], ("mae", "mse", "mape")))
    return rounded(out.select(*(F.round(F.col(c) + 1e-9, 3).alias(c) if c.startswith("mse") else F.col(c) for c in out.columns)))


PAST = "past AS (SELECT *, o_orderkey % 20 AS s FROM series WHERE back IS NOT NULL), scales AS (SELECT g, s, avg(abs(y - back)) AS scale FROM past GROUP BY ALL)"


def past(spark, d):
    """Points with a seasonal forecast (the value four orders before), 20 series a group."""
    return series(spark, d).filter("back is not null").withColumn("s", F.col("o_orderkey") % 20)


@query("ev7_masked_errors", with_(SERIES, PAST) + """, m AS (SELECT past.*, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS mask, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE y END AS t, scale FROM past JOIN scales USING (g, s))
SELECT g, round(avg(abs(pred - t) * coalesce(mask / nullif(t, 0), 0)), 6) AS mape, round(200 * avg(coalesce(abs(pred - t) / nullif(abs(pred) + abs(t), 0), 0) * mask), 6) AS smape, round(avg(abs(pred - t) * coalesce(mask / nullif(scale, 0), 0)), 6) AS mase FROM m GROUP BY g""")
def ev7_masked(spark, d):
    rows = past(spark, d)
    scales = rows.groupBy("g", "s").agg(F.avg(F.abs(F.col("y") - F.col("back"))).alias("scale"))
    masked = rows.join(scales, ["g", "s"]).withColumn("mask", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1)).withColumn("t", F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("y")))
    return rounded(masked.groupBy("g").agg(*sm.masked_errors("mask", "scale", y="t")))


@query("ev8_forecast_summary", with_(SERIES, PAST) + """, p AS (SELECT g, s, avg(200 * abs(pred - y) / (abs(pred) + abs(y))) AS sm, avg(200 * abs(back - y) / (abs(back) + abs(y))) AS sm0, avg(100 * abs(pred - y) / abs(y)) AS mp, avg(abs(pred - y)) AS e, avg(abs(back - y)) AS e0, count(*) AS n FROM past GROUP BY ALL),
q AS (SELECT g, count(*) AS w, sum(sm * n) / sum(n) AS smape, sum(sm0 * n) / sum(n) AS smape0, sum(mp * n) / sum(n) AS mape, avg(e / scale) AS mase, avg(e0 / scale) AS mase0 FROM p JOIN scales USING (g, s) GROUP BY g),
r AS (SELECT unnest([CASE WHEN g IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'Others' ELSE g END, 'Average']) AS grp, * FROM q),
t AS (SELECT grp, sum(smape * w) / sum(w) AS smape, sum(smape0 * w) / sum(w) AS smape0, sum(mape * w) / sum(w) AS mape, sum(mase * w) / sum(w) AS mase, sum(mase0 * w) / sum(w) AS mase0 FROM r GROUP BY grp)
SELECT grp, round(smape, 3) AS smape, round(mape, 3) AS mape, round(mase, 3) AS mase, round((mase / mase0 + smape / smape0) / 2, 3) AS owa FROM t""")
def ev8_summary(spark, d):
    rows = past(spark, d).select(F.col("g").alias("grp"), F.col("s").alias("series"), "y", "pred", F.col("back").alias("naive"))
    scales = rows.groupBy("grp", "series").agg(F.avg(F.abs(F.col("y") - F.col("naive"))).alias("scale"))
    return sm.forecast_summary(rows, scales, ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("ev9_point_adjust", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS gt, CASE WHEN value > 40 THEN 1 ELSE 0 END AS pred FROM events),
m AS (SELECT *, CASE WHEN gt <> lag(gt) OVER w OR lag(gt) OVER w IS NULL THEN 1 ELSE 0 END AS new, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, event_id, gt, CASE WHEN gt = 1 AND k > 1 AND max(CASE WHEN gt = 1 AND pred = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run) = 1 THEN 1 ELSE pred END AS adjusted FROM r""")
def ev9(spark, d):
    rows = fx.table(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("error", "view").cast("int").alias("gt"), F.coalesce((F.col("value") > 40).cast("int"), F.lit(0)).alias("pred"))
    return sm.point_adjust(rows, ["user_id"], "event_id").select("user_id", "event_id", "gt", "adjusted")


@query("ev10_accuracy", "SELECT event_type, round(avg(CASE WHEN (value > 40) = (event_id % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY event_type")
def ev10(spark, d):
    return rounded(fx.table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when((F.col("value") > 40) == (F.col("event_id") % 2 == 0), 1.0).otherwise(0.0)).alias("accuracy")))


TRIALS = "trials AS (SELECT 'd' || o_custkey % 4 AS dataset, o_orderpriority AS model, o_orderkey AS trial, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'success' END AS status, CAST(o_totalprice AS DOUBLE) AS mape, o_totalprice * 2.0 AS rmse, o_totalprice * 3.0 AS mae, CAST(o_orderkey % 100 AS DOUBLE) AS seconds FROM orders)"


@query("ev11_leaderboard", with_(TRIALS) + """SELECT dataset, model, arg_min(trial, mape) FILTER (WHERE status = 'success') AS best_trial, round(min(mape) FILTER (WHERE status = 'success'), 4) AS best_mape, round(avg(mape) FILTER (WHERE status = 'success'), 4) AS mean_mape, round(avg(rmse) FILTER (WHERE status = 'success'), 4) AS mean_rmse,
  round(avg(mae) FILTER (WHERE status = 'success'), 4) AS mean_mae, count(*) FILTER (WHERE status <> 'success') AS failures, round(sum(seconds) / 60, 4) AS minutes FROM trials GROUP BY dataset, model""")
def ev11(spark, d):
    p = F.col("o_totalprice").cast("double")
    k = F.col("o_orderkey")
    trials = fx.table(spark, d, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("dataset"), F.col("o_orderpriority").alias("model"), k.alias("trial"), F.when(k % 9 == 0, "failed").otherwise("success").alias("status"), p.alias("mape"), (p * 2).alias("rmse"), (p * 3).alias("mae"), (k % 100).cast("double").alias("seconds"))
    out = sm.leaderboard(trials)
    return out.select(*(F.round(F.col(c) + 1e-9, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("ev12_sensitivity_grid", with_(PREDICTIONS) + "SELECT lim AS cycle_limit, model, count(*) AS n, round(avg(abs(pred - y) / y), 6) AS mape FROM predictions, (VALUES (10), (20), (30), (40), (50)) v(lim) WHERE n_cycles <= lim GROUP BY ALL")
def ev12(spark, d):
    limits = F.explode(F.filter(F.array(*(F.lit(k) for k in (10, 20, 30, 40, 50))), lambda k: k >= F.col("n_cycles")))
    return rounded(fx.predictions(spark, d).withColumn("cycle_limit", limits).groupBy("cycle_limit", "model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("y")) / F.col("y")).alias("mape")))


@query("ev12_grid_of_two", with_(PREDICTIONS) + """, p AS (SELECT l_returnflag AS model, l_linenumber AS n_features, CAST(l_quantity AS INT) AS n_cycles, l_extendedprice AS y, l_extendedprice * (1 + l_discount - 0.05) AS pred FROM lineitem)
SELECT c AS n_cycles_limit, f AS n_features_limit, model, count(*) AS n, round(avg(abs(pred - y) / y), 6) AS mape FROM p, (VALUES (10), (20), (50)) c(c), (VALUES (2), (5), (7)) f(f) WHERE n_cycles <= c AND n_features <= f GROUP BY ALL""")
def ev12_two(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("n_features"), F.col("l_quantity").cast("int").alias("n_cycles"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_extendedprice") * (1 + F.col("l_discount") - 0.05)).cast("double").alias("pred"))
    return rounded(sm.sensitivity_grid(rows, {"n_cycles": [10, 20, 50], "n_features": [2, 5, 7]}, ["model"]))


@query("ev14_life_histogram", with_(LABELS) + "SELECT CAST(floor(life / 100) * 100 AS BIGINT) AS bin, count(*) AS n FROM life_labels GROUP BY 1")
def ev14(spark, d):
    return fx.life_labels(spark, d).groupBy((F.floor(F.col("life") / 100) * 100).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("ev14_soh_trajectories", with_(TELEMETRY, QD, SOH) + "SELECT soh.cell_id, cycle, round(soh, 6) AS soh FROM soh JOIN (SELECT cell_id, arg_max(soh, cycle) AS last FROM soh GROUP BY cell_id) e ON soh.cell_id = e.cell_id WHERE last >= 0.78")
def ev14_soh(spark, d):
    return rounded(sm.whole_lives(_soh(spark, d)))


@query("sm5_column_slices", with_(WIDE) + "SELECT id, round(quantity, 6) AS quantity, round(price, 6) AS price, round(target, 6) AS target FROM wide")
def sm5(spark, d):
    return rounded(sm.first_columns(wide(spark, d), 3, with_last=True))
