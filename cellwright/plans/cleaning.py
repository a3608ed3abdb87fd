"""Queries for sources, cleaning, imputation and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import cleaning as c
from cellwright.operators import profiles as pr
from cellwright.operators import tables as t
from cellwright.plans.cycles import rounded
from cellwright.plans.sql import CELLS, FEATURES, LABELS, LONG, SPLITS, TELEMETRY, with_
from cellwright.sources import fixtures as fx

Q: dict = {}
S: dict = {}
NAMES = ["temp_mean", "chg_v", "dvp"]
KEYS = ["cell_id", "cycle"]
HEAD = with_(TELEMETRY, FEATURES, LONG)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def long(spark, d):
    return c.to_long(fx.cycle_features(spark, d), KEYS, NAMES)


FILL = """n AS (SELECT *, row_number() OVER w AS i FROM {src} WINDOW w AS (PARTITION BY cell_id, feature ORDER BY cycle)),
k AS (SELECT *, last_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value({v} IGNORE NULLS) OVER b AS xa,
  first_value(CASE WHEN {v} IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value({v} IGNORE NULLS) OVER f AS xb FROM n
  WINDOW b AS (PARTITION BY cell_id, feature ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY cell_id, feature ORDER BY cycle ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT * EXCLUDE (i, ia, xa, ib, xb), coalesce({v}, xa + (xb - xa) * (i - ia) / nullif(ib - ia, 0), xa, xb) AS line FROM k)"""


@query("cl1_repair_outliers", HEAD + """, z AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY cell_id, feature ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m,
  coalesce(max(CASE WHEN value = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, feature), 0) AS zero FROM long),
o AS (SELECT *, coalesce(abs(value - m) > 0.01 * abs(m), false) AND zero = 0 AS out FROM z),
v AS (SELECT cell_id, cycle, feature, value, out, max(CASE WHEN out THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, feature) AS has_out, CASE WHEN NOT out THEN value END AS v FROM o),
""" + FILL.format(src="v", v="v") + " SELECT cell_id, cycle, feature, round(CASE WHEN has_out = 1 THEN line ELSE value END, 6) AS value FROM filled")
def cl1(spark, d):
    return rounded(c.repair_outliers(long(spark, d), tolerance=0.01))


@query("cl2_interpolate", HEAD + ", " + FILL.format(src="long", v="value") + " SELECT cell_id, cycle, feature, round(line, 6) AS value FROM filled")
def cl2(spark, d):
    return rounded(c.interpolate(long(spark, d)))


@query("cl3_relative_to_tenth", HEAD + """, n AS (SELECT *, row_number() OVER (PARTITION BY cell_id, feature ORDER BY cycle) AS i FROM long), b AS (SELECT *, max(i) OVER k AS rows_n, max(CASE WHEN i = 10 THEN value END) OVER k AS ten FROM n WINDOW k AS (PARTITION BY cell_id, feature))
SELECT cell_id, cycle, feature, round(CASE WHEN rows_n < 10 THEN value ELSE value - ten END, 6) AS value FROM b""")
def cl3(spark, d):
    return rounded(c.relative_to_tenth(long(spark, d)))


@query("cl4_column_drops", HEAD + """, x AS (SELECT cell_id, cycle, feature, value FROM long UNION ALL SELECT cell_id, cycle, 'constant', 1 FROM features UNION ALL SELECT cell_id, cycle, 'empty', NULL FROM features UNION ALL SELECT cell_id, cycle, 'Workload_Type', cycle FROM features)
SELECT feature, CASE WHEN feature = 'Workload_Type' THEN 'manual' WHEN stddev_samp(value) = 0 THEN 'constant' WHEN count(value) = 0 THEN 'all_null' ELSE 'null_rate' END AS reason FROM x GROUP BY feature
HAVING feature = 'Workload_Type' OR stddev_samp(value) = 0 OR count(value) = 0 OR (count(*) - count(value)) / count(*) > 0.1""")
def cl4(spark, d):
    wide = fx.cycle_features(spark, d).select("*", F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("empty"), F.col("cycle").cast("double").alias("Workload_Type"))
    return c.column_drops(c.to_long(wide, KEYS, [*NAMES, "constant", "empty", "Workload_Type"]), ["Workload_Type"], most_null=0.1)


@query("cl5_union_by_name", with_(TELEMETRY, FEATURES) + "SELECT cell_id, cycle, dvp, NULL::DOUBLE AS chg_v FROM features WHERE cell_id % 2 = 0 UNION ALL SELECT cell_id, cycle, NULL, chg_v FROM features WHERE cell_id % 2 = 1")
def cl5(spark, d):
    wide = fx.cycle_features(spark, d)
    return wide.filter("cell_id % 2 = 0").select(*KEYS, "dvp").unionByName(wide.filter("cell_id % 2 = 1").select(*KEYS, "chg_v"), allowMissingColumns=True)


IMPUTE = HEAD + """, counted AS (SELECT *, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY cell_id, feature) AS nulls FROM long), """ + FILL.format(src="counted", v="value") + ", means AS (SELECT feature, avg(value) AS g FROM long GROUP BY feature)"


@query("cl6_impute", IMPUTE + " SELECT cell_id, cycle, filled.feature AS feature, round(CASE WHEN nulls < 10 THEN coalesce(value, line, g, 0) ELSE coalesce(value, g, 0) END, 6) AS value FROM filled JOIN means ON filled.feature = means.feature")
def cl6(spark, d):
    return rounded(c.impute(long(spark, d)))


def groups(spark, d, size=4):
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.floor(F.col("s_suppkey") / size).alias("grp"))


@query("cl7_sibling_means", HEAD + """, m AS (SELECT cell_id, feature, avg(value) AS m, cell_id // 4 AS grp FROM long GROUP BY ALL), s AS (SELECT *, sum(m) OVER k AS t, count(m) OVER k AS n FROM m WINDOW k AS (PARTITION BY grp, feature))
SELECT cell_id, feature, round((t - coalesce(m, 0)) / nullif(n - CASE WHEN m IS NULL THEN 0 ELSE 1 END, 0), 6) AS mean FROM s""")
def cl7(spark, d):
    return rounded(c.sibling_means(long(spark, d), groups(spark, d)))


@query("cl8_group_range_means", HEAD + """, p AS (SELECT cell_id // 4 AS grp, feature, sum(value) AS s, count(value) AS n FROM long GROUP BY ALL), r AS (SELECT a.grp, b.feature, sum(b.s) / nullif(sum(b.n), 0) AS mean FROM (SELECT DISTINCT s_suppkey // 4 AS grp FROM supplier) a JOIN p b ON abs(a.grp - b.grp) <= 5 AND a.grp <> b.grp GROUP BY ALL)
SELECT s_suppkey AS cell_id, feature, round(mean, 6) AS mean FROM supplier JOIN r ON s_suppkey // 4 = r.grp""")
def cl8(spark, d):
    return rounded(c.group_range_means(long(spark, d), groups(spark, d)))


#: Names of suppliers as cells of two data sets.
SNL_NAMES = """names AS (SELECT s_suppkey AS cell_id, 'SNL_18650_' || CASE WHEN s_suppkey % 2 = 0 THEN 'NCA' ELSE 'LFP' END || '_25C_' || CASE WHEN (s_suppkey // 2) % 2 = 0 THEN '20-80' ELSE '0-100' END || '_0.5-1C'
  || CASE WHEN (s_suppkey // 4) % 2 = 0 THEN '' ELSE '5' END || CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE '_' || chr(CAST(97 + s_suppkey % 26 AS INT)) END AS name FROM supplier)"""
ISU_NAMES = """names AS (SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 9 = 4 THEN 'ISU-ILCC_' || s_suppkey ELSE 'ISU-ILCC_G' || (s_suppkey * 7 % 64 + 1) || 'C' || s_suppkey END AS name FROM supplier)"""


def snl_names(spark, d):
    k = F.col("s_suppkey")
    letter = F.when(k % 7 == 3, "").otherwise(F.concat(F.lit("_"), F.chr(97 + k % 26)))
    name = F.concat(F.lit("SNL_18650_"), F.when(k % 2 == 0, "NCA").otherwise("LFP"), F.lit("_25C_"), F.when(F.floor(k / 2) % 2 == 0, "20-80").otherwise("0-100"), F.lit("_0.5-1C"), F.when(F.floor(k / 4) % 2 == 0, "").otherwise("5"), letter)
    return fx.table(spark, d, "supplier").select(k.alias("cell_id"), name.alias("name"))


def isu_names(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 9 == 4, F.concat(F.lit("ISU-ILCC_"), k.cast("string"))).otherwise(F.concat(F.lit("ISU-ILCC_G"), (k * 7 % 64 + 1).cast("string"), F.lit("C"), k.cast("string")))
    return fx.table(spark, d, "supplier").select(k.alias("cell_id"), name.alias("name"))


CELL_MEANS = "m AS (SELECT cell_id, feature, avg(value) AS m FROM long GROUP BY ALL HAVING avg(value) IS NOT NULL)"


@query("cl7_named_siblings", HEAD + ", " + SNL_NAMES + ", " + CELL_MEANS + """, p AS (SELECT *, regexp_extract(name, '^(.+)_[a-zA-Z0-9]+$', 1) AS prefix, regexp_extract(replace(name, '20-80', '0-100'), '^(.+)_[a-zA-Z0-9]+$', 1) AS wide FROM names)
SELECT p.cell_id, feature, round(avg(m), 6) AS mean FROM p JOIN names o ON p.cell_id <> o.cell_id AND prefix <> '' AND starts_with(o.name, prefix) JOIN m ON m.cell_id = o.cell_id WHERE feature = 'temp_mean' GROUP BY ALL
UNION ALL SELECT p.cell_id, feature, round(avg(m), 6) FROM p JOIN names o ON p.cell_id <> o.cell_id AND wide <> '' AND contains(o.name, wide) JOIN m ON m.cell_id = o.cell_id
  WHERE feature = 'dvp' AND contains(p.name, 'NCA') AND contains(p.name, '25C') AND contains(p.name, '20-80') GROUP BY ALL""")
def cl7_named(spark, d):
    return rounded(c.named_sibling_means(long(spark, d), snl_names(spark, d)))


@query("cl8_numbered_groups", HEAD + ", " + ISU_NAMES + ", " + CELL_MEANS + """, n AS (SELECT *, CAST(nullif(regexp_extract(name, 'G(\\d+)', 1), '') AS INT) AS number FROM names),
a AS (SELECT n.cell_id, feature, avg(m) AS mean FROM n JOIN names o ON n.cell_id <> o.cell_id AND contains(o.name, 'G' || n.number) JOIN m ON m.cell_id = o.cell_id GROUP BY ALL),
b AS (SELECT n.cell_id, feature, avg(m) AS mean FROM n JOIN n o ON n.number <> o.number AND abs(n.number - o.number) <= 5 JOIN m ON m.cell_id = o.cell_id GROUP BY ALL)
SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.feature, b.feature) AS feature, round(coalesce(a.mean, b.mean), 6) AS mean FROM a FULL JOIN b ON a.cell_id = b.cell_id AND a.feature = b.feature""")
def cl8_numbered(spark, d):
    return rounded(c.numbered_group_means(long(spark, d), isu_names(spark, d)))


@query("cl12_fewest_cycles", with_(TELEMETRY) + "SELECT cell_id, count(*) AS n_cycles FROM (SELECT DISTINCT cell_id, cycle FROM telemetry) x GROUP BY cell_id ORDER BY n_cycles, cell_id LIMIT 20")
def cl12_fewest(spark, d):
    return c.fewest_cycles(fx.telemetry(spark, d).select(*KEYS).distinct())


@query("cl9_global_means", HEAD + "SELECT feature, round(avg(value), 6) AS mean FROM long GROUP BY feature")
def cl9(spark, d):
    return rounded(long(spark, d).groupBy("feature").agg(F.avg("value").alias("mean")))


@query("cl10_forward_fill", HEAD + "SELECT cell_id, cycle, feature, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY cell_id, feature ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS value FROM long")
def cl10(spark, d):
    return rounded(c.forward_fill(long(spark, d)))


@query("cl11_null_report", HEAD + """SELECT cell_id, count(DISTINCT cycle) AS n_rows, count(DISTINCT feature) AS n_features, count(*) FILTER (WHERE value IS NULL) AS n_nulls,
  coalesce(array_to_string(list(cycle || ':' || feature ORDER BY cycle, feature) FILTER (WHERE value IS NULL)[1:5], ','), '') AS first_nulls FROM long GROUP BY cell_id""")
def cl11(spark, d):
    return c.null_report(long(spark, d))


@query("cl12_cycle_counts", with_(TELEMETRY) + """, n AS (SELECT cell_id, cell_id // 4 AS grp, count(*) AS n FROM telemetry GROUP BY ALL)
SELECT grp, count(*) AS cells, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, count(*) FILTER (WHERE n < 50) AS under_50, count(*) FILTER (WHERE n BETWEEN 50 AND 99) AS under_100, count(*) FILTER (WHERE n >= 100) AS from_100 FROM n GROUP BY grp""")
def cl12(spark, d):
    return rounded(c.cycle_count_report(fx.telemetry(spark, d), groups(spark, d)))


@query("src4_first_cycles_per_cell", with_(TELEMETRY, FEATURES) + "SELECT cell_id, cycle, round(dvp, 6) AS dvp FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM features) x WHERE k <= 5")
def src4(spark, d):
    return rounded(t.first_rows(fx.cycle_features(spark, d).select(*KEYS, "dvp"), 5))


@query("src5_labels_from_json", "SELECT 'cell_' || s_suppkey AS cell, CAST(90 + (s_suppkey * 37) % 2000 AS DOUBLE) AS life FROM supplier WHERE 90 + (s_suppkey * 37) % 2000 > 100")
def src5(spark, d):
    key = F.concat(F.lit('"cell_'), F.col("cell_id").cast("string"), F.lit('.pkl": '), F.col("life").cast("string"))
    files = fx.life_labels(spark, d).groupBy((F.col("cell_id") % 3).alias("file")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(key), ", "), F.lit("}")).alias("json"))
    return t.labels_from_json(files, early=100)


@query("src6_label_aliases", "SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 3 AS BIGINT) END AS life FROM supplier")
def src6(spark, d):
    k = F.col("s_suppkey")
    cells_ = fx.table(spark, d, "supplier").select(k.alias("cell_id"), F.concat(F.lit("Tongji1_CY--"), k.cast("string")).alias("name"))
    labels = fx.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("Tongji_CY-#"), k.cast("string")).alias("name"), (k * 3).cast("bigint").alias("life"))
    alias = F.replace(F.regexp_replace("name", "^Tongji[123]_", "Tongji_"), F.lit("--"), F.lit("-#"))
    return c.alias_labels(cells_, labels, alias).select("cell_id", "life")


@query("src7_unprocessed_cells", "SELECT s_suppkey AS cell_id FROM supplier WHERE s_suppkey % 3 <> 0")
def src7(spark, d):
    cells_ = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    return t.without(cells_, cells_.filter("cell_id % 3 = 0"), ["cell_id"])


@query("j1_features_with_labels", with_(TELEMETRY, FEATURES, LABELS) + "SELECT f.cell_id, cycle, round(dvp, 6) AS dvp, CAST(life AS BIGINT) AS life FROM features f JOIN life_labels l ON f.cell_id = l.cell_id WHERE life > 100")
def j1(spark, d):
    return rounded(fx.cycle_features(spark, d).join(fx.life_labels(spark, d).filter("life > 100"), "cell_id").select(*KEYS, "dvp", F.col("life").cast("bigint").alias("life")))


@query("j2_split_membership", with_(TELEMETRY, FEATURES, SPLITS) + "SELECT cell_id, cycle FROM features WHERE cell_id IN (SELECT cell_id FROM splits WHERE split = 'train')")
def j2(spark, d):
    return t.in_split(fx.cycle_features(spark, d), fx.splits(spark, d), "train").select(*KEYS)


@query("j3_derived_splits", "SELECT c_custkey, c_mktsegment, CASE WHEN contains(c_mktsegment, 'AUTO') THEN 'LFP' WHEN contains(c_mktsegment, 'BUILD') THEN 'NCA' ELSE 'NMC' END AS split FROM customer")
def j3(spark, d):
    return t.by_substring(fx.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", [("AUTO", "LFP"), ("BUILD", "NCA")], "NMC", "split")


@query("j4_life_classes", with_(LABELS) + "SELECT cell_id, CAST(life AS BIGINT) AS life, CASE WHEN life < 300 THEN 1 WHEN life < 1000 THEN 2 WHEN life < 2000 THEN 3 ELSE 4 END AS life_class FROM life_labels")
def j4(spark, d):
    return t.life_classes(fx.life_labels(spark, d)).select("cell_id", F.col("life").cast("bigint").alias("life"), "life_class")


@query("j5_seen_unseen", with_(SPLITS) + "SELECT cell_id, split, CASE WHEN split = 'test' THEN CAST(cell_id % 2 AS INT) ELSE 1 END AS seen FROM splits")
def j5(spark, d):
    lookup = fx.splits(spark, d).filter("split = 'test'").select("cell_id", (F.col("cell_id") % 2).cast("int").alias("flag"))
    return t.seen_flags(fx.splits(spark, d), lookup)


@query("j7_prefix_siblings", "SELECT a.s_suppkey AS cell_id, count(b.s_suppkey) AS n_siblings FROM supplier a LEFT JOIN supplier b ON a.s_suppkey // 10 = b.s_suppkey // 10 AND a.s_suppkey <> b.s_suppkey GROUP BY ALL")
def j7(spark, d):
    g = groups(spark, d, 10)
    n = g.groupBy("grp").agg(F.count("*").alias("n"))
    return g.join(n, "grp").select("cell_id", (F.col("n") - 1).alias("n_siblings"))


@query("j8_common_cells", "SELECT s_suppkey AS cell_id FROM supplier WHERE s_suppkey % 2 = 0 INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def j8(spark, d):
    cells_ = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    return cells_.filter("cell_id % 2 = 0").intersect(cells_.filter("cell_id % 3 = 0"))


#: Datasets of the fixtures as profiles.
PROFILES = {"AFRICA": "CALCE", "AMERICA": "HUST", "ASIA": "CALB", "EUROPE": "UL_PUR", "MIDDLE EAST": "MATR"}
PROFILED = """p(dataset, profile, mode, area, no_width, no_dvp, charge_from, discharge_from, n_discharge) AS (VALUES ('AFRICA', 'CALCE', 1, NULL, false, false, 3.5, 4.1, 3), ('AMERICA', 'HUST', 1, 0.05, false, false, 3.0, NULL, 0),
  ('ASIA', 'CALB', 2, NULL, false, false, 3.5, 4.1, 3), ('EUROPE', 'UL_PUR', 2, 0.05, true, true, 3.5, 4.1, 3), ('MIDDLE EAST', 'MATR', 1, 0.03, false, false, 3.0, 3.5, 3))"""


def profiled(spark, d):
    """Cells with their profile's columns."""
    names = F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair])
    return fx.cells(spark, d).withColumn("profile", F.element_at(names, F.col("dataset"))).join(F.broadcast(pr.profiles(spark)), "profile")


@query("j9_profile_lookup", with_(CELLS, PROFILED) + """SELECT cell_id, cells.dataset, profile, mode, round(nominal_capacity_ah * 0.005, 6) AS dv_step, round(CAST(area AS DOUBLE), 6) AS area,
  round(CAST(charge_from AS DOUBLE), 6) AS charge_from, round(CAST(discharge_from AS DOUBLE), 6) AS discharge_from, n_discharge FROM cells JOIN p ON cells.dataset = p.dataset""")
def j9(spark, d):
    first = lambda c: F.get(F.get(c, F.lit(0)), F.lit(0))
    return rounded(profiled(spark, d).select("cell_id", "dataset", "profile", "mode", (F.col("nominal_capacity_ah") * 0.005).alias("dv_step"), "area", first("tevi").alias("charge_from"), first("tevd").alias("discharge_from"), F.size("tevd").alias("n_discharge")))


@query("j6_excluded_cycles", with_(TELEMETRY) + """SELECT cell_id, cycle, count(*) AS n_rows FROM telemetry t WHERE NOT EXISTS (SELECT 1 FROM telemetry x WHERE x.cell_id = t.cell_id AND x.cycle = t.cycle AND x.time_s > 1743)
GROUP BY ALL""")
def j6(spark, d):
    rows = fx.telemetry(spark, d)
    late = rows.filter("time_s > 1743").select(*KEYS).distinct()
    return t.without(rows, late, KEYS).groupBy(*KEYS).agg(F.count("*").alias("n_rows"))


@query("e2_relative_features", None)
def e2(spark, d):
    """Cleaning and imputation in one job, wide again (rows only: each step has its own SQL)."""
    clean = c.relative_to_tenth(c.repair_outliers(long(spark, d)))
    return rounded(c.to_wide(c.impute(clean), KEYS, NAMES))


@query("snk1_ordered_columns", with_(TELEMETRY, FEATURES) + "SELECT cell_id, cycle, round(temp_mean, 6) AS temp_mean, round(chg_v, 6) AS chg_v, round(dvp, 6) AS dvp FROM features")
def snk1(spark, d):
    wide = fx.cycle_features(spark, d)
    return rounded(t.ordered_columns(wide, [*KEYS, "temp_mean"]))

