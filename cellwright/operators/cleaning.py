"""Cleaning and imputation on long tables (cell_id, cycle, feature, value): one window per (cell, feature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import median_of, ordered, ratio

SERIES = ["cell_id", "feature"]
#: Features whose lower-case name holds one of these are not taken relative to the 10th cycle (fixed values).
NOT_RELATIVE = ("rate", "uvp", "lvp", "soc", "ichv", "idv", "cycle_number", "temperature", "ambient", "workload_type", "cell_id", "rest_time", "is_missing", "label", "mode")


def to_long(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return wide.unpivot(keys, features, "feature", "value")


def to_wide(long: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("feature", features).agg(F.first("value"))


def interpolate(series: DataFrame, value: str = "value", keys: list[str] = SERIES, order: str = "cycle") -> DataFrame:
    """Fill NULLs linearly by row position; those at the ends take the nearest value; a series without values stays NULL."""
    w = ordered(keys, order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("x")))
    numbered = series.withColumn("__i", F.row_number().over(w))
    around = numbered.withColumn("__a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("__a"), F.col("__b")
    line = a["x"] + (b["x"] - a["x"]) * ratio(F.col("__i") - a["i"], b["i"] - a["i"])
    return around.withColumn(value, F.coalesce(F.col(value), line, a["x"], b["x"])).drop("__i", "__a", "__b")


def repair_outliers(series: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Values off the centred 5-row median m by over tolerance * |m| become NULL and, with all NULLs of that series, are interpolated.
    A series that holds a 0 or has no outlier stays as it is."""
    w, k = ordered(SERIES, "cycle"), Window.partitionBy(*SERIES)
    m = median_of(F.col("value"), w, -2, 2)
    zero = F.max((F.col("value") == 0).cast("int")).over(k) == 1
    marked = series.withColumn("__out", F.coalesce(F.abs(F.col("value") - m) > tolerance * F.abs(m), F.lit(False)) & ~F.coalesce(zero, F.lit(False)))
    touched = marked.withColumn("__any", F.max("__out").over(k)).withColumn("__v", F.when(~F.col("__out"), F.col("value")))
    filled = interpolate(touched, "__v")
    return filled.withColumn("value", F.when(F.col("__any"), F.col("__v")).otherwise(F.col("value"))).drop("__out", "__any", "__v")


def relative_to_tenth(series: DataFrame) -> DataFrame:
    """Subtract a series' value in its cell's 10th row; series of fewer rows, and those named in NOT_RELATIVE, stay."""
    w = ordered(SERIES, "cycle")
    tenth = F.max(F.when(F.col("__i") == 10, F.struct(F.col("value").alias("x")))).over(Window.partitionBy(*SERIES))
    fixed = F.greatest(F.lit(False), *(F.contains(F.lower("feature"), F.lit(token)) for token in NOT_RELATIVE))
    out = series.withColumn("__i", F.row_number().over(w)).withColumn("__t", tenth)
    return out.withColumn("value", F.when(fixed | F.col("__t").isNull(), F.col("value")).otherwise(F.col("value") - F.col("__t.x"))).drop("__i", "__t")


def column_drops(long: DataFrame, manual: list[str] = [], most_null: float = 0.2) -> DataFrame:  # noqa: B006
    """feature, reason of the columns that go, tested in order: manual, constant, all NULL, too many NULLs."""
    agg = long.groupBy("feature").agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"), F.count("*").alias("rows"))
    reason = F.when(F.col("feature").isin(manual), "manual").when(F.col("sd") == 0, "constant").when(F.col("n") == 0, "all_null").when(ratio(F.col("rows") - F.col("n"), F.col("rows")) > most_null, "null_rate")
    return agg.select("feature", reason.alias("reason")).filter("reason is not null")


def impute(long: DataFrame, siblings: DataFrame | None = None, few: int = 10) -> DataFrame:
    """Per series: no NULL stays; fewer than ``few`` NULLs are interpolated; more take the siblings' mean (cell_id, feature, mean), then the
    feature's global mean, then 0."""
    k = Window.partitionBy(*SERIES)
    counted = long.withColumn("__nulls", F.count_if(F.col("value").isNull()).over(k))
    lines = interpolate(counted.withColumn("__line", F.col("value")), "__line")
    means = long.groupBy("feature").agg(F.avg("value").alias("__global"))
    out = lines.join(means, "feature")
    if siblings is not None:
        out = out.join(siblings.select("cell_id", "feature", F.col("mean").alias("__sibling")), SERIES, "left")
    else:
        out = out.withColumn("__sibling", F.lit(None).cast("double"))
    filled = F.when(F.col("__nulls") < few, F.coalesce("value", "__line", "__global", F.lit(0.0))).otherwise(F.coalesce("value", "__sibling", "__global", F.lit(0.0)))
    return out.withColumn("value", filled).drop("__nulls", "__line", "__global", "__sibling")


def sibling_means(long: DataFrame, groups: DataFrame) -> DataFrame:
    """cell_id, feature, mean of the per-cell means of the other cells in the same group (cell_id, grp): group sums less the cell's own."""
    own = long.groupBy("cell_id", "feature").agg(F.avg("value").alias("m")).join(groups, "cell_id")
    k = Window.partitionBy("grp", "feature")
    total, n = F.sum("m").over(k), F.count("m").over(k)
    return own.select("cell_id", "feature", ratio(total - F.coalesce("m", F.lit(0.0)), n - F.col("m").isNotNull().cast("int")).alias("mean"))


def group_range_means(long: DataFrame, groups: DataFrame, reach: int = 5) -> DataFrame:
    """cell_id, feature, mean over cells of other groups with numbers within ``reach``: an equi join on group numbers, a fixed number for each."""
    per = long.join(groups, "cell_id").groupBy("grp", "feature").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    near = per.withColumn("near", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.col("grp") + k))).filter("near <> grp")
    mean = near.groupBy(F.col("near").alias("grp"), "feature").agg(ratio(F.sum("s"), F.sum("n")).alias("mean"))
    return groups.join(mean, "grp").select("cell_id", "feature", "mean")


#: Parts of lower-case names that make a feature one of temperature (fixed values).
TEMPERATURE = ["temp", "t_rise", "mint", "maxt", "mat_", "met_"]


def containing(names: DataFrame, patterns: DataFrame, at_start: bool = False) -> DataFrame:
    """cell_id, pattern: the cells (cell_id, name) whose names contain (or with ``at_start`` begin with) a text of ``patterns`` (pattern).

    An equi join on all pieces of the names that are as long as a pattern; names have tens of characters, so patterns have few lengths.
    """
    distinct = patterns.select("pattern").filter("pattern <> ''").distinct()
    lengths = distinct.agg(F.collect_set(F.length("pattern")).alias("lengths"))  # one row
    each = names.crossJoin(F.broadcast(lengths)).select("cell_id", "name", F.explode("lengths").alias("l")).filter(F.length("name") >= F.col("l"))
    places = F.array(F.lit(1)) if at_start else F.sequence(F.lit(1), F.length("name") - F.col("l") + 1)
    pieces = each.withColumn("at", F.explode(places)).select("cell_id", F.substring("name", F.col("at"), F.col("l")).alias("pattern")).distinct()
    return pieces.join(distinct, "pattern")


def cell_feature_means(long: DataFrame) -> DataFrame:
    """cell_id, feature, m: per-cell means; a feature without values in a cell has none."""
    return long.groupBy("cell_id", "feature").agg(F.avg("value").alias("m")).filter("m is not null")


def _means_of_others(means: DataFrame, own: DataFrame, members: DataFrame) -> DataFrame:
    """cell_id, feature, mean over the cells (cell_id, pattern of ``members``) of the pattern that the cell has in ``own``, without the cell itself."""
    sums = members.join(means, "cell_id").groupBy("pattern", "feature").agg(F.sum("m").alias("s"), F.count("*").alias("n"))
    mine = own.join(members, ["cell_id", "pattern"], "left_semi").join(means, "cell_id").select("cell_id", "feature", "m")
    joined = own.join(sums, "pattern").join(mine, ["cell_id", "feature"], "left")
    n = F.col("n") - F.col("m").isNotNull().cast("int")
    return joined.filter(n > 0).select("cell_id", "feature", ((F.col("s") - F.coalesce("m", F.lit(0.0))) / n).alias("mean"))


def named_sibling_means(long: DataFrame, names: DataFrame) -> DataFrame:
    """cell_id, feature, mean of the per-cell means of the cells with like names (``names``: cell_id, name).

    Features of temperature: other cells whose names begin with the cell's own up to its last '_'.  DVP features of cells named NCA, 25C and 20-80: cells whose names contain the
    cell's own up to its last '_' with 0-100 for 20-80.  Cells without siblings have no row.
    """
    means = cell_feature_means(long)
    lower = F.lower("feature")
    warm = F.greatest(*(F.contains(lower, F.lit(t)) for t in TEMPERATURE))
    prefix = lambda name: F.regexp_extract(name, r"^(.+)_[a-zA-Z0-9]+$", 1)
    own = names.select("cell_id", prefix(F.col("name")).alias("pattern")).filter("pattern <> ''")
    temperature = _means_of_others(means.filter(warm), own, containing(names, own, at_start=True))
    special = names.filter(F.contains("name", F.lit("NCA")) & F.contains("name", F.lit("25C")) & F.contains("name", F.lit("20-80")))
    wide = special.select("cell_id", prefix(F.replace("name", F.lit("20-80"), F.lit("0-100"))).alias("pattern")).filter("pattern <> ''")
    peaks = _means_of_others(means.filter(F.contains(lower, F.lit("dvp")) & ~warm), wide, containing(names, wide))
    return temperature.unionByName(peaks)


def numbered_group_means(long: DataFrame, names: DataFrame, reach: int = 5) -> DataFrame:
    """cell_id, feature, mean of the per-cell means of other cells whose names contain the cell's 'G' and number (G5 is in G57 too).

    Where no such cell has the feature, of the cells of other numbers within ``reach``: an equi join on the numbers near each cell's.
    """
    means = cell_feature_means(long)
    numbered = names.withColumn("number", F.regexp_extract("name", r"G(\d+)", 1)).filter("number <> ''").withColumn("number", F.col("number").cast("int"))
    own = numbered.select("cell_id", F.concat(F.lit("G"), F.col("number").cast("string")).alias("pattern"))
    same = _means_of_others(means, own, containing(names, own))
    per = means.join(numbered, "cell_id").groupBy("number", "feature").agg(F.sum("m").alias("s"), F.count("*").alias("n"))
    near = per.withColumn("near", F.explode(F.sequence(F.col("number") - reach, F.col("number") + reach))).filter("near <> number")
    mean = near.groupBy(F.col("near").alias("number"), "feature").agg((F.sum("s") / F.sum("n")).alias("mean"))
    fallback = numbered.join(mean, "number").select("cell_id", "feature", "mean").join(same, ["cell_id", "feature"], "left_anti")
    return same.unionByName(fallback)


def forward_fill(long: DataFrame) -> DataFrame:
    """The last value before, else 0."""
    w = ordered(SERIES, "cycle").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("value", F.coalesce(F.last("value", True).over(w), F.lit(0.0)))


def null_report(long: DataFrame) -> DataFrame:
    """cell_id, rows, features, nulls and the cycles of the first five NULLs."""
    counts = long.groupBy("cell_id").agg(F.countDistinct("cycle").alias("n_rows"), F.countDistinct("feature").alias("n_features"), F.count_if(F.col("value").isNull()).alias("n_nulls"))
    place = F.row_number().over(ordered(["cell_id"], "cycle", "feature"))
    five = long.filter("value is null").select("cell_id", "cycle", "feature", place.alias("k")).filter("k <= 5")
    named = five.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", F.col("cycle").cast("string"), "feature").alias("at")))).alias("at"))
    return counts.join(named, "cell_id", "left").select("cell_id", "n_rows", "n_features", "n_nulls", F.coalesce(F.array_join("at.at", ","), F.lit("")).alias("first_nulls"))


def cycle_count_report(cycles: DataFrame, groups: DataFrame) -> DataFrame:
    """By group: cells, least, most and mean cycles, the upper median, and cells of under 50, 50-99 and at least 100 cycles."""
    n = cycles.groupBy("cell_id").agg(F.count("*").alias("n")).join(groups, "cell_id")
    # a row for each number of cycles that a group's cells have, not for each cell
    sized = n.groupBy("grp", "n").agg(F.count("*").alias("c"))
    sums = sized.withColumn("upto", F.sum("c").over(ordered(["grp"], "n"))).withColumn("all", F.sum("c").over(Window.partitionBy("grp")))
    median = sums.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("grp").agg(F.min("n").alias("upper_median"))
    agg = n.groupBy("grp").agg(F.count("*").alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), *(F.count_if(c).alias(a) for a, c in (("under_50", F.col("n") < 50), ("under_100", F.col("n").between(50, 99)), ("from_100", F.col("n") >= 100))))
    return agg.join(median, "grp").select("grp", "cells", "least", "most", "mean", "upper_median", "under_50", "under_100", "from_100")


def fewest_cycles(cycles: DataFrame, n: int = 20) -> DataFrame:
    """cell_id, n_cycles of the cells with the fewest cycles, the lower id first on ties (a report of n rows)."""
    return cycles.groupBy("cell_id").agg(F.count("*").alias("n_cycles")).orderBy("n_cycles", "cell_id").limit(n)


def alias_labels(cells: DataFrame, labels: DataFrame, alias: Column) -> DataFrame:
    """Life by the aliased name first, else by the name with '--' as '-#'."""
    first = labels.select(F.col("name").alias("__n1"), F.col("life").alias("__l1"))
    second = labels.select(F.col("name").alias("__n2"), F.col("life").alias("__l2"))
    joined = cells.join(first, alias == F.col("__n1"), "left").join(second, F.replace("name", F.lit("--"), F.lit("-#")) == F.col("__n2"), "left")
    return joined.withColumn("life", F.coalesce("__l1", "__l2")).drop("__n1", "__l1", "__n2", "__l2")
