"""Feature selection: statistics over the columns of a wide table, priorities, and drops."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.columns import no_nan, ordered, ratio
from cellwright.operators.ranks import quantiles
from cellwright.sources.files import written_once

#: Families of features (fixed values): exact names first, in this order.
EXACT = {
    "Energy": "discharge_capacity charge_capacity discharge_energy charge_energy coulombic_efficiency energy_efficiency",
    "Kinetics": "internal_resistance cv_current_tau tccc tcvc rcv charge_c_rate discharge_c_rate rest_time total_discharge_time"
    " uvp_time lvp_time v_rest_end charge_time_ratio_1_2 charge_time_1 charge_time_2 charge_time_3"
    " discharge_time_1 discharge_time_2 discharge_time_3 discharge_time_4",
    "Thermodynamics": "dtp dtpl_v mat_charge mat_discharge met_charge met_discharge mint_charge mint_discharge"
    " t_rise_charge t_rise_discharge thermal_load_charge thermal_load_discharge skew_t_discharge temperature heatrate ambient_temperature",
    "Curve": "icp icpl_v icp_area icp_fwhm icv icvl_v dvp dvpl_v dvp_q dvv dvvl_v dvv_q dvp_fwhm dvp_area centroid_voltage"
    " ratio_peak1_peak3 v_diff_peak3_peak1",
    "Geometric": "skew_v_discharge var_i_charge max_i_charge var_i_discharge var_v_discharge median_v_discharge"
    " charge_slope_1 charge_slope_2 charge_slope_3 discharge_slope_1 discharge_slope_2 discharge_slope_3"
    " tevi_1 tevi_2 tevi_3 tevd_1 tevd_2 tevd_3 charge_current_1 charge_current_2 charge_current_3"
    " discharge_current_1 discharge_current_2 discharge_current_3 discharge_current_4",
    "Metadata": "workload_type icp_is_missing dvp_type peak_mode ichv idv uvp lvp soc",
}
#: Families by parts of normalized names, for all other features, in this order (fixed values); without a match: Geometric.
PARTS = [
    ("Thermodynamics", "temperature heat t_rise temp"),
    ("Energy", "capacity energy"),
    ("Kinetics", "resistance tau time rate current_tau"),
    ("Curve", "ic dv peak area"),
    ("Geometric", "slope skewness kurtosis var_ mean_ median_"),
]
#: Physical priorities by parts of lower-case names, in this order (fixed values); without a match: 5.
PRIORITIES = [
    (2, "icp_area dvp_area icp_fwhm centroid_voltage t_rise_discharge dtp heatrate ichv idv v_rest_end uvp_time lvp_time charge_slope_ discharge_slope_ tevi_ tevd_"),
    (1, "icpl_v dvpl_v icvl_v dvvl_v icp dvp icv dvv internal_resistance cv_current_tau rcv coulombic_efficiency ambient_temperature"),
    (3, "skew_ kurtosis_ var_ median_"),
    (4, "discharge_capacity charge_capacity discharge_energy charge_energy"),
]


def normal_name(name: Column) -> Column:
    """Lower case, without parentheses; blanks, '-' and '/' as one '_', none at the ends."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"\([^)]*\)", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"[\s\-/]+", "_"), "_+", "_"), F.lit("_"))


def _first_rule(name: Column, rules: list[tuple], default) -> Column:
    out = F.lit(default)
    for value, parts in reversed(rules):
        out = F.when(F.greatest(F.lit(False), *(F.contains(name, F.lit(p)) for p in parts.split())), F.lit(value)).otherwise(out)
    return out


def families(features: DataFrame) -> DataFrame:
    """``features`` with family, without the cycle number: by exact name, else by parts of the name."""
    name = normal_name(F.col("feature"))
    family = _first_rule(name, PARTS, "Geometric")
    for value, names in reversed(EXACT.items()):
        family = F.when(name.isin(*names.split()), F.lit(value)).otherwise(family)
    return features.filter(name != "cycle_number").withColumn("family", family)


def priorities(features: DataFrame, rules: list[tuple] = PRIORITIES) -> DataFrame:
    """``features`` with level: 1 (core mechanism) to 5; other tables of levels may be given."""
    return features.withColumn("level", _first_rule(F.lower("feature"), rules, 5))


def target_relevance(relevance: DataFrame, threshold: float) -> DataFrame:
    """feature, r: of correlations (a, b, r) with a target the features with |r| of the threshold or more; a constant one has none."""
    return relevance.filter(F.abs("r") >= threshold).select(F.col("a").alias("feature"), "r")


def target_decides(wide: DataFrame, target: str, least: int = 5) -> DataFrame:
    """n_targets, keep_all: with fewer distinct targets than ``least`` a selection by relevance keeps all features."""
    return wide.agg(F.countDistinct(target).alias("n_targets")).withColumn("keep_all", F.col("n_targets") < least)


def selection_shortcut(wide: DataFrame, features: list[str], target: str, k: int, least: int = 5, skip_small: bool = True) -> DataFrame | None:
    """feature, importance of all features where no wrapper need run, else None: 0 with fewer distinct targets than ``least`` (with ``skip_small``), 1 with at most k features."""
    if skip_small and target_decides(wide, target, least).first()["keep_all"]:
        value = 0.0
    elif len(features) <= k:
        value = 1.0
    else:
        return None
    return wide.sparkSession.createDataFrame([(f, value) for f in features], "feature string, importance double")


def varying_columns(means: DataFrame, columns: list[str]) -> list[str]:
    """The columns that differ between rows: those with two values, or with one and some NULLs."""
    row = means.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns), F.count("*").alias("n")).first()
    return [c for c in columns if row[f"lo_{c}"] != row[f"hi_{c}"] or row[f"n_{c}"] < row["n"]]


def _moments(pairs: list[tuple[int, int]], shifts: list[float]):
    """A partition's sums of every pair over the rows where both are there: products of whole columns with each other and with what is there."""
    first, second = (np.array([p[k] for p in pairs], int) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(shifts)
        n, s, q, c = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(p)], 1).astype(float) - shifts
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            n += there.T @ there
            s += x.T @ there
            q += (x * x).T @ there
            c += x.T @ x
        at = pa.array(np.arange(len(pairs)))
        sums = (n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], c[first, second])
        yield pa.RecordBatch.from_arrays([at, *(pa.array(v) for v in sums)], names=["pair", *SUMS])

    return run


SUMS = ["n", "sa", "sb", "qa", "qb", "ab"]


def pearson_pairs(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, r over the rows where both are there; NULL if one of them is constant there.

    One scan for all pairs: tasks send six sums a pair.  Columns are shifted by their least values, so that a constant one has a deviation of exactly 0.
    """
    columns = sorted({c for p in pairs for c in p})
    place = {c: k for k, c in enumerate(columns)}
    # NaN is missing, as NULL is
    own = wide.select(*(no_nan(F.col(c).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)))
    least = own.agg(*(F.min(c).alias(c) for c in own.columns)).first()
    shifts = [v or 0.0 for v in least]
    sums = own.mapInArrow(_moments([(place[a], place[b]) for a, b in pairs], shifts), "pair bigint, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("pair").agg(*(F.sum(c).alias(c) for c in SUMS))

    def spread(s: str, q: str) -> Column:
        """Sum of squared differences from the mean, 0 where it is but the error of sums."""
        v = F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
        return F.when(v > 1e-12 * F.col(q), v).otherwise(0.0)

    both = F.col("ab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    r = ratio(both, F.sqrt(spread("sa", "qa")) * F.sqrt(spread("sb", "qb")))
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    return sums.withColumn("p", F.get(names, F.col("pair").cast("int"))).select("p.a", "p.b", r.alias("r"))


#: Ranks of so many distinct values, 16 bytes each, are small enough for every task.
FEW_VALUES = 100_000


def average_ranks(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as average ranks, for Spearman: ranks of the distinct values from counts, joined back, so that no column is sorted in one task.

    The rows are written once for all counts; ranks of a column with about ``FEW_VALUES`` distinct values at most are broadcast.
    """
    wide = out = written_once(wide, "columns")
    sizes = wide.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    for c in sorted(columns, key=lambda c: sizes[c]):
        counts = wide.groupBy(c).agg(F.count("*").alias("n"))
        dealt = counts.filter(F.col(c).isNotNull()).repartitionByRange(c).withColumn("p", F.spark_partition_id())
        own = dealt.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy(c)))
        totals = own.groupBy("p").agg(F.max("upto").alias("t"))  # a row for each partition
        before = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
        ranks = own.join(F.broadcast(before), "p").select(F.col(c).alias("__v"), (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("__r"))
        ranks = F.broadcast(ranks) if sizes[c] <= FEW_VALUES else ranks
        out = out.join(ranks, out[c].eqNullSafe(F.col("__v")), "left").drop(c, "__v").withColumnRenamed("__r", c)
    return out


def spearman_pairs(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    columns = sorted({c for p in pairs for c in p})
    return pearson_pairs(average_ranks(wide.select(*columns), columns), pairs)


def collinear_losers(correlations: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """dropped, kept, r: for every pair (a before b) over the threshold one loses: the higher level, else the lower |r| with the target, else b.

    Dropped features knock out others all the same, so the order doesn't matter; each loser's first pair is reported.
    ``ranked``: feature, position, level, target_r.
    """
    info = lambda s: ranked.select(F.col("feature").alias(s), F.col("position").alias(f"p{s}"), F.col("level").alias(f"l{s}"), F.abs(F.coalesce("target_r", F.lit(0.0))).alias(f"t{s}"))
    over = correlations.filter(F.abs("r") > threshold).join(info("a"), "a").join(info("b"), "b")
    a_loses = F.when(F.col("la") != F.col("lb"), F.col("la") > F.col("lb")).otherwise(F.col("tb") > F.col("ta"))
    judged = over.select(F.when(a_loses, F.col("a")).otherwise(F.col("b")).alias("dropped"), F.when(a_loses, F.col("b")).otherwise(F.col("a")).alias("kept"), "r", "pa", "pb")
    return judged.withColumn("k", F.row_number().over(ordered(["dropped"], "pa", "pb"))).filter("k = 1").select("dropped", "kept", "r")


def two_stage_losers(correlations: DataFrame, ranked: DataFrame, inside: float, across: float) -> DataFrame:
    """stage, dropped, kept, r: first the pairs within a family (``ranked`` has family) over ``inside``, then all pairs of the survivors over ``across``."""
    family = ranked.select("feature", "family")
    same = correlations.join(family.select(F.col("feature").alias("a"), F.col("family").alias("fa")), "a").join(family.select(F.col("feature").alias("b"), F.col("family").alias("fb")), "b").filter("fa = fb")
    first = collinear_losers(same.select("a", "b", "r"), ranked, inside)
    gone = first.select("dropped")
    left = correlations.join(gone.withColumnRenamed("dropped", "a"), "a", "left_anti").join(gone.withColumnRenamed("dropped", "b"), "b", "left_anti")
    second = collinear_losers(left.select("a", "b", "r"), ranked, across)
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))


def all_pairs(features: list[str]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))


def binned_information(wide: DataFrame, features: str | list[str], target: str, bins: int = 10) -> DataFrame:
    """feature, mi: mutual information of equal-frequency bins; deterministic, in place of a nearest-neighbour estimate.

    The edges of all features are exact quantiles of the rows where feature and target are there, counted digit by digit (``ranks.quantiles``); one more scan
    counts the bins of all features, and bins * bins rows a feature are left.  The columns are written once, as what makes them (a join, say) would run again in each scan.
    """
    features = [features] if isinstance(features, str) else features
    wide = written_once(wide.select(*dict.fromkeys([*features, target])), "columns")
    both = {f: F.col(f).isNotNull() & F.col(target).isNotNull() for f in features}
    masked = wide.select(*(F.when(both[f], F.col(c)).alias(f"{kind}{k}") for k, f in enumerate(features) for kind, c in (("x", f), ("y", target))))
    edges = quantiles(masked, masked.columns, [k / bins for k in range(1, bins)])
    bin_of = lambda c: F.size(F.filter(F.array(*(F.lit(v) for v in edges[c])).cast("array<double>"), lambda v: v < F.col(c)))
    cells = F.array(*(F.when(F.col(f"x{k}").isNotNull(), F.struct(F.lit(f).alias("feature"), bin_of(f"x{k}").alias("x"), bin_of(f"y{k}").alias("y"))) for k, f in enumerate(features)))
    joint = masked.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).groupBy("c.feature", "c.x", "c.y").count()
    total = lambda *keys: F.sum("count").over(Window.partitionBy("feature", *keys))
    p = joint.withColumn("px", total("x")).withColumn("py", total("y")).withColumn("n", total())
    return p.groupBy("feature").agg(F.sum(F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("px") * F.col("py")))).alias("mi"))


def robustness(importance: DataFrame, top: int | None = None) -> DataFrame:
    """Per feature over seeds: how often selected, its mean rank, mean and sample deviation of importance; most selected and best ranked first."""
    ranks = importance.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("importance"), "feature")))
    n = ranks.agg(F.countDistinct("seed").alias("n"))
    agg = ranks.groupBy("feature").agg(F.count("*").alias("selection_count"), F.avg("rank").alias("avg_rank"), F.avg("importance").alias("avg_importance"), F.stddev_samp("importance").alias("std_importance"))
    out = agg.crossJoin(F.broadcast(n)).withColumn("selection_rate", F.col("selection_count") / F.col("n")).drop("n")
    return out.orderBy(F.desc("selection_rate"), "avg_rank", "feature").limit(top) if top else out


def importance_knee(importance: DataFrame, share: float) -> DataFrame:
    """k: the fewest features that hold the share of all importance."""
    w = Window.orderBy(F.desc("importance"), "feature")  # a row for each feature
    run = importance.withColumn("k", F.row_number().over(w)).withColumn("c", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = importance.agg(F.sum("importance").alias("t"))
    return run.crossJoin(F.broadcast(total)).filter(F.col("c") >= share * F.col("t") - 1e-12).agg(F.min("k").alias("k"))


def agreement(sets: DataFrame) -> DataFrame:
    """method, other, common, jaccard, overlap of methods' feature sets (method, features)."""
    a, b = sets.select(F.col("method"), F.col("features").alias("fa")), sets.select(F.col("method").alias("other"), F.col("features").alias("fb"))
    common = F.size(F.array_intersect("fa", "fb"))
    pairs = a.join(b, F.col("method") < F.col("other"))
    return pairs.select("method", "other", common.alias("common"), ratio(common, F.size(F.array_union("fa", "fb"))).alias("jaccard"), ratio(common, F.least(F.size("fa"), F.size("fb"))).alias("overlap"))


def feature_matrix(selected: DataFrame, datasets: list[str]) -> DataFrame:
    """feature, a 0/1 column for each dataset, and their sum."""
    counts = selected.groupBy("feature").pivot("dataset", datasets).agg(F.lit(1))
    flags = [F.coalesce(F.col(f"`{d}`"), F.lit(0)) for d in datasets]
    return counts.select("feature", *(f.alias(d) for f, d in zip(flags, datasets, strict=True)), sum(flags[1:], flags[0]).alias("n_datasets"))


def cell_means(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.groupBy("cell_id").agg(*(F.avg(c).alias(c) for c in columns))


def permutation_importance(scored: DataFrame, features: list[str], predict: Column, target: str, key: str, repeats: int = 5, seed: int = 0, shard_rows: int = 200_000) -> DataFrame:
    """feature, importance: rise of the mean absolute error when the feature's values are dealt out anew, over repeats.

    In every repeat a row takes the values of the row after it in a hashed order, in shards of about ``shard_rows`` rows (the last one those of the first): one window over
    the rows of all repeats.  Each (repeat, feature) copy then has that feature replaced, and ``predict``, a Column of the features, is evaluated on all copies in one pass.
    """
    shards = max(1, scored.count() // shard_rows)
    own = scored.select(key, target, *features).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.xxhash64(F.lit(seed), "__r", key)
    w = Window.partitionBy("__r", F.pmod(F.xxhash64("__r", key), F.lit(shards))).orderBy(order, key)
    values = F.struct(*(F.col(f) for f in features))
    dealt = own.withColumn("__x", F.coalesce(F.lead(values).over(w), F.first(values).over(w)))
    copies = dealt.withColumn("__f", F.explode(F.array(*(F.lit(f) for f in features))))
    moved = copies.select("__f", target, *(F.when(F.col("__f") == f, F.col(f"__x.{f}")).otherwise(F.col(f)).alias(f) for f in features))
    changed = moved.groupBy(F.col("__f").alias("feature")).agg(F.avg(F.abs(predict - F.col(target))).alias("e"))
    base = scored.agg(F.avg(F.abs(predict - F.col(target))).alias("e0"))
    return changed.crossJoin(F.broadcast(base)).select("feature", (F.col("e") - F.col("e0")).alias("importance"))
