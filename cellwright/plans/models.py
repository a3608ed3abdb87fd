"""Queries for model-based selection, baselines, and domains (rows only: models are beyond SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import models as m
from cellwright.operators import samples as sm
from cellwright.plans.cycles import rounded
from cellwright.plans.learning import wide
from cellwright.sources import fixtures as fx

Q: dict = {}
S: dict = {}
NAMES = ["quantity", "discount", "tax", "twice"]


def query(name: str):
    def add(f):
        Q[name] = f
        return f

    return add


@query("fs10_tree_importance")
def fs10(spark, d):
    return rounded(m.tree_importance(wide(spark, d), NAMES, "price", rounds=5))


@query("fs11_recursive_elimination")
def fs11(spark, d):
    left = m.recursive_elimination(wide(spark, d), NAMES, "price", keep=2)
    return spark.createDataFrame([(f, k) for k, f in enumerate(left)], "feature string, position int")


@query("fs11_elimination_importance")
def fs11_importance(spark, d):
    return rounded(m.elimination_importance(wide(spark, d), NAMES, "price", "id", keep=2, repeats=2))


@query("fs19_lasso_selection")
def fs19(spark, d):
    return rounded(m.lasso_selection(wide(spark, d), NAMES, "price", strength=100.0))


@query("sm14_life_baseline")
def sm14(spark, d):
    rows = fx.cycle_features(spark, d).groupBy("cell_id").agg(*(F.avg(c).alias(c) for c in ("temp_mean", "chg_v", "dvp"))).join(fx.life_labels(spark, d).withColumn("life", F.col("life").cast("double")), "cell_id").join(fx.splits(spark, d), "cell_id")
    scored = m.life_baseline(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), ["temp_mean", "chg_v", "dvp"], "life")
    return rounded(scored.groupBy("split").agg(*sm.errors("life", "pred")))


@query("sm14_tuned_baseline")
def sm14_tuned(spark, d):
    """Cross-validated errors of all settings on the training cells."""
    rows = fx.cycle_features(spark, d).groupBy("cell_id").agg(*(F.avg(c).alias(c) for c in ("temp_mean", "chg_v", "dvp"))).join(fx.life_labels(spark, d), "cell_id").join(fx.splits(spark, d), "cell_id").filter("split = 'train'")
    return rounded(m.tuned_baseline(rows, ["temp_mean", "chg_v", "dvp"], "life", "cell_id", folds=3, strengths=(0.0, 10.0), depths=(2,), rounds=(5, 10))[0])


@query("sm9_resampled_domain")
def sm9(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", "label")
    return m.resampled_domain(rows.filter("label < 3"), rows.filter("label >= 3"), "vec_id")


@query("sm10_cutout_jitter")
def sm10(spark, d):
    return rounded(m.jittered(fx.telemetry(spark, d).select("cell_id", "cycle", "seq", "voltage_v"), ["cell_id", "cycle"], "seq", "voltage_v", 30, holes=3))


@query("sm11_frequency_mask")
def sm11(spark, d):
    return rounded(m.low_rank_spectrum(fx.telemetry(spark, d).select("cell_id", "cycle", "seq", "voltage_v"), ["cell_id", "cycle"], "seq", "voltage_v", 30))


@query("ev13_domain_distance")
def ev13(spark, d):
    rows = fx.table(spark, d, "embeddings").select((F.col("label") < 5).cast("int").alias("domain"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(m.mmd(rows, features=16))


@query("sm11_frequency_mix")
def sm11_mix(spark, d):
    return rounded(m.mixed_spectrum(fx.telemetry(spark, d).select("cell_id", "cycle", "seq", "voltage_v"), ["cell_id", "cycle"], "seq", "voltage_v", 0.5))


@query("ev13_exact_distance")
def ev13_exact(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("domain"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(m.mmd_exact(rows, "vec_id"))
